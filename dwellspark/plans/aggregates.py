"""Registered queries: aggregations, rankings, price index, streets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dwellspark.fixtures import (API_USAGE_SQL, CANDIDATES_CTE, SOURCES_CTE, api_usage,
                                 coordinate_sources, dwelling_sales, geocode_candidates, sales)
from dwellspark.lineage import cut_lineage, shared_folder
from dwellspark.operators import stats
from dwellspark.plans import sqltext as q
from dwellspark.plans.registry import ORACLES, over_sales, query
from dwellspark.sources import sinks

RK = q.routing_key("eircode")
NORM = q.norm_address("address")


@query("market_sales", over_sales(f"SELECT county, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM dwelling WHERE {q.MARKET} GROUP BY county"))
def _(spark, d):
    return (stats.market_sales(dwelling_sales(spark, d)).groupBy("county")
            .agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total")))


@query("price_summary", over_sales(
    f"SELECT county, {q.PRICE_SUMMARY}, min(sale_date) AS first_sale, max(sale_date) AS last_sale FROM dwelling WHERE {q.MARKET} GROUP BY county"))
def _(spark, d):
    return stats.price_summary(stats.market_sales(dwelling_sales(spark, d)), ["county"])


@query("price_summary_all", over_sales(
    f"SELECT {q.PRICE_SUMMARY}, min(sale_date) AS first_sale, max(sale_date) AS last_sale FROM dwelling"))
def _(spark, d):
    return stats.price_summary(dwelling_sales(spark, d), [])


_TREND = ("count(*) AS n, round(quantile_cont(CAST(price AS DOUBLE), 0.5)) AS median_price, "
          "round(CAST(sum(price) AS DOUBLE) / count(*)) AS mean_price, "
          "CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price")


@query("price_trends", over_sales(
    f"SELECT county, CAST(year(sale_date) AS INT) AS year, {_TREND} FROM dwelling WHERE {q.MARKET} GROUP BY ALL"))
def _(spark, d):
    return stats.price_trends(dwelling_sales(spark, d), ["county"])


@query("price_trends_by_postcode", over_sales(
    f"SELECT {RK} AS routing_key, CAST(year(sale_date) AS INT) AS year, {_TREND} FROM dwelling WHERE {q.MARKET} GROUP BY ALL"))
def _(spark, d):
    return stats.price_trends(sales(spark, d), ["routing_key"])


@query("county_counts", over_sales("SELECT county, count(*) AS n FROM dwelling GROUP BY county"))
def _(spark, d):
    return dwelling_sales(spark, d).groupBy("county").agg(F.count("*").alias("n"))


@query("county_summary", over_sales(
    f"""SELECT county, count(*) AS all_sales, count(*) FILTER ({q.MARKET}) AS market_sales,
        quantile_cont(CAST(price AS DOUBLE), 0.5) FILTER ({q.MARKET}) AS median_price,
        CAST(sum(price) FILTER ({q.MARKET}) AS DOUBLE) / count(*) FILTER ({q.MARKET}) AS mean_price FROM dwelling GROUP BY county"""))
def _(spark, d):
    return stats.county_summary(dwelling_sales(spark, d))


RK_STATS_SQL = f"""SELECT routing_key, (SELECT county FROM dwelling x WHERE {q.routing_key('x.eircode')} = s.routing_key GROUP BY county ORDER BY count(*) DESC, county LIMIT 1) AS primary_county,
        count(*) AS property_count, string_agg(DISTINCT county, '|' ORDER BY county) AS counties, min(sale_date) AS earliest_sale, max(sale_date) AS latest_sale,
        count(latitude) AS geocoded_count, count(latitude) / count(*) AS geocoded_pct,
        quantile_cont(CAST(price AS DOUBLE), 0.5) FILTER (NOT not_full_market_price) AS median_price,
        quantile_cont(latitude, 0.5) AS centroid_lat, quantile_cont(longitude, 0.5) AS centroid_lon
        FROM (SELECT *, {RK} AS routing_key FROM dwelling) s WHERE regexp_matches(routing_key, '^[A-Z][0-9][0-9W]$') GROUP BY routing_key"""


@query("routing_key_stats", over_sales(RK_STATS_SQL))
def _(spark, d):
    return stats.routing_key_stats(sales(spark, d)).withColumn("counties", F.array_join("counties", "|"))


POSTCODE_REF_CTE = f"""postcode_reference AS (SELECT {q.compact_postcode('eircode')} AS postcode, {q.mean('latitude')} AS latitude, {q.mean('longitude')} AS longitude,
        count(*) AS property_count, min(county) AS county, stddev_samp(latitude) AS lat_stddev, stddev_samp(longitude) AS lon_stddev
        FROM dwelling WHERE latitude BETWEEN 51.4 AND 55.5 AND longitude BETWEEN -10.7 AND -5.4 AND length({q.compact_postcode('eircode')}) = 7 GROUP BY 1)"""


@query("postcode_reference", over_sales(
    "SELECT postcode, round(latitude, 8) AS latitude, round(longitude, 8) AS longitude, property_count, county, round(lat_stddev, 6) + 0 AS lat_stddev, round(lon_stddev, 6) + 0 AS lon_stddev FROM postcode_reference",
    POSTCODE_REF_CTE))
def _(spark, d):
    from dwellspark.functions.geo import round_to
    r = stats.postcode_reference(sales(spark, d))
    return r.select("postcode", "property_count", "county",
                    round_to("latitude", 8).alias("latitude"), round_to("longitude", 8).alias("longitude"),
                    round_to("lat_stddev", 6).alias("lat_stddev"), round_to("lon_stddev", 6).alias("lon_stddev"))


@query("postcode_prefix_summary", over_sales(
    "SELECT postcode[1:3] AS routing_key, count(*) AS postcodes, CAST(sum(property_count) AS BIGINT) AS properties, round(avg(latitude), 10) AS latitude, round(avg(longitude), 10) AS longitude, avg(property_count) AS mean_per_postcode FROM postcode_reference GROUP BY 1",
    POSTCODE_REF_CTE))
def _(spark, d):
    from dwellspark.functions.geo import round_to
    return (stats.postcode_prefix_summary(stats.postcode_reference(sales(spark, d)))
            .withColumn("latitude", round_to("latitude", 10)).withColumn("longitude", round_to("longitude", 10)))


_SHARED = """shared AS (SELECT latitude, longitude, count(DISTINCT address) AS distinct_addresses, count(*) AS total_sales, count(DISTINCT county) AS counties,
    string_agg(DISTINCT county, '|' ORDER BY county) AS county_list, min(sale_date) AS earliest_sale, max(sale_date) AS latest_sale
    FROM dwelling WHERE latitude IS NOT NULL GROUP BY latitude, longitude)"""


@query("shared_coordinates", over_sales(
    "SELECT *, CASE WHEN distinct_addresses >= 100 THEN 'high' ELSE 'medium' END AS severity FROM shared WHERE distinct_addresses >= 2", _SHARED))
def _(spark, d):
    return (stats.shared_coordinates(dwelling_sales(spark, d), 2)
            .withColumn("county_list", F.array_join("county_list", "|"))
            .withColumn("counties", F.col("counties").cast("long")))


@query("shared_coordinate_impact", over_sales(
    """SELECT county, count(*) AS affected, count(eircode) FILTER (eircode <> '') AS high_priority, count(*) - count(eircode) FILTER (eircode <> '') AS medium_priority,
       count(*) * 100.0::DOUBLE / (SELECT count(*) FROM dwelling) AS pct_of_all FROM dwelling p JOIN (SELECT latitude AS a, longitude AS b FROM shared WHERE distinct_addresses >= 50) c
       ON abs(p.latitude - a) < 0.000001 AND abs(p.longitude - b) < 0.000001 GROUP BY county""", _SHARED))
def _(spark, d):
    return stats.shared_coordinate_impact(dwelling_sales(spark, d), 50)


@query("place_scatter", over_sales(
    f"""SELECT place, n, round(mean_lat, 8) AS mean_lat, round(mean_lon, 8) AS mean_lon, round(std_lat, 8) AS std_lat, round(std_lon, 8) AS std_lon FROM (
        SELECT trim(split_part(address, ',', -1)) AS place, count(*) AS n, {q.mean('latitude')} AS mean_lat, {q.mean('longitude')} AS mean_lon,
        stddev_samp(latitude) AS std_lat, stddev_samp(longitude) AS std_lon FROM dwelling WHERE latitude IS NOT NULL GROUP BY 1)
        WHERE length(place) >= 4 AND n >= 10 AND (std_lat > 0.05 OR std_lon > 0.05) ORDER BY coalesce(std_lat,0)+coalesce(std_lon,0) DESC LIMIT 30"""))
def _(spark, d):
    from dwellspark.functions.geo import round_to
    r = stats.place_scatter(dwelling_sales(spark, d))
    return r.select("place", "n", *[round_to(c, 8).alias(c) for c in ("mean_lat", "mean_lon", "std_lat", "std_lon")])


@query("inconsistent_addresses", over_sales(
    """SELECT * FROM (SELECT address, count(DISTINCT latitude) > 1 OR count(DISTINCT longitude) > 1 AS coordinates_differ, count(DISTINCT bedrooms) > 1 AS bedrooms_differ,
        count(DISTINCT property_type) > 1 AS type_differs, count(*) AS n FROM dwelling GROUP BY address) WHERE coordinates_differ OR bedrooms_differ OR type_differs"""))
def _(spark, d):
    return stats.inconsistent_addresses(dwelling_sales(spark, d))


_AMBIG = "CASE WHEN k%13=0 THEN concat(CAST(k%9 AS VARCHAR), ' SHORE ROAD') ELSE address END"


@query("ambiguous_addresses", over_sales(
    f"""SELECT address, count(*) AS n, count(DISTINCT county) AS counties, string_agg(DISTINCT county, ', ' ORDER BY county) AS county_list
        FROM (SELECT {_AMBIG} AS address, county FROM dwelling) GROUP BY address HAVING count(DISTINCT county) > 1"""))
def _(spark, d):
    a = F.when(F.col("k") % 13 == 0, F.concat((F.col("k") % 9).cast("string"), F.lit(" SHORE ROAD"))).otherwise(F.col("address"))
    r = stats.ambiguous_addresses(dwelling_sales(spark, d).withColumn("address", a))
    return r.withColumn("counties", F.col("counties").cast("long"))


@query("repeat_sales", over_sales(
    "SELECT count(*) AS unique_properties, CAST(sum(c) AS BIGINT) AS total_records, max(c) AS max_sales FROM (SELECT count(*) AS c FROM dwelling GROUP BY address HAVING count(*) > 1)"))
def _(spark, d):
    return stats.repeat_sales(dwelling_sales(spark, d))


@query("duplicate_groups", over_sales(
    f"""SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS redundant_rows FROM (
        SELECT count(*) AS c FROM (SELECT {NORM} AS a, sale_date, price FROM dwelling UNION ALL SELECT {NORM}, sale_date, price FROM dwelling WHERE id%17=0) GROUP BY a, sale_date, price HAVING count(*) > 1)"""))
def _(spark, d):
    s = sales(spark, d)
    return stats.duplicate_groups(s.unionByName(s.where("id % 17 = 0")))


_COVERED = ["latitude", "eircode", "bedrooms", "property_type", "size_description", "ber_rating"]


@query("coverage", over_sales(" UNION ALL ".join(
    f"""SELECT county, CAST(year(sale_date) AS INT) AS year, count(*) AS total, '{c}' AS column_name, count({c}) AS present, count(*) - count({c}) AS missing,
        round(count({c}) * 100.0::DOUBLE / count(*), 1) AS pct FROM dwelling GROUP BY 1, 2""" for c in _COVERED)))
def _(spark, d):
    return stats.coverage(dwelling_sales(spark, d).withColumn("year", F.year("sale_date")), _COVERED, ["county", "year"])


_LEN = "CASE WHEN length(address) < 20 THEN 'Very short (<20 chars)' WHEN length(address) < 40 THEN 'Short (20-40 chars)' WHEN length(address) < 60 THEN 'Medium (40-60 chars)' ELSE 'Long (60+ chars)' END"
_TYP = "CASE WHEN lower(address) LIKE '%apartment%' OR lower(address) LIKE '%apt%' THEN 'Apartments' WHEN lower(address) LIKE '%unit%' THEN 'Units' WHEN lower(address) LIKE '%house%' THEN 'Houses' WHEN regexp_matches(address, '[0-9]+ [A-Z]') THEN 'Has number (likely house)' ELSE 'Other/Unknown' END"


@query("missing_breakdown", over_sales(" UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {expr} AS bucket, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM dwelling WHERE latitude IS NULL GROUP BY 2"
    for dim, expr in [("county", "county"), ("has_postcode", "CASE WHEN coalesce(eircode, '') <> '' THEN 'yes' ELSE 'no' END"),
                      ("year", "CAST(year(sale_date) AS VARCHAR)"), ("length", _LEN), ("type", _TYP)])))
def _(spark, d):
    return stats.missing_breakdown(dwelling_sales(spark, d))


@query("enrichment_progress", over_sales(
    """SELECT coalesce(strftime(sale_date, '%Y-%m'), 'all') AS month, count(*) AS total, count(*) FILTER (bedrooms IS NULL AND property_type IS NULL) AS none,
       count(*) FILTER (bedrooms IS NOT NULL AND property_type IS NOT NULL) AS "full", count(*) FILTER ((bedrooms IS NULL) <> (property_type IS NULL)) AS partial
       FROM dwelling WHERE year(sale_date) = 1998 GROUP BY ROLLUP (strftime(sale_date, '%Y-%m'))"""))
def _(spark, d):
    return stats.enrichment_progress(dwelling_sales(spark, d), 1998)


@query("provenance_counts", over_sales(
    "SELECT property_type_source, count(*) AS n FROM dwelling WHERE property_type IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return stats.provenance_counts(dwelling_sales(spark, d))


@query("api_usage_summary", f"""
WITH usage AS ({API_USAGE_SQL}), g AS (SELECT source, CAST(ts AS DATE) AS day, grouping(source, CAST(ts AS DATE)) AS level,
  CAST(coalesce(sum(request_count), 0) AS BIGINT) AS requests, CAST(coalesce(sum(success_count), 0) AS BIGINT) AS success, CAST(coalesce(sum(error_count), 0) AS BIGINT) AS errors
  FROM usage WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY GROUPING SETS ((), (source), (CAST(ts AS DATE))))
SELECT CASE WHEN level = 3 THEN 'total' WHEN level = 1 THEN 'source' ELSE 'day' END AS kind,
  CASE WHEN level = 3 THEN '' WHEN level = 1 THEN source ELSE CAST(day AS VARCHAR) END AS name, requests, success, errors,
  CASE WHEN level = 3 THEN 100000 - requests END AS remaining, CASE WHEN level = 3 THEN requests * 100.0::DOUBLE / 100000 END AS percent_used,
  CASE WHEN level = 3 THEN requests / 31 END AS daily_average,
  CASE WHEN level = 3 THEN CASE WHEN requests >= 100000 THEN 'stop' WHEN requests * 100.0 / 100000 >= 80 THEN 'warn' ELSE 'ok' END END AS state FROM g""")
def _(spark, d):
    return stats.api_usage_summary(api_usage(spark, d), "2024-01-05", as_of="2024-01-31")


@query("price_quantile_trim", over_sales(
    """SELECT id, CAST(price AS DOUBLE) AS price FROM dwelling WHERE CAST(price AS DOUBLE) BETWEEN (SELECT quantile_cont(CAST(price AS DOUBLE), 0.01) FROM dwelling)
       AND (SELECT quantile_cont(CAST(price AS DOUBLE), 0.99) FROM dwelling)"""))
def _(spark, d):
    return stats.trim_quantiles(dwelling_sales(spark, d)).select("id", F.col("price").cast("double").alias("price"))


@query("county_page", over_sales(
    f"""SELECT county, total_count, median_price, mean_price, min_year, max_year, recent_mean, recent_ids FROM
      (SELECT county, count(*) AS total_count FROM dwelling GROUP BY 1) JOIN
      (SELECT county, max_by(median_price, year) AS median_price, max_by(mean_price, year) AS mean_price, min(year) AS min_year, max(year) AS max_year FROM
         (SELECT county, CAST(year(sale_date) AS INT) AS year, {_TREND} FROM dwelling WHERE {q.MARKET} GROUP BY ALL) GROUP BY county) USING (county) JOIN
      (SELECT county, round(avg(CAST(price AS DOUBLE)), 4) AS recent_mean, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS recent_ids FROM
         (SELECT *, row_number() OVER (PARTITION BY county ORDER BY sale_date DESC, id) AS rn FROM dwelling) WHERE rn <= 10 GROUP BY county) USING (county)"""))
def _(spark, d):
    from dwellspark.functions.geo import round_to
    r = stats.county_page(dwelling_sales(spark, d))
    ids = F.array_join(F.transform("recent", lambda x: x["id"].cast("string")), ",")
    return r.withColumn("recent_ids", ids).withColumn("recent_mean", round_to("recent_mean", 4)).drop("recent")


@query("address_history", over_sales(
    """SELECT address, count(*) AS n, max(sale_date) AS latest_date, CAST(arg_max(price, (sale_date, id)) AS DOUBLE) AS latest_price, CAST(min(price) AS DOUBLE) AS min_price,
       CAST(max(price) AS DOUBLE) AS max_price, CAST(list_sort(list(price))[count(*)//2 + 1] AS DOUBLE) AS median_price FROM dwelling GROUP BY address"""))
def _(spark, d):
    return stats.address_history(dwelling_sales(spark, d))


@query("rating_distribution", over_sales(
    """SELECT county, property_type, ber_rating, n, n * 100.0::DOUBLE / sum(n) OVER w AS share, coalesce(sum(n) FILTER (ber_rating[1:1] <= 'B') OVER w, 0) * 100.0::DOUBLE / sum(n) OVER w AS share_ab,
       coalesce(sum(n) FILTER (ber_rating[1:1] >= 'D') OVER w, 0) * 100.0::DOUBLE / sum(n) OVER w AS share_dg
       FROM (SELECT county, property_type, ber_rating, count(*) AS n FROM dwelling WHERE ber_rating IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY county, property_type)"""))
def _(spark, d):
    return stats.rating_distribution(dwelling_sales(spark, d), ["county", "property_type"])


@query("rating_extremes", over_sales(
    """SELECT 'top' AS list, county, share_ab, CAST(row_number() OVER (ORDER BY share_ab DESC, county) AS INT) AS rank FROM s QUALIFY rank <= 10 UNION ALL
       SELECT 'bottom', county, share_ab, CAST(row_number() OVER (ORDER BY share_ab, county) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "s AS (SELECT county, count(*) FILTER (ber_rating[1:1] <= 'B') * 100.0::DOUBLE / count(*) AS share_ab FROM dwelling WHERE ber_rating IS NOT NULL GROUP BY county)"))
def _(spark, d):
    return stats.rating_extremes(dwelling_sales(spark, d), "county")


@query("postcode_league", over_sales(
    """SELECT routing_key, n, median_price, mean_price, (SELECT arg_max(routing_key, (median_price, routing_key)) FROM l) AS dearest, (SELECT arg_min(routing_key, (median_price, routing_key)) FROM l) AS cheapest,
       (SELECT arg_max(routing_key, (n, routing_key)) FROM l) AS most_active, (SELECT list_sort(list(median_price))[count(*)//2 + 1] FROM l) AS median_of_medians FROM l""",
    f"l AS (SELECT {RK} AS routing_key, {q.PRICE_SUMMARY} FROM dwelling WHERE {q.MARKET} GROUP BY 1 HAVING routing_key IS NOT NULL)"))
def _(spark, d):
    return stats.postcode_league(sales(spark, d), prefix="")


@query("geocoder_comparison", over_sales(
    f"""SELECT source, tried, found, found * 100.0::DOUBLE / tried AS success_pct, round(e, 2) AS mean_error_m, source = (SELECT source FROM g ORDER BY e, source LIMIT 1) AS best FROM g""",
    CANDIDATES_CTE,
    f"g AS (SELECT source, count(*) AS tried, count(cand_lat) AS found, avg({q.haversine('latitude', 'longitude', 'cand_lat', 'cand_lon')}) AS e FROM dwelling JOIN candidates USING (id) WHERE latitude IS NOT NULL GROUP BY source)"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return stats.geocoder_comparison(s.select("id", "latitude", "longitude"), geocode_candidates(s))


@query("source_quality_profile", over_sales(
    """SELECT *, CASE issues WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' WHEN 2 THEN 'fair' ELSE 'needs attention' END AS grade FROM (
      SELECT *, CAST(shared_high >= 50 AS INT) + CAST(shared_medium >= 200 AS INT) + CAST(out_of_bounds > 0 AS INT) + CAST(county_mismatch > total * 0.01 AS INT) AS issues FROM
      (SELECT source, count(*) AS total, count(*) FILTER (latitude IS NULL) AS missing, count(*) FILTER (NOT (latitude BETWEEN 51.4 AND 55.5 AND longitude BETWEEN -10.7 AND -5.4)) AS out_of_bounds,
        count(*) FILTER (NOT (latitude BETWEEN minlat AND maxlat AND longitude BETWEEN minlon AND maxlon)) AS county_mismatch FROM sources JOIN bounds USING (county) GROUP BY source)
      JOIN (SELECT source, count(*) FILTER (c >= 100) AS shared_high, count(*) FILTER (c BETWEEN 10 AND 99) AS shared_medium FROM
        (SELECT source, round(latitude, 6) AS a, round(longitude, 6) AS b, count(*) AS c FROM sources WHERE latitude IS NOT NULL GROUP BY ALL) GROUP BY source) USING (source))""", SOURCES_CTE))
def _(spark, d):
    return stats.source_quality_profile(coordinate_sources(dwelling_sales(spark, d)))


@query("precision_histogram", over_sales(
    r"""SELECT source, length(regexp_extract(CAST(latitude AS VARCHAR), '^-?\d+\.(\d+)$', 1)) AS lat_decimals,
        length(regexp_extract(CAST(longitude AS VARCHAR), '^-?\d+\.(\d+)$', 1)) AS lon_decimals, count(*) AS n FROM sources WHERE latitude IS NOT NULL GROUP BY ALL""", SOURCES_CTE))
def _(spark, d):
    return stats.precision_histogram(coordinate_sources(dwelling_sales(spark, d)))


# ------------------------------------------------------------ windows and rankings

INDEX_CTE = f"""monthly AS (SELECT county, CAST(date_trunc('month', sale_date) AS DATE) AS month, quantile_cont(CAST(price AS DOUBLE), 0.5) AS median_price, count(*) AS sale_count
    FROM dwelling WHERE NOT not_full_market_price AND price BETWEEN 50000 AND 5000000 AND sale_date >= DATE '1995-01-01' GROUP BY ALL HAVING count(*) >= 3),
    price_index AS (SELECT *, median_price / first_value(median_price) OVER (PARTITION BY county ORDER BY month) AS price_index FROM monthly)"""


@query("county_price_index", over_sales("SELECT * FROM price_index", INDEX_CTE))
def _(spark, d):
    return stats.county_price_index(dwelling_sales(spark, d), "1995-01-01", min_n=3)


@query("share_of_total", over_sales(
    "SELECT property_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM dwelling GROUP BY 1"))
def _(spark, d):
    counts = dwelling_sales(spark, d).groupBy("property_type").agg(F.count("*").alias("n"))
    return stats.share_of_total(counts)


@query("top_n_per_group", over_sales(
    """SELECT county, id, sale_date, CAST(row_number() OVER (PARTITION BY county ORDER BY sale_date DESC, id) AS INT) AS rank, count(*) OVER (PARTITION BY county) AS total
       FROM dwelling QUALIFY rank <= 50"""))
def _(spark, d):
    s = dwelling_sales(spark, d)
    newest = stats.top_n(s.select("county", "id", "sale_date"), ["county"], [F.col("sale_date").desc(), F.col("id")], 50)
    return newest.join(s.groupBy("county").agg(F.count("*").alias("total")), "county")


STREET_CTES = q.STREET_KEY_CTES + """,
street_stats AS (SELECT street, area, county_key, max(street_display) AS street_display, max(area_display) AS area_display, max(county) AS county, count(*) AS tx_count,
   quantile_cont(CAST(price AS DOUBLE), 0.5) AS median_price, CAST(sum(price) AS DOUBLE) / count(*) AS mean_price FROM street_rows WHERE NOT not_full_market_price AND price > 0
   GROUP BY street, area, county_key HAVING count(*) >= 3 AND NOT regexp_matches(max(street_display), '\\b(block|building|apartments?)\\b', 'i') AND count(*) FILTER (is_apartment) / count(*) < 0.5),
by_value AS (SELECT *, CAST(row_number() OVER (ORDER BY median_price DESC, street, area, county_key) AS INT) AS rank FROM street_stats WHERE tx_count >= 8 QUALIFY rank <= 30),
by_volume AS (SELECT *, CAST(row_number() OVER (ORDER BY tx_count DESC, street, area, county_key) AS INT) AS rank FROM street_stats ANTI JOIN by_value USING (street, area, county_key) QUALIFY rank <= 20),
ranking AS (SELECT *, 'value' AS rank_type FROM by_value UNION ALL SELECT *, 'volume' FROM by_volume)""".replace("\\\\", "\\")


def _ranking(spark, d):
    return stats.street_ranking(dwelling_sales(spark, d), address="address")


@query("street_ranking", over_sales("SELECT * FROM ranking", STREET_CTES))
def _(spark, d):
    return _ranking(spark, d)


_SLUG = lambda e: f"regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_REGISTRY = f"""registry AS (SELECT CASE WHEN count(*) OVER (PARTITION BY {_SLUG("street_display || ' ' || area_display")}) > 1 THEN {_SLUG("street_display || ' ' || area_display || ' ' || county")}
   ELSE {_SLUG("street_display || ' ' || area_display")} END AS slug, regexp_replace(street_display, '^the\\b', 'The') AS name, area_display AS area, county, {_SLUG('county')} AS county_slug, rank_type AS category, rank,
   concat_ws('|', street, area, county_key) AS normalized_key, CASE WHEN rank_type = 'value' THEN concat('Ranks among the dearest streets: half of its ', tx_count, ' sales went above €', format('{{:,}}', CAST(trunc(median_price) AS BIGINT)), '.')
   ELSE concat('Ranks among the busiest streets: ', tx_count, ' sales, half of them above €', format('{{:,}}', CAST(trunc(median_price) AS BIGINT)), '.') END AS description FROM ranking)"""


@query("street_slugs", over_sales(
    f"""SELECT street, area, county_key, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN l ELSE s END AS slug FROM (SELECT street, area, county_key,
        {_SLUG("max(street_display) || ' ' || max(area_display)")} AS s, {_SLUG("max(street_display) || ' ' || max(area_display) || ' ' || max(county)")} AS l FROM street_rows GROUP BY ALL)""", q.STREET_KEY_CTES))
def _(spark, d):
    streets = (stats.with_street_key(dwelling_sales(spark, d), "address").groupBy(*stats.STREET)
               .agg(F.max("street_display").alias("street_display"), F.max("area_display").alias("area_display"),
                    F.max("county").alias("county")))
    return stats.street_slugs(streets).select(*stats.STREET, "slug")


@query("street_registry", over_sales("SELECT * FROM registry", STREET_CTES, _REGISTRY))
def _(spark, d):
    return stats.street_registry(_ranking(spark, d))


@query("street_pages", over_sales(
    """SELECT slug, stats_row.n AS total_transactions, stats_row.median, stats_row.avg, first_year, last_year, trend_years, trend_medians, transactions, transaction_prices FROM (
      SELECT slug, {'n': count(*), 'median': CAST(round_even(quantile_cont(p, 0.5), 0) AS BIGINT), 'avg': CAST(round_even(CAST(sum(price) AS DOUBLE)/count(*), 0) AS BIGINT)} AS stats_row,
        CAST(min(year(sale_date)) AS INT) AS first_year, CAST(max(year(sale_date)) AS INT) AS last_year FROM r GROUP BY slug) JOIN
      (SELECT slug, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS trend_years, string_agg(CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY y) AS trend_medians FROM
        (SELECT slug, year(sale_date) AS y, quantile_cont(p, 0.5) AS m FROM r GROUP BY ALL) GROUP BY slug) USING (slug) JOIN
      (SELECT slug, count(*) AS transactions, CAST(sum(round_even(p, 0)) AS BIGINT) AS transaction_prices FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY sale_date DESC, id) AS rn FROM r) WHERE rn <= 50 GROUP BY slug) USING (slug)""",
    STREET_CTES, _REGISTRY,
    "r AS (SELECT s.*, slug, CAST(price AS DOUBLE) AS p FROM street_rows s JOIN registry g ON g.normalized_key = concat_ws('|', s.street, s.area, s.county_key) WHERE NOT not_full_market_price AND price > 0)"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    registry = cut_lineage(stats.street_registry(_ranking(spark, d)))
    pages = stats.street_pages(s, registry, address="address")
    years = lambda f: F.array_join(F.transform("trends", lambda t: t[f].cast("string")), ",")
    return pages.select(
        "slug", "total_transactions", "stats.median", "stats.avg", "stats.first_year", "stats.last_year",
        years("year").alias("trend_years"), years("median").alias("trend_medians"),
        F.size("transactions").cast("long").alias("transactions"),
        F.aggregate("transactions", F.lit(0).cast("long"), lambda a, t: a + t["price"]).alias("transaction_prices"))


def _season_sql(part: str) -> str:
    return over_sales(
        """SELECT part, month, years, round(s, 4) AS share_pct, round(r, 6) AS price_ratio FROM (
           SELECT part, month, count(*) AS years, avg(n * 100.0::DOUBLE / yn) AS s, avg(m / ym) AS r FROM
             (SELECT part, y, CAST(month(sale_date) AS INT) AS month, count(*) AS n, quantile_cont(p, 0.5) AS m FROM r GROUP BY ALL) JOIN
             (SELECT part, y, count(*) AS yn, quantile_cont(p, 0.5) AS ym FROM r GROUP BY ALL) USING (part, y) GROUP BY part, month)""",
        f"b AS (SELECT *, year(sale_date) AS y, CAST(price AS DOUBLE) AS p, quantile_cont(CAST(price AS DOUBLE), 0.5) OVER (PARTITION BY year(sale_date)) AS ymed FROM dwelling WHERE {q.MARKET} AND year(sale_date) BETWEEN 1995 AND 2000)",
        f"r AS (SELECT *, {part} AS part FROM b)")


@query("seasonality", _season_sql("county"))
def _(spark, d):
    return stats.seasonality(dwelling_sales(spark, d), (1995, 2000), "county")


@query("seasonality_by_value", _season_sql("CASE WHEN p > ymed THEN 'above' ELSE 'below' END"))
def _(spark, d):
    return stats.seasonality(dwelling_sales(spark, d), (1995, 2000), "value")


@query("latest_coordinate", over_sales(
    """SELECT id, coalesce(la, latitude) AS latitude, coalesce(lo, longitude) AS longitude FROM dwelling LEFT JOIN
       (SELECT address, arg_max(latitude, (sale_date, latitude, longitude)) AS la, arg_max(longitude, (sale_date, latitude, longitude)) AS lo FROM dwelling WHERE latitude IS NOT NULL GROUP BY address) USING (address)"""))
def _(spark, d):
    return stats.latest_coordinate(dwelling_sales(spark, d)).select("id", "latitude", "longitude")


@query("write_street_documents", f"SELECT slug, total_transactions, transactions, transaction_prices FROM ({ORACLES['street_pages']})")
def _(spark, d):
    path = f"{shared_folder(spark)}/streets-{uuid.uuid4().hex}"
    s = sales(spark, d)
    sinks.write_street_documents(stats.street_pages(s, cut_lineage(stats.street_registry(_ranking(spark, d))), address="address"), path)
    read = spark.read.schema("slug string, total_transactions long, transactions array<struct<price: long>>").json(path)
    return read.select("slug", "total_transactions", F.size("transactions").cast("long").alias("transactions"),
                       F.aggregate("transactions", F.lit(0).cast("long"), lambda a, t: a + t["price"]).alias("transaction_prices"))
