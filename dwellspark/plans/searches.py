"""Registered queries: filters, searches, work lists, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.fixtures import (ASKED_CTE, REQUESTS_CTE, address_requests, dwelling_sales, sales,
                                 search_requests, table)
from dwellspark.functions.geo import round_to
from dwellspark.operators import search, stats
from dwellspark.plans import sqltext as q
from dwellspark.plans.aggregates import RK, RK_STATS_SQL
from dwellspark.plans.registry import over_sales, query

NORM_SALES = f"normed AS (SELECT *, {q.norm_address('address')} AS address_normalized, {RK} AS routing_key, latitude IS NULL AS needs_geocoding FROM dwelling)"


@query("sale_filters", over_sales("SELECT id FROM dwelling WHERE price >= 100000 AND price <= 400000 AND year(sale_date) BETWEEN 1996 AND 1999 AND lower(county) = 'dublin'"))
def _(spark, d):
    return search.sale_filters(dwelling_sales(spark, d), 100_000, 400_000, 1996, 1999, "DUBLIN").select("id")


_PAIR_D = q.haversine("q_lat", "q_lon", "latitude", "longitude")
_RADIUS_CTES = (REQUESTS_CTE,
    f"""pairs AS (SELECT query_id, r.county AS asked, radius_km, s.county, id, sale_date, {_PAIR_D} AS dist FROM requests r, dwelling s
        WHERE latitude IS NOT NULL AND NOT geocode_suspect AND abs(latitude - q_lat) < 0.19 AND {_PAIR_D} <= 20000)""",
    """rings AS (SELECT query_id, i, least(radius_km * f, 20.0::DOUBLE) AS ring FROM requests, (VALUES (0,1.0::DOUBLE),(1,2.0),(2,3.0),(3,5.0),(4,10.0),(5,1000.0)) v(i, f))""",
    """county_hits AS (SELECT r.query_id, r.county AS req_county, count(p.id) AS c0 FROM requests r LEFT JOIN pairs p ON p.query_id = r.query_id AND dist <= p.radius_km*1000 AND lower(p.county) = lower(asked) GROUP BY 1, 2)""",
    """ring_counts AS (SELECT g.query_id, i, ring, req_county IS NOT NULL AND c0 = 0 AS county_dropped, count(p.id) AS n
        FROM rings g JOIN county_hits h ON g.query_id = h.query_id LEFT JOIN pairs p ON p.query_id = g.query_id AND dist <= ring*1000 AND (req_county IS NULL OR c0 = 0 OR lower(req_county) = lower(p.county)) GROUP BY ALL)""",
    """chosen AS (SELECT query_id, arg_min(ring, i) AS ring_km, any_value(county_dropped) AS county_dropped FROM ring_counts WHERE least(n, 25) >= 5 OR ring >= 20 GROUP BY query_id)""",
    """found AS (SELECT p.*, ring_km, county_dropped, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sale_date DESC, dist, id) AS INT) AS position FROM pairs p JOIN chosen USING (query_id)
        WHERE dist <= ring_km*1000 AND (asked IS NULL OR county_dropped OR lower(asked) = lower(county)) QUALIFY position <= 25)""")


def _radius_asks(spark, d):
    return search_requests(spark, d).drop("home_county"), dwelling_sales(spark, d)


def _radius_hits(spark, d):
    return search.radius_search(*_radius_asks(spark, d), limit=25)


@query("radius_search", over_sales(
    "SELECT query_id, position, id, round(dist, 3) AS distance_m, ring_km, county_dropped, ring_km <> radius_km AS radius_expanded FROM found", *_RADIUS_CTES))
def _(spark, d):
    return _radius_hits(spark, d).select("query_id", "position", "id", round_to("distance_m", 3).alias("distance_m"),
                                         "ring_km", "county_dropped", "radius_expanded")


_ASKED_NORM = f"asked_norm AS (SELECT *, {q.norm_address('query')} AS norm FROM asked)"
_TERMS_CTES = (
    f"""terms AS (SELECT query_id, county, list_distinct({q.stems('{q}')}) AS ts FROM {{src}})""",
    f"""dict AS (SELECT address_normalized AS a, county AS c, {q.stems('address_normalized')} AS toks FROM normed GROUP BY 1, 2)""",
    """term_hits AS (SELECT query_id, a, c, round(len(list_filter(toks, lambda t: list_contains(ts, t))) / CAST(len(toks) AS DOUBLE), 6) AS rank_score FROM terms, dict
        WHERE list_has_all(toks, ts) AND (county IS NULL OR county = c))""",
    """term_rows AS (SELECT query_id, id, rank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, sale_date DESC, id) AS INT) AS position
        FROM term_hits JOIN normed s ON s.address_normalized = a AND s.county = c QUALIFY position <= 100)""")


@query("all_terms_search", over_sales("SELECT * FROM term_rows", ASKED_CTE, NORM_SALES,
                                      *[t.replace("{q}", "query").replace("{src}", "asked") for t in _TERMS_CTES]))
def _(spark, d):
    s = sales(spark, d)
    return (search.all_terms_search(address_requests(spark, s), s)
            .select("query_id", "id", "rank_score", "position"))


@query("exact_address_search", over_sales(
    "SELECT query_id, id, 'prefix' AS found_by, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sale_date DESC, id) AS INT) AS position FROM prefix_hits UNION ALL SELECT query_id, id, 'terms', position FROM term_rows",
    ASKED_CTE, NORM_SALES, _ASKED_NORM,
    "prefix_hits AS (SELECT query_id, id, sale_date FROM asked_norm q JOIN normed s ON starts_with(s.address_normalized, norm) AND (q.county IS NULL OR q.county = s.county))",
    "unmatched AS (SELECT * FROM asked_norm ANTI JOIN prefix_hits USING (query_id))",
    *[t.replace("{q}", "norm").replace("{src}", "unmatched") for t in _TERMS_CTES]))
def _(spark, d):
    s = sales(spark, d)
    return search.exact_address_search(address_requests(spark, s), s).select("query_id", "id", "found_by", "position")


@query("substring_search", over_sales("SELECT id, sale_date FROM dwelling WHERE address ILIKE '%merrion rd, town1%' ORDER BY sale_date DESC, id LIMIT 50"))
def _(spark, d):
    return search.substring_search(dwelling_sales(spark, d), "Merrion Rd, Town1").select("id", "sale_date")


_POLYS = """polys AS (SELECT c_custkey AS poly_id, q_lat - 0.02 AS y0, q_lat + 0.02 AS y1, q_lon - 0.03 AS x0, q_lon + 0.03 AS x1 FROM requests JOIN customer ON query_id = c_custkey)"""


@query("polygon_search", over_sales(
    """SELECT poly_id, id, CAST(row_number() OVER (PARTITION BY poly_id ORDER BY sale_date DESC, id) AS INT) AS position FROM polys JOIN dwelling
       ON latitude > y0 AND latitude < y1 AND longitude > x0 AND longitude < x1 AND NOT (latitude >= (y0+y1)/2 AND longitude >= (x0+x1)/2)
       WHERE NOT geocode_suspect AND price >= 50000 QUALIFY position <= 50""", REQUESTS_CTE, _POLYS))
def _(spark, d):
    from dwellspark.plans.scalars import l_shape
    y, x = F.col("q_lat"), F.col("q_lon")
    polys = search_requests(spark, d).select(F.col("query_id").alias("poly_id"),
                                             l_shape(y - 0.02, y + 0.02, x - 0.03, x + 0.03).alias("ring"))
    shown = search.sale_filters(dwelling_sales(spark, d), min_price=50_000)
    return search.polygon_search(polys, shown).select("poly_id", "id", "position")


# Requests with bounds of their own, some NULL.
_BOUND_SQL = "{t}.*, CASE WHEN {k}%3=0 THEN 100000 END AS min_price, CASE WHEN {k}%4=0 THEN 300000 END AS max_price, CASE WHEN {k}%5=0 THEN 1995 END AS min_year, CASE WHEN {k}%7=0 THEN 1998 END AS max_year"
_INSIDE = ("(min_price IS NULL OR price >= min_price) AND (max_price IS NULL OR price <= max_price) "
           "AND (min_year IS NULL OR year(sale_date) >= min_year) AND (max_year IS NULL OR year(sale_date) <= max_year)")
_BOUNDED_REQUESTS = (REQUESTS_CTE.replace("requests AS", "plain AS", 1), f"requests AS (SELECT {_BOUND_SQL.format(t='plain', k='query_id')} FROM plain)")


def _with_bounds(df, key: str):
    k = F.col(key)
    return df.withColumns({"min_price": F.when(k % 3 == 0, 100_000), "max_price": F.when(k % 4 == 0, 300_000),
                           "min_year": F.when(k % 5 == 0, 1995), "max_year": F.when(k % 7 == 0, 1998)})


@query("radius_search_bounded", over_sales(
    "SELECT query_id, position, id, round(dist, 3) AS distance_m, ring_km, county_dropped FROM found",
    *_BOUNDED_REQUESTS, *[c.replace("WHERE latitude IS NOT NULL AND NOT geocode_suspect", f"WHERE {_INSIDE} AND latitude IS NOT NULL AND NOT geocode_suspect") for c in _RADIUS_CTES[1:]]))
def _(spark, d):
    asked = _with_bounds(search_requests(spark, d).drop("home_county"), "query_id")
    return search.radius_search(asked, dwelling_sales(spark, d), limit=25).select(
        "query_id", "position", "id", round_to("distance_m", 3).alias("distance_m"), "ring_km", "county_dropped")


@query("polygon_search_bounded", over_sales(
    f"""SELECT poly_id, id, CAST(row_number() OVER (PARTITION BY poly_id ORDER BY sale_date DESC, id) AS INT) AS position FROM (SELECT {_BOUND_SQL.format(t='polys', k='poly_id')} FROM polys) JOIN dwelling
       ON latitude > y0 AND latitude < y1 AND longitude > x0 AND longitude < x1 AND NOT (latitude >= (y0+y1)/2 AND longitude >= (x0+x1)/2)
       WHERE NOT geocode_suspect AND {_INSIDE} QUALIFY position <= 50""", REQUESTS_CTE, _POLYS))
def _(spark, d):
    from dwellspark.plans.scalars import l_shape
    y, x = F.col("q_lat"), F.col("q_lon")
    polys = search_requests(spark, d).select(F.col("query_id").alias("poly_id"), l_shape(y - 0.02, y + 0.02, x - 0.03, x + 0.03).alias("ring"))
    return search.polygon_search(_with_bounds(polys, "poly_id"), dwelling_sales(spark, d)).select("poly_id", "id", "position")


@query("postcode_search_bounded", over_sales(
    f"""SELECT code, min_price, max_price, min_year, max_year, id, CAST(row_number() OVER (PARTITION BY code, min_price, max_price, min_year, max_year ORDER BY sale_date DESC, id) AS INT) AS position
        FROM (SELECT DISTINCT substr(eircode, 1, 3) AS code, {_BOUND_SQL.format(t='b', k='k').replace('b.*, ', '')} FROM dwelling b WHERE eircode IS NOT NULL) w
        JOIN dwelling s ON starts_with(replace(upper(eircode), ' ', ''), code) WHERE {_INSIDE} QUALIFY position <= 40"""))
def _(spark, d):
    s = dwelling_sales(spark, d)
    codes = _with_bounds(s.where("eircode is not null").select(F.substring("eircode", 1, 3).alias("code"), "k"), "k").drop("k").distinct()
    return search.postcode_search(codes, s, limit=40).select("code", *search.BOUNDS, "id", "position")


_CODES = """codes AS (SELECT DISTINCT lower(eircode) AS code FROM dwelling WHERE eircode IS NOT NULL UNION SELECT DISTINCT eircode[1:3] FROM dwelling WHERE eircode IS NOT NULL),
  wanted AS (SELECT DISTINCT CASE WHEN length(n) >= 5 THEN n ELSE n[1:3] END AS code, CASE WHEN length(n) >= 5 THEN 'full_eircode' ELSE 'routing_key' END AS match_type FROM (SELECT replace(upper(trim(code)), ' ', '') AS n FROM codes)),
  code_rows AS (SELECT w.*, s.* FROM wanted w JOIN (SELECT *, replace(upper(eircode), ' ', '') AS full_code FROM dwelling) s ON CASE WHEN match_type = 'full_eircode' THEN full_code = code ELSE starts_with(full_code, code) END)"""


def _codes(s):
    full = s.where("eircode is not null").select(F.lower("eircode").alias("code"))
    return full.unionByName(s.where("eircode is not null").select(F.substring("eircode", 1, 3).alias("code"))).distinct()


@query("postcode_search", over_sales(
    "SELECT code, match_type, id, CAST(row_number() OVER (PARTITION BY code ORDER BY sale_date DESC, id) AS INT) AS position FROM code_rows QUALIFY position <= 100", _CODES))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return search.postcode_search(_codes(s), s, limit=100).select("code", "match_type", "id", "position")


@query("postcode_search_stats", over_sales(
    f"""SELECT code, match_type, count(*) AS total_count, round(quantile_cont(CAST(price AS DOUBLE), 0.5)) AS median_price, round(CAST(sum(price) AS DOUBLE)/count(*)) AS avg_price,
        min(sale_date) AS earliest_sale, max(sale_date) AS latest_sale FROM code_rows WHERE {q.MARKET} GROUP BY ALL""", _CODES))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return search.postcode_search_stats(_codes(s), s)


@query("routing_key_list", over_sales("SELECT routing_key, primary_county, property_count FROM rks", f"rks AS ({RK_STATS_SQL})"))
def _(spark, d):
    return search.routing_key_list(stats.routing_key_stats(sales(spark, d))).select("routing_key", "primary_county", "property_count")


@query("routing_key_autocomplete", over_sales(
    "SELECT routing_key, property_count, geocoded_pct FROM rks WHERE routing_key LIKE 'F%' ORDER BY property_count DESC, routing_key LIMIT 20", f"rks AS ({RK_STATS_SQL})"))
def _(spark, d):
    return (search.routing_key_autocomplete(stats.routing_key_stats(sales(spark, d)), "f")
            .select("routing_key", "property_count", "geocoded_pct"))


_HITS_WITH_QUERY = f"""hits AS (SELECT f.*, s.address, a.query, {q.match_class('s.address', 'a.query')} AS match_class FROM found f JOIN dwelling s USING (id) JOIN asked a ON a.query_id = f.query_id)"""


@query("partition_matches", over_sales(
    """SELECT query_id, id, match_class, CAST(row_number() OVER (PARTITION BY query_id ORDER BY slot, position) AS INT) AS display_position FROM (SELECT *,
        CASE WHEN match_class = 'street' AND row_number() OVER (PARTITION BY query_id, match_class ORDER BY position) <= 2 THEN 0 WHEN match_class = 'exact' THEN 1
             WHEN match_class = 'street' THEN 2 ELSE 3 END AS slot FROM hits)""", *_RADIUS_CTES, ASKED_CTE, _HITS_WITH_QUERY))
def _(spark, d):
    s = dwelling_sales(spark, d)
    rows = _radius_hits(spark, d).join(address_requests(spark, s).select("query_id", "query"), "query_id")
    return search.rank_matches(rows).select("query_id", "id", "match_class", "display_position")


@query("merge_pins", over_sales(
    """SELECT query_id, id, 'exact' AS pin FROM ex JOIN dwelling USING (id) WHERE latitude IS NOT NULL UNION ALL
       SELECT query_id, id, 'near' FROM found ANTI JOIN (SELECT query_id, id FROM ex JOIN dwelling USING (id) WHERE latitude IS NOT NULL) e USING (query_id, id)""",
    *_RADIUS_CTES, "ex AS (SELECT k AS query_id, id FROM dwelling)"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    exact = s.select(F.col("k").alias("query_id"), "id", "latitude", "longitude")
    return search.merge_pins(exact, _radius_hits(spark, d)).select("query_id", "id", "pin")


@query("geocoding_queue", over_sales("SELECT id, sale_date, price::DOUBLE AS price FROM dwelling WHERE latitude IS NULL ORDER BY (price > 500000) DESC, sale_date DESC, id LIMIT 20"))
def _(spark, d):
    return search.geocoding_queue(dwelling_sales(spark, d), 20).select("id", "sale_date", F.col("price").cast("double").alias("price"))


@query("needs_geocoding_worklist", over_sales(
    """SELECT id, CAST(CASE WHEN price > 500000 THEN 1 WHEN price > 300000 THEN 2 ELSE 3 END AS INT) AS priority_tier,
       row_number() OVER (ORDER BY CASE WHEN price > 500000 THEN 1 WHEN price > 300000 THEN 2 ELSE 3 END, sale_date DESC, price DESC, id) <= 30 AS first_page FROM dwelling WHERE latitude IS NULL"""))
def _(spark, d):
    s = sales(spark, d).withColumn("needs_geocoding", F.col("latitude").isNull())
    first = search.needs_geocoding_worklist(s, 30).select("id", F.lit(True).alias("_f"))
    return (search.needs_geocoding_worklist(s).join(first, "id", "left")
            .select("id", "priority_tier", F.coalesce("_f", F.lit(False)).alias("first_page")))


@query("postcode_first_worklist", over_sales(
    "SELECT id, eircode FROM dwelling WHERE latitude IS NULL ORDER BY (coalesce(eircode, '') <> '') DESC, price DESC, sale_date DESC, id LIMIT 40"))
def _(spark, d):
    s = sales(spark, d).withColumn("needs_geocoding", F.col("latitude").isNull())
    return search.needs_geocoding_worklist(s, 40, postcode_first=True).select("id", "eircode")


@query("regeocode_worklist", over_sales(
    f"""SELECT id, CAST(CASE WHEN price > 500000 THEN 1 ELSE 2 END AS INT) AS value_tier, round({q.haversine('latitude', 'longitude', 'la', 'lo')} / 1000, 3) AS km FROM normed LEFT JOIN
       (SELECT routing_key, {q.mean('latitude')} AS la, {q.mean('longitude')} AS lo FROM normed WHERE latitude IS NOT NULL AND routing_key IS NOT NULL GROUP BY 1) USING (routing_key) WHERE geocode_quality_issue""", NORM_SALES))
def _(spark, d):
    return search.regeocode_worklist(sales(spark, d)).select("id", "value_tier", round_to("distance_from_centroid_km", 3).alias("km"))


@query("postcode_enrichment_queue", over_sales(
    r"""SELECT id, CAST(CASE WHEN county IN ('Dublin','Cork','Galway','Limerick','Waterford') THEN 1 WHEN county IN ('Louth','Kildare','Meath','Wicklow') THEN 2 ELSE 3 END AS INT) AS county_tier,
        CAST(CASE WHEN regexp_matches(address, '^[0-9]+') THEN 1 ELSE 2 END AS INT) AS number_tier FROM dwelling WHERE eircode IS NULL AND latitude IS NOT NULL
        AND (county IN ('Dublin','Cork','Galway','Limerick','Waterford','Louth','Kildare','Meath','Wicklow') OR regexp_matches(address, '^[0-9]+'))
        ORDER BY county_tier, number_tier, sale_date DESC, id LIMIT 1000"""))
def _(spark, d):
    return search.postcode_enrichment_queue(dwelling_sales(spark, d), 1000).select("id", "county_tier", "number_tier")


@query("enrichment_queue", over_sales(
    """SELECT id, CAST(CASE WHEN bedrooms IS NULL AND property_type IS NULL AND property_type_source IS NULL THEN 0 WHEN property_type_source = 'house_guess' THEN 1 ELSE 2 END AS INT) AS tier
       FROM dwelling WHERE year(sale_date) = 1998 AND ((bedrooms IS NULL AND property_type IS NULL) OR property_type_source = 'house_guess')"""))
def _(spark, d):
    return search.enrichment_queue(dwelling_sales(spark, d), 1998).select("id", "tier")


@query("recent_enrichment_queue", over_sales(
    "SELECT id, sale_date FROM dwelling WHERE sale_date >= DATE '2000-05-01' AND (bedrooms IS NULL OR property_type IS NULL)"))
def _(spark, d):
    return search.recent_enrichment_queue(dwelling_sales(spark, d), "2001-08-01", 15).select("id", "sale_date")


@query("sliced_enrichment_queue", over_sales(
    """SELECT id, 1 AS slice FROM (SELECT id FROM dwelling WHERE sale_date >= DATE '2001-05-01' AND sale_date < DATE '2001-07-01' AND (bedrooms IS NULL OR property_type IS NULL) ORDER BY price DESC, sale_date DESC, id LIMIT 15)
       UNION ALL SELECT id, 2 FROM (SELECT id FROM dwelling WHERE sale_date >= DATE '2000-01-01' AND sale_date < DATE '2001-01-01' AND price >= 300000 AND (bedrooms IS NULL OR property_type IS NULL) ORDER BY price DESC, sale_date DESC, id LIMIT 20)"""))
def _(spark, d):
    return search.sliced_enrichment_queue(dwelling_sales(spark, d), [
        {"start": "2001-05-01", "end": "2001-07-01", "cap": 15},
        {"start": "2000-01-01", "end": "2001-01-01", "min_price": 300_000, "cap": 20}]).select("id", "slice")


_FIXES = """fixes AS (SELECT s_suppkey AS fix_id, concat('TOWN', CAST(s_suppkey%40 AS VARCHAR), ',') AS word, 53.3498::DOUBLE + (s_suppkey%4)*0.0004 AS wrong_lat, -6.2603::DOUBLE AS wrong_lon,
   53.0::DOUBLE + s_suppkey*0.001 AS right_lat, -7.0::DOUBLE - s_suppkey*0.001 AS right_lon FROM supplier)"""


@query("known_error_override", over_sales(
    """SELECT s.id, h.fix_id IS NOT NULL AS corrected, round(coalesce(right_lat, latitude), 6) AS latitude, round(coalesce(right_lon, longitude), 6) AS longitude FROM dwelling s LEFT JOIN
       (SELECT id, min(fix_id) AS fix_id FROM dwelling JOIN fixes ON contains(lower(address), lower(word)) AND abs(latitude - wrong_lat) < 0.001 AND abs(longitude - wrong_lon) < 0.001 GROUP BY id) h USING (id)
       LEFT JOIN fixes f ON f.fix_id = h.fix_id""", _FIXES))
def _(spark, d):
    k = F.col("s_suppkey")
    fixes = table(spark, d, "supplier").select(
        k.alias("fix_id"), F.concat(F.lit("TOWN"), (k % 40).cast("string"), F.lit(",")).alias("word"),
        (F.lit(53.3498) + (k % 4) * 0.0004).alias("wrong_lat"), F.lit(-6.2603).alias("wrong_lon"),
        (F.lit(53.0) + k * 0.001).alias("right_lat"), (F.lit(-7.0) - k * 0.001).alias("right_lon"))
    return search.apply_corrections(dwelling_sales(spark, d), fixes).select(
        "id", "corrected", round_to("latitude", 6).alias("latitude"), round_to("longitude", 6).alias("longitude"))


@query("sample_sales", over_sales("SELECT id FROM dwelling ORDER BY md5(concat('7:', CAST(id AS VARCHAR))), id LIMIT 500"))
def _(spark, d):
    return search.sample_sales(dwelling_sales(spark, d), 500, seed=7).select("id")


@query("sample_per_county", over_sales(
    "SELECT county, id FROM dwelling WHERE latitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY county ORDER BY md5(concat('7:', CAST(id AS VARCHAR))), id) <= 3"))
def _(spark, d):
    return search.sample_per_group(dwelling_sales(spark, d).where("latitude is not null"), ["county"], 3, seed=7).select("county", "id")


@query("validation_sample", over_sales(
    """SELECT id FROM dwelling WHERE NOT not_full_market_price AND price BETWEEN 100000 AND 1000000 AND sale_date >= DATE '2001-08-01' - 180 AND latitude IS NOT NULL
       ORDER BY md5(concat('3:', CAST(id AS VARCHAR))), id LIMIT 100"""))
def _(spark, d):
    return search.validation_sample(dwelling_sales(spark, d), 100, "2001-08-01", seed=3).select("id")


_AREA_TRENDS = f"""area_rows AS (SELECT query_id, price, CAST(year(sale_date) AS INT) AS year FROM requests JOIN dwelling ON latitude IS NOT NULL AND NOT geocode_suspect AND {q.MARKET} AND abs(latitude - q_lat) < 0.06 AND {_PAIR_D} <= radius_km * 1000),
  area_years AS (SELECT query_id, year, count(*) AS n, round(quantile_cont(CAST(price AS DOUBLE), 0.5)) AS median_price, round(CAST(sum(price) AS DOUBLE)/count(*)) AS mean_price, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price FROM area_rows GROUP BY ALL)"""


@query("price_trends_by_radius", over_sales("SELECT * FROM area_years", REQUESTS_CTE, _AREA_TRENDS))
def _(spark, d):
    return search.area_trends(search_requests(spark, d), dwelling_sales(spark, d))


@query("area_summary", over_sales(
    """SELECT r.query_id, total_count, avg_price, recent_ids, median_price, min_year, max_year FROM requests r LEFT JOIN (SELECT query_id, count(*) AS total_count, CAST(floor(CAST(sum(price) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_price,
         string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY position) AS recent_ids FROM found f JOIN dwelling USING (id) WHERE position <= 10 GROUP BY 1) USING (query_id)
       LEFT JOIN (SELECT query_id, arg_max(median_price, year) AS median_price, min(year) AS min_year, max(year) AS max_year FROM area_years GROUP BY 1) USING (query_id)""", *_RADIUS_CTES, _AREA_TRENDS))
def _(spark, d):
    r = search.area_summary(search_requests(spark, d).drop("home_county"), dwelling_sales(spark, d), expand=True)
    return r.select("query_id", "total_count", "avg_price", "median_price", "min_year", "max_year",
                    F.array_join(F.transform("recent", lambda x: x["id"].cast("string")), ",").alias("recent_ids"))
