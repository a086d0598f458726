"""Registered queries: sources, sinks, join shapes, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dwellspark.fixtures import AMENITY_CTE, amenity_points, dwelling_sales, sales, search_requests, table, REQUESTS_CTE
from dwellspark.functions.geo import round_to
from dwellspark.lineage import shared_folder
from dwellspark.operators import joins, multiset, stats
from dwellspark.plans import sqltext as q
from dwellspark.plans.aggregates import INDEX_CTE, RK, RK_STATS_SQL
from dwellspark.plans.registry import over_sales, query
from dwellspark.schema import county_boxes
from dwellspark.sources import register, sinks

# ------------------------------------------------------------ sources and sinks

_RAW_SQL = """raw AS (SELECT id, CASE id%5 WHEN 0 THEN strftime(sale_date, '%Y-%m-%d') WHEN 1 THEN 'unknown' ELSE strftime(sale_date, ' %d/%m/%Y') END AS date_raw,
  address AS address_raw, county AS county_raw, CASE WHEN id%6=0 THEN '  ' ELSE eircode END AS eircode_raw,
  CASE WHEN id%37=0 THEN 'n/a' ELSE concat('€', format('{:,}', CAST(trunc(price) AS BIGINT)), '.', lpad(CAST(CAST((price - trunc(price))*100 AS INT) AS VARCHAR), 2, '0')) END AS price_raw,
  CASE WHEN not_full_market_price THEN 'YES' ELSE 'No' END AS nfmp_raw, CASE WHEN vat_exclusive THEN ' true ' ELSE NULL END AS vat_raw FROM dwelling)"""


def register_raw(s):
    """The sales as raw register text, with damaged dates and prices by key."""
    i = F.col("id")
    return s.select(
        "id", F.when(i % 5 == 0, F.date_format("sale_date", "yyyy-MM-dd")).when(i % 5 == 1, "unknown")
        .otherwise(F.date_format("sale_date", " dd/MM/yyyy")).alias("date_raw"),
        F.col("address").alias("address_raw"), F.col("county").alias("county_raw"),
        F.when(i % 6 == 0, "  ").otherwise(F.col("eircode")).alias("eircode_raw"),
        F.when(i % 37 == 0, "n/a").otherwise(F.concat(F.lit("€"), F.format_number("price", 2))).alias("price_raw"),
        F.when(F.col("not_full_market_price"), "YES").otherwise("No").alias("nfmp_raw"),
        F.when(F.col("vat_exclusive"), " true ").alias("vat_raw"), F.lit(None).cast("string").alias("description_raw"),
        F.lit(None).cast("string").alias("size_raw"), F.lit(None).cast("string").alias("latitude_raw"),
        F.lit(None).cast("string").alias("longitude_raw"))


_TYPED = r"""SELECT id, CASE WHEN regexp_matches(trim(date_raw), '^\d{1,2}/') THEN CAST(try_strptime(trim(date_raw), '%d/%m/%Y') AS DATE) ELSE CAST(try_strptime(trim(date_raw), '%Y-%m-%d') AS DATE) END AS sale_date,
  address_raw AS address, nullif(trim(eircode_raw), '') AS eircode, TRY_CAST(nullif(regexp_replace(price_raw, '[^\d.]', '', 'g'), '') AS DOUBLE) AS price,
  lower(trim(nfmp_raw)) IN ('yes','true','1') AS not_full_market_price, coalesce(lower(trim(vat_raw)) IN ('yes','true','1'), false) AS vat_exclusive FROM raw"""


@query("typed_register_rows", over_sales(_TYPED, _RAW_SQL))
def _(spark, d):
    raw = register_raw(dwelling_sales(spark, d))
    typed = register.typed_register_rows(raw.withColumn("description_raw", F.col("id").cast("string")))
    return typed.select(F.col("description").cast("long").alias("id"), "sale_date", "address", "eircode",
                        F.col("price").cast("double").alias("price"), "not_full_market_price", "vat_exclusive")


@query("register_rejects", over_sales(
    f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sale_date IS NULL THEN 'no date' WHEN price IS NULL THEN 'no price' END AS reason FROM ({_TYPED})) WHERE reason IS NOT NULL GROUP BY 1", _RAW_SQL))
def _(spark, d):
    _, rejects = register.split_rejects(register.typed_register_rows(register_raw(dwelling_sales(spark, d))))
    return rejects.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@query("read_register_csv", over_sales(
    f"SELECT id, sale_date, address, eircode, price, not_full_market_price, vat_exclusive FROM ({_TYPED}) WHERE sale_date IS NOT NULL AND price IS NOT NULL", _RAW_SQL))
def _(spark, d):
    from dwellspark.streaming.jobs import REGISTER_COLUMNS
    path = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    names = ["date_raw", "address_raw", "county_raw", "eircode_raw", "price_raw", "nfmp_raw", "vat_raw", "id", "size_raw"]
    raw = register_raw(dwelling_sales(spark, d)).select(*[F.col(a).cast("string").alias(b) for a, b in zip(names, REGISTER_COLUMNS)])
    raw.write.option("header", True).csv(path)
    valid, _ = register.read_register_csv(spark, path)
    return valid.select(F.col("description").cast("long").alias("id"), "sale_date", "address", "eircode", F.col("price").cast("double").alias("price"),
                        "not_full_market_price", "vat_exclusive")


@query("write_worklist_csv", over_sales("SELECT id, county, latitude, NULL::VARCHAR AS new_latitude, NULL::VARCHAR AS new_longitude FROM dwelling WHERE latitude IS NULL"))
def _(spark, d):
    path = f"{shared_folder(spark)}/worklist-{uuid.uuid4().hex}"
    sinks.write_worklist_csv(dwelling_sales(spark, d).where("latitude is null").select("id", "county", "latitude"), path)
    return spark.read.option("header", True).schema("id long, county string, latitude double, new_latitude string, new_longitude string").csv(path)


_UPSERT = """target AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey%4 <> 0),
  updates AS (SELECT c_custkey AS k, 'NEW' AS seg, c_acctbal + 1 AS bal FROM customer WHERE c_custkey%3 = 0)"""


@query("upsert_by_key", f"""WITH {_UPSERT} SELECT coalesce(u.k, t.k) AS k, CASE WHEN u.k IS NOT NULL THEN u.seg ELSE t.seg END AS seg, CASE WHEN u.k IS NOT NULL THEN u.bal ELSE t.bal END AS bal,
  CASE WHEN u.k IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM target t FULL JOIN updates u ON t.k = u.k""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    target = c.where("k % 4 <> 0").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    updates = c.where("k % 3 = 0").withColumn("seg", F.lit("NEW")).withColumn("bal", F.col("bal") + 1)
    out = joins.upsert_by_key(target, updates, ["k"], stamp="2024-02-01")
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("accounts_export", over_sales(
    """SELECT substr(address, 1, 80) AS name, substr(address, 1, 255) AS street, county AS city, coalesce(eircode, '') AS postal_code, 'Ireland' AS country, '2024-01-01' AS import_date,
       concat('Sale Date: ', strftime(sale_date, '%d/%m/%Y'), ', Price: €', format('{:,}', CAST(round_even(CAST(price AS DOUBLE), 0) AS BIGINT))) AS description FROM dwelling"""))
def _(spark, d):
    return sinks.accounts_export(dwelling_sales(spark, d), "2024-01-01")


_CACHE = f"""cache AS (SELECT eircode_c || ', Ireland' AS query, 53.0::DOUBLE + k%100*0.01 AS cached_lat, -7.0::DOUBLE - k%100*0.01 AS cached_lon FROM (SELECT DISTINCT k, {q.compact_postcode('eircode')} AS eircode_c FROM dwelling WHERE eircode IS NOT NULL AND k%2=0) QUALIFY row_number() OVER (PARTITION BY eircode_c ORDER BY k) = 1
  UNION ALL SELECT DISTINCT {q.compact_postcode('eircode')}[1:3] || ', Ireland', CASE WHEN n%2=0 THEN 52.5::DOUBLE END, -8.5::DOUBLE FROM dwelling JOIN bounds USING (county) WHERE eircode IS NOT NULL
  UNION ALL SELECT address, 52.0::DOUBLE + min(k)%100*0.01, -9.0::DOUBLE FROM dwelling WHERE k%3=0 GROUP BY address)"""


@query("apply_geocode_cache", over_sales(
    f"""SELECT id, round(coalesce(a.cached_lat, b.cached_lat, c.cached_lat), 6) AS latitude, round(CASE WHEN a.cached_lat IS NOT NULL THEN a.cached_lon WHEN b.cached_lat IS NOT NULL THEN b.cached_lon ELSE c.cached_lon END, 6) AS longitude
       FROM (SELECT *, {q.compact_postcode("coalesce(eircode, '')")} AS code FROM dwelling) s
       LEFT JOIN cache a ON length(code) >= 7 AND a.query = code || ', Ireland' AND a.cached_lat IS NOT NULL
       LEFT JOIN cache b ON b.query = CASE WHEN code <> '' THEN code[1:3] || ', Ireland' ELSE s.address END AND b.cached_lat IS NOT NULL
       LEFT JOIN cache c ON c.query = s.address AND c.cached_lat IS NOT NULL""", _CACHE))
def _(spark, d):
    from dwellspark.functions.text import normalize_postcode
    s = dwelling_sales(spark, d)
    code = s.where("eircode is not null").withColumn("c", normalize_postcode("eircode"))
    full = (code.where("k % 2 = 0").groupBy("c").agg(F.min("k").alias("k"))
            .select(F.concat("c", F.lit(", Ireland")).alias("query"), (F.lit(53.0) + F.col("k") % 100 * F.lit(0.01)).alias("cached_lat"),
                    (F.lit(-7.0) - F.col("k") % 100 * F.lit(0.01)).alias("cached_lon")))
    keys = (code.groupBy(F.substring("c", 1, 3).alias("c")).agg(F.min("county").alias("county"))
            .select(F.concat("c", F.lit(", Ireland")).alias("query"),
                    F.when((F.ascii("c") - 65) % 2 == 0, F.lit(52.5)).alias("cached_lat"), F.lit(-8.5).alias("cached_lon")))
    bare = (s.where("k % 3 = 0").groupBy("address").agg(F.min("k").alias("k"))
            .select(F.col("address").alias("query"), (F.lit(52.0) + F.col("k") % 100 * F.lit(0.01)).alias("cached_lat"),
                    F.lit(-9.0).alias("cached_lon")))
    return sinks.apply_geocode_cache(s, full.unionByName(keys).unionByName(bare)).select("id", "latitude", "longitude")


# ------------------------------------------------------------ join shapes


@query("dimension_join", over_sales(
    "SELECT id, coalesce(minlat, 0) AS minlat, coalesce(maxlon, 0) AS maxlon, round(centroid_lat, 8) AS centroid_lat FROM (SELECT *, " + RK + " AS routing_key FROM dwelling) JOIN bounds USING (county) JOIN rks USING (routing_key)",
    f"rks AS ({RK_STATS_SQL})"))
def _(spark, d):
    s = sales(spark, d)
    keys = stats.routing_key_stats(s).select("routing_key", "centroid_lat")
    boxes = county_boxes(spark).select(F.col("box_county").alias("county"), F.col("min_lat").alias("minlat"), F.col("max_lon").alias("maxlon"))
    # 26 boxes and at most 2,860 valid routing keys: sizes fixed by their key spaces
    return (s.join(boxes, "county").join(keys, "routing_key")
            .select("id", "minlat", "maxlon", round_to("centroid_lat", 8).alias("centroid_lat")))


@query("shared_point_join", over_sales(
    "SELECT id, distinct_addresses FROM dwelling JOIN (SELECT latitude, longitude, count(DISTINCT address) AS distinct_addresses FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL HAVING count(DISTINCT address) >= 2) USING (latitude, longitude)"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    points = stats.shared_coordinates(s, 2).select("latitude", "longitude", "distinct_addresses")
    return s.join(points, ["latitude", "longitude"]).select("id", "distinct_addresses")


@query("tolerance_join", over_sales(
    """SELECT id, a AS p_lat, b AS p_lon FROM dwelling JOIN (SELECT DISTINCT latitude + 0.0000004 AS a, longitude - 0.0000004 AS b FROM dwelling WHERE latitude IS NOT NULL)
       ON abs(latitude - a) < 0.000001 AND abs(longitude - b) < 0.000001"""))
def _(spark, d):
    s = dwelling_sales(spark, d)
    points = s.where("latitude is not null").select(
        (F.col("latitude") + F.lit(0.0000004)).alias("p_lat"), (F.col("longitude") - F.lit(0.0000004)).alias("p_lon")).distinct()
    return joins.near_equal_join(s, points, ["latitude", "longitude"], ["p_lat", "p_lon"], 1e-6).select("id", "p_lat", "p_lon")


@query("anti_join", over_sales(
    "SELECT id FROM dwelling s WHERE latitude IS NOT NULL AND eircode IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT latitude AS a, longitude AS b FROM dwelling GROUP BY ALL HAVING count(DISTINCT address) >= 10) WHERE abs(s.latitude - a) < 0.000001 AND abs(s.longitude - b) < 0.000001)"))
def _(spark, d):
    s = dwelling_sales(spark, d).where("latitude is not null and eircode is not null")
    hit = stats.at_shared_points(dwelling_sales(spark, d), 10).select("id")
    return s.select("id").join(hit, "id", "left_anti")


_D = q.haversine("q_lat", "q_lon", "latitude", "longitude")


@query("radius_join", over_sales(
    f"SELECT query_id, id, round({_D}, 3) AS distance_m FROM requests, dwelling WHERE latitude IS NOT NULL AND abs(latitude - q_lat) < 0.03 AND {_D} <= 2000", REQUESTS_CTE))
def _(spark, d):
    points = dwelling_sales(spark, d).select("id", "latitude", "longitude")
    return (joins.radius_rows(search_requests(spark, d).select("query_id", "q_lat", "q_lon"), points, 2000.0, digits=3)
            .select("query_id", "id", "distance_m"))


@query("nearest_join", over_sales(
    f"""SELECT id, kind AS class, arg_min(point_id, (dist, point_id)) AS point_id, round(min(dist), 3) AS distance_m FROM
       (SELECT id, amenity_type AS kind, amenity_id AS point_id, {q.haversine('s.latitude', 's.longitude', 'a.latitude', 'a.longitude')} AS dist FROM dwelling s, amenities a WHERE s.latitude IS NOT NULL) GROUP BY ALL""", AMENITY_CTE))
def _(spark, d):
    points = amenity_points(spark, d).select(F.col("amenity_type").alias("class"), F.col("amenity_id").alias("point_id"),
                                             F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    s = dwelling_sales(spark, d).select("id", "latitude", "longitude")
    return joins.nearest_join(s, points).select("id", "class", "point_id", round_to("distance_m", 3).alias("distance_m"))


def _asof(policy: str, name: str) -> None:
    pick = ("arg_min(i.price_index, (abs(date_diff('day', sale_date, i.month)), i.month))" if policy == "nearest" else "arg_max(i.price_index, i.month)")

    @query(name, over_sales(
        f"""SELECT id, coalesce(e.price_index, near.v) AS index_value, e.price_index IS NOT NULL AS exact FROM dwelling s
           LEFT JOIN price_index e ON e.county = s.county AND e.month = date_trunc('month', s.sale_date)
           LEFT JOIN (SELECT k.county, sale_date, {pick} AS v FROM (SELECT DISTINCT county, sale_date FROM dwelling) k JOIN price_index i USING (county) GROUP BY ALL) near ON near.county = s.county AND near.sale_date = s.sale_date""", INDEX_CTE))
    def _(spark, d):
        s = dwelling_sales(spark, d)
        index = stats.county_price_index(s, "1995-01-01", min_n=3)
        return (joins.asof_nearest(s, index, "county", "sale_date", policy=policy)
                .select("id", "index_value", F.coalesce("index_value_exact", F.lit(False)).alias("exact")))


_asof("nearest", "asof_nearest")
_asof("latest", "asof_latest")


@query("sql_functions", over_sales(
    f"""SELECT id, {q.norm_address('address')} AS normal, {q.norm_address('address', True)} AS extended, coalesce(e.price_index, l.price_index, 1.0::DOUBLE) AS index_value
        FROM dwelling s LEFT JOIN price_index e ON e.county = s.county AND e.month = date_trunc('month', s.sale_date)
        LEFT JOIN (SELECT county, arg_max(price_index, month) AS price_index FROM price_index GROUP BY county) l ON l.county = s.county""", INDEX_CTE))
def _(spark, d):
    from dwellspark.functions.register import register_functions, register_index_function
    s = dwelling_sales(spark, d)
    s.createOrReplaceTempView("asked_sales")
    stats.county_price_index(s, "1995-01-01", min_n=3).createOrReplaceTempView("county_index")
    register_functions(spark)
    register_index_function(spark, "county_index")
    return spark.sql("SELECT id, normalize_address(address) AS normal, normalize_address_extended(address) AS extended, "
                     "county_index_at(county, sale_date) AS index_value FROM asked_sales")


@query("flag_outer_join", over_sales(
    "SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS suspect, b.id IS NOT NULL AS listed FROM (SELECT id FROM dwelling WHERE geocode_suspect) a FULL JOIN (SELECT id FROM dwelling WHERE latitude IS NULL) b ON a.id = b.id"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    suspect = s.where("geocode_suspect").select("id", F.lit(True).alias("suspect"))
    listed = s.where("latitude is null").select("id", F.lit(True).alias("listed"))
    return suspect.join(listed, "id", "full").fillna(False, ["suspect", "listed"])


@query("fill_from", over_sales(
    "SELECT id, coalesce(eircode, e) AS eircode, coalesce(bedrooms, b) AS bedrooms FROM dwelling LEFT JOIN (SELECT address, min(eircode) AS e, max(bedrooms) AS b FROM dwelling GROUP BY address) USING (address)"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    src = s.groupBy("address").agg(F.min("eircode").alias("eircode"), F.max("bedrooms").alias("bedrooms"))
    return joins.fill_from(s, src, ["address"], ["eircode", "bedrooms"]).select("id", "eircode", "bedrooms")


_PLACES = "places AS (SELECT DISTINCT p_name AS place FROM part UNION SELECT 'Elm Ct, Town3' UNION SELECT 'church dr'  UNION SELECT 'n' || CAST(s_suppkey AS VARCHAR) || ',' FROM supplier)"


def _places(spark, d):
    extra = spark.createDataFrame([("Elm Ct, Town3",), ("church dr",)], "place string")
    return (table(spark, d, "part").select(F.col("p_name").alias("place"))
            .union(table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string"), F.lit(","))))
            .union(extra).distinct())


@query("pattern_join", over_sales(
    "SELECT id, min(place) AS place FROM dwelling JOIN places ON contains(lower(address), lower(place)) GROUP BY id", _PLACES))
def _(spark, d):
    return joins.pattern_join(dwelling_sales(spark, d).select("id", "address"), _places(spark, d)).select("id", "place")


@query("reapply_postcodes", over_sales(
    """SELECT s.id, e AS eircode FROM dwelling s LEFT JOIN (SELECT sale_date, address, price, min(eircode) AS e FROM dwelling WHERE id%3 = 0 AND eircode <> '' GROUP BY ALL) x
       ON s.sale_date = x.sale_date AND s.address = x.address AND s.price = x.price"""))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return joins.reapply_postcodes(s, s.where("id % 3 = 0")).select("id", "eircode")


# ------------------------------------------------------------ set operations

_SNAPSHOT = """base AS (SELECT * FROM dwelling WHERE id%23 <> 0), source AS (SELECT id, sale_date, CASE WHEN id%2=0 THEN lower(address) ELSE address END AS address, county || ' ' AS county, price FROM dwelling
   UNION ALL SELECT id, sale_date, upper(address) || '.', county, price FROM dwelling WHERE id%31 = 0 UNION ALL SELECT id, sale_date, upper(address) || '.', county, price FROM dwelling WHERE id%31 = 0)"""


def register_snapshot(s):
    """(base, source): the base lacks some sales; the source repeats others."""
    cols = ["id", "sale_date", "address", "county", "price"]
    spelled = s.withColumn("address", F.when(F.col("id") % 2 == 0, F.lower("address")).otherwise(F.col("address"))) \
        .withColumn("county", F.concat("county", F.lit(" "))).select(*cols)
    again = s.where("id % 31 = 0").withColumn("address", F.concat(F.upper("address"), F.lit("."))).select(*cols)
    return s.where("id % 23 <> 0"), spelled.unionByName(again).unionByName(again)


@query("reconcile_snapshot", over_sales(
    """SELECT id, address, county FROM (SELECT s.*, row_number() OVER (PARTITION BY sale_date, price, trim(county) ORDER BY md5(concat_ws('|', CAST(sale_date AS VARCHAR), address, county, CAST(price AS VARCHAR))), id) AS rn,
         count(*) OVER (PARTITION BY sale_date, price, trim(county)) AS n FROM source s)
       LEFT JOIN (SELECT sale_date AS d, price AS p, trim(county) AS c, count(*) AS have FROM base GROUP BY ALL) b ON sale_date = d AND price = p AND trim(county) = c WHERE rn <= n - coalesce(have, 0)""", _SNAPSHOT))
def _(spark, d):
    base, source = register_snapshot(dwelling_sales(spark, d))
    return multiset.reconcile(base, source).select("id", "address", "county")


@query("delta_since", over_sales("SELECT id FROM dwelling WHERE sale_date > (SELECT max(sale_date) FROM dwelling WHERE sale_date < DATE '2000-06-01')"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return multiset.delta_since(s.where("sale_date < date'2000-06-01'"), s).select("id")


@query("union_distinct_ids", over_sales(
    "SELECT id FROM dwelling WHERE geocode_suspect UNION SELECT id FROM dwelling WHERE geocode_quality_issue UNION SELECT id FROM dwelling WHERE latitude IS NULL"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return multiset.union_distinct_ids(s.where("geocode_suspect"), s.where("geocode_quality_issue"), s.where("latitude is null"))


_REPORT_CTES = (
    "pts AS (SELECT latitude AS a, longitude AS b, count(DISTINCT address) AS n FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL HAVING count(DISTINCT address) >= 2)",
    """at_points AS (SELECT s.*, a, b, pts.n AS n, row_number() OVER (PARTITION BY a, b ORDER BY (coalesce(eircode, '') <> '') DESC, sale_date DESC, id) AS rn FROM dwelling s JOIN pts ON abs(latitude - a) < 0.000001 AND abs(longitude - b) < 0.000001)""",
    "bad_places(place_no, place) AS (VALUES (0, 'MAIN ST., TOWN5'), (1, 'Elm Ct'), (2, 'CHURCH DR'), (3, 'nowhere'))")


@query("regeocode_report", over_sales(
    """SELECT priority, reason, id FROM (SELECT 'HIGH' AS priority, concat('Centroid: ', n, ' addresses at same point') AS reason, id FROM at_points WHERE n >= 50 AND rn <= 60 ORDER BY n DESC, a, b, rn LIMIT 10000)
       UNION ALL SELECT * FROM (SELECT 'MEDIUM', concat('Cluster: ', n, ' addresses at same point'), id FROM at_points WHERE n < 50 AND rn <= 100 ORDER BY n DESC, a, b, rn LIMIT 5000)
       UNION ALL SELECT * FROM (SELECT 'LOW', 'Missing coordinates (has eircode)', id FROM dwelling WHERE latitude IS NULL AND eircode <> '' ORDER BY sale_date DESC, id LIMIT 5000)
       UNION ALL SELECT * FROM (SELECT 'VERIFY', concat('Recent sale in problematic area: ', place), id FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY sale_date DESC, id) AS rn FROM dwelling JOIN bad_places ON contains(lower(address), lower(place))
         WHERE latitude IS NOT NULL AND sale_date >= DATE '2001-08-01' - 730) WHERE rn <= 20 ORDER BY place_no, rn LIMIT 1000)""", *_REPORT_CTES))
def _(spark, d):
    places = spark.createDataFrame([(0, "MAIN ST., TOWN5"), (1, "Elm Ct"), (2, "CHURCH DR"), (3, "nowhere")], "place_no int, place string")
    return (multiset.regeocode_report(dwelling_sales(spark, d), "2001-08-01", places, crowded=50, cluster=2, per_point=60)
            .select("priority", "reason", "id"))


@query("import_with_defaults", over_sales(
    "SELECT id, latitude IS NULL AS unlocated, needs_geocoding FROM (SELECT id, latitude, false AS needs_geocoding FROM dwelling WHERE id%7 <> 0 UNION ALL SELECT id, NULL, true FROM dwelling WHERE id%7 = 0)"))
def _(spark, d):
    s = dwelling_sales(spark, d)
    base = s.where("id % 7 <> 0").withColumn("needs_geocoding", F.lit(False))
    new = s.where("id % 7 = 0").select("id", "sale_date", "address", "county", "price")
    return multiset.append_register(base, new).select("id", F.col("latitude").isNull().alias("unlocated"), "needs_geocoding")


@query("incremental_register", over_sales(
    f"""SELECT county, sale_date, price, greatest(0, n - coalesce(have, 0)) AS new_rows, greatest(0, n - coalesce(have, 0)) AS ids FROM (SELECT sale_date, price, county, count(*) AS n FROM (SELECT t.*, s.county FROM ({_TYPED}) t JOIN dwelling s USING (id)) WHERE sale_date IS NOT NULL AND price IS NOT NULL GROUP BY ALL)
       LEFT JOIN (SELECT sale_date, CAST(price AS DOUBLE) AS price, county, count(*) AS have FROM dwelling WHERE id%4 <> 0 GROUP BY ALL) USING (sale_date, price, county) WHERE n > coalesce(have, 0)""", _RAW_SQL))
def _(spark, d):
    from dwellspark.streaming.jobs import REGISTER_COLUMNS, ingest_batch
    s = dwelling_sales(spark, d)
    names = ["date_raw", "address_raw", "county_raw", "eircode_raw", "price_raw", "nfmp_raw", "vat_raw", "description_raw", "size_raw"]
    raw = register_raw(s).select(*[F.col(a).alias(b) for a, b in zip(names, REGISTER_COLUMNS)])
    base = s.where("id % 4 <> 0").withColumn("needs_geocoding", F.col("latitude").isNull())
    new, _rejects = ingest_batch(base, raw)
    return new.groupBy("county", "sale_date", F.col("price").cast("double").alias("price")).agg(
        F.count("*").alias("new_rows"), F.countDistinct("id").alias("ids"))


@query("incremental_key_stats", over_sales(RK_STATS_SQL))
def _(spark, d):
    s = sales(spark, d)
    base, new = s.where("id % 4 <> 0"), s.where("id % 4 = 0")
    state = stats.merge_key_states(stats.routing_key_state(base).union(stats.routing_key_state(new)))
    return stats.stats_of_state(state).withColumn("counties", F.array_join("counties", "|"))


@query("read_amenities", f"""WITH {AMENITY_CTE} SELECT amenity_type, count(*) AS n, count(description) AS described, count(*) FILTER (amenity_id % 10 = 0) AS tenth FROM (SELECT *, CASE WHEN amenity_type = 'transport' THEN category END AS description FROM amenities) WHERE amenity_id % 9 <> 0 GROUP BY 1""")
def _(spark, d):
    from dwellspark.sources.amenities import read_amenities
    a = amenity_points(spark, d).withColumn("lat", F.when(F.col("amenity_id") % 9 == 0, "n/a").otherwise(F.col("latitude").cast("string")))
    transport = a.where("amenity_type = 'transport'").select(
        F.col("amenity_id").cast("string").alias("Infrastructure Name"), F.col("category").alias("Category"), F.col("category").alias("Description"),
        F.col("name").alias("Unnamed: 5"), F.col("lat").alias("Latitude"), F.col("longitude").cast("string").alias("Longitude"))
    schools = a.where("amenity_type = 'school'").select(
        F.col("amenity_id").cast("string").alias("School Name"), F.col("category").alias("Category"), F.col("level").alias("Level"),
        F.col("lat").alias("Latitude"), F.col("longitude").cast("string").alias("Longitude"))
    valid, _skipped = read_amenities(transport, schools)
    return valid.groupBy("amenity_type").agg(F.count("*").alias("n"), F.count("description").alias("described"),
                                             F.count_if(F.col("name").cast("long") % 10 == 0).alias("tenth"))
