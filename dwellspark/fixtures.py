"""Derived property-sale tables over the given star-schema tables.

The mapping is one SQL text that Spark and the SQL oracle both run: a customer
plays the dwelling and an order plays a sale of it. `DWELLING_CTES` is the text;
`dwelling_sales` runs it on Spark without hints, so the planner chooses the join
between orders and customer by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.functions import text
from dwellspark.schema import COUNTY_BOXES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounds_values(limit: int | None = 25) -> str:
    rows = []
    for n, (county, box) in enumerate(list(COUNTY_BOXES.items())[:limit]):
        nums = ", ".join(f"CAST({v} AS DOUBLE)" for v in box)
        rows.append(f"({n}, '{county}', {nums})")
    return ", ".join(rows)


BOUNDS_CTE = ("bounds(n, county, minlat, maxlat, minlon, maxlon) AS "
              f"(SELECT * FROM (VALUES {_bounds_values()}) AS v)")
ALL_BOXES_CTE = ("boxes(box_county, b_minlat, b_maxlat, b_minlon, b_maxlon) AS "
                 f"(SELECT col1, col2, col3, col4, col5 FROM (VALUES {_bounds_values(None)}) "
                 "AS v(col0, col1, col2, col3, col4, col5))")

_SALES_SQL = """
c AS (
 SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS sale_date,
        CAST(o_totalprice AS DECIMAL(12,2)) AS price,
        o_orderstatus = 'P' AS nfmp, o_orderpriority = '1-URGENT' AS vat, c_nationkey AS n
 FROM orders JOIN customer ON o_custkey = c_custkey),
dwelling AS (
SELECT id, k, sale_date, price, nfmp AS not_full_market_price, vat AS vat_exclusive, b.county,
 concat(CASE WHEN k%7=0 THEN 'Apartment ' WHEN k%11=0 THEN 'No. ' ELSE '' END,
        CAST(k%200+1 AS {string}), CASE WHEN k%7=0 THEN ', ' ELSE ' ' END,
        CASE k%5 WHEN 0 THEN 'MAIN ST.' WHEN 1 THEN 'MERRION RD' WHEN 2 THEN 'PARK AVE'
                 WHEN 3 THEN 'ELM CT' ELSE 'CHURCH DR' END,
        ', TOWN', CAST(k%40 AS {string}), ', ', b.county) AS address,
 CASE WHEN k%3=0 OR id%5=0 THEN NULL
      ELSE concat(chr(65+c.n), CAST(10+c.n AS {string}), ' X',
                  lpad(CAST(k%1000 AS {string}), 3, '0')) END AS eircode,
 CASE WHEN id%50=0 THEN NULL WHEN id%97=0 THEN CAST(53.3498 AS DOUBLE)
      ELSE round(b.minlat+(k*37%1000)/CAST(1000 AS DOUBLE)*(b.maxlat-b.minlat),6) END AS latitude,
 CASE WHEN id%50=0 THEN NULL WHEN id%97=0 THEN CAST(-6.2603 AS DOUBLE)
      ELSE round(b.minlon+(k*91%1000)/CAST(1000 AS DOUBLE)*(b.maxlon-b.minlon),6) END AS longitude,
 CAST(CASE WHEN id%4=0 THEN NULL
           ELSE 1+(k%5)+CASE WHEN id%31=0 THEN 1 ELSE 0 END END AS INT) AS bedrooms,
 id%41=0 AS geocode_quality_issue,
 id%53=0 AS geocode_suspect,
 CASE WHEN id%2=0 THEN 'Second-Hand Dwelling house /Apartment'
      ELSE 'New Dwelling house /Apartment' END AS description,
 CASE WHEN id%6=0 THEN 'greater than 125 sq metres' ELSE NULL END AS size_description,
 CASE WHEN id%3=0 THEN NULL WHEN k%7=0 THEN 'apartment' WHEN k%4=0 THEN 'semi-detached'
      WHEN k%4=1 THEN 'terraced' WHEN id%29=0 THEN 'duplex' ELSE 'house' END AS property_type,
 CASE WHEN id%3=0 AND id%4=0 THEN 'enrichment' WHEN id%3=0 THEN NULL
      WHEN k%7=0 THEN 'address_apartment' WHEN id%10=1 THEN 'house_guess'
      ELSE 'enrichment' END AS property_type_source,
 CASE WHEN id%9=0 THEN NULL
      ELSE concat(chr(CAST(65+k%7 AS INT)),
                  CASE WHEN k%7<3 THEN CAST(1+k%3 AS {string})
                       WHEN k%7<5 THEN CAST(1+k%2 AS {string}) ELSE '' END) END AS ber_rating
FROM c JOIN bounds b ON b.n = c.n)
"""

DWELLING_CTES = f"{BOUNDS_CTE}, {_SALES_SQL.format(string='VARCHAR')}"


def dwelling_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived sales table: one row per order."""
    return spark.sql(
        f"WITH {BOUNDS_CTE}, "
        + _SALES_SQL.format(string="STRING")
        .replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}")
        + " SELECT * FROM dwelling",
        orders=table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus",
            "o_orderpriority"),
        customer=table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dwelling_sales` with the generated columns of a stored register."""
    return (dwelling_sales(spark, sf_dir)
            .withColumn("address_normalized", text.normalize_address("address"))
            .withColumn("routing_key", text.routing_key("eircode")))


# ------------------------------------------------------------ further derived tables
# Each has a DataFrame form and the SQL text its oracle uses.

API_USAGE_SQL = """SELECT date_trunc('hour', ts) AS ts, event_type AS source, count(*) AS request_count,
  count(*) FILTER (value >= 5) AS success_count, count(*) FILTER (NOT value >= 5) AS error_count FROM events GROUP BY 1, 2"""


def api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly request, success and error counts per source."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("source"))
            .agg(F.count("*").alias("request_count"), F.count_if(F.col("value") >= 5).alias("success_count"),
                 F.count_if(~(F.col("value") >= 5)).alias("error_count")))


CANDIDATES_CTE = """candidates AS (
  SELECT id, source, CASE WHEN id%19=0 THEN NULL WHEN source='first' THEN coalesce(latitude, 53.1) + (id%5)*0.0005 ELSE coalesce(latitude, 53.1) + (id%7)*0.1 END AS cand_lat,
    CASE WHEN id%19=0 THEN NULL WHEN source='first' THEN coalesce(longitude, -7.1) + (id%3)*0.0005 ELSE coalesce(longitude, -7.1) - (id%4)*0.1 END AS cand_lon,
    CASE id%6 WHEN 0 THEN 'address' WHEN 1 THEN 'street' WHEN 2 THEN 'poi' WHEN 3 THEN 'postcode' WHEN 4 THEN 'place' ELSE 'locality' END AS feature_type
  FROM dwelling, (VALUES ('first'), ('second')) AS v(source) WHERE (source = 'first') OR id%2=0)"""


def geocode_candidates(sales_df: DataFrame) -> DataFrame:
    """Two candidate coordinates per sale (one for odd ids) with a feature type."""
    i = F.col("id")
    la, lo = F.coalesce("latitude", F.lit(53.1)), F.coalesce("longitude", F.lit(-7.1))
    kinds = F.array(*[F.lit(k) for k in ("address", "street", "poi", "postcode", "place", "locality")])
    near = F.struct(F.lit("first").alias("source"), (la + (i % 5) * F.lit(0.0005)).alias("cand_lat"),
                    (lo + (i % 3) * F.lit(0.0005)).alias("cand_lon"))
    far = F.struct(F.lit("second").alias("source"), (la + (i % 7) * F.lit(0.1)).alias("cand_lat"),
                   (lo - (i % 4) * F.lit(0.1)).alias("cand_lon"))
    both = F.when(i % 2 == 0, F.array(near, far)).otherwise(F.array(near))
    miss = i % 19 == 0
    return (sales_df.select("id", F.explode(both).alias("c"), F.element_at(kinds, (i % 6 + 1).cast("int")).alias("feature_type"))
            .select("id", "c.source", F.when(~miss, F.col("c.cand_lat")).alias("cand_lat"),
                    F.when(~miss, F.col("c.cand_lon")).alias("cand_lon"), "feature_type"))


ALT_CTE = """alt AS (SELECT address, county, round(min_by(latitude, id) + CASE WHEN min(k)%3=0 THEN 0 WHEN min(k)%3=1 THEN 0.001::DOUBLE ELSE 0.5::DOUBLE END, 6) AS latitude,
  min_by(longitude, id) AS longitude FROM dwelling WHERE latitude IS NOT NULL GROUP BY address, county)"""


def alt_coordinates(sales_df: DataFrame) -> DataFrame:
    """A second geocoder: one row per address, shifted by 0, 0.001 or 0.5 degrees."""
    shift = F.when(F.min("k") % 3 == 0, F.lit(0.0)).when(F.min("k") % 3 == 1, F.lit(0.001)).otherwise(F.lit(0.5))
    return (sales_df.where("latitude is not null").groupBy("address", "county")
            .agg(F.round(F.min_by("latitude", "id") + shift, 6).alias("latitude"),
                 F.min_by("longitude", "id").alias("longitude")))


SOURCES_CTE = ALT_CTE + """, sources AS (SELECT 'base' AS source, address, county, latitude, longitude FROM dwelling
  UNION ALL SELECT 'second', address, county, latitude, longitude FROM alt)"""


def coordinate_sources(sales_df: DataFrame) -> DataFrame:
    cols = ["source", "address", "county", "latitude", "longitude"]
    return (sales_df.withColumn("source", F.lit("base")).select(*cols)
            .unionByName(alt_coordinates(sales_df).withColumn("source", F.lit("second")).select(*cols)))


# One search request per customer, placed near that customer's dwelling.
_REQUESTS_SQL = """
SELECT c_custkey AS query_id, b.county AS home_county,
  round(b.minlat+(c_custkey*37%1000)/CAST(1000 AS DOUBLE)*(b.maxlat-b.minlat),6) + (c_custkey%3)*CAST(0.004 AS DOUBLE) AS q_lat,
  round(b.minlon+(c_custkey*91%1000)/CAST(1000 AS DOUBLE)*(b.maxlon-b.minlon),6) AS q_lon,
  CAST(CASE c_custkey%4 WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 5 END AS DOUBLE) AS radius_km,
  CASE c_custkey%3 WHEN 0 THEN lower(b.county) WHEN 1 THEN 'Nowhere' ELSE NULL END AS county
FROM {customer} JOIN bounds b ON b.n = c_nationkey"""
REQUESTS_CTE = f"requests AS ({_REQUESTS_SQL.format(customer='customer')})"


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {BOUNDS_CTE} {_REQUESTS_SQL}",
                     customer=table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))


# Address requests: a spelled prefix, a re-ordered address, a bare street, a miss.
_ASKED_SQL = """
SELECT k AS query_id, CASE k%4 WHEN 0 THEN replace(min(address), ', TOWN', ',  Town')
    WHEN 1 THEN concat('Town', CAST(k%40 AS {string}), ' ', CASE k%5 WHEN 0 THEN 'Main Street' WHEN 1 THEN 'Merrion Road' WHEN 2 THEN 'Park Avenue' WHEN 3 THEN 'Elm Court' ELSE 'Church Drive' END)
    WHEN 2 THEN substr(min(address), 1, 14) ELSE concat('No such place ', CAST(k AS {string})) END AS query,
  CASE WHEN k%3=0 THEN min(county) ELSE NULL END AS county
FROM {dwelling} GROUP BY k"""
ASKED_CTE = f"asked AS ({_ASKED_SQL.format(string='VARCHAR', dwelling='dwelling')})"


def address_requests(spark: SparkSession, sales_df: DataFrame) -> DataFrame:
    return spark.sql(_ASKED_SQL.replace("{string}", "STRING"), dwelling=sales_df.select("k", "address", "county"))


# Points of interest inside the city box: rail, tram or school by supplier key.
_AMENITY_SQL = """
SELECT s_suppkey AS amenity_id, CASE s_suppkey%3 WHEN 2 THEN 'school' ELSE 'transport' END AS amenity_type, s_name AS name,
  CASE WHEN s_suppkey%3 = 1 THEN CASE WHEN s_suppkey%2=0 THEN 'Luas Green Line' ELSE 'Luas Red Line' END WHEN s_suppkey%3 = 0 THEN 'DART' ELSE 'School' END AS category,
  CASE WHEN s_suppkey%3 = 2 THEN CASE s_suppkey%7 WHEN 0 THEN 'Tertiary' WHEN 1 THEN 'Secondary' WHEN 2 THEN 'Secondary & Primary' ELSE 'Primary' END END AS level,
  round(CAST(53.20 AS DOUBLE) + (s_suppkey*17%100)/CAST(100 AS DOUBLE)*CAST(0.30 AS DOUBLE), 6) AS latitude,
  round(CAST(-6.45 AS DOUBLE) + (s_suppkey*29%100)/CAST(100 AS DOUBLE)*CAST(0.40 AS DOUBLE), 6) AS longitude
FROM {supplier}"""
AMENITY_CTE = f"amenities AS ({_AMENITY_SQL.format(supplier='supplier')})"


def amenity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_AMENITY_SQL, supplier=table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


# Location look-ups: coordinates, routing keys, postcodes, streets, towns, misses.
_LOOKUPS_SQL = """
SELECT k AS query_id, CASE k%6 WHEN 0 THEN concat(CAST(51+k%4 AS {string}), '.25 , -', CAST(6+k%3 AS {string}), '.5')
    WHEN 1 THEN coalesce(lower(substr(min(eircode), 1, 3)), 'Q9') WHEN 2 THEN coalesce(max(eircode), 'Z99 Z999')
    WHEN 3 THEN concat(CASE k%5 WHEN 0 THEN 'Main Street' WHEN 1 THEN 'Merrion Road' WHEN 2 THEN 'Parks Avenue' WHEN 3 THEN 'Elm Court' ELSE 'Church Drive' END, ', Town', CAST(k%40 AS {string}), ', Co. ', min(county))
    WHEN 4 THEN concat('Town', CAST(k%40 AS {string}), ', ', min(county), CASE WHEN k%8=0 THEN 's' ELSE '' END) ELSE concat('Nowhere ', CAST(k AS {string})) END AS query,
  CASE WHEN k%2=0 THEN min(county) ELSE NULL END AS county
FROM {dwelling} GROUP BY k"""
LOOKUPS_CTE = f"lookups AS ({_LOOKUPS_SQL.format(string='VARCHAR', dwelling='dwelling')})"


def location_lookups(spark: SparkSession, sales_df: DataFrame) -> DataFrame:
    return spark.sql(_LOOKUPS_SQL.replace("{string}", "STRING"), dwelling=sales_df.select("k", "address", "county", "eircode"))


# Valuation requests: known addresses, partial addresses, postcodes only, misses.
_SUBJECTS_SQL = """
SELECT k AS request_id, CASE k%4 WHEN 0 THEN min(address) WHEN 1 THEN concat(CAST(k%200+1 AS {string}), ' ', CASE k%5 WHEN 0 THEN 'Main' WHEN 1 THEN 'Merrion' WHEN 2 THEN 'Park' WHEN 3 THEN 'Elm' ELSE 'Church' END, ' TOWN', CAST(k%40 AS {string}))
    WHEN 2 THEN concat('House ', CAST(k AS {string})) ELSE substr(min(address), 1, 20) END AS address,
  CASE WHEN k%3=0 THEN NULL ELSE max(eircode) END AS eircode, CASE WHEN k%7=0 THEN NULL ELSE upper(min(county)) END AS county,
  CAST(CASE WHEN k%5=0 THEN 3 ELSE NULL END AS INT) AS bedrooms
FROM {dwelling} GROUP BY k"""
SUBJECTS_CTE = f"subjects AS ({_SUBJECTS_SQL.format(string='VARCHAR', dwelling='dwelling')})"


def valuation_requests(spark: SparkSession, sales_df: DataFrame) -> DataFrame:
    return spark.sql(_SUBJECTS_SQL.replace("{string}", "STRING"), dwelling=sales_df.select("k", "address", "county", "eircode"))
