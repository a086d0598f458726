"""Registered queries: location resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.fixtures import LOOKUPS_CTE, SUBJECTS_CTE, location_lookups, sales, valuation_requests
from dwellspark.functions.geo import round_to
from dwellspark.operators import resolve, stats
from dwellspark.plans import sqltext as q
from dwellspark.plans.aggregates import POSTCODE_REF_CTE, RK_STATS_SQL
from dwellspark.plans.registry import over_sales, query
from dwellspark.plans.searches import NORM_SALES

_COVERS = (f"len(list_filter(toks, lambda t: NOT (contains(a, t) OR coalesce(contains(a, {q.TOKEN_ALT}), false) "
           f"OR coalesce(contains(a, {q.TOKEN_NUMBER}), false)))) = 0")
_BOOK = "book AS (SELECT lower(address) AS a, lower(county) AS c, latitude, longitude FROM dwelling WHERE latitude IS NOT NULL), words AS (SELECT DISTINCT a, c FROM book)"
_TOKENS = f"""token_sums AS (SELECT query_id, len(any_value(toks)) AS k, {q.mean('latitude')} AS lat, {q.mean('longitude')} AS lon, coalesce(stddev_samp(latitude), 0) AS sy, coalesce(stddev_samp(longitude), 0) AS sx
    FROM (SELECT query_id, lower(county) AS asked, {q.tokens('query')} AS toks FROM lookups) l JOIN words ON len(toks) > 0 AND {_COVERS} AND (asked IS NULL OR asked = c) JOIN book USING (a, c) GROUP BY query_id),
  by_tokens AS (SELECT query_id, lat, lon, 'db_tokens' AS source FROM token_sums WHERE sy < CASE WHEN k >= 2 THEN 0.02 ELSE 0.01 END AND sx < CASE WHEN k >= 2 THEN 0.02 ELSE 0.01 END)"""
_FUZZY = f"""fz1 AS (SELECT query_id, count(*) AS n, {q.mean('latitude')} AS lat, {q.mean('longitude')} AS lon FROM lookups JOIN words ON contains(a, lower(trim(query))) OR contains(c, lower(trim(query))) JOIN book USING (a, c) GROUP BY query_id),
  fz2 AS (SELECT query_id, count(*) AS n, {q.mean('latitude')} AS lat, {q.mean('longitude')} AS lon FROM (SELECT query_id, lower(trim(query[1:-2])) AS t FROM lookups ANTI JOIN fz1 USING (query_id) WHERE lower(query) LIKE '%s' AND lower(query) NOT LIKE '%ss')
     JOIN words ON contains(a, t) OR contains(c, t) JOIN book USING (a, c) GROUP BY query_id),
  by_fuzzy AS (SELECT query_id, lat, lon, 'db_fuzzy' AS source FROM (SELECT * FROM fz1 UNION ALL SELECT * FROM fz2) WHERE n >= 3)"""


def _point(df):
    return [round_to("lat", 6).alias("lat"), round_to("lon", 6).alias("lon")]


@query("resolve_by_tokens", over_sales("SELECT query_id, round(lat, 6) AS lat, round(lon, 6) AS lon, source FROM by_tokens", LOOKUPS_CTE, _BOOK, _TOKENS))
def _(spark, d):
    s = sales(spark, d)
    r = resolve.resolve_by_tokens(location_lookups(spark, s), s)
    return r.select("query_id", *_point(r), "source")


@query("resolve_fuzzy", over_sales("SELECT query_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM by_fuzzy", LOOKUPS_CTE, _BOOK, _FUZZY))
def _(spark, d):
    s = sales(spark, d)
    r = resolve.resolve_fuzzy(location_lookups(spark, s), s)
    return r.select("query_id", *_point(r))


_CASCADE = f"""shaped AS (SELECT *, regexp_matches(trim(query), '^(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)$') AS is_raw, regexp_matches(trim(query), '^[A-Za-z]\\d{{1,2}}[A-Za-z]?$') AS is_key,
     regexp_matches(trim(query), '^[A-Za-z]\\d{{1,2}}\\s?[A-Za-z0-9]{{4}}$') AS is_full, {q.compact_postcode('query')} AS norm FROM lookups),
  coded AS (SELECT replace(upper(eircode), ' ', '') AS code, latitude, longitude FROM dwelling WHERE latitude IS NOT NULL AND eircode IS NOT NULL),
  stepped AS (SELECT s.*, kn, klat, klon, en, elat, elon, r.latitude AS rlat, r.longitude AS rlon FROM shaped s
     LEFT JOIN (SELECT query_id, count(*) AS kn, {q.mean('latitude')} AS klat, {q.mean('longitude')} AS klon FROM shaped JOIN coded ON starts_with(code, CASE WHEN is_key THEN upper(trim(query)) ELSE norm[1:3] END) WHERE is_key OR is_full GROUP BY 1) k USING (query_id)
     LEFT JOIN (SELECT code, count(*) AS en, {q.mean('latitude')} AS elat, {q.mean('longitude')} AS elon FROM coded GROUP BY 1) e ON is_full AND e.code = norm LEFT JOIN postcode_reference r ON is_full AND r.postcode = norm),
  judged AS (SELECT *, is_full AND en IS NOT NULL AND kn >= 5 AND NOT (abs(elat - klat) < 0.05 AND abs(elon - klon) < 0.08) AS bad FROM stepped),
  own AS (SELECT query_id, CASE WHEN bad THEN norm END AS flag_postcode,
     CASE WHEN is_raw THEN 'raw' WHEN is_key AND kn IS NOT NULL THEN 'db_routing_key' WHEN is_full AND en IS NOT NULL AND NOT bad THEN 'db_exact' WHEN is_full AND rlat IS NOT NULL THEN 'db_eircode_ref' WHEN is_full AND kn IS NOT NULL THEN 'db_routing_key' END AS source,
     CASE WHEN is_raw THEN CAST(split_part(query, ',', 1) AS DOUBLE) WHEN is_key AND kn IS NOT NULL THEN klat WHEN is_full AND en IS NOT NULL AND NOT bad THEN elat WHEN is_full AND rlat IS NOT NULL THEN rlat WHEN is_full THEN klat END AS lat,
     CASE WHEN is_raw THEN CAST(split_part(query, ',', 2) AS DOUBLE) WHEN is_key AND kn IS NOT NULL THEN klon WHEN is_full AND en IS NOT NULL AND NOT bad THEN elon WHEN is_full AND rlat IS NOT NULL THEN rlon WHEN is_full THEN klon END AS lon FROM judged)"""


@query("resolve_locations", over_sales(
    """SELECT o.query_id, flag_postcode, coalesce(o.source, t.source, f.source) AS source, round(CASE WHEN o.source IS NOT NULL THEN o.lat WHEN t.source IS NOT NULL THEN t.lat ELSE f.lat END, 6) AS lat,
       round(CASE WHEN o.source IS NOT NULL THEN o.lon WHEN t.source IS NOT NULL THEN t.lon ELSE f.lon END, 6) AS lon FROM own o LEFT JOIN by_tokens t USING (query_id) LEFT JOIN by_fuzzy f USING (query_id)""",
    LOOKUPS_CTE, POSTCODE_REF_CTE, _BOOK, _TOKENS, _FUZZY, _CASCADE))
def _(spark, d):
    s = sales(spark, d)
    r = resolve.resolve_locations(location_lookups(spark, s), s, stats.postcode_reference(s))
    return r.select("query_id", "flag_postcode", "source", *_point(r))


@query("flag_bad_postcodes", over_sales(
    "SELECT id, geocode_quality_issue OR EXISTS (SELECT 1 FROM own WHERE flag_postcode = replace(upper(eircode), ' ', '')) AS flagged FROM dwelling", LOOKUPS_CTE, POSTCODE_REF_CTE, _CASCADE))
def _(spark, d):
    s = sales(spark, d)
    r = resolve.resolve_locations(location_lookups(spark, s), s, stats.postcode_reference(s))
    return resolve.flag_bad_postcodes(s, r).select("id", F.col("geocode_quality_issue").alias("flagged"))


_HINT = f"""parts AS (SELECT query_id, list_filter(list_transform(string_split(query, ','), lambda p: trim(p)), lambda p: p <> '') AS p FROM lookups),
  tries AS (SELECT query_id, 1 AS no, lower(p[-1]) AS term FROM parts WHERE len(p) >= 2 UNION ALL SELECT query_id, 2, lower(p[-2] || ', ' || p[-1]) FROM parts WHERE len(p) >= 3),
  hints AS (SELECT query_id, no, term, {q.mean('latitude')} AS lat, {q.mean('longitude')} AS lon FROM tries JOIN words ON contains(a, term) JOIN book USING (a, c) WHERE length(term) >= 4 GROUP BY ALL
     HAVING count(*) >= 5 AND coalesce(stddev_samp(latitude), 0) < 0.4 AND coalesce(stddev_samp(longitude), 0) < 0.4)"""


@query("area_hint", over_sales(
    "SELECT query_id, round(lat, 6) AS lat, round(lon, 6) AS lon, term AS hint FROM hints QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY no) = 1", LOOKUPS_CTE, _BOOK, _HINT))
def _(spark, d):
    s = sales(spark, d)
    # the planted mis-located sales spread every cluster, hence the wider limit here
    r = resolve.area_hint(location_lookups(spark, s), s, spread=0.4)
    return r.select("query_id", *_point(r), "hint")


@query("postcode_confidence", over_sales(
    """SELECT code, round(coalesce(r.latitude, p.la), 6) AS lat, round(coalesce(r.longitude, p.lo), 6) AS lon, CASE WHEN r.postcode IS NOT NULL THEN 'postcode' ELSE 'routing_key' END AS source,
       CASE WHEN r.postcode IS NOT NULL THEN CASE WHEN lat_stddev < 0.001 AND lon_stddev < 0.001 THEN 'high' WHEN lat_stddev < 0.01 AND lon_stddev < 0.01 THEN 'medium' ELSE 'low' END ELSE 'medium' END AS confidence
       FROM (SELECT DISTINCT lower(eircode) AS code FROM dwelling WHERE eircode IS NOT NULL UNION SELECT DISTINCT eircode[1:3] FROM dwelling WHERE eircode IS NOT NULL) LEFT JOIN postcode_reference r ON r.postcode = replace(upper(code), ' ', '')
       LEFT JOIN (SELECT postcode[1:3] AS rk, avg(latitude) AS la, avg(longitude) AS lo FROM postcode_reference GROUP BY 1) p ON length(code) <= 4 AND rk = upper(code)[1:3] WHERE r.postcode IS NOT NULL OR rk IS NOT NULL""", POSTCODE_REF_CTE))
def _(spark, d):
    s = sales(spark, d)
    coded = s.where("eircode is not null")
    codes = coded.select(F.lower("eircode").alias("code")).union(coded.select(F.substring("eircode", 1, 3))).distinct()
    ref = stats.postcode_reference(s)
    r = resolve.postcode_confidence(codes, ref, stats.postcode_prefix_summary(ref))
    return r.select("code", *_point(r), "source", "confidence")


SUBJECT_CTES = (SUBJECTS_CTE, NORM_SALES, f"rks AS ({RK_STATS_SQL})",
    f"""asked_s AS (SELECT *, {q.norm_address('address')} AS norm, lower(coalesce(county, 'Dublin')) AS cty FROM subjects),
  located AS (SELECT id, address_normalized AS a, lower(county) AS c, latitude, longitude, bedrooms FROM normed WHERE latitude IS NOT NULL),
  pre AS (SELECT request_id, arg_min((l.id, latitude, longitude, l.bedrooms), l.id) AS hit FROM asked_s s JOIN located l ON starts_with(a, norm) AND c = cty GROUP BY 1),
  toks AS (SELECT request_id, cty, list_filter(regexp_extract_all(norm, '\\w+'), lambda w: length(w) >= 2 AND NOT list_contains(['the','and','dublin','ireland','co','county'], lower(w))) AS ts FROM asked_s ANTI JOIN pre USING (request_id)),
  flex AS (SELECT request_id, arg_min((l.id, latitude, longitude, l.bedrooms), (length(a), l.id)) AS hit FROM toks JOIN located l ON c = cty AND len(ts) >= 3 AND len(list_filter(ts[1:6], lambda w: NOT contains(lower(a), lower(w)))) = 0 GROUP BY 1),
  both_hits AS (SELECT * FROM pre UNION ALL SELECT * FROM flex),
  placed AS (SELECT s.*, struct_extract_at(hit, 2) AS hla, struct_extract_at(hit, 3) AS hlo, struct_extract_at(hit, 4) AS hb, centroid_lat, centroid_lon, CASE WHEN routing_key IS NOT NULL THEN least(0.85, 0.70::DOUBLE + property_count / 1000.0::DOUBLE * 0.15::DOUBLE) END AS kconf
     FROM asked_s s LEFT JOIN both_hits USING (request_id) LEFT JOIN rks ON routing_key = upper(eircode[1:3]) AND property_count >= 5),
  resolved AS (SELECT request_id, use_hit, CASE WHEN use_hit THEN hla ELSE centroid_lat END AS lat, CASE WHEN use_hit THEN hlo ELSE centroid_lon END AS lon, CASE WHEN use_hit THEN 0.8::DOUBLE ELSE kconf END AS location_confidence,
     CASE WHEN use_hit THEN 'database_exact' WHEN kconf IS NOT NULL THEN 'eircode_routing_key' END AS method, coalesce(bedrooms, CASE WHEN use_hit THEN hb END) AS bedrooms
     FROM (SELECT *, hla IS NOT NULL AND NOT coalesce({q.haversine('hla', 'hlo', 'centroid_lat', 'centroid_lon')} / 1000 > 30, false) AS use_hit FROM placed))""")


@query("resolve_subject", over_sales("SELECT request_id, lat, lon, location_confidence, method, bedrooms FROM resolved", *SUBJECT_CTES))
def _(spark, d):
    s = sales(spark, d)
    return resolve.resolve_subjects(valuation_requests(spark, s), s, stats.routing_key_stats(s)).select(
        "request_id", "lat", "lon", "location_confidence", "method", "bedrooms")
