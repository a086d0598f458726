"""Registered queries: coordinate quality, repair, enrichment, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.fixtures import ALT_CTE, CANDIDATES_CTE, alt_coordinates, dwelling_sales, geocode_candidates, sales, table
from dwellspark.functions.geo import round_to
from dwellspark.operators import quality, repair, stats
from dwellspark.plans import sqltext as q
from dwellspark.plans.aggregates import RK_STATS_SQL
from dwellspark.plans.registry import over_sales, query
from dwellspark.plans.searches import NORM_SALES

_LAT_DEC = r"length(regexp_extract(CAST({} AS VARCHAR), '^-?\d+\.(\d+)$', 1))"


def _score_sql(lat: str, lon: str) -> tuple[str, str]:
    """Score and issue text over a row joined with its county box and crowd flag."""
    dla, dlo = _LAT_DEC.format(lat), _LAT_DEC.format(lon)
    mism = f"coalesce(NOT ({lat} BETWEEN minlat AND maxlat AND {lon} BETWEEN minlon AND maxlon), false)"
    crowd = f"EXISTS (SELECT 1 FROM crowd c WHERE c.la = round({lat}, 6) AND c.lo = round({lon}, 6))"
    oob = f"NOT ({lat} BETWEEN 51.4 AND 55.5 AND {lon} BETWEEN -10.7 AND -5.4)"
    fine, coarse = f"({dla} >= 6 AND {dlo} >= 6)", f"({dla} <= 3 OR {dlo} <= 3)"
    score = (f"CASE WHEN {lat} IS NULL OR {lon} IS NULL OR {oob} THEN 0 ELSE greatest(0, least(100, 100 - CASE WHEN {crowd} THEN 80 ELSE 0 END "
             f"- CASE WHEN {mism} THEN 50 ELSE 0 END + CASE WHEN {fine} THEN 5 WHEN {coarse} THEN -10 ELSE 0 END)) END")
    issues = (f"CASE WHEN {lat} IS NULL OR {lon} IS NULL THEN 'Missing coordinates' WHEN {oob} THEN 'Out of bounds' ELSE concat_ws('; ', CASE WHEN {crowd} THEN 'Known centroid coordinate' END, "
              f"CASE WHEN {mism} THEN 'County mismatch' END, CASE WHEN {fine} THEN 'High precision (good)' WHEN {coarse} THEN 'Low precision' END) END")
    return score, issues


_CROWD = """crowd AS (SELECT la, lo FROM (SELECT round(latitude, 6) AS la, round(longitude, 6) AS lo FROM dwelling WHERE latitude IS NOT NULL UNION ALL SELECT round(latitude, 6), round(longitude, 6) FROM alt)
   GROUP BY ALL HAVING count(*) >= 50)"""
_S, _I = _score_sql("latitude", "longitude")


@query("coordinate_score", over_sales(f"SELECT id, CAST({_S} AS INT) AS score, {_I} AS issues FROM dwelling JOIN bounds USING (county)", ALT_CTE, _CROWD))
def _(spark, d):
    s = dwelling_sales(spark, d)
    points = quality.crowded_points(s, alt_coordinates(s))
    return quality.score_coordinates(s, points).select("id", "score", F.array_join("issues", "; ").alias("issues"))


_BS, _ = _score_sql("b.latitude", "b.longitude")
_SS, _ = _score_sql("s.latitude", "s.longitude")


@query("choose_coordinates", over_sales(
    """SELECT id, CAST(bs AS INT) AS base_score, CAST(ss AS INT) AS second_score, src AS chosen_source, chosen_lat, chosen_lon,
       concat(CASE WHEN alone THEN 'base only' WHEN bs < 20 AND ss < 20 THEN 'both sources low' WHEN ss < 20 THEN 'base better' WHEN bs < 20 THEN 'second better' WHEN ss > bs + 10 THEN 'second higher quality'
         WHEN bs > ss + 10 THEN 'base higher quality' ELSE 'second preferred, similar scores' END, ' (', bs, ' vs ', ss, ')') AS reason,
       CASE WHEN src = 'none' THEN 'nullify' WHEN chosen_lat <> la OR chosen_lon <> lo THEN 'update' ELSE 'no_change' END AS change
       FROM (SELECT *, CASE src WHEN 'base' THEN la WHEN 'second' THEN sla END AS chosen_lat, CASE src WHEN 'base' THEN lo WHEN 'second' THEN slo END AS chosen_lon FROM (SELECT *,
         CASE WHEN alone THEN CASE WHEN bs >= 20 THEN 'base' ELSE 'none' END WHEN bs < 20 AND ss < 20 THEN 'none' WHEN ss < 20 THEN 'base' WHEN bs < 20 THEN 'second' WHEN bs > ss + 10 THEN 'base' ELSE 'second' END AS src FROM scored))""",
    ALT_CTE, _CROWD,
    "last_base AS (SELECT upper(trim(address)) AS key, max(id) AS id, arg_max(latitude, id) AS latitude, arg_max(longitude, id) AS longitude, arg_max(county, id) AS county FROM dwelling WHERE latitude IS NOT NULL GROUP BY 1)",
    "second_src AS (SELECT upper(trim(address)) AS key, max((latitude, longitude)) AS p, true AS both_there FROM alt WHERE county <> 'Kerry' GROUP BY 1), second_pts AS (SELECT key, p[1] AS latitude, p[2] AS longitude, both_there FROM second_src)".replace("p[1]", "struct_extract_at(p, 1)").replace("p[2]", "struct_extract_at(p, 2)"),
    f"scored AS (SELECT b.id, b.latitude AS la, b.longitude AS lo, s.latitude AS sla, s.longitude AS slo, both_there IS NULL AS alone, {_BS} AS bs, CASE WHEN both_there IS NULL THEN 0 ELSE {_SS} END AS ss FROM last_base b LEFT JOIN second_pts s USING (key) JOIN bounds ON bounds.county = b.county)".replace(
        "AS bs, CASE", "AS bs, CASE")))
def _(spark, d):
    s = dwelling_sales(spark, d)
    second = alt_coordinates(s)
    out = quality.choose_coordinates(s, second.where("county <> 'Kerry'").unionByName(
        second.where("county = 'Kerry'").withColumn("address", F.concat(F.lit("~"), F.col("address")))))
    return out.select("id", "base_score", "second_score", "chosen_source", "chosen_lat", "chosen_lon", "reason", "change")


_FLAG_CTES = (NORM_SALES, f"rks AS ({RK_STATS_SQL})",
    "crowd2 AS (SELECT latitude, longitude, count(DISTINCT address) AS crowd FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL)",
    f"""flagged AS (SELECT s.id, coalesce(NOT (s.latitude BETWEEN minlat-0.2 AND maxlat+0.2 AND s.longitude BETWEEN minlon-0.2 AND maxlon+0.2), false) AS county_bad,
        coalesce({q.haversine('s.latitude', 's.longitude', 'centroid_lat', 'centroid_lon')} / 1000 > 40, false) AS key_bad, coalesce(crowd >= 50, false) AS crowd_suspect, coalesce(crowd >= 30, false) AS crowd_worklist, s.latitude
        FROM normed s JOIN bounds ON bounds.county = s.county LEFT JOIN rks ON rks.routing_key = s.routing_key AND geocoded_count >= 20 LEFT JOIN crowd2 c ON c.latitude = s.latitude AND c.longitude = s.longitude)""")


@query("flag_suspect", over_sales(
    "SELECT id, county_bad, key_bad, county_bad OR key_bad OR crowd_suspect AS geocode_suspect, latitude IS NULL OR county_bad OR key_bad OR crowd_worklist AS needs_geocoding FROM flagged", *_FLAG_CTES))
def _(spark, d):
    s = sales(spark, d)
    return quality.flag_geocodes(s, stats.routing_key_stats(s)).select(
        "id", "county_bad", "key_bad", "geocode_suspect", "needs_geocoding")


@query("incremental_flags", over_sales(
    "SELECT id, county_bad OR key_bad OR crowd_suspect AS geocode_suspect, latitude IS NULL OR county_bad OR key_bad OR crowd_worklist AS needs_geocoding FROM flagged", *_FLAG_CTES))
def _(spark, d):
    s = sales(spark, d)
    base, new = s.where("id % 40 <> 0"), s.where("id % 40 = 0")
    state = lambda rows: stats.routing_key_state(rows)
    before = quality.flag_geocodes(base, stats.stats_of_state(state(base))).select("id", "geocode_suspect", "needs_geocoding")
    merged = stats.stats_of_state(stats.merge_key_states(state(base).union(state(new))))
    after = quality.refresh_flags(s, new, merged)
    return before.join(after.select("id"), "id", "left_anti").unionByName(after)


_CAND_ROWS = """cand AS (SELECT c.*, county, routing_key, CASE id%3 WHEN 0 THEN 'rooftop' WHEN 1 THEN 'parcel' END AS precision FROM candidates c JOIN normed USING (id)),
  cand_keyed AS (SELECT c.*, centroid_lat, centroid_lon, minlat, maxlat, minlon, maxlon FROM cand c JOIN bounds USING (county) LEFT JOIN rks ON rks.routing_key = c.routing_key)"""


def _judged_input(spark, d):
    s = sales(spark, d)
    extra = s.select("id", "county", "routing_key")
    precision = F.when(F.col("id") % 3 == 0, "rooftop").when(F.col("id") % 3 == 1, "parcel")
    return geocode_candidates(s).join(extra, "id").withColumn("precision", precision), stats.routing_key_stats(s)


_JUDGE = f"""judged AS (SELECT *, CASE WHEN reason <> 'validated' THEN 0 WHEN cand_lat BETWEEN minlat AND maxlat AND cand_lon BETWEEN minlon AND maxlon THEN q ELSE least(q, 70) END AS quality FROM (
   SELECT *, CASE WHEN cand_lat IS NULL THEN 'no_result' WHEN NOT (cand_lat BETWEEN 51.4 AND 55.5 AND cand_lon BETWEEN -10.7 AND -5.4) THEN 'out_of_bounds'
     WHEN {q.haversine('cand_lat', 'cand_lon', 'centroid_lat', 'centroid_lon')} > 40000 THEN 'routing_key_far'
     WHEN NOT (cand_lat BETWEEN minlat-0.2 AND maxlat+0.2 AND cand_lon BETWEEN minlon-0.2 AND maxlon+0.2) THEN 'wrong_county' ELSE 'validated' END AS reason,
     CASE feature_type WHEN 'address' THEN CASE precision WHEN 'rooftop' THEN 100 WHEN 'parcel' THEN 90 ELSE 80 END WHEN 'postcode' THEN 85 WHEN 'poi' THEN 75 WHEN 'street' THEN 75 ELSE 70 END AS q FROM cand_keyed))"""


@query("validate_candidate", over_sales("SELECT id, source, reason, CAST(quality AS INT) AS quality FROM judged", CANDIDATES_CTE, NORM_SALES, f"rks AS ({RK_STATS_SQL})", _CAND_ROWS, _JUDGE))
def _(spark, d):
    cands, keys = _judged_input(spark, d)
    return quality.validate_candidates(cands, keys).select("id", "source", "reason", "quality")


@query("validate_by_degree_gap", over_sales(
    """SELECT id, source, CAST(CASE WHEN cand_lat IS NULL OR NOT (cand_lat BETWEEN 51.4 AND 55.5 AND cand_lon BETWEEN -10.7 AND -5.4) OR NOT (abs(cand_lat - centroid_lat) < 0.05 AND abs(cand_lon - centroid_lon) < 0.08) THEN 0
       WHEN centroid_lat IS NOT NULL THEN 100 WHEN cand_lat BETWEEN minlat AND maxlat AND cand_lon BETWEEN minlon AND maxlon THEN 90 ELSE 70 END AS INT) AS quality FROM cand_keyed""",
    CANDIDATES_CTE, NORM_SALES, f"rks AS ({RK_STATS_SQL})", _CAND_ROWS))
def _(spark, d):
    cands, keys = _judged_input(spark, d)
    return quality.validate_by_degree_gap(cands, keys).select("id", "source", "quality")


@query("check_register_coordinates", over_sales(
    """SELECT id, CASE WHEN la IS NULL OR longitude IS NULL THEN 'no_coordinates' WHEN NOT (la BETWEEN 51.4 AND 55.5 AND longitude BETWEEN -10.7 AND -5.4) THEN 'out_of_bounds' ELSE 'ok' END AS "check"
       FROM (SELECT id, CASE WHEN id%11=0 THEN latitude + 3 ELSE latitude END AS la, longitude FROM dwelling)"""))
def _(spark, d):
    la = F.when(F.col("id") % 11 == 0, F.col("latitude") + 3).otherwise(F.col("latitude"))
    return quality.check_register_coordinates(dwelling_sales(spark, d).withColumn("latitude", la)).select("id", "check")


@query("apply_candidates", over_sales(
    """SELECT s.id, coalesce(b.cand_lat, latitude) AS latitude, coalesce(b.cand_lon, longitude) AS longitude, CASE WHEN b.id IS NOT NULL THEN false ELSE s.geocode_suspect END AS geocode_suspect, CASE WHEN b.id IS NOT NULL THEN false ELSE s.latitude IS NULL END AS needs_geocoding
       FROM dwelling s LEFT JOIN (SELECT * FROM judged WHERE quality >= 70 QUALIFY row_number() OVER (PARTITION BY id ORDER BY quality DESC, source DESC) = 1) b ON b.id = s.id""",
    CANDIDATES_CTE, NORM_SALES, f"rks AS ({RK_STATS_SQL})", _CAND_ROWS, _JUDGE))
def _(spark, d):
    cands, keys = _judged_input(spark, d)
    s = dwelling_sales(spark, d).withColumn("needs_geocoding", F.col("latitude").isNull())
    return repair.apply_candidates(s, quality.validate_candidates(cands, keys)).select(
        "id", "latitude", "longitude", "geocode_suspect", "needs_geocoding")


@query("apply_manual_updates", over_sales(
    """SELECT id, CASE WHEN id%9=0 THEN 53.1::DOUBLE ELSE latitude END AS latitude, CASE WHEN id%18=0 THEN '1 New Street' ELSE address END AS address, CASE WHEN id%27=0 THEN 'A11 BCDE' ELSE eircode END AS eircode FROM dwelling"""))
def _(spark, d):
    s = dwelling_sales(spark, d)
    i = F.col("id")
    updates = s.where("id % 9 = 0").select(
        "id", F.lit(53.1).alias("new_lat"), F.lit(-7.0).alias("new_lon"), F.when(i % 18 == 0, " 1 New Street ").otherwise("").alias("new_address"),
        F.when(i % 27 == 0, "a11 bcde").alias("new_eircode"))
    return repair.apply_manual_updates(s, updates).select("id", "latitude", "address", "eircode")


_CANON = ("canon_pairs AS (SELECT address, geocode_quality_issue AS f, latitude, longitude, count(*) AS n, max(sale_date) AS d FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL)",
          "canon_xy AS (SELECT address, latitude AS canon_lat, longitude AS canon_lon FROM canon_pairs QUALIFY row_number() OVER (PARTITION BY address ORDER BY f, n DESC, d DESC, latitude, longitude) = 1)",
          *[f"canon_{c} AS (SELECT address, {c} AS canon_{c} FROM (SELECT address, {c}, count(*) AS n, max(sale_date) AS d, max(price) AS p FROM dwelling WHERE {c} IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY address ORDER BY n DESC, d DESC, p DESC, CAST({c} AS VARCHAR) DESC) = 1)"
            for c in ("bedrooms", "property_type")])


@query("canonical_coordinate", over_sales("SELECT * FROM canon_xy", *_CANON))
def _(spark, d):
    return repair.canonical_coordinates(dwelling_sales(spark, d), "address")


@query("canonical_attribute", over_sales("SELECT address, canon_bedrooms, canon_property_type FROM canon_bedrooms FULL JOIN canon_property_type USING (address)", *_CANON))
def _(spark, d):
    return repair.canonical_attributes(dwelling_sales(spark, d), "address")


_REPAIR = (*_CANON, """fixed AS (SELECT s.id, s.address, s.latitude AS ola, s.longitude AS olo, s.bedrooms AS ob, s.property_type AS ot,
    CASE WHEN bad THEN coalesce(canon_lat, latitude) ELSE latitude END AS latitude, CASE WHEN bad THEN coalesce(canon_lon, longitude) ELSE longitude END AS longitude,
    CASE WHEN bad THEN coalesce(canon_bedrooms, bedrooms) ELSE bedrooms END AS bedrooms, CASE WHEN bad THEN coalesce(canon_property_type, property_type) ELSE property_type END AS property_type
    FROM dwelling s JOIN (SELECT address, count(DISTINCT latitude) > 1 OR count(DISTINCT longitude) > 1 OR count(DISTINCT bedrooms) > 1 OR count(DISTINCT property_type) > 1 AS bad FROM dwelling GROUP BY address) USING (address)
    LEFT JOIN canon_xy USING (address) LEFT JOIN canon_bedrooms USING (address) LEFT JOIN canon_property_type USING (address))""")


@query("repair_inconsistent", over_sales("SELECT id, latitude, longitude, bedrooms, property_type FROM fixed", *_REPAIR))
def _(spark, d):
    fixed, _audit = repair.repair_inconsistent(dwelling_sales(spark, d))
    return fixed.select("id", "latitude", "longitude", "bedrooms", "property_type")


@query("repair_audit", over_sales(
    """SELECT field, count(*) AS n, count(old_value) AS had_value FROM (SELECT 'latitude' AS field, CAST(ola AS VARCHAR) AS old_value FROM fixed WHERE latitude IS DISTINCT FROM ola UNION ALL SELECT 'longitude', CAST(olo AS VARCHAR) FROM fixed WHERE longitude IS DISTINCT FROM olo
       UNION ALL SELECT 'bedrooms', CAST(ob AS VARCHAR) FROM fixed WHERE bedrooms IS DISTINCT FROM ob UNION ALL SELECT 'property_type', ot FROM fixed WHERE property_type IS DISTINCT FROM ot) GROUP BY field""", *_REPAIR))
def _(spark, d):
    _fixed, audit = repair.repair_inconsistent(dwelling_sales(spark, d))
    return audit.groupBy("field").agg(F.count("*").alias("n"), F.count("old_value").alias("had_value"))


@query("lookup_plan", over_sales(
    """SELECT address, canon_lat IS NULL AS needs_geocoding, canon_lat IS NULL OR canon_bedrooms IS NULL OR canon_property_type IS NULL AS needs_enrichment FROM (SELECT DISTINCT address FROM dwelling)
       LEFT JOIN canon_xy USING (address) LEFT JOIN canon_bedrooms USING (address) LEFT JOIN canon_property_type USING (address)""", *_CANON))
def _(spark, d):
    return repair.lookup_plan(dwelling_sales(spark, d), "address")


@query("impute_exact_address", over_sales(
    """SELECT m.id, latitude AS imputed_lat, longitude AS imputed_lon, n AS support FROM (SELECT id, county, """ + q.match_key("address") + """ AS key FROM dwelling WHERE latitude IS NULL) m JOIN
       (SELECT county, key, latitude, longitude, n FROM (SELECT county, """ + q.match_key("address") + """ AS key, latitude, longitude, count(*) AS n FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY county, key ORDER BY n DESC, latitude, longitude) = 1) USING (county, key)"""))
def _(spark, d):
    return repair.impute_exact(dwelling_sales(spark, d)).select("id", "imputed_lat", "imputed_lon", "support")


@query("impute_same_street", over_sales(
    f"""SELECT id, latitude AS imputed_lat, longitude AS imputed_lon, n AS support FROM (SELECT id, county, {q.match_key('street')} AS st FROM street_rows WHERE latitude IS NULL) m JOIN
       (SELECT county, st, latitude, longitude, n FROM (SELECT k.county, st, latitude, longitude, count(*) AS n FROM (SELECT DISTINCT county, {q.match_key('street')} AS st FROM street_rows WHERE latitude IS NULL) k
          JOIN dwelling s ON s.county = k.county AND contains({q.match_key('s.address')}, st) WHERE latitude IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
        QUALIFY row_number() OVER (PARTITION BY county, st ORDER BY n DESC, latitude, longitude) = 1) USING (county, st)""", q.STREET_KEY_CTES))
def _(spark, d):
    return repair.impute_same_street(dwelling_sales(spark, d)).select("id", "imputed_lat", "imputed_lon", "support")


_PATTERN = r"lower(trim(regexp_replace(address, '^(no\.?\s*)?(\d+[a-z]?\s*,?\s*)', '', 'i')))"


@query("impute_street_mean", over_sales(
    f"""SELECT id, round(la, 8) AS imputed_lat, round(lo, 8) AS imputed_lon, n AS support, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT id, county, {_PATTERN} AS p FROM dwelling WHERE latitude IS NULL AND length(address) > 20)
       JOIN (SELECT county, {_PATTERN} AS p, {q.mean('latitude')} AS la, {q.mean('longitude')} AS lo, count(*) AS n FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) USING (county, p) WHERE length(p) >= 15"""))
def _(spark, d):
    return repair.impute_street_mean(dwelling_sales(spark, d)).select(
        "id", round_to("imputed_lat", 8).alias("imputed_lat"), round_to("imputed_lon", 8).alias("imputed_lon"), "support", "confidence")


@query("propagate_postcodes", over_sales(
    "SELECT id, coalesce(eircode, e) AS eircode FROM normed LEFT JOIN (SELECT address_normalized, max(eircode) AS e FROM normed GROUP BY 1 HAVING count(DISTINCT eircode) = 1) USING (address_normalized)", NORM_SALES))
def _(spark, d):
    return repair.propagate_postcodes(sales(spark, d)).select("id", "eircode")


_RESULTS = """results AS (SELECT id AS result_id, address, CASE WHEN id%2=0 THEN eircode END AS eircode, CASE WHEN id%3=0 THEN CAST(1 + id%6 AS INT) END AS bedrooms, CASE WHEN id%5=0 THEN 'cottage' WHEN id%7=0 THEN 'bungalow' END AS property_type FROM dwelling WHERE id%8 = 1 OR id%15 = 0 OR id%22 = 0)"""


def listing_results(s):
    i = F.col("id")
    return s.where("id % 8 = 1 or id % 15 = 0 or id % 22 = 0").select(
        i.alias("result_id"), "address", F.when(i % 2 == 0, F.col("eircode")).alias("eircode"),
        F.when(i % 3 == 0, (1 + i % 6).cast("int")).alias("bedrooms"),
        F.when(i % 5 == 0, "cottage").when(i % 7 == 0, "bungalow").alias("property_type"))


@query("propagate_enrichment", over_sales(
    """SELECT id, coalesce(nb, bedrooms) AS bedrooms, CASE WHEN take THEN nt ELSE property_type END AS property_type, CASE WHEN take OR (tried AND nothing AND bedrooms IS NULL AND property_type IS NULL AND property_type_source IS NULL) THEN 'web_enrichment' ELSE property_type_source END AS property_type_source
       FROM (SELECT *, nt IS NOT NULL AND property_type_source IS DISTINCT FROM 'address_apartment' AS take FROM (
         SELECT s.id, s.bedrooms, s.property_type, s.property_type_source, arg_max(r.bedrooms, r.result_id) FILTER (r.bedrooms IS NOT NULL AND fits) AS nb, arg_max(r.property_type, r.result_id) FILTER (r.property_type IS NOT NULL AND fits) AS nt,
           count(r.result_id) > 0 AS tried, count(r.bedrooms) = 0 AND count(r.property_type) = 0 AS nothing
         FROM (SELECT s.*, r.result_id AS rid, s.eircode IS NULL OR r.eircode IS NULL OR r.eircode = s.eircode AS fits FROM dwelling s LEFT JOIN results r USING (address)) s LEFT JOIN results r ON r.result_id = s.rid GROUP BY ALL))""", _RESULTS))
def _(spark, d):
    s = dwelling_sales(spark, d)
    return repair.apply_enrichment(s, listing_results(s)).select("id", "bedrooms", "property_type", "property_type_source")


_LISTINGS = """listing AS (SELECT page_id, html, address, county, eircode, CASE page_id%3 WHEN 0 THEN coalesce(eircode, '') || ' Listing A, 3 bed' WHEN 1 THEN lower(address) || ' 2 bed terraced' ELSE 'Elsewhere town' END AS own,
   string_split(html, '<p>') AS parts FROM pages JOIN dwelling ON id = page_id)"""


def listing_pages(spark, d):
    """Each page with the sale it was looked up for and a block about that sale."""
    k = F.col("page_id") % 3
    own = (F.when(k == 0, F.concat(F.coalesce("eircode", F.lit("")), F.lit(" Listing A, 3 bed")))
           .when(k == 1, F.concat(F.lower("address"), F.lit(" 2 bed terraced"))).otherwise("Elsewhere town"))
    return (table(spark, d, "pages").join(dwelling_sales(spark, d).select("id", "address", "county", "eircode"), F.col("id") == F.col("page_id"))
            .withColumn("blocks", F.concat(F.array(own), F.split("html", "<p>"))))


_STOP = "['the','and','of','co','county','ireland','road','street','avenue','drive','close','court','park','lane','apt','apartment','flat','unit','block','property','properties','town','saint']"


@query("match_listing_blocks", over_sales(
    """SELECT page_id, md5(CASE WHEN len(coded) > 0 THEN array_to_string(coded, ' ') WHEN len(tokens) > 0 AND best >= 1 THEN array_to_string(list_transform(list_filter(list_zip(blocks, hits), lambda z: z[2] >= CASE WHEN best >= 2 THEN greatest(2, best - 1) ELSE 1 END), lambda z: z[1]), ' ') ELSE html END) AS focused
       FROM (SELECT *, list_max(hits) AS best FROM (SELECT *, list_transform(blocks, lambda b: len(list_filter(tokens, lambda t: contains(lower(b), t)))) AS hits FROM
         (SELECT *, list_prepend(own, parts) AS blocks, list_filter(list_prepend(own, parts), lambda b: coalesce(contains(replace(upper(b), ' ', ''), replace(upper(eircode), ' ', '')), false)) AS coded,
            list_filter(list_distinct(regexp_extract_all(lower(address), '[a-z]{3,}')), lambda t: NOT list_contains(""" + _STOP + """, t) AND NOT list_contains(regexp_extract_all(lower(county), '[a-z]{3,}'), t)) AS tokens FROM listing)))""", _LISTINGS))
def _(spark, d):
    focus = repair.match_listing_blocks("address", "county", "eircode", "blocks", "html")
    return listing_pages(spark, d).select("page_id", F.md5(focus).alias("focused"))


_TAGLESS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')"


@query("extract_from_pages",
       f"""SELECT page_id, {q.bedrooms('t')} AS bedrooms, CASE WHEN contains(l,'semi-detached') OR contains(l,'semi detached') OR contains(l,'semidetached') THEN 'semi-detached' WHEN contains(l,'detached') THEN 'detached' WHEN contains(l,'terrace') OR contains(l,'townhouse') THEN 'terraced'
        WHEN contains(l,'apartment') OR contains(l,'apt') OR contains(l,'flat') THEN 'apartment' WHEN contains(l,'duplex') THEN 'duplex' WHEN contains(l,'bungalow') THEN 'bungalow' WHEN contains(l,'cottage') THEN 'cottage' WHEN contains(l,'house') THEN 'house' END AS property_type
        FROM (SELECT page_id, t, lower(t) AS l FROM (SELECT page_id, {_TAGLESS} AS t FROM (SELECT page_id, html || CASE page_id%4 WHEN 0 THEN '<p>4 <b>bed</b> detached</p>' WHEN 1 THEN '<script>9 bed</script><p>Apt</p>' WHEN 2 THEN '<!-- 7 bed --><p>12 bed cottage</p>' ELSE '' END AS h FROM pages)))""")
def _(spark, d):
    k = F.col("page_id") % 4
    add = (F.when(k == 0, "<p>4 <b>bed</b> detached</p>").when(k == 1, "<script>9 bed</script><p>Apt</p>")
           .when(k == 2, "<!-- 7 bed --><p>12 bed cottage</p>").otherwise(""))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", add).alias("html"))
    return repair.extract_listings(pages)


_REPORT_SQL = f"""
report AS (
 {" UNION ALL ".join(f"SELECT 'completeness' AS name, 'info' AS status, 'null_{c}' AS metric, CAST(count(*) - count({c}) AS DOUBLE) AS value FROM normed" for c in ("latitude", "longitude", "eircode", "address", "address_normalized", "sale_date", "price", "county", "property_type", "bedrooms", "routing_key"))}
 UNION ALL SELECT 'completeness', 'info', 'total_rows', count(*) FROM normed
 UNION ALL SELECT 'geocoding_quality', CASE WHEN oob > 0 THEN 'fail' WHEN round(cr * 100.0::DOUBLE / total, 2) > 5.0 OR ng > 5000 THEN 'warn' ELSE 'ok' END, m, v FROM (SELECT *, unnest([struct_pack(m := 'out_of_bounds', v := CAST(oob AS DOUBLE)), {{'m': 'centroid_rows', 'v': cr}}, {{'m': 'centroid_pct', 'v': round(cr * 100.0::DOUBLE / total, 2)}}, {{'m': 'needs_geocoding', 'v': ng}}], recursive := true)
   FROM (SELECT count(*) FILTER (NOT (latitude BETWEEN 51.4 AND 55.5 AND longitude BETWEEN -10.7 AND -5.4)) AS oob, count(*) FILTER (latitude IS NULL) AS ng, count(*) AS total,
     (SELECT count(*) FROM dwelling p JOIN (SELECT latitude AS a, longitude AS b FROM dwelling WHERE latitude IS NOT NULL GROUP BY ALL HAVING count(DISTINCT address) >= 100) ON abs(p.latitude - a) < 1e-6 AND abs(p.longitude - b) < 1e-6) AS cr FROM normed))
 UNION ALL SELECT 'price_sanity', CASE WHEN uo > 2000 THEN 'warn' ELSE 'ok' END, m, v FROM (SELECT *, unnest([struct_pack(m := 'min_price', v := mn), {{'m': 'max_price', 'v': mx}}, {{'m': 'avg_price', 'v': av}}, {{'m': 'median_price', 'v': md}}, {{'m': 'below_10k', 'v': lo}}, {{'m': 'above_20m', 'v': hi}}, {{'m': 'unflagged_outliers', 'v': uo}}], recursive := true)
   FROM (SELECT CAST(min(price) AS DOUBLE) AS mn, CAST(max(price) AS DOUBLE) AS mx, CAST(sum(price) AS DOUBLE)/count(*) AS av, quantile_cont(CAST(price AS DOUBLE), 0.5) AS md, count(*) FILTER (price < 10000) AS lo, count(*) FILTER (price > 20000000) AS hi, count(*) FILTER ((price < 10000 OR price > 20000000) AND NOT not_full_market_price) AS uo FROM normed))
 UNION ALL SELECT 'date_sanity', 'warn', m, v FROM (SELECT unnest([struct_pack(m := 'future_dated', v := CAST(count(*) FILTER (sale_date > DATE '2001-06-01') AS DOUBLE)), {{'m': 'before_2010', 'v': count(*) FILTER (sale_date < DATE '2010-01-01')}}], recursive := true) FROM normed)
 UNION ALL SELECT 'duplicates', CASE WHEN r > 2000 THEN 'warn' ELSE 'info' END, m, v FROM (SELECT *, unnest([struct_pack(m := 'duplicate_groups', v := CAST(g AS DOUBLE)), {{'m': 'redundant_rows', 'v': r}}], recursive := true) FROM (SELECT count(*) AS g, coalesce(sum(c - 1), 0) AS r FROM (SELECT count(*) AS c FROM normed GROUP BY address_normalized, sale_date, price HAVING count(*) > 1)))
 UNION ALL SELECT 'county_distribution', CASE WHEN count(DISTINCT county) = 26 THEN 'ok' ELSE 'warn' END, 'distinct_counties', count(DISTINCT county) FROM normed
 UNION ALL SELECT 'property_type_provenance', 'info', 'populated', count(property_type) FROM normed UNION ALL SELECT 'property_type_provenance', 'info', coalesce(property_type_source, 'none'), count(*) FROM normed WHERE property_type IS NOT NULL GROUP BY 3
 UNION ALL SELECT 'eircode_consistency', CASE WHEN mm + mf > 0 THEN 'warn' ELSE 'ok' END, m, v FROM (SELECT *, unnest([struct_pack(m := 'routing_key_mismatch', v := CAST(mm AS DOUBLE)), {{'m': 'malformed_eircode', 'v': mf}}], recursive := true) FROM (SELECT count(*) FILTER (upper(eircode[1:3]) <> routing_key) AS mm, count(*) FILTER (NOT regexp_matches(eircode, '^[A-Za-z][0-9][0-9Ww]')) AS mf FROM normed))
 UNION ALL SELECT 'recent_geocode_coverage', CASE WHEN cur < 98.0 THEN 'warn' ELSE 'ok' END, m, p FROM (SELECT *, (SELECT arg_max(p, y) FROM ys) AS cur FROM (SELECT concat('pct_', y) AS m, p FROM ys UNION ALL SELECT 'current_year_pct', arg_max(p, y) FROM ys)))"""
_YEARS = "ys AS (SELECT year(sale_date) AS y, round(count(latitude) * 100.0::DOUBLE / count(*), 1) AS p FROM normed WHERE sale_date >= DATE '1998-01-01' GROUP BY 1)"


def _report(spark, d, s=None):
    s = (s if s is not None else sales(spark, d)).withColumn("needs_geocoding", F.col("latitude").isNull())
    return quality.quality_report(s, "2001-06-01", since="1998-01-01")


@query("quality_report", over_sales("SELECT * FROM report", NORM_SALES, _YEARS, _REPORT_SQL))
def _(spark, d):
    return quality.report_metrics(_report(spark, d))


# The register as it stood at the start of 2000: the same report over its earlier rows.
_EARLIER = "dwelling_b AS (SELECT * FROM dwelling WHERE sale_date < DATE '2000-01-01')"
_EARLIER_CTES = [c.replace("normed AS", "normed_b AS").replace("ys AS", "ys_b AS").replace("report AS", "report_b AS").replace("FROM normed", "FROM normed_b")
                 .replace("FROM dwelling", "FROM dwelling_b").replace("FROM ys", "FROM ys_b") for c in (NORM_SALES, _YEARS, _REPORT_SQL)]


@query("quality_trend", over_sales(
    """SELECT coalesce(a.name, b.name) AS name, coalesce(a.metric, b.metric) AS metric, a.value AS now_value, b.value AS base_value, a.value - b.value AS change,
       CASE WHEN b.value <> 0 THEN round((a.value - b.value) * 100.0::DOUBLE / b.value, 4) END AS change_pct,
       CASE WHEN a.value < b.value THEN 'down' WHEN a.value > b.value THEN 'up' WHEN a.value = b.value THEN 'same' END AS trend
       FROM report a FULL JOIN report_b b ON a.name = b.name AND a.metric = b.metric""", NORM_SALES, _YEARS, _REPORT_SQL, _EARLIER, *_EARLIER_CTES))
def _(spark, d):
    s = sales(spark, d)
    snapshot = lambda rows: quality.report_metrics(_report(spark, d, rows))
    return quality.quality_trend(snapshot(s), snapshot(s.where("sale_date < date'2000-01-01'")))
