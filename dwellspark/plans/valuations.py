"""Registered queries: valuation, back-test, studies, loans."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.fixtures import (AMENITY_CTE, REQUESTS_CTE, amenity_points, dwelling_sales, sales, search_requests, table,
                                 valuation_requests)
from dwellspark.functions.geo import round_to
from dwellspark.operators import search, stats, studies, valuation
from dwellspark.plans import sqltext as q
from dwellspark.plans.aggregates import INDEX_CTE
from dwellspark.plans.registry import over_sales, query
from dwellspark.plans.resolution import SUBJECT_CTES

AS_OF = "2001-08-01"


def _pipeline(subjects: str, min_n: int, strict: bool, rooms: bool, floor: int) -> tuple[str, ...]:
    """CTEs from `subjects` (subject_id, s_lat, s_lon, window_end, target_date, exclude_id,
    subject_bedrooms) to `comps`, `adjusted`, `weighted` and `valued`."""
    dist = q.haversine("s_lat", "s_lon", "latitude", "longitude")
    age = "date_diff('day', sale_date, window_end)"
    idx = lambda at, name: (f"LEFT JOIN price_index e{name} ON e{name}.county = c.county AND e{name}.month = date_trunc('month', {at}) "
                            f"LEFT JOIN (SELECT k.county, k.at, arg_min(i.price_index, (abs(date_diff('day', k.at, i.month)), i.month)) AS v FROM (SELECT DISTINCT county, {at} AS at FROM comps) k JOIN price_index i USING (county) GROUP BY ALL) n{name} ON n{name}.county = c.county AND n{name}.at = {at}")
    room = ("CASE WHEN bedrooms IS NULL OR subject_bedrooms IS NULL THEN 1.0::DOUBLE WHEN bedrooms = subject_bedrooms THEN 1.5 WHEN abs(bedrooms - subject_bedrooms) = 1 THEN 0.7 ELSE 0.2 END"
            if rooms else "1.0::DOUBLE")
    seq = lambda e: f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(cs, lambda x: {e})), lambda a, b: a + b)"
    near = "CASE WHEN dmax > 0 THEN 1.0::DOUBLE - dist / dmax ELSE 1.0::DOUBLE END"
    return (
        f"""cand_c AS (SELECT b.*, d.id, d.county, price, sale_date, bedrooms, {dist} AS dist, 1.0::DOUBLE - {age} / 1095.0::DOUBLE AS recency FROM {subjects} b JOIN dwelling d
            ON latitude IS NOT NULL AND NOT not_full_market_price AND price BETWEEN 50000 AND 5000000 AND {age} {'>' if strict else '>='} 0 AND {age} <= 1095 AND abs(latitude - s_lat) < 0.19 AND {dist} <= 20000 AND (exclude_id IS NULL OR d.id <> exclude_id))""",
        f"""rings_c AS (SELECT subject_id, CASE WHEN count(*) FILTER (dist <= 1000) >= {min_n} THEN 1000 WHEN count(*) FILTER (dist <= 2000) >= {min_n} THEN 2000 WHEN count(*) FILTER (dist <= 5000) >= {min_n} THEN 5000
            WHEN count(*) FILTER (dist <= 10000) >= {min_n} THEN 10000 ELSE 20000 END AS ring FROM cand_c GROUP BY 1)""",
        "comps AS (SELECT c.*, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY dist, sale_date DESC, id) AS INT) AS rank FROM cand_c c JOIN rings_c USING (subject_id) WHERE dist <= ring QUALIFY rank <= 30)",
        f"""adjusted AS (SELECT c.*, coalesce(coalesce(et.price_index, nt.v) / coalesce(es.price_index, ns.v), 1.0) AS factor,
            CAST(trunc(CAST(price AS DOUBLE) * coalesce(coalesce(et.price_index, nt.v) / coalesce(es.price_index, ns.v), 1.0)) AS BIGINT) AS adjusted_price FROM comps c {idx('sale_date', 's')} {idx('target_date', 't')})""",
        f"""raw_w AS (SELECT *, greatest(0.0::DOUBLE, ({near}) * ({near}) * recency * {room}) AS rw FROM (SELECT *, max(dist) OVER (PARTITION BY subject_id) AS dmax FROM adjusted)),
            weighted AS (SELECT *, CASE WHEN tw > 0 THEN rw / tw ELSE 1.0::DOUBLE / n END AS weight FROM (SELECT *, sum(rw) OVER (PARTITION BY subject_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tw, count(*) OVER (PARTITION BY subject_id) AS n FROM raw_w))""",
        f"""packed AS (SELECT subject_id, list({{'p': CAST(adjusted_price AS DOUBLE), 'w': weight, 'd': dist}} ORDER BY rank) AS cs, list_sort(list(adjusted_price)) AS ps, count(*) AS n FROM weighted GROUP BY subject_id),
            s1 AS (SELECT *, CAST(trunc({seq('x.p * x.w')}) AS BIGINT) AS estimate, {seq('x.p')} / n AS mean_p, {seq('x.d')} / n / 1000.0::DOUBLE AS km FROM packed),
            s2 AS (SELECT *, sqrt({seq('x.w * (x.p - estimate) * (x.p - estimate)')}) AS ws, CASE WHEN n > 1 THEN sqrt({seq('(x.p - mean_p) * (x.p - mean_p)')} / (n - 1)) ELSE 0.0::DOUBLE END AS sd, CASE WHEN n < 5 THEN 2.0::DOUBLE WHEN n < 10 THEN 1.5 ELSE 1.0 END AS kk FROM s1),
            s3 AS (SELECT *, CAST(trunc(greatest(0.0::DOUBLE, estimate - kk * ws)) AS BIGINT) AS ci_lower, CAST(trunc(estimate + kk * ws) AS BIGINT) AS ci_upper, round(CASE WHEN mean_p > 0 THEN sd / mean_p ELSE 0 END, 3) AS cv FROM s2),
            s4 AS (SELECT *, CASE WHEN n >= 10 THEN 1.0::DOUBLE WHEN n >= 5 THEN 0.7 WHEN n >= 3 THEN 0.4 ELSE 0.2 END AS f0, CASE WHEN km <= 3 THEN 1.0::DOUBLE WHEN km <= 10 THEN 0.7 WHEN km <= 20 THEN 0.4 ELSE 0.2 END AS f1, CASE WHEN cv <= 0.2 THEN 1.0::DOUBLE WHEN cv <= 0.35 THEN 0.7 WHEN cv <= 0.5 THEN 0.4 ELSE 0.2 END AS f2 FROM s3),
            valued AS (SELECT subject_id, CAST(n AS INT) AS n_comparables, estimate, ci_lower, ci_upper, CASE WHEN estimate > 0 THEN round((ci_upper - ci_lower) / CAST(estimate AS DOUBLE) * 100, 1) ELSE 0 END AS ci_width_pct, round(mean_p, 2) AS mean_price,
              CASE WHEN n % 2 = 1 THEN CAST(ps[n//2 + 1] AS DOUBLE) ELSE (ps[n//2] + ps[n//2 + 1]) / 2.0::DOUBLE END AS median_price, round(sd, 2) AS std_dev, cv, ps[1] AS min_price, ps[-1] AS max_price, round((f0 + f1 + f2) / 3.0::DOUBLE, 2) AS quality_score,
              CASE WHEN (f0 + f1 + f2) / 3.0::DOUBLE >= 0.75 THEN 'high' WHEN (f0 + f1 + f2) / 3.0::DOUBLE >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level, n >= 3 AND km <= 20 AND cv <= 0.5 AS is_valid,
              concat_ws(',', CASE f0 WHEN 0.7 THEN 'COMPARABLES_MODERATE' WHEN 0.4 THEN 'COMPARABLES_LOW' WHEN 0.2 THEN 'COMPARABLES_VERY_LOW' END, CASE f1 WHEN 0.7 THEN 'DISTANCE_MODERATE' WHEN 0.4 THEN 'DISTANCE_HIGH' WHEN 0.2 THEN 'DISTANCE_VERY_HIGH' END,
                CASE f2 WHEN 0.7 THEN 'PRICE_VARIATION_MODERATE' WHEN 0.4 THEN 'PRICE_VARIATION_HIGH' WHEN 0.2 THEN 'PRICE_VARIATION_VERY_HIGH' END) AS warnings FROM s4 WHERE n >= {floor})""")


_PLAIN = f"plain AS (SELECT query_id AS subject_id, q_lat AS s_lat, q_lon AS s_lon, DATE '{AS_OF}' AS window_end, DATE '{AS_OF}' AS target_date, NULL::BIGINT AS exclude_id, CAST(2 + query_id%3 AS INT) AS subject_bedrooms FROM requests)"
_PLAIN_CTES = (REQUESTS_CTE, INDEX_CTE, _PLAIN, *_pipeline("plain", 10, False, True, 1))


def _plain_subjects(spark, d):
    end = F.lit(AS_OF).cast("date")
    return search_requests(spark, d).select(
        F.col("query_id").alias("subject_id"), F.col("q_lat").alias("s_lat"), F.col("q_lon").alias("s_lon"), end.alias("window_end"),
        end.alias("target_date"), F.lit(None).cast("long").alias("exclude_id"), (2 + F.col("query_id") % 3).cast("int").alias("subject_bedrooms"))


def _index(s):
    return stats.county_price_index(s, "1995-01-01", min_n=3)


def _valued(spark, d):
    s = dwelling_sales(spark, d)
    return valuation.value_subjects(_plain_subjects(spark, d), s, _index(s), min_n=10, floor=1)


@query("find_comparables", over_sales("SELECT subject_id, rank, id, round(dist, 3) AS distance_m, round(recency, 6) AS recency_score FROM comps", *_PLAIN_CTES))
def _(spark, d):
    comps = valuation.find_comparables(_plain_subjects(spark, d), dwelling_sales(spark, d))
    return comps.select("subject_id", "rank", "id", round_to("distance_m", 3).alias("distance_m"), round_to("recency_score", 6).alias("recency_score"))


@query("time_adjust", over_sales("SELECT subject_id, id, round(factor, 9) AS adjustment_factor, adjusted_price FROM adjusted", *_PLAIN_CTES))
def _(spark, d):
    _, comps = _valued(spark, d)
    return comps.select("subject_id", "id", round_to("adjustment_factor", 9).alias("adjustment_factor"), "adjusted_price")


@query("comparable_weights", over_sales("SELECT subject_id, id, round(weight, 9) AS weight FROM weighted", *_PLAIN_CTES))
def _(spark, d):
    _, comps = _valued(spark, d)
    return comps.select("subject_id", "id", round_to("weight", 9).alias("weight"))


_EST = ["subject_id", "n_comparables", "estimate", "ci_lower", "ci_upper", "ci_width_pct", "mean_price", "median_price", "std_dev", "cv", "min_price", "max_price"]


@query("estimate", over_sales(f"SELECT {', '.join(_EST)} FROM valued", *_PLAIN_CTES))
def _(spark, d):
    values, _ = _valued(spark, d)
    return values.select(*_EST)


@query("confidence", over_sales("SELECT subject_id, quality_score, confidence_level, is_valid, warnings FROM valued", *_PLAIN_CTES))
def _(spark, d):
    values, _ = _valued(spark, d)
    return values.select("subject_id", "quality_score", "confidence_level", "is_valid",
                         F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"))


_REQ_SUBJECTS = f"req_subjects AS (SELECT request_id AS subject_id, lat AS s_lat, lon AS s_lon, DATE '{AS_OF}' AS window_end, DATE '{AS_OF}' AS target_date, NULL::BIGINT AS exclude_id, bedrooms AS subject_bedrooms FROM resolved WHERE lat IS NOT NULL)"


@query("value_properties", over_sales(
    """SELECT request_id, method, estimate, ci_lower, ci_upper, confidence_level, CASE WHEN lat IS NULL THEN 'address not located' WHEN estimate IS NULL THEN 'insufficient comparable sales' END AS reason
       FROM resolved LEFT JOIN valued ON subject_id = request_id""", *SUBJECT_CTES, INDEX_CTE, _REQ_SUBJECTS, *_pipeline("req_subjects", 5, False, True, 3)))
def _(spark, d):
    s = sales(spark, d)
    results, _ = valuation.value_properties(valuation_requests(spark, s), s, _index(s), AS_OF)
    return results.select("request_id", "method", "estimate", "ci_lower", "ci_upper", "confidence_level", "reason")


_SLOTS = """slots AS (SELECT 'rail' AS kind, * FROM amenities WHERE amenity_type = 'transport' AND (contains(category, 'DART') OR contains(category, 'Train Station') OR contains(category, 'Commuter'))
  UNION ALL SELECT 'luas', * FROM amenities WHERE amenity_type = 'transport' AND contains(category, 'Luas') UNION ALL SELECT 'primary_school', * FROM amenities WHERE level IN ('Primary', 'Secondary & Primary')
  UNION ALL SELECT 'secondary_school', * FROM amenities WHERE level IN ('Secondary', 'Secondary & Primary') UNION ALL SELECT 'tertiary', * FROM amenities WHERE level = 'Tertiary')"""


@query("nearest_amenities", over_sales(
    f"""SELECT id, kind, amenity_id, CAST(round_even(dist, 0) AS BIGINT) AS distance_m FROM (SELECT s.id, kind, arg_min(amenity_id, (dist, amenity_id)) AS amenity_id, min(dist) AS dist FROM
        (SELECT s.id, kind, amenity_id, {q.haversine('s.latitude', 's.longitude', 'a.latitude', 'a.longitude')} AS dist FROM dwelling s, slots a WHERE s.latitude BETWEEN 53.15 AND 53.65 AND s.longitude BETWEEN -6.55 AND -6.00) s GROUP BY ALL) WHERE kind <> 'tertiary' OR dist <= 2000""",
    AMENITY_CTE, _SLOTS))
def _(spark, d):
    s = dwelling_sales(spark, d).select("id", "latitude", "longitude")
    return valuation.nearest_amenities(s, amenity_points(spark, d)).select("id", "kind", "amenity_id", "distance_m")


_BT_SUBJECTS = """bt_subjects AS (SELECT id AS subject_id, latitude AS s_lat, longitude AS s_lon, sale_date AS window_end, sale_date AS target_date, id AS exclude_id, NULL::INT AS subject_bedrooms FROM
   (SELECT * FROM dwelling WHERE NOT not_full_market_price AND price BETWEEN 100000 AND 1000000 AND sale_date >= DATE '2001-08-01' - 180 AND latitude IS NOT NULL ORDER BY md5(concat('3:', CAST(id AS VARCHAR))), id LIMIT 400))"""
_BT = (INDEX_CTE, _BT_SUBJECTS, *_pipeline("bt_subjects", 5, True, False, 5),
       "bt AS (SELECT v.*, address, county, property_type, CAST(price AS DOUBLE) AS actual_price, abs(estimate - CAST(price AS DOUBLE)) / CAST(price AS DOUBLE) * 100 AS error_pct FROM valued v JOIN dwelling ON id = subject_id)")


def _backtest(spark, d):
    s = dwelling_sales(spark, d)
    sample = search.validation_sample(s, 400, AS_OF, seed=3)
    return valuation.backtest(sample, s, _index(s))


@query("backtest", over_sales("SELECT subject_id, estimate, round(error_pct, 6) AS error_pct, confidence_level, n_comparables FROM bt", *_BT))
def _(spark, d):
    return _backtest(spark, d).select("subject_id", "estimate", round_to("error_pct", 6).alias("error_pct"), "confidence_level", "n_comparables")


_SECTIONS = " UNION ALL ".join(f"SELECT '{s}' AS section, {b} AS bucket, error_pct FROM bt" for s, b in [
    ("overall", "'all'"), ("county", "county"), ("confidence", "confidence_level"),
    ("comparables", "CASE WHEN n_comparables <= 5 THEN '<5' WHEN n_comparables <= 10 THEN '5-10' WHEN n_comparables <= 20 THEN '10-20' ELSE '20+' END"),
    ("price", "CASE WHEN actual_price <= 200000 THEN '<200k' WHEN actual_price <= 300000 THEN '200-300k' WHEN actual_price <= 400000 THEN '300-400k' WHEN actual_price <= 500000 THEN '400-500k' ELSE '500k+' END"),
    ("type", "property_type")])


@query("accuracy_report", over_sales(
    f"""SELECT section, bucket, count(*) AS n, round(avg(error_pct), 4) AS mean_error, round(quantile_cont(error_pct, 0.5), 4) AS median_error, round(stddev_samp(error_pct), 4) AS std_error FROM ({_SECTIONS}) WHERE bucket IS NOT NULL GROUP BY ALL""", *_BT))
def _(spark, d):
    return valuation.accuracy_report(_backtest(spark, d))[0]


@query("accuracy_metrics", over_sales(
    """SELECT unnest(['within_10_pct','within_15_pct','within_20_pct','within_25_pct','within_30_pct','over_50_pct','ci_coverage_pct','mean_ci_width_pct','mean_quality','quality_error_corr','min_error','max_error','target_met']) AS metric,
       unnest([round(v, 7) for v in [100 * avg(CAST(error_pct < 10 AS INT)), 100 * avg(CAST(error_pct < 15 AS INT)), 100 * avg(CAST(error_pct < 20 AS INT)), 100 * avg(CAST(error_pct < 25 AS INT)), 100 * avg(CAST(error_pct < 30 AS INT)), 100 * avg(CAST(error_pct > 50 AS INT)),
         100 * avg(CAST(actual_price BETWEEN ci_lower AND ci_upper AS INT)), avg(ci_width_pct), avg(quality_score), corr(quality_score, error_pct), min(error_pct), max(error_pct), CAST(avg(error_pct) <= 25 AS DOUBLE)]]) AS value FROM bt""", *_BT))
def _(spark, d):
    return valuation.accuracy_report(_backtest(spark, d))[1].withColumn("value", round_to("value", 7))


@query("worst_predictions", over_sales("SELECT subject_id, round(error_pct, 6) AS error_pct, address FROM bt ORDER BY bt.error_pct DESC, subject_id LIMIT 10", *_BT))
def _(spark, d):
    return valuation.worst_predictions(_backtest(spark, d)).select("subject_id", round_to("error_pct", 6).alias("error_pct"), "address")


# ------------------------------------------------------------ studies

TRANSPORT, SCHOOLS = ["green", "red", "dart", "any_rail"], ["primary", "secondary", "tertiary", "any_school"]


def _classes(rules: list[tuple[str, str]]) -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS class, * FROM amenities WHERE {c}" for n, c in rules)
    return (f"pts AS ({union}), study AS (SELECT id, price, class, min({q.haversine('s.latitude', 's.longitude', 'a.latitude', 'a.longitude')}) AS dist FROM dwelling s, pts a "
            "WHERE s.latitude IS NOT NULL AND NOT not_full_market_price AND price > 0 AND county = 'Dublin' GROUP BY ALL)")


_TRANSPORT_CTE = _classes([("green", "contains(category, 'Green Line')"), ("red", "contains(category, 'Red Line')"), ("dart", "contains(category, 'DART')"), ("any_rail", "amenity_type = 'transport'")])
_SCHOOL_CTE = _classes([("primary", "level IN ('Primary', 'Secondary & Primary')"), ("secondary", "level IN ('Secondary', 'Secondary & Primary')"), ("tertiary", "level = 'Tertiary'"), ("any_school", "amenity_type = 'school'")])


def _study(spark, d, names, county="Dublin"):
    s = studies.study_sales(dwelling_sales(spark, d) if county else sales(spark, d), county)
    rule = studies.transport_classes() if names is TRANSPORT else studies.school_classes()
    return studies.with_distances(s, amenity_points(spark, d), rule, names)


_NEAR_FAR = """SELECT class, near_n, near_median, far_n, far_median, near_median / far_median - 1 AS raw_gap FROM (SELECT class, count(*) FILTER (dist < 1000) AS near_n, quantile_cont(CAST(price AS DOUBLE), 0.5) FILTER (dist < 1000) AS near_median,
    count(*) FILTER (dist >= 1000) AS far_n, quantile_cont(CAST(price AS DOUBLE), 0.5) FILTER (dist >= 1000) AS far_median FROM study GROUP BY class) WHERE near_n > 0 AND far_n > 0"""
_BANDS = """SELECT class, CASE WHEN dist < 250 THEN '0-250m' WHEN dist < 500 THEN '250-500m' WHEN dist < 1000 THEN '500m-1km' WHEN dist < 2000 THEN '1-2km' ELSE '>2km' END AS band, count(*) AS n, quantile_cont(CAST(price AS DOUBLE), 0.5) AS median_price FROM study GROUP BY ALL"""


@query("near_far_gap", over_sales(_NEAR_FAR, AMENITY_CTE, _TRANSPORT_CTE))
def _(spark, d):
    return studies.near_far_gap(_study(spark, d, TRANSPORT), TRANSPORT)


@query("near_far_gap_schools", over_sales(_NEAR_FAR, AMENITY_CTE, _SCHOOL_CTE))
def _(spark, d):
    return studies.near_far_gap(_study(spark, d, SCHOOLS), SCHOOLS)


@query("distance_bands", over_sales(_BANDS, AMENITY_CTE, _TRANSPORT_CTE))
def _(spark, d):
    return studies.distance_bands(_study(spark, d, TRANSPORT), TRANSPORT)


@query("distance_bands_schools", over_sales(_BANDS, AMENITY_CTE, _SCHOOL_CTE))
def _(spark, d):
    return studies.distance_bands(_study(spark, d, SCHOOLS), SCHOOLS)


def _hedonic_sql() -> str:
    """Demeaning by windows in a recursive query, then the normal equations of three flags by cofactors."""
    x, mean = ("a", "b", "c"), lambda v, by: f"{v} - sum(n * {v}) OVER (PARTITION BY {by}) / sum(n) OVER (PARTITION BY {by}) AS {v}"
    taken = lambda by: ", ".join(mean(v, by) for v in ("y", *x))
    minor = lambda i, j: (lambda r, c: f"({x[r[0]]}{x[c[0]]} * {x[r[1]]}{x[c[1]]} - {x[r[0]]}{x[c[1]]} * {x[r[1]]}{x[c[0]]})")(
        [(i + 1) % 3, (i + 2) % 3], [(j + 1) % 3, (j + 2) % 3])
    pairs = [(u, v) for u in x for v in x]
    sandwich = lambda v: " + ".join(f"i{v}{p} * m.{p}{r} * i{r}{v}" for p, r in pairs)
    flag = lambda name, v: (f"SELECT '{name}' AS flag, beta_{v} AS bta, sqrt({sandwich(v)}) * sqrt(areas / (areas - 1.0) * (n - 1.0) / (n - rank)) AS se, "
                            "1 - (yy - between + ry - explained) / (yy - sy * sy / n) AS r2, n, areas FROM solved, m, total, freedom")
    body = " UNION ALL ".join(flag(f"near_{n}", v) for n, v in zip(("green", "red", "dart"), x))
    return over_sales(
        f"SELECT flag, round(bta, 6) AS coefficient, round(se, 6) AS std_error, round(exp(bta) - 1, 6) AS premium, round(exp(bta - 1.959963984540054 * se) - 1, 6) AS premium_low, "
        f"round(exp(bta + 1.959963984540054 * se) - 1, 6) AS premium_high, round(r2, 6) AS r_squared, n, areas FROM ({body}) WHERE n > 0", AMENITY_CTE,
        _TRANSPORT_CTE.replace(" AND county = 'Dublin'", ""),
        "near AS (SELECT id, " + ", ".join(f"max(CAST(class = '{n}' AND dist < 1000 AS INT))::DOUBLE AS {v}" for n, v in zip(("green", "red", "dart"), x)) + " FROM study GROUP BY id)",
        f"base AS (SELECT {q.routing_key('eircode')} AS g, CAST(year(sale_date) AS INT) AS t, CAST(price AS DOUBLE) AS price, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM dwelling LEFT JOIN near USING (id) "
        "WHERE latitude IS NOT NULL AND NOT not_full_market_price AND price > 0)",
        "kept AS (SELECT * FROM base WHERE price BETWEEN (SELECT quantile_cont(price, 0.01) FROM base) AND (SELECT quantile_cont(price, 0.99) FROM base) AND g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY g) >= 50)",
        "combos AS (SELECT g, t, a, b, c, count(*)::DOUBLE AS n, avg(ln(price)) AS y, sum(ln(price)) AS sy, sum(ln(price) * ln(price)) AS yy FROM kept GROUP BY ALL)",
        "total AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(sy) AS sy, sum(yy) AS yy, sum(n * y * y) AS between, CAST(count(DISTINCT g) AS INT) AS areas, count(DISTINCT t) AS years FROM combos)",
        f"swept AS (SELECT g, t, n, y, a, b, c, 0 AS step FROM combos UNION ALL SELECT g, t, n, {taken('t')}, step + 1 FROM (SELECT g, t, n, {taken('g')}, step FROM swept WHERE step < 60))",
        "last AS (SELECT * FROM swept WHERE step = 60)",
        "prods AS (SELECT " + ", ".join(f"sum(n * {u} * {v}) AS {u}{v}" for u, v in pairs) + ", " + ", ".join(f"sum(n * {u} * y) AS {u}_y" for u in x) + ", sum(n * y * y) AS ry FROM last)",
        "inv AS (SELECT *, " + ", ".join(f"{minor(i, j)} / det AS i{x[j]}{x[i]}" for i in range(3) for j in range(3)) + " FROM (SELECT *, " + " + ".join(f"a{x[j]} * {minor(0, j)}" for j in range(3)) + " AS det FROM prods))",
        "solved AS (SELECT *, beta_a * a_y + beta_b * b_y + beta_c * c_y AS explained FROM (SELECT *, " + ", ".join(f"i{v}a * a_y + i{v}b * b_y + i{v}c * c_y AS beta_{v}" for v in x) + " FROM inv))",
        "scores AS (SELECT g, " + ", ".join(f"sum(n * last.{v} * (y - beta_a * last.a - beta_b * last.b - beta_c * last.c)) AS s{v}" for v in x) + " FROM last, solved GROUP BY g)",
        "m AS (SELECT " + ", ".join(f"sum(s{u} * s{v}) AS {u}{v}" for u, v in pairs) + " FROM scores)",
        "freedom AS (SELECT areas + years - 1 + 3 AS rank FROM total)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("hedonic_premium", _hedonic_sql())
def _(spark, d):
    rows = stats.trim_quantiles(_study(spark, d, TRANSPORT, county=None)).withColumn("year", F.year("sale_date"))
    for n in ("green", "red", "dart"):
        rows = rows.withColumn(f"near_{n}", (F.col(f"d_{n}") < 1000).cast("int"))
    found = studies.hedonic_premium(rows, ["near_green", "near_red", "near_dart"])
    return found.select("flag", *[round_to(c, 6).alias(c) for c in ("coefficient", "std_error", "premium", "premium_low", "premium_high", "r_squared")], "n", "areas")


_LOAN = "SELECT o_orderkey AS loan_id, o_totalprice AS p, (o_custkey%8)*0.5::DOUBLE / 100 / 12 AS r, CAST(5 + o_custkey%26 AS INT) AS years FROM orders"


@query("amortization_schedule", f"""
WITH l AS ({_LOAN}), m AS (SELECT *, years * 12 AS n, CASE WHEN r = 0 THEN p / (years*12) ELSE p * r * pow(1 + r, years*12) / (pow(1 + r, years*12) - 1) END AS pay FROM l),
b AS (SELECT loan_id, p, pay, year, CASE WHEN r = 0 THEN p - pay * (year-1)*12 ELSE p * pow(1+r, (year-1)*12) - pay * (pow(1+r, (year-1)*12) - 1) / r END AS o, CASE WHEN r = 0 THEN p - pay * year*12 ELSE p * pow(1+r, year*12) - pay * (pow(1+r, year*12) - 1) / r END AS c
  FROM (SELECT *, CAST(unnest(range(1, years + 1)) AS INT) AS year FROM m))
SELECT loan_id, year, round(greatest(0, o), 2) + 0 AS opening_balance, round(greatest(0, o - c), 2) + 0 AS principal_paid, round(greatest(0, pay*12 - (o - c)), 2) + 0 AS interest_paid, round(greatest(0, c), 2) + 0 AS closing_balance, round(greatest(0, pay*12*year - (p - c)), 2) + 0 AS cumulative_interest FROM b""")
def _(spark, d):
    loans = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_totalprice").alias("principal"), ((F.col("o_custkey") % 8) * 0.5).alias("annual_rate"),
        (5 + F.col("o_custkey") % 26).cast("int").alias("years"))
    a = studies.amortization_schedule(loans)
    return a.select("loan_id", "year", *[round_to(c, 2).alias(c) for c in (
        "opening_balance", "principal_paid", "interest_paid", "closing_balance", "cumulative_interest")])


@query("value_properties_amenities", over_sales(
    f"""SELECT request_id, string_agg(concat(kind, ':', CAST(round_even(dist, 0) AS BIGINT)), ',' ORDER BY kind) AS nearby FROM (SELECT request_id, kind, min({q.haversine('lat', 'lon', 'a.latitude', 'a.longitude')}) AS dist
        FROM resolved r, slots a WHERE lat BETWEEN 53.15 AND 53.65 AND lon BETWEEN -6.55 AND -6.00 GROUP BY ALL) WHERE kind <> 'tertiary' OR dist <= 2000 GROUP BY request_id""", *SUBJECT_CTES, AMENITY_CTE, _SLOTS))
def _(spark, d):
    s = sales(spark, d)
    results, _ = valuation.value_properties(valuation_requests(spark, s), s, _index(s), AS_OF, amenities=amenity_points(spark, d))
    each = F.transform("nearby_amenities", lambda a: F.concat(a["kind"], F.lit(":"), a["distance_m"].cast("string")))
    return results.where("nearby_amenities is not null").select("request_id", F.array_join(each, ",").alias("nearby"))
