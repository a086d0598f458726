"""Joins, quantiles, reconciliation and valuation against brute force."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.operators import incremental, joins, multiset, quantiles, repair, search, studies, valuation


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    left = [(i, rng.uniform(51.5, 55.3), rng.uniform(-10.3, -5.6)) for i in range(150)]
    right = [(i, rng.gauss(53.3, 0.2), rng.gauss(-6.3, 0.2)) for i in range(300)]
    right += [(1000 + i, 53.35, -6.26) for i in range(150)]     # a third of all rows on one point
    return left, right


def test_radius_pairs_matches_brute_force(spark, points):
    left, right = points
    a = spark.createDataFrame(left, "q long, q_lat double, q_lon double")
    b = spark.createDataFrame(right, "id long, latitude double, longitude double")
    got = {(r["q"], r["id"]) for r in joins.radius_pairs(a, b, 40_000.0).collect()}
    want = {(l[0], r[0]) for l in left for r in right if hav(l[1], l[2], r[1], r[2]) <= 40_000}
    assert got == want and want


@pytest.mark.parametrize("cell", [0.01, 0.2])
def test_nearest_join_matches_brute_force(spark, points, cell):
    left, right = points
    a = spark.createDataFrame(left, "q long, latitude double, longitude double")
    b = spark.createDataFrame([("even" if r[0] % 2 == 0 else "odd", *r) for r in right], "class string, point_id long, p_lat double, p_lon double")
    got = {(r["q"], r["class"]): r["point_id"] for r in joins.nearest_join(a, b, cell_deg=cell).collect()}
    for l, cls in itertools.product(left, ("even", "odd")):
        best = min((hav(l[1], l[2], r[1], r[2]), r[0]) for r in right if (r[0] % 2 == 0) == (cls == "even"))
        assert got[(l[0], cls)] == best[1]


def test_nearest_join_splits_dense_cells(spark):
    """10,000 points on one place, 20,000 distinct ones and 3,000 rows in one cell: only near leaves meet."""
    rng = np.random.default_rng(2)
    spots = np.round(np.c_[53.341 + 0.008 * rng.random(20_000), -6.261 + 0.012 * rng.random(20_000)], 7)
    asked = np.round(np.c_[53.341 + 0.008 * rng.random(3_000), -6.261 + 0.012 * rng.random(3_000)], 7)
    near = [("a", i, float(y), float(x)) for i, (y, x) in enumerate(spots)] + [("a", 50_000 + i, 53.345, -6.255) for i in range(10_000)]
    b = spark.createDataFrame(near, "class string, point_id long, p_lat double, p_lon double")
    a = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(asked)], "q long, latitude double, longitude double")
    coords, placed, opened = joins.nearest_candidates(a, b)
    cell = ["class", *joins.POINT_CELL]
    assert placed.groupBy(*cell).count().agg(F.max("count")).first()[0] <= 256
    assert coords.groupBy(*joins.ROW_CELL).count().agg(F.max("count")).first()[0] <= 256
    met = coords.join(opened, joins.ROW_CELL).join(placed, cell).count()
    assert met < 3_000 * 8 * 256
    assert opened.count() < 3_000 * 60
    got = {r["q"]: r["distance_m"] for r in joins.nearest_join(a, b).collect()}
    p, o = np.radians(np.r_[spots, [[53.345, -6.255]]]), np.radians(asked)
    for i in range(0, 3_000, 50):
        h = np.sin((p[:, 0] - o[i, 0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(o[i, 0]) * np.sin((p[:, 1] - o[i, 1]) / 2) ** 2
        assert got[i] == pytest.approx(2 * 6371000 * np.arcsin(np.sqrt(h.min())), abs=1e-6)
    assert len(got) == 3_000


def test_gram_index_keeps_scopes_apart(spark):
    """Terms of one county meet texts of that county only; terms without one meet all; one index serves both."""
    rng = random.Random(8)
    rows = sorted({("".join(rng.choice("abc ") for _ in range(10)), rng.choice(["x", "y", None])) for _ in range(120)}, key=str)
    d = spark.createDataFrame(rows, "txt string, county string")
    terms = [(t, c) for t in ("ab", "abc", "c", "b a", "zzz", "") for c in ("x", "y", None)]
    q = spark.createDataFrame(terms, "term string, asked string")
    index = joins.gram_index(q, "term", d, "txt", ["county"], "county")
    got = Counter((r["term"], r["asked"], r["txt"], r["county"]) for r in joins.contains_join(q, "term", d, "txt", ["county"], "county", "asked", index).collect())
    want = Counter((t, c, x, k) for t, c in terms for x, k in rows if t and t in x and c in (None, k))
    assert got == want and want
    assert index.entries.where("_gram like 'zz%' or length(_gram) > 3").count() == 0
    asked = [(1, "x", [["ab"], ["c", "zz"]]), (2, None, [["ab"], ["c a", "bb"]]), (3, "y", [["zzz"], ["a"]]), (4, "x", [])]
    r = spark.createDataFrame(asked, "query_id long, asked string, variants array<array<string>>")
    got = {(o["query_id"], o["txt"], o["county"]) for o in joins.contains_all_join(r, d, "txt", ["county"], "county", "asked").collect()}
    assert got == {(i, x, k) for i, c, vs in asked for x, k in rows if vs and c in (None, k) and all(any(v in x for v in g) for g in vs)}


def test_near_equal_join(spark):
    a = spark.createDataFrame([(1, 53.0, -6.0), (2, 53.0000009, -6.0), (3, 53.000002, -6.0)], "id long, la double, lo double")
    b = spark.createDataFrame([(53.0000000, -6.0)], "pa double, po double")
    assert {r["id"] for r in joins.near_equal_join(a, b, ["la", "lo"], ["pa", "po"], 1e-6).collect()} == {1, 2}


def test_text_joins_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c") for _ in range(12)) for _ in range(80)] + ["aaa", "ab"]
    texts = sorted(set(texts))
    terms = ["a", "ab", "abc", "b c", "aab ", "zzz", "aaaa"]
    d = spark.createDataFrame([(t,) for t in texts], "txt string")
    q = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r["term"], r["txt"]) for r in joins.contains_join(q, "term", d, "txt", []).collect()}
    assert got == {(t, x) for t in terms for x in texts if t in x}
    got = {(r["term"], r["txt"]) for r in joins.prefix_join(q, "term", d, "txt").collect()}
    assert got == {(t, x) for t in terms for x in texts if x.startswith(t)}
    wanted = [(1, [["ab"], ["c a", "cb"]]), (2, [["zz"], ["a"]]), (3, [["bb", "aa"], ["c"]])]
    r = spark.createDataFrame(wanted, "query_id long, variants array<array<string>>")
    got = {(x["query_id"], x["txt"]) for x in joins.contains_all_join(r, d, "txt", []).collect()}
    assert got == {(i, x) for i, vs in wanted for x in texts if all(any(v in x for v in g) for g in vs)}


def test_grouped_quantiles_exact_under_skew(spark):
    rng = random.Random(1)
    rows = [(None if i % 3 == 0 else f"g{i % 7}", round(rng.uniform(1, 90_000), 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("v", F.col("v").cast("decimal(12,2)"))
    got = {r["g"]: r for r in quantiles.grouped_quantiles(df, ["g"], "v", {"m": 0.5, "p9": 0.9, "u": "upper"}).collect()}
    for g in {r[0] for r in rows}:
        vs = sorted(v for k, v in rows if k == g)
        assert got[g]["n"] == len(vs)
        assert got[g]["m"] == pytest.approx(np.percentile(vs, 50), abs=1e-6)
        assert got[g]["p9"] == pytest.approx(np.percentile(vs, 90), abs=1e-6)
        assert got[g]["u"] == vs[len(vs) // 2]
        assert got[g]["mean_value"] == pytest.approx(np.mean(vs), abs=1e-6)


SNAP = "sale_date date, address string, county string, price decimal(12,2)"


def test_reconcile_is_a_multiset_difference(spark):
    day = dt.date(2020, 1, 1)
    base = [(day, "a", "Cork", 10), (day, "b", "Cork", 10), (day, "c", "Mayo", 20)]
    source = [(day, "A", "Cork ", 10)] * 900 + [(day, f"x{i}", "Cork", 10) for i in range(50)] + [(day, "c", "Mayo", 20)] + [(day, "d", "Sligo", 30)] * 2
    dec = lambda rows: spark.createDataFrame([(d, a, c, p) for d, a, c, p in rows], "sale_date date, address string, county string, price int") \
        .withColumn("price", F.col("price").cast("decimal(12,2)"))
    b, s = dec(base), dec(source)
    new = multiset.reconcile(b, s)
    got = Counter((r["county"].strip(), int(r["price"])) for r in new.collect())
    assert got == {("Cork", 10): 948, ("Sligo", 30): 2}
    assert multiset.reconcile(b.unionByName(new), s).count() == 0
    assert sorted(map(tuple, multiset.reconcile(b, s.repartition(7)).collect())) == sorted(map(tuple, new.collect()))


def test_canonical_coordinate_prefers_documented_order(spark):
    rows = [("a", 53.0, -6.0, False, dt.date(2020, 1, 1)), ("a", 54.0, -7.0, False, dt.date(2021, 1, 1)), ("a", 52.0, -5.0, True, dt.date(2022, 1, 1)),
            ("b", 51.0, -8.0, True, dt.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "address_normalized string, latitude double, longitude double, geocode_quality_issue boolean, sale_date date")
    got = {r["address_normalized"]: r["canon_lat"] for r in repair.canonical_coordinates(df).collect()}
    assert got == {"a": 54.0, "b": 51.0}


def comps(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, rank int, distance_m double, recency_score double, bedrooms int, subject_bedrooms int")


def test_weights(spark):
    df = comps(spark, [(1, 1, 100.0, 0.9, None, None), (1, 2, 4500.0, 0.3, None, None), (1, 3, 5000.0, 1.0, None, None)])
    w = {r["rank"]: r["weight"] for r in valuation.comparable_weights(df).collect()}
    raw = [(1 - 100 / 5000) ** 2 * 0.9, (1 - 4500 / 5000) ** 2 * 0.3, 0.0]
    assert raw[0] == pytest.approx(0.8644, abs=1e-4) and raw[1] == pytest.approx(0.003)
    for i in range(3):
        assert w[i + 1] == pytest.approx(raw[i] / sum(raw))
    same = comps(spark, [(1, 1, 50.0, 0.9, None, None), (1, 2, 50.0, 0.3, None, None)])
    assert [r["weight"] for r in valuation.comparable_weights(same).collect()] == [0.5, 0.5]


def priced(spark, prices, weights):
    rows = [(1, i + 1, p, w, 500.0) for i, (p, w) in enumerate(zip(prices, weights))]
    return spark.createDataFrame(rows, "subject_id long, rank int, adjusted_price long, weight double, distance_m double")


def test_estimate_golden_values(spark):
    r = valuation.estimate(priced(spark, [400_000, 420_000, 410_000], [0.4, 0.3, 0.3])).first()
    assert r["estimate"] == 409_000
    r = valuation.estimate(priced(spark, [50_000, 500_000, 90_000, 60_000], [0.25] * 4)).first()
    assert r["ci_lower"] == 0 and r["ci_width_pct"] > 200


def test_time_adjust_truncates(spark):
    df = spark.createDataFrame([(1, "Cork", dt.date(2020, 1, 9), 400_000, dt.date(2021, 1, 1)), (2, "Mayo", dt.date(2020, 1, 9), 500_000, dt.date(2021, 1, 1))],
                               "id long, county string, sale_date date, price int, target_date date")
    idx = spark.createDataFrame([("Cork", dt.date(2020, 1, 1), 1.20), ("Cork", dt.date(2021, 1, 1), 1.40)], "county string, month date, price_index double")
    got = {r["id"]: (r["adjusted_price"], r["fallback"]) for r in valuation.time_adjust(df, idx).collect()}
    assert got == {1: (466_666, False), 2: (500_000, True)}


def test_find_comparables_matches_brute_force(spark):
    rng = random.Random(9)
    day0 = dt.date(2020, 1, 1)
    rows = [(i, 53.3 + rng.gauss(0, 0.04), -6.3 + rng.gauss(0, 0.06), day0 + dt.timedelta(days=rng.randrange(1500)), 200_000) for i in range(400)]
    rows += [(1000 + i, 53.31, -6.31, day0 + dt.timedelta(days=1000 + i % 2), 200_000) for i in range(200)]   # one hot point
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, sale_date date, price int").selectExpr(
        "*", "false as not_full_market_price", "'a' as address", "'Dublin' as county", "cast(null as int) bedrooms", "cast(null as string) property_type")
    subjects = [(i, 53.3 + rng.gauss(0, 0.1), -6.3 + rng.gauss(0, 0.1), day0 + dt.timedelta(days=rng.randrange(900, 1600)), rng.randrange(400)) for i in range(40)]
    subjects.append((99, 53.31, -6.31, day0 + dt.timedelta(days=1100), 1003))
    s = spark.createDataFrame(subjects, "subject_id long, s_lat double, s_lon double, window_end date, exclude_id long")
    got = {}
    for r in valuation.find_comparables(s, df, min_n=10).collect():
        got.setdefault(r["subject_id"], {})[r["rank"]] = r["id"]
    for sid, y, x, end, ex in subjects:
        near = sorted((hav(y, x, r[1], r[2]), -r[3].toordinal(), r[0]) for r in rows
                      if r[0] != ex and 0 <= (end - r[3]).days <= 1095 and hav(y, x, r[1], r[2]) <= 20_000)
        ring = next((k for k in (1e3, 2e3, 5e3, 1e4) if sum(n[0] <= k for n in near) >= 10), 2e4)
        want = [n[2] for n in near if n[0] <= ring][:30]
        assert [got.get(sid, {})[k] for k in sorted(got.get(sid, {}))] == want


def test_hedonic_matches_dense_least_squares(spark):
    rng = np.random.default_rng(0)
    n = 1500
    area, year = rng.integers(0, 6, n), rng.integers(2010, 2014, n)
    near = rng.integers(0, 2, n)
    y = 12 + 0.1 * near + 0.05 * area + 0.02 * (year - 2010) + rng.normal(0, 0.2, n)
    price = np.round(np.exp(y), 2)
    rows = [(f"A{a}", int(t), int(f), float(p)) for a, t, f, p in zip(area, year, near, price)]
    df = spark.createDataFrame(rows, "routing_key string, year int, near_x int, price double")
    r = studies.hedonic_premium(df, ["near_x"]).first()
    cols = [np.ones(n), near] + [(area == a) * 1.0 for a in range(1, 6)] + [(year == t) * 1.0 for t in range(2011, 2014)]
    x = np.column_stack(cols)
    ly = np.log(price)
    beta, *_ = np.linalg.lstsq(x, ly, rcond=None)
    e = ly - x @ beta
    inv = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(s, s) for s in (x[area == a].T @ e[area == a] for a in range(6)))
    k = x.shape[1]
    cov = 6 / 5 * (n - 1) / (n - k) * inv @ meat @ inv
    assert r["coefficient"] == pytest.approx(beta[1], abs=1e-9)
    assert r["std_error"] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-6)
    assert r["r_squared"] == pytest.approx(1 - e @ e / ((ly - ly.mean()) ** 2).sum(), abs=1e-9)
    assert (r["n"], r["areas"]) == (n, 6)


def test_radius_search_matches_the_loop(spark):
    rng = random.Random(11)
    rows = [(i, 53.3 + rng.gauss(0, 0.05), -6.3 + rng.gauss(0, 0.08), ["Dublin", "Meath"][i % 2], dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900))) for i in range(250)]
    rows += [(900 + i, 53.30, -6.30, "Dublin", dt.date(2021, 1, 1) + dt.timedelta(days=i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, county string, sale_date date").withColumn("geocode_suspect", F.lit(None).cast("boolean"))
    asked = [(i, 53.3 + rng.gauss(0, 0.08), -6.3 + rng.gauss(0, 0.1), rng.choice([0.3, 1.0, 2.5, 12.0]), rng.choice([None, "dublin", "Kerry", "Meath"])) for i in range(60)]
    q = spark.createDataFrame(asked, "query_id long, q_lat double, q_lon double, radius_km double, county string")
    for limit in (20, 3):
        got = {}
        for r in search.radius_search(q, df, limit=limit).collect():
            got.setdefault(r["query_id"], []).append((r["position"], r["id"], r["ring_km"], r["county_dropped"]))
        for qid, y, x, radius, county in asked:
            within = lambda km, c: sorted((-r[4].toordinal(), hav(y, x, r[1], r[2]), r[0]) for r in rows
                                          if hav(y, x, r[1], r[2]) <= km * 1000 and (c is None or c.lower() == r[3].lower()))[:limit]
            found, used, dropped = [], radius, False
            if county:
                found = within(radius, county)
                dropped = not found
            if len(found) < 5:
                for km in [radius, radius * 2, radius * 3, radius * 5, radius * 10, 20.0]:
                    used = min(km, 20.0)
                    found = within(used, None if dropped else county)
                    if len(found) >= 5 or used >= 20:
                        break
            have = sorted(got.get(qid, []))
            assert [h[1] for h in have] == [f[2] for f in found]
            assert all(h[2] == used and h[3] == dropped for h in have)


def _around(rng, lat, lon, spread, n):
    return [(i, lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread) * 3) for i in range(n)]


@pytest.mark.parametrize("lat, lon", [(53.0, -7.0), (65.0, 20.0), (84.0, 0.0)])
def test_radius_of_each_row_at_any_latitude(spark, lat, lon):
    rng = random.Random(1)
    asked = [(*r, rng.choice([0.0, 400.0, 5_000.0, 35_000.0, 50_000.0])) for r in _around(rng, lat, lon, 1, 80)]
    points = _around(rng, lat, lon, 1, 160)
    a = spark.createDataFrame(asked, "q int, q_lat double, q_lon double, reach double")
    b = spark.createDataFrame(points, "id int, latitude double, longitude double")
    got = {(r["q"], r["id"]) for r in joins.radius_pairs(a, b, "reach").collect()}
    assert got == {(q, i) for q, y, x, m in asked for i, v, u in points if hav(y, x, v, u) <= m}


def test_nearest_join_keeps_rows_far_from_all_points(spark):
    rng = random.Random(2)
    points = _around(rng, 53, -7, 1, 20)
    rows = spark.createDataFrame([(1, 53.1, -7.2), (2, 22.0, -40.0), (3, 65.0, 20.0), (4, -60.0, 100.0)], "q int, latitude double, longitude double")
    placed = spark.createDataFrame([("c", *p) for p in points], "class string, point_id int, p_lat double, p_lon double")
    got = {r["q"]: r["distance_m"] for r in joins.nearest_join(rows, placed).collect()}
    for r in rows.collect():
        assert got[r["q"]] == pytest.approx(min(hav(r["latitude"], r["longitude"], y, x) for _, y, x in points), abs=1)


def test_alerts_reach_as_far_as_asked(spark):
    at = dt.datetime(2024, 5, 1)
    rows = [(i, dt.date(2024, 4, 1), 100, f"{i} Rd", "Cork", 52.0 + i * 0.05, -8.0, False, False, at) for i in range(12)]
    sales = spark.createDataFrame(rows, "id long, sale_date date, price int, address string, county string, latitude double, longitude double, "
                                        "not_full_market_price boolean, geocode_suspect boolean, created_at timestamp")
    subs = spark.createDataFrame([(1, "a@b.c", "0 Rd", 35.0, None, True, dt.datetime(2024, 1, 1), None)],
                                 "sub_id int, email string, address string, radius_km double, county string, is_active boolean, created_at timestamp, last_sent_at timestamp")
    got = {r["id"] for r in incremental.match_alerts(subs, sales).collect()}
    assert got == {r[0] for r in rows if hav(52.0, -8.0, r[5], r[6]) <= 35_000} and len(got) > 4


def test_polygon_limit_is_the_callers(spark):
    rows = [(i, dt.date(2024, 1, 1), 53.0 + i * 1e-4, -7.0, False) for i in range(120)]
    sales = spark.createDataFrame(rows, "id long, sale_date date, latitude double, longitude double, geocode_suspect boolean")
    ring = [{"lat": y, "lon": x} for y, x in ((52.9, -7.1), (52.9, -6.9), (53.1, -6.9), (53.1, -7.1))]
    polys = spark.createDataFrame([(1, ring)], "poly_id int, ring array<struct<lat: double, lon: double>>")
    assert search.polygon_search(polys, sales, limit=80).count() == 80


def test_rows_without_need_fit_the_budget(spark):
    work = spark.createDataFrame([(1, 0), (2, 3), (3, 4), (4, None)], "id int, need int")
    usage = spark.createDataFrame([(dt.datetime(2024, 1, 2), 95)], "ts timestamp, request_count int")
    got = {r["id"]: r["running_need"] for r in incremental.request_budget(work, usage, [F.col("id")], "2024-01-01", limit=100).collect()}
    assert got == {1: 0, 2: 3, 4: 0}


def test_hedonic_premium_without_a_large_area(spark):
    rows = spark.createDataFrame([(100.0, 1, "A", 2020)], "price double, near int, routing_key string, year int")
    assert studies.hedonic_premium(rows, ["near"]).count() == 0


def test_ring_cover_is_bounded_and_complete(spark):
    rng = random.Random(8)
    rings = {"country": [(51.3, -8.0), (53.4, -5.3), (55.5, -8.0), (53.4, -10.7)], "street": [(53.34, -6.27), (53.36, -6.27), (53.35, -6.24)],
             "line": [(53.0, -7.0), (53.0, -7.0), (53.0, -7.0)], "world": [(-89.0, -179.0), (-89.0, 179.0), (89.0, 179.0), (89.0, -179.0)]}
    polys = spark.createDataFrame([(k, v) for k, v in rings.items()], "poly_id string, ring array<struct<lat:double,lon:double>>")
    cells = {r["poly_id"]: r["count"] for r in search.ring_cover(polys).groupBy("poly_id").count().collect()}
    assert set(cells) == set(rings) and max(cells.values()) < 1000
    places = [(rng.uniform(51, 56), rng.uniform(-11, -5)) for _ in range(300)] + [(rng.gauss(53.35, 0.01), rng.gauss(-6.255, 0.01)) for _ in range(200)]
    sales = spark.createDataFrame([(f"s{i}", dt.date(2020, 1, 1), y, x, False) for i, (y, x) in enumerate(places)],
                                  "id string, sale_date date, latitude double, longitude double, geocode_suspect boolean")

    def within(y, x, ring):
        odd = False
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    got = {(r["poly_id"], r["id"]) for r in search.polygon_search(polys, sales, limit=1000).collect()}
    assert got == {(k, f"s{i}") for k, ring in rings.items() for i, (y, x) in enumerate(places) if within(y, x, ring)} and len(got) > 500
    assert search.polygon_search(polys.limit(0), sales).count() == 0
