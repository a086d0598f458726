"""Radix selection, absorbed fixed effects and area summaries against brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.operators import quantiles, search, studies
from dwellspark.sources import sinks


def test_ordered_key_is_the_bit_pattern(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 0x7FF0000000000000, 3000, dtype=np.int64)
    values = [struct.unpack("<d", struct.pack("<q", int(b)))[0] for b in bits]
    values += [2.0 ** e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0 ** e, d) for e in range(-1000, 1000, 37) for d in (0, math.inf)]
    values += [-v for v in values[::3]] + [0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.ordered_key(F.col("v")).alias("k")).collect()
    for r in got:
        want = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-want if r.v < 0 else want)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_radix_quantiles(spark, by):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.lognormal(0, 12, 20_000), -rng.lognormal(0, 3, 9_000), np.full(10_000, 3.25), rng.normal(1000, 1e-9, 5_000)])
    g = np.where(rng.random(len(v)) < 0.9, "hot", "cold")
    rows = list(zip(g.tolist(), v.tolist())) + [("hot", None), ("hot", float("nan")), ("cold", float("inf")), (None, 1.5), (None, 2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.999, "e": 1.0, "u": "upper"}
    got = {r["g"] if by else None: r for r in quantiles.grouped_quantiles(df, by, "v", probs, None).collect()}
    parts = {"hot": v[g == "hot"], "cold": v[g == "cold"], None: np.array([1.5, 2.5])} if by else {None: np.append(v, [1.5, 2.5])}
    assert set(got) == set(parts)
    for key, x in parts.items():
        r = got[key]
        assert r["n"] == len(x) and r["min_value"] == x.min() and r["max_value"] == x.max()
        for name, p in probs.items():
            want = np.sort(x)[len(x) // 2] if p == "upper" else np.quantile(x, p)
            assert r[name] == pytest.approx(want, rel=1e-12)


def test_radix_levels_bound_the_buckets(spark):
    """Half a million distinct values within one unit: no selection ranks more than 8192 buckets."""
    df = spark.range(500_000).select((F.col("id") * math.pi / 2_000_000 + 1).alias("v"))
    keys = df.select(quantiles.ordered_key(F.col("v")).alias("k"))
    for high, low in zip(quantiles.LEVELS, quantiles.LEVELS[1:]):
        per = keys.select(F.shiftright("k", high).alias("q"), F.shiftright("k", low).alias("p")).distinct().groupBy("q").count().agg(F.max("count")).first()[0]
        assert per <= 8192
    assert quantiles.grouped_quantiles(df, [], "v", {"m": 0.5}, None, False).first()["m"] == pytest.approx(249_999.5 * math.pi / 2_000_000 + 1, rel=1e-12)


def test_absorbed_effects_equal_dummies(spark):
    """Two effects with many levels and unequal cells, a flag that one effect determines, a NULL flag."""
    rng = np.random.default_rng(3)
    n = 4000
    area, month = (rng.beta(1, 3, n) * 60).astype(int), (rng.beta(2, 2, n) * 90).astype(int)
    near, far, fixed = (rng.random(n) < 0.2 + area / 100).astype(int), (rng.random(n) < 0.3 + month / 200).astype(int), (area % 2 == 0).astype(int)
    price = np.exp(12 + 0.1 * near - 0.05 * far + 0.01 * area + 0.003 * month + rng.normal(0, 0.3, n))
    rows = [(f"A{a}", int(m), int(x) if x else None, int(y), int(z), float(p)) for a, m, x, y, z, p in zip(area, month, near, far, fixed, price)]
    df = spark.createDataFrame(rows, "area string, month int, near int, far int, fixed int, price double")
    got = {r["flag"]: r for r in studies.hedonic_premium(df, ["near", "far"], "area", ("month",), min_area=1).collect()}
    dummies = [(area == a) * 1.0 for a in np.unique(area)] + [(month == m) * 1.0 for m in np.unique(month)[1:]]
    x = np.column_stack([near, far, *dummies])
    y = np.log(price)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e, inv = y - x @ beta, np.linalg.pinv(x.T @ x)
    groups = np.unique(area)
    meat = sum(np.outer(s, s) for s in (x[area == a].T @ e[area == a] for a in groups))
    cov = len(groups) / (len(groups) - 1) * (n - 1) / (n - np.linalg.matrix_rank(x)) * inv @ meat @ inv
    for i, f in enumerate(("near", "far")):
        assert got[f]["coefficient"] == pytest.approx(beta[i], abs=1e-8) and got[f]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-6)
        assert got[f]["r_squared"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), abs=1e-8) and got[f]["areas"] == len(groups)
    three = {r["flag"]: r["coefficient"] for r in studies.hedonic_premium(df, ["near", "far", "fixed"], "area", ("month",), min_area=1).collect()}
    assert three["fixed"] == pytest.approx(0, abs=1e-6) and three["near"] == pytest.approx(beta[0], abs=1e-8)


def test_area_summary_is_of_one_area(spark, sales):
    """Rows and trends follow the asked radius, also beyond the rings of the radius search."""
    point = sales.where("latitude is not null").first()
    areas = spark.createDataFrame([(1, point.latitude, point.longitude, 45.0, None), (2, 0.0, 0.0, 45.0, None)], "query_id int, q_lat double, q_lon double, radius_km double, county string")
    got = {r.query_id: r for r in search.area_summary(areas, sales).collect()}
    rows = [r for r in sales.where("latitude is not null and not geocode_suspect").collect()]
    near = [r for r in rows if haversine(point.latitude, point.longitude, r.latitude, r.longitude) <= 45_000]
    assert got[1].total_count == len(near) and [x.sale_date for x in got[1].recent] == sorted((r.sale_date for r in near), reverse=True)[:10]
    assert got[2].total_count is None and got[2].recent is None


def haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def test_repeated_cache_rows_do_not_multiply_sales(spark):
    df = spark.createDataFrame([(1, "1 A St", "Cork", None, None, None)], "id int, address string, county string, eircode string, latitude double, longitude double")
    cache = spark.createDataFrame([("1 A St, Cork", 52.0, -8.0), ("1 A St, Cork", 51.0, -8.5), ("1 A St", 53.0, -7.0), (None, 1.0, 1.0)], "query string, cached_lat double, cached_lon double")
    got = sinks.apply_geocode_cache(df, cache).collect()
    assert [(r.id, r.latitude, r.longitude) for r in got] == [(1, 51.0, -8.5)]
