"""Steps whose work must not grow with equal rows: what they look up, and that the rows are those of the plain way."""

import datetime as dt
import math

from pyspark.sql import functions as F

from dwellspark.functions import geo, text
from dwellspark.operators import incremental, joins, resolve, search, stats


def _sales(spark, n=30):
    rows = [(i, dt.date(2020, 1, 1 + i % 28), 100_000.0 + i, f"{1 + i % 2} Main St, Town{i % 2}, Cork", "Cork" if i % 3 else "Kerry", 51.9 + i % 2 * 0.01, -8.5,
             False, False, None, None, None) for i in range(n)]
    s = spark.createDataFrame(rows, "id long, sale_date date, price double, address string, county string, latitude double, longitude double, "
                                    "not_full_market_price boolean, geocode_suspect boolean, bedrooms int, property_type string, eircode string")
    return s.withColumn("created_at", F.col("sale_date").cast("timestamp"))


def test_county_box_reads_the_county_once(spark):  # the compiled stage had it 26 times and did not fit
    inside = geo.in_county_box("la", "lo", text.normalize_county("c"), 0.2)
    assert str(inside).count("regexp_replace") == 1
    rows = [(51.9, -8.5, "Co Cork"), (51.9, -8.5, "Donegal"), (51.9, -8.5, "Nowhere"), (51.9, -8.5, None), (None, -8.5, "Cork")]
    got = spark.createDataFrame(rows, "la double, lo double, c string").select(inside.alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, None, None, None]


def test_radius_rows_meet_in_the_result_alone(spark):  # F12
    left = [(i, 53.0 + i % 3 * 0.01, -6.0) for i in range(40)] + [(98, None, -6.0), (99, 53.0, None)]
    right = [(100 + i, 53.0 + i % 2 * 0.01, -6.0) for i in range(50)] + [(100, 53.0, -6.0), (None, 53.01, -6.0), (7, None, None)]
    a = spark.createDataFrame(left, "q long, q_lat double, q_lon double")
    b = spark.createDataFrame(right, "id long, latitude double, longitude double")
    got = sorted(((r["q"], r["id"]) for r in joins.radius_rows(a, b, 500.0, bundle=4).collect()), key=str)
    far = lambda p, q: None in (*p, *q) or math.dist(p, q) > 0.004
    assert got == sorted(((x[0], y[0]) for x in left for y in right if not far(x[1:], y[1:])), key=str)
    plain = joins.radius_pairs(a, b, 500.0).select("q", "id", F.round("distance_m", 6))
    assert sorted(map(str, plain.collect())) == sorted(map(str, joins.radius_rows(a, b, 500.0, bundle=4).select("q", "id", F.round("distance_m", 6)).collect()))


def test_equal_subscriptions_are_looked_up_once(spark, monkeypatch):  # F11, F21
    t = dt.datetime(2020, 1, 5)
    subs = [(i, f"m{i}", "1 main st", 2.0, None, True, t, None) for i in range(20)] + [(3, "other", "2 main st", 0.1, "Cork", True, t, None), (77, "x", "2 main st", 0.1, "Cork", False, t, None)]
    subs = spark.createDataFrame(subs, "sub_id long, email string, address string, radius_km double, county string, is_active boolean, created_at timestamp, last_sent_at timestamp")
    met = []
    monkeypatch.setattr(incremental, "radius_pairs", lambda left, *rest: met.append(left.count()) or joins.radius_pairs(left, *rest))
    for match in ("contains", "prefix"):
        met.clear()
        got = incremental.match_alerts(subs, _sales(spark), limit=5, match=match).collect()
        assert met == [3]  # the shared one, and the two of id 3
        newest = sorted((r for r in _sales(spark).collect() if r["created_at"] > t), key=lambda r: (-r["sale_date"].toordinal(), r["id"]))
        for sub in (0, 19):
            rows = sorted((r for r in got if r["sub_id"] == sub), key=lambda r: r["position"])
            assert [r["id"] for r in rows] == [r["id"] for r in newest[:5]] and {r["email"] for r in rows} == {f"m{sub}"}
        assert {r["email"] for r in got if r["sub_id"] == 3} == {"m3", "other"} and not [r for r in got if r["sub_id"] == 77]


def test_streets_are_read_off_addresses(spark, monkeypatch):  # F20
    read, plain = [], stats.with_street_key
    monkeypatch.setattr(stats, "with_street_key", lambda df, address="address_normalized": read.append(df.count()) or plain(df, address))
    s = _sales(spark, 60)
    ranking = stats.street_ranking(s, "address", floor=1, min_value=1)
    pages = stats.street_pages(s, stats.street_registry(ranking), "address", newest=3).collect()
    assert read == [4, 4]  # two addresses in two counties each
    assert sum(p["total_transactions"] for p in pages) == 60 and {len(p["transactions"]) for p in pages} == {3}


def test_audit_of_shared_requests(spark):  # F25
    asks = spark.createDataFrame([(i, 51.9, -8.5, 5.0, "cork" if i % 2 else None) for i in range(1, 9)], "query_id long, q_lat double, q_lon double, radius_km double, county string")
    rows, members = search.shared_radius_search(asks, _sales(spark), limit=10)
    assert rows.select("query_id").distinct().count() == 2 and members.count() == 8
    audit = sorted(map(str, joins.for_each_request(incremental.county_filter_audit(rows), members).collect()))
    assert audit == sorted(map(str, incremental.county_filter_audit(search.radius_search(asks, _sales(spark), limit=10)).collect())) and len(audit) == 4


def test_equal_locations_are_looked_up_once(spark, monkeypatch):  # F15
    asks = [(i, "Main St, Town1, Cork", "Cork") for i in range(10)] + [(i, "Nowhere 5", None) for i in range(10, 15)] + [(None, "Main St, Town1, Cork", "Cork"), (20, "51.5, -8.5", None)]
    asks = spark.createDataFrame(asks, "query_id long, query string, county string")
    met, plain = [], resolve.resolve_by_tokens
    monkeypatch.setattr(resolve, "resolve_by_tokens", lambda requests, *rest: met.append(requests.count()) or plain(requests, *rest))
    reference = spark.createDataFrame([], "postcode string, latitude double, longitude double")
    got = {r["query_id"]: r for r in resolve.resolve_locations(asks, _sales(spark), reference).collect()}
    assert met == [2]
    assert {(got[i]["source"], round(got[i]["lat"], 6)) for i in range(10)} == {("db_tokens", 51.91)}
    assert {got[i]["source"] for i in (*range(10, 15), None)} == {None} and got[20]["source"] == "raw"


def test_terms_with_an_unknown_gram_meet_no_scope(spark):  # F15
    book = spark.createDataFrame([("1 main st", "cork"), ("2 main rd", "kerry"), ("3 elm ct", None)], "a string, c string")
    terms = spark.createDataFrame([("main",), ("elm ct",), ("main square",), ("st",), ("aaaa",)], "t string")
    got = joins.contains_join(terms, "t", book, "a", ["c"], "c").select("t", "a").collect()
    assert sorted(map(tuple, got)) == [("elm ct", "3 elm ct"), ("main", "1 main st"), ("main", "2 main rd"), ("st", "1 main st")]


def test_rows_of_an_exact_search_are_not_stored(spark, monkeypatch):  # F2 of round 4: every row with every column was, and was dealt three times
    county = lambda i: (None, "Cork", "Kerry")[i % 3]
    rows = [(i % 90, None if i % 17 == 0 else dt.date(2020, 1 + i % 12, 1 + i % 28), f"{1 + i % 2} Main Street, Town", county(i)) for i in range(100)]
    rows += [(i, dt.date(2019, 5, 5), None, "Cork") for i in (200, 201)]
    s = spark.createDataFrame(rows, "id long, sale_date date, address string, county string").withColumn("address_normalized", F.col("address"))
    asks = [(i, "1 Main St", ("Cork", None)[i % 2]) for i in range(6)] + [(6, "Town Main Street", None), (7, "Town Main Street", "Kerry"), (7, "1 Main St", "Cork"),
                                                                          (8, "Nowhere", None), (None, "1 Main St", None), (None, "Town Main", None)]
    asked = spark.createDataFrame(asks, "query_id long, query string, county string")
    kept, plain = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: (kept.append(plain(df)), kept[-1])[1])
    got = search.exact_address_search(asked, s, limit=5).select("query_id", "id", "county", "found_by", "position").collect()
    assert max(k.count() for k in kept) < 30
    newest = lambda r: (r[1] is None, -(r[1] or dt.date(1, 1, 1)).toordinal(), r[0])
    want = []
    for q in range(6):
        hit = sorted((r for r in rows if (r[2] or "").startswith("1 ") and (q % 2 or r[3] == "Cork")), key=newest)
        want += [(q, r[0], "prefix", n) for n, r in enumerate(hit, 1)]
    for q, hit in ((6, [r for r in rows if r[2]]), (7, [r for r in rows if (r[2] or "").startswith("1 ") and r[3] == "Cork"])):
        hit = sorted(hit, key=newest)[:5 if q == 6 else None]
        want += [(q, r[0], "terms" if q == 6 else "prefix", n) for n, r in enumerate(hit, 1)]
    assert sorted((r["query_id"], r["id"], r["found_by"], r["position"]) for r in got) == sorted(want)


def test_distances_are_rounded_once_for_two_places(spark, sf):  # F3 of round 4: most of the time went into rounding the distance of every row
    from dwellspark.plans import catalog
    plan = catalog.queries()["radius_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    rows, places = plan.split("Generate explode(_lefts", 1)
    assert "round(" not in rows.lower() and "round(" in places.lower()
    a = spark.createDataFrame([(i, 53.0 + i % 3 * 0.001234, -6.0) for i in range(9)], "q long, q_lat double, q_lon double")
    b = spark.createDataFrame([(i, 53.0 + i % 2 * 0.0007, -6.0007) for i in range(8)], "id long, latitude double, longitude double")
    got = joins.radius_rows(a, b, 150.0, digits=1).select("q", "id", "distance_m").collect()
    want = joins.radius_rows(a, b, 150.0).select("q", "id", geo.round_to("distance_m", 1).alias("distance_m")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r["distance_m"] for r in got}) > 2
