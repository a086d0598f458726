"""Equal requests are looked up once and each gets its rows; lists are cut before sales are opened."""

import datetime

import pytest

from dwellspark.operators import joins, search, valuation

DAY = datetime.date(2000, 1, 1)


@pytest.fixture(scope="module")
def town(spark):
    rows = [(i, f"{i % 7} Main Street, Town", "Cork", DAY + datetime.timedelta(i), 100_000 + 997 * (i % 13), False, 53.0 + (i % 5) * 0.001, -7.0, False, 3, "house")
            for i in range(200)]
    return spark.createDataFrame(rows, "id long, address_normalized string, county string, sale_date date, price long, not_full_market_price boolean, "
                                 "latitude double, longitude double, geocode_suspect boolean, bedrooms int, property_type string"
                                 ).selectExpr("*", "address_normalized as address")


def met(monkeypatch, module, name):
    """Distinct left rows that each call of a join got."""
    seen, plain = [], getattr(module, name)

    def counted(left, *args, **kwargs):
        seen.append(left.count())
        return plain(left, *args, **kwargs)
    monkeypatch.setattr(module, name, counted)
    return seen


def by_request(rows, *cols):
    out = {}
    for r in rows.collect():
        out.setdefault(r[0], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


def places(spark, key="query_id"):
    return spark.createDataFrame([(i, 53.0, -7.0, 1.0 + (i == 19), None) for i in range(20)], f"{key} long, q_lat double, q_lon double, radius_km double, county string")


def test_equal_areas_meet_places_once(spark, town, monkeypatch):
    seen = met(monkeypatch, search, "radius_pairs")
    got = by_request(search.area_trends(places(spark), town), "year", "n", "median_price", "min_price", "max_price")
    assert seen == [2] and len(got) == 20 and len({str(v) for v in got.values()}) == 1
    prices = sorted(r.price for r in town.collect())
    assert got[0] == [(2000, 200, float(round((prices[99] + prices[100]) / 2)), prices[0], prices[-1])]


def test_median_over_wide_prices(spark):
    """The median lies in another bucket than most of the prices' sum."""
    rows = [(i, DAY, p, False, 53.0 + i * 1e-4, -7.0, False) for i, p in enumerate([10_000, 20_000, 70_000, 400_000, 15_000_000, 19_000_000])]
    df = spark.createDataFrame(rows, "id long, sale_date date, price long, not_full_market_price boolean, latitude double, longitude double, geocode_suspect boolean")
    got = search.area_trends(places(spark).where("query_id = 0"), df).collect()
    assert [(r.n, r.median_price) for r in got] == [(6, 235_000.0)]


def test_equal_searches_are_looked_up_once(spark, town, monkeypatch):
    seen = met(monkeypatch, search, "radius_pairs")
    got = by_request(search.radius_search(places(spark), town, limit=3).select("query_id", "position", "id"), "position", "id")
    assert max(seen) == 2 and all(v == [(1, 199), (2, 198), (3, 197)] for v in got.values()) and len(got) == 20


def test_equal_subjects_are_valued_once(spark, town, monkeypatch):
    subjects = places(spark, "subject_id").selectExpr("subject_id", "q_lat as s_lat", "q_lon as s_lon", "date'2000-12-31' as window_end", "cast(null as long) as exclude_id")
    seen = met(monkeypatch, valuation, "radius_pairs")
    got = by_request(valuation.find_comparables(subjects, town, max_n=4).select("subject_id", "rank", "id"), "rank", "id")
    assert max(seen) == 1 and len(got) == 20 and len({str(v) for v in got.values()}) == 1


def test_a_repeated_id_keeps_its_rows(spark, town):
    """As before, requests of one id multiply each other's rows."""
    twice = places(spark).where("query_id < 1").union(places(spark).where("query_id < 1"))
    got = search.radius_search(twice.union(places(spark).where("query_id = 1")), town, limit=4).select("query_id", "position", "id")
    assert by_request(got, "position", "id") == {0: [(i, 199) for i in range(1, 5)], 1: [(1, 199), (2, 198), (3, 197), (4, 196)]}


def test_only_first_addresses_are_opened(spark, town, monkeypatch):
    asked = spark.createDataFrame([(i, "main street", None) for i in range(9)], "query_id long, query string, county string")
    seen, opened = met(monkeypatch, search, "_term_hits"), []
    plain = search._first_hits
    monkeypatch.setattr(search, "_first_hits", lambda *a: (opened.append(plain(*a)), opened[-1])[1])
    got = by_request(search.all_terms_search(asked, town, limit=3).select("query_id", "position", "id"), "position", "id")
    assert seen == [1] and opened[0].count() == 3
    assert len(got) == 9 and all(v == [(1, 199), (2, 198), (3, 197)] for v in got.values())


def test_corrections_meet_distinct_addresses(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{i % 2} Town{i % 2}, X", 53.0, -6.0) for i in range(40)], "id long, address string, latitude double, longitude double")
    fixes = spark.createDataFrame([(f, "town1", 53.0, -6.0, 50.0 + f, -8.0) for f in range(30, 0, -1)],
                                  "fix_id long, word string, wrong_lat double, wrong_lon double, right_lat double, right_lon double")
    seen = met(monkeypatch, search, "near_equal_join")
    got = {r.id: (r.corrected, r.latitude) for r in search.apply_corrections(df, fixes).collect()}
    assert seen == [2] and got == {i: (i % 2 == 1, 51.0 if i % 2 else 53.0) for i in range(40)}


def test_a_sparse_area_goes_on_to_wider_rings(spark, town):
    area = spark.createDataFrame([(1, 53.05, -7.0, 1.0, None)], "query_id long, q_lat double, q_lon double, radius_km double, county string")
    assert search.area_summary(area, town).first().total_count is None
    wide = search.area_summary(area, town, expand=True).first()
    assert wide.total_count == 10 and [r.id for r in wide.recent] == list(range(199, 189, -1))


def test_shared_requests_keep_null_ids(spark):
    asked, members = joins.shared_requests(spark.createDataFrame([(None, "a"), (2, "b"), (3, "b")], "query_id long, q string"), ["q"])
    assert sorted((r.query_id or 0, r.q) for r in asked.collect()) == [(0, "a"), (2, "b")]
    rows = joins.for_each_request(asked, members).collect()
    assert sorted((r.query_id or 0, r.q) for r in rows) == [(0, "a"), (2, "b"), (3, "b")]


def test_restored_queries(spark, sf):
    from dwellspark.plans import catalog
    sql = catalog.oracle_sql()
    assert "lookups" in sql["area_hint"] and "< 0.4" in sql["area_hint"] and "chosen" in sql["area_summary"]
