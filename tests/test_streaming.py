"""Streaming forms against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from dwellspark import fixtures
from dwellspark.operators import incremental, quality, stats
from dwellspark.plans.incrementals import arrived_sales, query_log, subscriptions
from dwellspark.streaming import jobs


def stream_of(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_alert_stream_equals_batch(spark, sales, tmp_path):
    s = arrived_sales(sales)
    subs = subscriptions(s)
    q = jobs.start_alert_stream(stream_of(spark, s, str(tmp_path / "in")), s, subs, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    key = lambda d: sorted((r["sub_id"], r["position"], r["id"]) for r in d.collect())
    got, want = key(spark.read.parquet(str(tmp_path / "out"))), key(incremental.match_alerts(subs, s))
    assert got == want and want


def test_query_log_stream_counts(spark, sf, tmp_path):
    log = query_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).drop("arrived_at")
    out = jobs.query_log_stream(stream_of(spark, log, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("log_stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window_start"], r["geocode_source"]): (r["queries"], r["empty"]) for r in spark.table("log_stats").collect()}
    batch = incremental.query_log_stats(log.withColumn("arrived_at", F.col("ts")))
    want = {(r["window_start"], r["geocode_source"]): (r["queries"], r["empty"]) for r in batch.collect()}
    assert got == want and want


def test_register_stream_is_idempotent(spark, tmp_path):
    store, incoming = tmp_path / "store", tmp_path / "incoming"
    incoming.mkdir()
    rows = [(1, dt.date(2020, 2, 1), "1 Rd", "Cork", 100, "T12 AB12"), (2, dt.date(2015, 2, 1), "9 Rd", "Cork", 100, "T12 AB13")]
    base = spark.createDataFrame(rows, "id long, sale_date date, address string, county string, price int, eircode string") \
        .withColumn("price", F.col("price").cast("decimal(12,2)")).withColumn("needs_geocoding", F.lit(False)) \
        .withColumns({"latitude": F.lit(53.0), "longitude": F.lit(-8.0), "not_full_market_price": F.lit(False)})
    jobs.store_sales(base, str(store), "start")
    head = ",".join(jobs.REGISTER_COLUMNS) + "\n"
    (incoming / "a.csv").write_text(head + "01/02/2020,1 Road,Cork,,100,No,No,,\n03/02/2020,2 Rd,Mayo,T12 AB14,200,No,No,,\nbad,3 Rd,Mayo,,1,No,No,,\n")
    run = lambda: jobs.start_register_stream(spark, str(incoming), str(store), str(tmp_path / "cp")).awaitTermination()
    stored = lambda: jobs.stored_sales(spark, str(store))
    run()
    assert stored().count() == 3
    (incoming / "b.csv").write_text(head + "01/02/2020,1 Rd.,Cork,,100,No,No,,\n03/02/2020,2 Rd,Mayo,,200,No,No,,\n03/02/2020,2 Rd,Mayo,,200,No,No,,\n")
    run()
    rows = stored().collect()
    assert sorted((r["county"], int(r["price"])) for r in rows) == [("Cork", 100), ("Cork", 100), ("Mayo", 200), ("Mayo", 200)]
    assert len({r["id"] for r in rows}) == 4
    assert spark.read.option("recursiveFileLookup", True).parquet(str(store / "rejects")).count() == 1
    read = jobs.stored_sales(spark, str(store), [2020]).select(F.input_file_name().alias("f")).distinct()
    assert all("sale_year=2020" in r["f"] for r in read.collect())      # other years are not opened
    got = {r["routing_key"]: r for r in jobs.stored_key_stats(spark, str(store)).collect()}
    assert set(got) == {"T12"} and got["T12"]["property_count"] == 3 and got["T12"]["geocoded_count"] == 2
    assert (got["T12"]["primary_county"], got["T12"]["median_price"]) == ("Cork", 100.0)
    assert (got["T12"]["earliest_sale"], got["T12"]["latest_sale"]) == (dt.date(2015, 2, 1), dt.date(2020, 2, 3))


def test_refreshed_flags_equal_flags_of_the_whole(spark):
    """A third of all rows on one point; the delivery moves a centroid and makes a crowd."""
    rows = [(i, f"{i} Rd", "Cork", "T12 X%03d" % i, 51.9, -8.5) for i in range(60)] + [(100 + i, f"{i} Ln", "Mayo", "F12 X%03d" % i, 53.9 + i / 1000, -9.3) for i in range(40)]
    rows += [(200 + i, f"{i} Av", "Cork", None, None, None) for i in range(5)] + [(300 + i, f"{i} Sq", "Mayo", "F12 Y%03d" % i, 53.2, -6.3) for i in range(60)]
    s = spark.createDataFrame(rows, "id long, address string, county string, eircode string, latitude double, longitude double").withColumns(
        {"routing_key": F.substring("eircode", 1, 3), "price": F.lit(1), "not_full_market_price": F.lit(False), "sale_date": F.lit(dt.date(2020, 1, 1))})
    key = lambda d: sorted((r["id"], r["geocode_suspect"], r["needs_geocoding"]) for r in d.select("id", "geocode_suspect", "needs_geocoding").collect())
    for cut in ("id >= 300", "id % 7 = 0", "id between 200 and 299", "id < 0"):
        base, new = s.where(f"not ({cut})"), s.where(cut)
        merged = stats.stats_of_state(stats.merge_key_states(stats.routing_key_state(base).union(stats.routing_key_state(new))))
        before = quality.flag_geocodes(base, stats.routing_key_stats(base)).select("id", "geocode_suspect", "needs_geocoding")
        after = quality.refresh_flags(s, new, merged)
        assert key(before.join(after.select("id"), "id", "left_anti").unionByName(after)) == key(quality.flag_geocodes(s, stats.routing_key_stats(s)))
