"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dwellspark.functions import text
from dwellspark.operators import stats
from dwellspark.operators.incremental import match_alerts
from dwellspark.operators.multiset import append_register, reconcile
from dwellspark.sources.register import HEADER_ALIASES, bind_headers, canonical_headers, csv_lines, split_rejects, typed_register_rows


def start_alert_stream(new_sales: DataFrame, register: DataFrame, subs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New sales against the static subscriptions, one digest file per micro-batch.

    The batch id is part of the output path, so a replayed batch overwrites itself."""
    def send(batch: DataFrame, batch_id: int) -> None:
        match_alerts(subs, register, batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (new_sales.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def query_log_stream(log: DataFrame, window: str = "1 day", delay: str = "1 hour", by: str = "geocode_source") -> DataFrame:
    """Watermarked tumbling counts with approximate latency quantiles."""
    return (log.withWatermark("ts", delay).groupBy(F.window("ts", window), by)
            .agg(F.count("*").alias("queries"), F.count_if(F.col("result_count") == 0).alias("empty"),
                 F.percentile_approx("elapsed_ms", 0.5).alias("p50_ms"), F.percentile_approx("elapsed_ms", 0.95).alias("p95_ms"),
                 F.max("elapsed_ms").alias("max_ms"))
            .select(F.col("window.start").alias("window_start"), by, "queries", "empty", "p50_ms", "p95_ms", "max_ms"))


REGISTER_COLUMNS = ["Date of Sale (dd/mm/yyyy)", "Address", "County", "Eircode", "Price (€)", "Not Full Market Price",
                    "VAT Exclusive", "Description of Property", "Property Size Description"]


def ingest_batch(base: DataFrame, raw: DataFrame, delivery: str = "") -> tuple[DataFrame, DataFrame]:
    """(new rows, rejects) of one delivery, its columns under their headers or canonical names, against the stored register. New rows get an id from
    their content, the copy they are and the delivery's name, and the routing key of their postcode."""
    named = raw if set(HEADER_ALIASES) <= set(raw.columns) else canonical_headers(raw)
    valid, rejects = split_rejects(typed_register_rows(named))
    new = reconcile(base, valid, copy_no="_nth")
    named = new.withColumn("id", F.shiftrightunsigned(F.xxhash64(F.lit(delivery), "_nth", *valid.columns), 1))
    keyed = named.withColumn("routing_key", text.routing_key("eircode")).drop("_nth")
    return append_register(base.limit(0), keyed), rejects


def store_sales(rows: DataFrame, store: str, batch: str) -> None:
    """Write one delivery to the store, by year of sale, with its part of the routing-key statistics. The first
    delivery sets the columns of the store."""
    keyed = rows if "routing_key" in rows.columns else rows.withColumn("routing_key", text.routing_key("eircode"))
    (keyed.withColumn("sale_year", F.year("sale_date")).write.mode("overwrite").partitionBy("sale_year")
     .parquet(f"{store}/sales/batch={batch}"))
    stats.routing_key_state(keyed).write.mode("overwrite").parquet(f"{store}/key_state/batch={batch}")


def stored_sales(spark: SparkSession, store: str, years: list[int] | None = None, but: str | None = None) -> DataFrame:
    """Sales of the store, of some years only (other folders are not opened), without the batch `but`."""
    rows = spark.read.parquet(f"{store}/sales")
    if years is not None:
        rows = rows.where(F.col("sale_year").isin(years))
    if but is not None:
        rows = rows.where(F.col("batch").cast("string") != but)
    return rows.drop("batch", "sale_year")


def stored_key_stats(spark: SparkSession, store: str) -> DataFrame:
    """Routing-key statistics of the store from the states of its deliveries; no sale is read."""
    return stats.stats_of_state(stats.merge_key_states(spark.read.parquet(f"{store}/key_state").drop("batch")))


def delivery_years(raw: DataFrame) -> list[int]:
    """Years of a delivery's sales: they go to the driver, and the calendar bounds them."""
    named = raw if set(HEADER_ALIASES) <= set(raw.columns) else canonical_headers(raw)
    valid, _rejects = split_rejects(typed_register_rows(named))
    return sorted(r[0] for r in valid.select(F.year("sale_date")).distinct().collect() if r[0] is not None)


def start_register_stream(spark: SparkSession, incoming: str, store: str, checkpoint: str, encoding: str = "UTF-8",
                          multi_line: bool = False) -> StreamingQuery:
    """Files in `incoming` are typed, each by its own header, reconciled against the register in
    `store` (begun with `store_sales`) and the missing rows appended; rejects go next to it.

    Reconciliation is a multiset difference by date, so only the delivery's years of the store are read. Each
    micro-batch writes its own folders, so a replayed batch adds nothing twice. Register files carry no coordinates, so a
    delivery leaves the flags of stored rows as they are; located deliveries use `quality.refresh_flags`."""
    raw = csv_lines(spark.readStream, incoming, encoding, multi_line)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        session, name = batch.sparkSession, str(batch_id)
        delivery = bind_headers(batch)
        base = stored_sales(session, store, delivery_years(delivery), but=name)
        new, rejects = ingest_batch(base, delivery, name)
        store_sales(new.select(*base.columns), store, name)
        rejects.write.mode("overwrite").parquet(f"{store}/rejects/batch={name}")
    return (raw.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
