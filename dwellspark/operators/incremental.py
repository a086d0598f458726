"""Subscriptions, query-log analytics and budgets (batch forms).

The streaming forms in `dwellspark.streaming` call these per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.functions import text
from dwellspark.lineage import cut_lineage
from dwellspark.operators.joins import contains_join, for_each_request, prefix_join, radius_pairs, shared_requests, with_scalars
from dwellspark.operators.quantiles import grouped_quantiles, join_null_safe
from dwellspark.operators.stats import top_n


def subscription_points(subs: DataFrame, df: DataFrame, match: str = "contains") -> DataFrame:
    """Subject point of each active subscription: the located sale with the lowest id
    whose address contains (or starts with) the subscribed address."""
    book = (df.where("latitude is not null").groupBy(F.lower("address").alias("_a"))
            .agg(F.min(F.struct("id", "latitude", "longitude")).alias("_p")))
    terms = subs.where("is_active").select(F.lower("address").alias("_t")).distinct()
    pairs = (contains_join(terms, "_t", book.select("_a"), "_a", []).join(book, "_a") if match == "contains"
             else prefix_join(terms, "_t", book, "_a"))
    point = pairs.groupBy("_t").agg(F.min("_p").alias("_p")).select(
        "_t", F.col("_p.latitude").alias("q_lat"), F.col("_p.longitude").alias("q_lon"))
    return subs.where("is_active").join(point, F.lower("address") == F.col("_t")).drop("_t")


def match_alerts(subs: DataFrame, df: DataFrame, new_sales: DataFrame | None = None, limit: int = 50,
                 match: str = "contains", hide_suspect: bool = False) -> DataFrame:
    """Newest sales for each subscription (sub_id, email, address, radius_km, county,
    is_active, created_at, last_sent_at) since its last digest.

    Addresses are located in `df`; the sales come from `new_sales` when given. Subscriptions that ask the same are looked up once, and
    meet distinct points with their newest arrival. A point's sales are opened once for each date they are asked since, not once
    for each subscription, and cut to the newest `limit` then."""
    sales = (df if new_sales is None else new_sales).where(
        F.col("latitude").isNotNull() & ~F.col("not_full_market_price"))
    if hide_suspect:
        sales = sales.where(~F.coalesce("geocode_suspect", F.lit(False)))
    place = ["latitude", "longitude", "sale_county"]
    order = [F.col("sale_date").desc(), F.col("id")]
    points = sales.groupBy("latitude", "longitude", F.col("county").alias("sale_county")).agg(F.max("created_at").alias("_newest"))
    located = subscription_points(subs, df, match).withColumn("_since", F.coalesce("last_sent_at", "created_at"))
    asked, members = shared_requests(located, ["q_lat", "q_lon", "radius_km", "county", "_since"], "sub_id", "email")
    near = radius_pairs(asked.withColumn("_reach", F.col("radius_km") * 1000.0), points, "_reach").where(
        (F.col("_newest") > F.col("_since"))
        & (F.col("county").isNull() | (F.col("county") == "") | (F.col("county") == F.col("sale_county"))))
    near = cut_lineage(near.select("sub_id", "email", *place, "_since", "distance_m"))
    opened = join_null_safe(sales.select("id", "sale_date", "price", F.col("address").alias("sale_address"), F.col("county").alias("sale_county"),
                                         F.col("created_at").alias("_arrived"), "latitude", "longitude"),
                            near.select(*place, "_since").distinct(), place).where(F.col("_arrived") > F.col("_since"))
    kept = top_n(opened, [*place, "_since"], order, limit, "_rn").drop("_rn", "_arrived")
    found = top_n(join_null_safe(near, kept, [*place, "_since"]), ["sub_id"], order, limit, "position").select(
        "sub_id", "email", "position", "id", "sale_address", "price", "sale_date", "sale_county",
        (F.col("distance_m") / 1000.0).alias("distance_km"))
    return for_each_request(found, members, "sub_id", "email")


def subscription_token(email, address) -> Column:
    return F.sha2(F.concat_ws("|", email, address), 256)


def apply_subscription_events(subs: DataFrame, events: DataFrame) -> DataFrame:
    """Fold subscribe/unsubscribe events (ts, kind, email, address, radius_km, county,
    token) into one row per (email, address).

    Subscribing updates, reactivates or inserts; unsubscribing by token deactivates
    what is active at that moment. Only the last event per key matters."""
    key = ["email", "address"]
    signed = (events.where("kind = 'subscribe'").groupBy(*key)
              .agg(F.max_by(F.struct("radius_km", "county"), "ts").alias("_new"), F.max("ts").alias("_sub_ts")))
    merged = subs.join(signed, key, "full").withColumn(
        "token", F.coalesce("token", subscription_token("email", "address")))
    left = events.where("kind = 'unsubscribe'").groupBy("token").agg(F.max("ts").alias("_off_ts"))
    rows = merged.join(left, "token", "left")
    new = F.col("_new").isNotNull()
    off = F.coalesce(F.col("_off_ts") > F.coalesce("_sub_ts", F.lit("1970-01-01").cast("timestamp")), F.lit(False))
    return rows.select(
        *key, F.when(new, F.col("_new.radius_km")).otherwise(F.col("radius_km")).alias("radius_km"),
        F.when(new, F.col("_new.county")).otherwise(F.col("county")).alias("county"),
        (F.when(new, True).otherwise(F.col("is_active")) & ~off).alias("is_active"),
        F.when(new, F.col("_sub_ts")).otherwise(F.col("created_at")).alias("created_at"), "last_sent_at", "token")


def query_log_stats(log: DataFrame, window: str = "1 day", delay: str = "1 hour", by: str = "geocode_source") -> DataFrame:
    """Volume, empty results and latency per period and source.

    Rows that arrived later than the delay allows are left out, as the stream's
    watermark does."""
    on_time = log.where(F.col("arrived_at") <= F.col("ts") + F.expr(f"interval {delay}"))
    rows = on_time.withColumn("window_start", F.window("ts", window)["start"])
    key = ["window_start", by]
    counts = rows.groupBy(*key).agg(F.count("*").alias("queries"), F.count_if(F.col("result_count") == 0).alias("empty"))
    latency = grouped_quantiles(rows, key, "elapsed_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, None)
    return counts.join(latency.select(*key, "p50_ms", "p95_ms", F.col("max_value").alias("max_ms")), key)


def county_filter_audit(results: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Per request with a county that was not dropped: rows of another county."""
    a, b = F.col("county"), F.col("asked_county")
    wrong = (a != b) if case_sensitive else (F.lower(a) != F.lower(b))
    return (results.where(b.isNotNull() & ~F.col("county_dropped")).groupBy("query_id", "asked_county")
            .agg(F.count("*").alias("total"), F.count_if(wrong).alias("wrong"),
                 F.array_sort(F.collect_set("county")).alias("counties")))


def request_budget(worklist: DataFrame, usage: DataFrame, order: list[Column], month_start: str, need: str = "need",
                   limit: int = 100_000) -> DataFrame:
    """Rows of an ordered work list that still fit the month's allowance.

    Rows that need nothing always fit, at no cost. Every other row needs at least one request, so no more than `limit` rows can fit: the
    running sum is taken over that many leading rows only, which is exact."""
    used = usage.where(F.col("ts") >= F.lit(month_start).cast("timestamp")).agg(
        F.coalesce(F.sum("request_count"), F.lit(0)).alias("used"))
    free = worklist.where(F.coalesce(F.col(need), F.lit(0)) < 1)
    head = worklist.where(F.col(need) >= 1).orderBy(*order).limit(limit)
    running = F.sum(need).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    costed = head.withColumn("running_need", running).unionByName(free.withColumn("running_need", F.lit(0)))
    return (with_scalars(costed, used)
            .withColumn("remaining", F.lit(limit) - F.col("used"))
            .where((F.col("running_need") <= F.col("remaining")) | (F.col("running_need") == 0)))
