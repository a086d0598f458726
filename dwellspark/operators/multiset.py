"""Snapshot reconciliation and the union of work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.operators.joins import contains_join, near_equal_join
from dwellspark.operators.search import newest_first
from dwellspark.operators.stats import shared_coordinates, top_n


def snapshot_key(df: DataFrame) -> list[Column]:
    """(date, price in cents, trimmed county): the address is left out on purpose,
    because its spelling drifts between snapshots."""
    return [F.col("sale_date").alias("_kd"), F.col("price").cast("decimal(14,2)").alias("_kp"),
            F.trim("county").alias("_kc")]


_KEY = ["_kd", "_kp", "_kc"]
ROW_ORDER = "_digest"
SLICE_CHARS = 4


def row_digest(cols: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))


def reconcile(base: DataFrame, source: DataFrame, content: list[str] | None = None, copy_no: str | None = None) -> DataFrame:
    """Rows of the source missing from the base as a multiset: per key the first
    max(0, n_source - n_base) rows in the order of a content digest.

    Exact copies are collapsed to a count first and expanded at the end, and keys are
    counted by digest prefix, so a hot key is ranked in up to 65,536 independent
    slices and never in one task. Running it twice adds nothing. `copy_no` names a column
    that tells the returned copies of equal rows apart."""
    content = content or [c for c in source.columns if c != "id"]
    copies = source.groupBy(*source.columns).agg(F.count("*").alias("_copies"))
    rows = copies.select("*", *snapshot_key(copies), row_digest(content).alias(ROW_ORDER)) \
        .withColumn("_slice", F.substring(ROW_ORDER, 1, SLICE_CHARS))
    slices = rows.groupBy(*_KEY, "_slice").agg(F.sum("_copies").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*_KEY).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*_KEY))
    have = base.select(*snapshot_key(base)).groupBy(*_KEY).agg(F.count("*").alias("_have"))
    have = have.select(*[F.col(k).alias(f"_b{k}") for k in _KEY], "_have")
    quota = slices.select(*_KEY, "_slice", before.alias("_before"), total.alias("_total"))
    same = reduce(lambda a, b: a & b, [quota[k].eqNullSafe(have[f"_b{k}"]) for k in _KEY])
    quota = (quota.join(have, same, "left")
             .withColumn("_take", F.col("_total") - F.coalesce("_have", F.lit(0)) - F.col("_before"))
             .where("_take > 0").select(*[F.col(k).alias(f"_q{k}") for k in _KEY],
                                        F.col("_slice").alias("_qslice"), "_take"))
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(quota[f"_q{k}"]) for k in _KEY])
    wanted = rows.join(quota, match & (rows["_slice"] == quota["_qslice"]))
    order = [ROW_ORDER, *(["id"] if "id" in source.columns else [])]
    upto = F.sum("_copies").over(Window.partitionBy(*_KEY, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0))
    part = wanted.withColumn("_left", F.col("_take") - (upto - F.col("_copies"))).where("_left > 0")
    nth = [F.concat_ws(".", "_chunk", "_copy").alias(copy_no)] if copy_no else []
    return _repeat(part, F.least("_left", "_copies")).select(*source.columns, *nth)


def _repeat(df: DataFrame, times: Column, chunk: int = 100_000) -> DataFrame:
    """Each row `times` times (at least once), in chunks of bounded size."""
    df = df.withColumn("_times", times)
    df = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / chunk))))
    size = F.least(F.lit(chunk), F.col("_times") - F.col("_chunk") * chunk)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long"))))


def delta_since(base: DataFrame, source: DataFrame, since: str | None = None) -> DataFrame:
    """Rows newer than the base's newest (or a given) date. Misses late filings,
    which is why `reconcile` is the default."""
    if since is not None:
        return source.where(F.col("sale_date") > F.lit(since).cast("date"))
    newest = base.agg(F.max("sale_date").alias("_newest"))
    return source.where(F.col("sale_date") > newest.scalar())


def union_distinct_ids(*hits: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [h.select("id") for h in hits]).distinct()


def append_register(base: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows; absent columns become NULL and unlocated rows need geocoding."""
    located = F.col("latitude").isNotNull() if "latitude" in new.columns else F.lit(False)
    return base.unionByName(new.withColumn("needs_geocoding", ~located), allowMissingColumns=True)


def regeocode_report(df: DataFrame, as_of: str, places: DataFrame, crowded: int = 100, cluster: int = 10,
                     caps: dict[str, int] | None = None, per_point: int = 1000, per_cluster: int = 100,
                     n_clusters: int = 200, per_place: int = 20) -> DataFrame:
    """Four priority lists with their published caps in one table."""
    caps = {"HIGH": 10_000, "MEDIUM": 5_000, "LOW": 5_000, "VERIFY": 1_000, **(caps or {})}
    points = shared_coordinates(df, cluster).select(
        F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), "distinct_addresses")
    point_order = [F.col("distinct_addresses").desc(), F.col("p_lat"), F.col("p_lon")]
    coded_first = [(F.coalesce("eircode", F.lit("")) != "").desc(), *newest_first()]
    cols = ["priority", "reason", "id", "address", "county", "eircode", "latitude", "longitude", "sale_date", "price"]

    def at_points(some: DataFrame, cap: int, limit: int, priority: str, label: str) -> DataFrame:
        hits = near_equal_join(df, some, ["latitude", "longitude"], ["p_lat", "p_lon"], 1e-6)
        rows = top_n(hits, ["p_lat", "p_lon"], coded_first, cap, "_rn").orderBy(*point_order, "_rn").limit(limit)
        reason = F.concat(F.lit(label), F.col("distinct_addresses").cast("string"), F.lit(" addresses at same point"))
        return rows.withColumn("priority", F.lit(priority)).withColumn("reason", reason).select(*cols)

    high = at_points(points.where(F.col("distinct_addresses") >= crowded), per_point, caps["HIGH"], "HIGH", "Centroid: ")
    some = points.where(F.col("distinct_addresses") < crowded).orderBy(*point_order).limit(n_clusters)
    medium = at_points(some, per_cluster, caps["MEDIUM"], "MEDIUM", "Cluster: ")
    low = (df.where(F.col("latitude").isNull() & (F.coalesce("eircode", F.lit("")) != ""))
           .orderBy(*newest_first()).limit(caps["LOW"]).withColumn("priority", F.lit("LOW"))
           .withColumn("reason", F.lit("Missing coordinates (has eircode)")).select(*cols))
    recent = df.where(F.col("latitude").isNotNull() & (F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), 730)))
    dictionary = recent.select(F.lower("address").alias("_a")).distinct()
    hit = contains_join(places.withColumn("_t", F.lower("place")), "_t", dictionary, "_a", [])
    verify = recent.join(hit, F.lower(F.col("address")) == F.col("_a")).drop("_a", "_t")
    verify = (top_n(verify, ["place"], newest_first(), per_place, "_rn").orderBy("place_no", "_rn").limit(caps["VERIFY"])
              .withColumn("priority", F.lit("VERIFY"))
              .withColumn("reason", F.concat(F.lit("Recent sale in problematic area: "), F.col("place"))).select(*cols))
    return reduce(DataFrame.unionByName, [high, medium, low, verify])
