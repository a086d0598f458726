"""Exact grouped quantiles that never hold a whole group in one task.

A built-in exact percentile keeps one value map per group, which fails when one
group holds a third of a large table. Here the values are counted first (map-side
combined), summed into value buckets, and only the few buckets that contain the
wanted ranks are opened and ranked. The work per task is bounded by the bucket
width and the number of buckets, whatever the number of rows.

Values that take any number of distinct doubles go by radix selection instead: a bucket is then a prefix of the
double's bit pattern, 13 bits longer at each level, and only the bucket that holds a wanted rank is opened, so no task ranks more
than 8192 buckets for one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.lineage import cut_lineage


def null_safe(left: DataFrame, right: DataFrame, keys, prefix: str = "_r_") -> tuple[DataFrame, Column]:
    """Right side with renamed keys and the null-safe join condition."""
    right = right.select(*[F.col(k).alias(prefix + k) if k in keys else F.col(k) for k in right.columns])
    cond = [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    return right, reduce(lambda a, b: a & b, cond, F.lit(True))


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    renamed, cond = null_safe(left, right, keys)
    return left.join(renamed, cond, how).drop(*["_r_" + k for k in keys])


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float | str],
                      width: float | Column | None = 1000.0, stats: bool = True,
                      weight: str | None = None) -> DataFrame:
    """Exact quantiles of `value` per `by` group.

    `probs` maps an output name to a probability (linear interpolation) or to
    'upper' (the element at rank n // 2). With `stats` the result also has n,
    mean_value, min_value and max_value from the same pass. NULL values are skipped;
    `width` is the value-bucket width, a number or an expression over `by`, or None for continuous values (radix
    selection; values that are not finite are skipped too); `weight` names a column of row counts when the input is already aggregated."""
    if width is None:
        return _radix_quantiles(df, by, value, probs, stats, weight)
    width = width if isinstance(width, Column) else F.lit(width)
    hist = (df.where(F.col(value).isNotNull())
            .groupBy(*by, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c")))
    bucket = F.floor(F.col("_v").cast("double") / width).cast("long")
    buckets = hist.groupBy(*by, bucket.alias("_b")).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_v") * F.col("_c")).alias("_s"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    detail = join_null_safe(hist.withColumn("_b", bucket), opened_buckets(buckets, by, probs), [*by, "_b"])
    return ranked_values(detail, by, probs, stats)


def opened_buckets(buckets: DataFrame, by: list[str], probs: dict[str, float | str]) -> DataFrame:
    """The value buckets that hold a wanted rank, with the rows before them (`_before`) and n, _total, _min, _max of their
    group. `buckets` is (by, _b, _n, _s, _lo, _hi): bucket, rows, sum and bounds of its values."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = group.orderBy("_b")
    buckets = buckets.select(
        *by, "_b", "_n", F.sum("_n").over(running).alias("_cum"),
        F.sum("_n").over(group).alias("n"), F.sum("_s").over(group).alias("_total"),
        F.min("_lo").over(group).alias("_min"), F.max("_hi").over(group).alias("_max"))
    wanted = reduce(lambda a, b: a | b, [_holds(r, "_n", "_cum") for lo, hi, _ in _ranks(probs).values() for r in (lo, hi)])
    return buckets.where(wanted).withColumn("_before", F.col("_cum") - F.col("_n")).drop("_n", "_cum")


def ranked_values(detail: DataFrame, by: list[str], probs: dict[str, float | str], stats: bool = True) -> DataFrame:
    """Quantiles per group from the counted values (_v, _c) of its opened buckets, beside the columns of `opened_buckets`."""
    ranks = _ranks(probs)
    inside = Window.partitionBy(*by, "_b").orderBy("_v")
    detail = detail.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    picks = []
    for name, (lo, hi, _) in ranks.items():
        at = lambda r: F.max(F.when(_holds(r, "_c", "_upto"), F.col("_v").cast("double")))
        picks += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}")]
    out = detail.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("_total").alias("_total"), F.max("_min").alias("_min"),
        F.max("_max").alias("_max"), *picks)
    cols = [F.col(k) for k in by]
    if stats:
        cols += [F.col("n"), (F.col("_total").cast("double") / F.col("n")).alias("mean_value"),
                 F.col("_min").cast("double").alias("min_value"),
                 F.col("_max").cast("double").alias("max_value")]
    for name, (_, _, frac) in ranks.items():
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((a * (F.lit(1.0) - frac) + b * frac).alias(name))
    return out.select(*cols)


def _holds(rank: Column, size: str, cum: str) -> Column:
    return (rank >= F.col(cum) - F.col(size)) & (rank < F.col(cum))


def _ranks(probs: dict[str, float | str]) -> dict[str, tuple[Column, Column, Column]]:
    """Lower rank, upper rank and the share of the upper one, over the row count n."""
    ranks = {}
    for name, p in probs.items():
        if p == "upper":
            lo = hi = F.floor(F.col("n") / 2).cast("long")
            frac = F.lit(0.0)
        else:
            pos = (F.col("n") - 1).cast("double") * F.lit(float(p))
            lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
            frac = pos - F.floor(pos)
        ranks[name] = (lo, hi, frac)
    return ranks


#: Bits left below each level of the selection: the exponent comes first, then the mantissa in fours of 13 bits.
LEVELS = (52, 39, 26, 13, 0)


def ordered_key(v: Column) -> Column:
    """The bit pattern of a finite double as a whole number in the order of the values."""
    size = F.abs(v)
    guess = F.greatest(F.lit(-1022), F.floor(F.log2(size)))
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(size >= two(guess + 1), guess + 1).when((size < two(guess)) & (guess > -1022), guess - 1).otherwise(guess)
    key = (e + 1022) * F.lit(1 << 52) + (size / two(e) * F.lit(float(1 << 52))).cast("long")
    return F.when(v < 0, -key).otherwise(key)


def _radix_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float | str], stats: bool, weight: str | None) -> DataFrame:
    v, keys = F.col(value).cast("double"), [*by, "_g"]
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).withColumn("_g", F.lit(1))
    values = cut_lineage(finite.groupBy(*keys, v.alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
                         .withColumn("_p", ordered_key(F.col("_v"))))
    tables = {0: values.select(*keys, "_p", "_c")}
    for low, high in zip(LEVELS[::-1], LEVELS[-2::-1]):
        tables[high] = tables[low].groupBy(*keys, F.shiftright("_p", high - low).alias("_p")).agg(F.sum("_c").alias("_c"))
    total = values.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("_total"),
                                      F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    ranks = _ranks(probs)
    asked = F.explode(F.array_distinct(F.array(*[r for lo, hi, _ in ranks.values() for r in (lo, hi)])))
    at = total.select(*keys, asked.alias("_rank")).withColumn("_left", F.col("_rank"))
    for i, level in enumerate(LEVELS):
        below = tables[level]
        if i:
            below = below.withColumn("_q", F.shiftright("_p", LEVELS[i - 1] - level))
            at = at.withColumnRenamed("_p", "_q")
        met = join_null_safe(at, below, [*keys, "_q"] if i else keys)
        met = met.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_rank").orderBy("_p")))
        met = met.where((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c")))
        at = met.select(*keys, "_rank", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"), "_p")
    found = join_null_safe(at, values.select(*keys, "_p", "_v"), [*keys, "_p"]).groupBy(*keys, "_rank").agg(F.min("_v").alias("_v"))
    wide = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two entries a probability
    out = join_null_safe(total, wide, keys)
    cols = [F.col(k) for k in by]
    if stats:
        cols += [F.col("n"), (F.col("_total") / F.col("n")).alias("mean_value"), F.col("_min").alias("min_value"), F.col("_max").alias("max_value")]
    at_rank = lambda r: F.element_at("_at", r)
    return out.select(*cols, *[(at_rank(lo) * (F.lit(1.0) - frac) + at_rank(hi) * frac).alias(name) for name, (lo, hi, frac) in ranks.items()])
