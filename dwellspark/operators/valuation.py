"""Comparable-sales valuation of whole request tables, and its back-test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.functions import geo
from dwellspark.lineage import cut_lineage
from dwellspark.operators.joins import asof_nearest, for_each_request, nearest_join, radius_pairs, shared_requests
from dwellspark.operators.quantiles import grouped_quantiles
from dwellspark.operators.resolve import resolve_subjects
from dwellspark.operators.stats import market_sales, routing_key_stats, top_n

# Search radii, window, price bounds of comparables.
RADII_M = [1_000.0, 2_000.0, 5_000.0, 10_000.0, 20_000.0]
WINDOW_DAYS = 3 * 365
COMPARABLE_MIN, COMPARABLE_MAX = 50_000, 5_000_000
# What a subject asks for.
SUBJECT = ["s_lat", "s_lon", "window_end", "exclude_id"]


def find_comparables(subjects: DataFrame, df: DataFrame, min_n: int = 10, max_n: int = 30, strict: bool = False,
                     hide_suspect: bool = False, reaches_m: tuple[float, ...] = (2_000.0, 5_000.0, 20_000.0)) -> DataFrame:
    """Comparables of each subject (subject_id, s_lat, s_lon, window_end, exclude_id).

    Market sales of the three years before `window_end` (exclusive when strict); the
    smallest radius with enough of them; the nearest, then newest, `max_n`. Sales on
    one point and day tie in distance and recency, so each such group is cut to
    max_n + 1 rows and counted before any subject meets it: a point holding a third of
    all sales stays bounded. Radii are tried in tiers of growing reach, each with a grid of its own that only
    the subjects meet that the tiers before could not settle. Subjects that ask the same are looked up once."""
    asked, members = shared_requests(subjects.where("subject_id is not null"), SUBJECT, "subject_id")
    return for_each_request(_comparables(asked, df, min_n, max_n, strict, hide_suspect, reaches_m), members, "subject_id")


def _comparables(subjects: DataFrame, df: DataFrame, min_n: int = 10, max_n: int = 30, strict: bool = False,
                 hide_suspect: bool = False, reaches_m: tuple[float, ...] = (2_000.0, 5_000.0, 20_000.0)) -> DataFrame:
    sales = market_sales(df, COMPARABLE_MIN, COMPARABLE_MAX).where("latitude is not null and longitude is not null")
    if hide_suspect:
        sales = sales.where(~F.coalesce("geocode_suspect", F.lit(False)))
    place = ["latitude", "longitude"]
    days = cut_lineage(sales.groupBy(*place, "sale_date").agg(F.count("*").alias("n")))
    points = days.select(*place).distinct()
    kept = top_n(sales, [*place, "sale_date"], [F.col("id")], max_n + 1, "_rn").drop("_rn")
    own = sales.select(F.col("id").alias("exclude_id"), F.col("latitude").alias("_xy"), F.col("longitude").alias("_xx"),
                       F.col("sale_date").alias("_xd"))
    asked = cut_lineage(subjects.where("s_lat is not null").join(own, "exclude_id", "left"))
    age = F.datediff("window_end", "sale_date")
    in_window = (age <= WINDOW_DAYS) & ((age > 0) if strict else (age >= 0))

    def tier(some: DataFrame, reach: float):
        radii = [r for r in RADII_M if r <= reach]
        pairs = radius_pairs(some, points, reach, left_at=("s_lat", "s_lon"))
        mine = (F.col("_xy") == F.col("latitude")) & (F.col("_xx") == F.col("longitude")) & (F.col("_xd") == F.col("sale_date"))
        n = F.col("n") - F.when(F.coalesce(mine, F.lit(False)), 1).otherwise(0)
        counts = (pairs.join(days, place).where(in_window).groupBy("subject_id")
                  .agg(*[F.sum(F.when(F.col("distance_m") <= r, n).otherwise(0)).alias(f"n{i}") for i, r in enumerate(radii)]))
        ring = F.lit(None).cast("double")
        for i, r in reversed(list(enumerate(radii))):
            ring = F.when(F.col(f"n{i}") >= min_n, F.lit(r)).otherwise(ring)
        if reach >= RADII_M[-1]:
            ring = F.coalesce(ring, F.lit(RADII_M[-1]))
        return counts.select("subject_id", ring.alias("ring_m")), pairs

    cols = ["subject_id", *place, "distance_m", "window_end", "exclude_id", "ring_m"]
    inside = lambda chosen, pairs: (pairs.join(chosen, "subject_id").where(F.col("distance_m") <= F.col("ring_m")).select(*cols))
    rest, parts = asked, []
    for reach in reaches_m:
        chosen, pairs = tier(rest, reach)
        settled = cut_lineage(chosen.where("ring_m is not null"))
        parts.append(inside(settled, pairs))
        rest = rest.join(settled.select("subject_id"), "subject_id", "left_anti")
    found = reduce(DataFrame.unionByName, parts)
    rows = (found.join(kept, place).where(in_window & (F.col("exclude_id").isNull() | (F.col("id") != F.col("exclude_id"))))
            .withColumn("recency_score", F.lit(1.0) - age / F.lit(float(WINDOW_DAYS))))
    rows = top_n(rows, ["subject_id"], [F.col("distance_m"), F.col("sale_date").desc(), F.col("id")], max_n, "rank")
    return rows.select("subject_id", "rank", "id", "address", "county", "price", "sale_date", "bedrooms", "property_type",
                       "distance_m", "recency_score", "ring_m")


def time_adjust(comparables: DataFrame, index: DataFrame, target: str = "target_date", policy: str = "nearest") -> DataFrame:
    """Prices moved to the target date by the county index, truncated to whole units;
    unchanged where the county has no index."""
    rows = asof_nearest(comparables, index, "county", "sale_date", policy=policy, out="sale_index")
    rows = asof_nearest(rows, index, "county", target, policy=policy, out="target_index")
    price, factor = F.col("price").cast("double"), F.col("target_index") / F.col("sale_index")
    return (rows.withColumn("adjustment_factor", F.coalesce(factor, F.lit(1.0)))
            .withColumn("fallback", factor.isNull())
            .withColumn("adjusted_price", F.coalesce(price * factor, price).cast("long"))
            .drop("sale_index_exact", "target_index_exact"))


def comparable_weights(comparables: DataFrame, subject_bedrooms: str | None = "subject_bedrooms") -> DataFrame:
    """Add normalised `weight`; equal weights when every raw weight is zero."""
    group = Window.partitionBy("subject_id")
    ordered = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dmax = F.max("distance_m").over(group)
    near = F.when(dmax > 0, F.lit(1.0) - F.col("distance_m") / dmax).otherwise(F.lit(1.0))
    rooms = F.lit(1.0)
    if subject_bedrooms:
        gap = F.abs(F.col("bedrooms") - F.col(subject_bedrooms))
        rooms = F.when(gap.isNull(), 1.0).when(gap == 0, 1.5).when(gap == 1, 0.7).otherwise(0.2)
    raw = F.greatest(F.lit(0.0), near * near * F.coalesce("recency_score", F.lit(0.5)) * rooms)
    rows = comparables.withColumn("_raw", raw)
    total = F.sum("_raw").over(ordered)
    return (rows.withColumn("_total", total).withColumn("_n", F.count("*").over(group))
            .withColumn("weight", F.when(F.col("_total") > 0, F.col("_raw") / F.col("_total"))
                        .otherwise(F.lit(1.0) / F.col("_n"))).drop("_raw", "_total", "_n"))


def _seq_sum(array: str, value) -> Column:
    """Sum in array order, so results do not depend on partitioning."""
    return F.aggregate(array, F.lit(0.0), lambda a, c: a + value(c))


def estimate(comparables: DataFrame) -> DataFrame:
    """Weighted estimate, interval and statistics per subject (at most 30 rows each)."""
    packed = comparables.groupBy("subject_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "adjusted_price", "weight", "distance_m"))).alias("_c"))
    price = lambda c: c["adjusted_price"].cast("double")
    n = F.size("_c")
    prices = F.array_sort(F.transform("_c", lambda c: c["adjusted_price"]))
    rows = (packed.withColumn("n_comparables", n)
            .withColumn("estimate", _seq_sum("_c", lambda c: price(c) * c["weight"]).cast("long"))
            .withColumn("_mean", _seq_sum("_c", price) / n).withColumn("_p", prices)
            .withColumn("mean_distance_km", _seq_sum("_c", lambda c: c["distance_m"]) / n / 1000.0))
    est = F.col("estimate").cast("double")
    dev = lambda c: price(c) - F.col("_mean")
    half = n.cast("int")
    rows = (rows.withColumn("_ws", F.sqrt(_seq_sum("_c", lambda c: c["weight"] * (price(c) - est) * (price(c) - est))))
            .withColumn("_sd", F.when(n > 1, F.sqrt(_seq_sum("_c", lambda c: dev(c) * dev(c)) / (n - 1))).otherwise(F.lit(0.0)))
            .withColumn("median_price", F.when(n % 2 == 1, F.get("_p", F.floor(half / 2).cast("int")).cast("double")).otherwise(
                (F.get("_p", (half / 2 - 1).cast("int")) + F.get("_p", (half / 2).cast("int"))) / 2.0)))
    k = F.when(n < 5, 2.0).when(n < 10, 1.5).otherwise(1.0)
    rows = (rows.withColumn("ci_lower", F.greatest(F.lit(0.0), est - k * F.col("_ws")).cast("long"))
            .withColumn("ci_upper", (est + k * F.col("_ws")).cast("long")))
    width = F.when(F.col("estimate") > 0, (F.col("ci_upper") - F.col("ci_lower")) / est * 100.0).otherwise(0.0)
    cv = F.when(F.col("_mean") > 0, F.col("_sd") / F.col("_mean")).otherwise(F.lit(0.0))
    return rows.select(
        "subject_id", "n_comparables", "estimate", "ci_lower", "ci_upper", geo.round_to(width, 1).alias("ci_width_pct"),
        geo.round_to("_mean", 2).alias("mean_price"), "median_price", geo.round_to("_sd", 2).alias("std_dev"),
        geo.round_to(cv, 3).alias("cv"), F.array_min("_p").alias("min_price"), F.array_max("_p").alias("max_price"),
        "mean_distance_km")


# Bounds of the quality factors (1, 0.7, 0.4, else 0.2).
FACTOR_VALUES = (1.0, 0.7, 0.4, 0.2)
COUNT_BOUNDS, DISTANCE_BOUNDS, CV_BOUNDS = (10, 5, 3), (3.0, 10.0, 20.0), (0.20, 0.35, 0.50)


def confidence(estimates: DataFrame) -> DataFrame:
    """Quality score, level, validity and the warnings with their texts."""
    n, km, cv = F.col("n_comparables"), F.col("mean_distance_km"), F.col("cv")
    step = lambda tests: F.when(tests[0], 0).when(tests[1], 1).when(tests[2], 2).otherwise(3)
    rows = estimates.withColumns({"_f0": step([n >= b for b in COUNT_BOUNDS]), "_f1": step([km <= b for b in DISTANCE_BOUNDS]),
                                  "_f2": step([cv <= b for b in CV_BOUNDS])})
    value = lambda c: F.element_at(F.array(*[F.lit(v) for v in FACTOR_VALUES]), F.col(c) + 1)
    quality = (value("_f0") + value("_f1") + value("_f2")) / 3.0
    number = lambda c, d: F.format_string(f"%.{d}f", c)
    km_s, cv_s, n_s = number(km, 1), number(cv, 2), n.cast("string")
    texts = {
        "_f0": [("INFO", "COMPARABLES_MODERATE", F.concat(F.lit("Moderate number of comparables ("), n_s, F.lit(")"))),
                ("WARNING", "COMPARABLES_LOW", F.concat(F.lit("Low number of comparables ("), n_s, F.lit(")"))),
                ("ERROR", "COMPARABLES_VERY_LOW", F.concat(F.lit("Very few comparables ("), n_s, F.lit(")")))],
        "_f1": [("INFO", "DISTANCE_MODERATE", F.concat(F.lit("Comparables are "), km_s, F.lit(" km away on average"))),
                ("WARNING", "DISTANCE_HIGH", F.concat(F.lit("Regional estimate: comparables are "), km_s, F.lit(" km away"))),
                ("ERROR", "DISTANCE_VERY_HIGH", F.concat(F.lit("Sparse area: comparables are "), km_s, F.lit(" km away")))],
        "_f2": [("INFO", "PRICE_VARIATION_MODERATE", F.concat(F.lit("Moderate price variation (CV = "), cv_s, F.lit(")"))),
                ("WARNING", "PRICE_VARIATION_HIGH", F.concat(F.lit("High price variation (CV = "), cv_s, F.lit(")"))),
                ("ERROR", "PRICE_VARIATION_VERY_HIGH", F.concat(F.lit("Very high price variation (CV = "), cv_s, F.lit(")")))]}
    warnings = F.array_compact(F.array(*[
        F.when(F.col(f) == i + 1, F.struct(F.lit(level).alias("level"), text.alias("message"), F.lit(code).alias("code")))
        for f, options in texts.items() for i, (level, code, text) in enumerate(options)]))
    return (rows.withColumn("_q", quality).withColumn("warnings", warnings)
            .withColumn("confidence_level", F.when(F.col("_q") >= 0.75, "high").when(F.col("_q") >= 0.5, "medium").otherwise("low"))
            .withColumn("is_valid", (n >= 3) & (km <= 20.0) & (cv <= 0.5))
            .withColumn("quality_score", geo.round_to("_q", 2)).drop("_f0", "_f1", "_f2", "_q"))


def value_subjects(subjects: DataFrame, df: DataFrame, index: DataFrame, min_n: int = 5, floor: int = 3,
                   use_bedrooms: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(estimates, weighted comparables) of located subjects; `subjects` also carries
    target_date and subject_bedrooms. Subjects below `floor` comparables get none; equal subjects are valued once."""
    asked, members = shared_requests(subjects.where("subject_id is not null"), [*SUBJECT, "target_date", "subject_bedrooms"], "subject_id")
    asked = cut_lineage(asked)
    comps = _comparables(asked, df, min_n=min_n, strict=strict)
    extra = asked.select("subject_id", "target_date", "subject_bedrooms")
    comps = cut_lineage(comps.join(extra, "subject_id"))
    weighted = comparable_weights(time_adjust(comps, cut_lineage(index)), "subject_bedrooms" if use_bedrooms else None)
    weighted = cut_lineage(weighted)
    result = confidence(estimate(weighted)).where(F.col("n_comparables") >= floor)
    return for_each_request(result, members, "subject_id"), for_each_request(weighted, members, "subject_id")


def value_properties(requests: DataFrame, df: DataFrame, index: DataFrame, as_of: str,
                     stats: DataFrame | None = None, amenities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Value (request_id, address, eircode, county, bedrooms): (results, comparables).

    Results keep every request: unlocated ones and those with fewer than three
    comparables carry a reason instead of a value. With `amenities`, requests in the city
    box get `nearby_amenities`, at most one per slot."""
    located = cut_lineage(resolve_subjects(requests, df, stats if stats is not None else routing_key_stats(df)))
    end = F.lit(as_of).cast("date")
    subjects = located.where("lat is not null").select(
        F.col("request_id").alias("subject_id"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"),
        end.alias("window_end"), end.alias("target_date"), F.lit(None).cast("long").alias("exclude_id"),
        F.col("bedrooms").alias("subject_bedrooms"))
    values, comps = value_subjects(subjects, df, index)
    reason = (F.when(F.col("lat").isNull(), "address not located")
              .when(F.col("estimate").isNull(), "insufficient comparable sales"))
    results = (located.join(values.withColumnRenamed("subject_id", "request_id"), "request_id", "left")
               .withColumn("reason", reason).withColumn("valuation_date", end))
    if amenities is not None:
        places = located.where("lat is not null").select("request_id", "lat", "lon")
        near = (nearest_amenities(places, amenities, ("lat", "lon")).groupBy("request_id").agg(F.array_sort(F.collect_list(
            F.struct("kind", "name", F.col("category"), "distance_m"))).alias("nearby_amenities")))
        results = results.join(near, "request_id", "left")
    return results, comps.withColumnRenamed("subject_id", "request_id")


# ------------------------------------------------------------ amenities

# City box and the reach of the tertiary slot.
CITY_BOX = (53.15, 53.65, -6.55, -6.00)
TERTIARY_MAX_M = 2_000.0


def amenity_slots() -> Column:
    """Slots an amenity serves; one point may serve two."""
    kind, cat, level = F.col("amenity_type"), F.coalesce("category", F.lit("")), F.coalesce("level", F.lit(""))
    transport, school = kind == "transport", kind == "school"
    rail = cat.contains("DART") | cat.contains("Train Station") | cat.contains("Commuter")
    both = level == "Secondary & Primary"
    slots = [("rail", transport & rail), ("luas", transport & cat.contains("Luas")),
             ("primary_school", school & ((level == "Primary") | both)),
             ("secondary_school", school & ((level == "Secondary") | both)), ("tertiary", school & (level == "Tertiary"))]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in slots]))


def nearest_amenities(points: DataFrame, amenities: DataFrame, at=("latitude", "longitude")) -> DataFrame:
    """Nearest amenity per slot for points in the city box, whole metres."""
    y, x = at
    slots = (amenities.where("latitude is not null and longitude is not null")
             .select(F.explode(amenity_slots()).alias("class"), F.col("amenity_id").alias("point_id"),
                     F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")))
    city = points.where(geo.in_bounds(y, x, CITY_BOX))
    found = nearest_join(city, slots, at)
    names = amenities.select(F.col("amenity_id").alias("point_id"), "name", "category")
    return (found.where((F.col("class") != "tertiary") | (F.col("distance_m") <= TERTIARY_MAX_M))
            .join(names, "point_id").withColumnRenamed("class", "kind").withColumnRenamed("point_id", "amenity_id")
            .withColumn("distance_m", F.bround("distance_m").cast("long")))


# ------------------------------------------------------------ back-test


def backtest(sample: DataFrame, df: DataFrame, index: DataFrame, leak: bool = False, as_of: str | None = None) -> DataFrame:
    """Leave-one-out valuation of sampled sales at their own sale date.

    Only earlier sales are used; `leak=True` takes the three years before `as_of`
    instead, which lets later sales in."""
    end = F.lit(as_of).cast("date") if leak else F.col("sale_date")
    subjects = sample.select(
        F.col("id").alias("subject_id"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"),
        end.alias("window_end"), F.col("sale_date").alias("target_date"), F.col("id").alias("exclude_id"),
        F.lit(None).cast("int").alias("subject_bedrooms"))
    values, _ = value_subjects(subjects, df, index, floor=5, use_bedrooms=False, strict=not leak)
    actual = F.col("actual_price")
    facts = sample.select(F.col("id").alias("subject_id"), "address", "county", "property_type", "bedrooms",
                          F.col("price").cast("double").alias("actual_price"))
    return (facts.join(values, "subject_id")
            .withColumn("error_pct", F.abs(F.col("estimate") - actual) / actual * 100.0))


def _bucket(col: str, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed bins; NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(bounds, bounds[1:], labels))):
        out = F.when((F.col(col) > lo) & (F.col(col) <= hi), label).otherwise(out)
    return out


def accuracy_report(bt: DataFrame, target: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """(error statistics per section and bucket, overall metrics in long form)."""
    bt = cut_lineage(bt)
    sections = F.array(*[F.struct(F.lit(s).alias("section"), b.alias("bucket")) for s, b in [
        ("overall", F.lit("all")), ("county", F.col("county")), ("confidence", F.col("confidence_level")),
        ("comparables", _bucket("n_comparables", [0, 5, 10, 20, 100], ["<5", "5-10", "10-20", "20+"])),
        ("price", _bucket("actual_price", [0, 200e3, 300e3, 400e3, 500e3, 1e6],
                          ["<200k", "200-300k", "300-400k", "400-500k", "500k+"])),
        ("type", F.col("property_type"))]])
    long = bt.select("error_pct", F.explode(sections).alias("s")).select("s.*", "error_pct").where("bucket is not null")
    by = ["section", "bucket"]
    spread = long.groupBy(*by).agg(F.avg("error_pct").alias("_m"), F.stddev_samp("error_pct").alias("_sd"))
    groups = (grouped_quantiles(long, by, "error_pct", {"median_error": 0.5}, None).join(spread, by)
              .select(*by, "n", geo.round_to("_m", 4).alias("mean_error"), geo.round_to("median_error", 4).alias("median_error"),
                      geo.round_to("_sd", 4).alias("std_error")))
    share = lambda cond: F.avg(F.when(cond, 100.0).otherwise(0.0))
    e = F.col("error_pct")
    wide = bt.agg(
        *[share(e < b).alias(f"within_{b}_pct") for b in (10, 15, 20, 25, 30)], share(e > 50).alias("over_50_pct"),
        share(F.col("actual_price").between(F.col("ci_lower"), F.col("ci_upper"))).alias("ci_coverage_pct"),
        F.avg("ci_width_pct").alias("mean_ci_width_pct"), F.avg("quality_score").alias("mean_quality"),
        F.corr("quality_score", "error_pct").alias("quality_error_corr"),
        F.min("error_pct").alias("min_error"), F.max("error_pct").alias("max_error"),
        (F.avg("error_pct") <= target).cast("double").alias("target_met"))
    metrics = wide.unpivot([], wide.columns, "metric", "value")
    return groups, metrics


def worst_predictions(bt: DataFrame, n: int = 10) -> DataFrame:
    return bt.orderBy(F.col("error_pct").desc(), "subject_id").limit(n)
