"""Aggregations and rankings over a sales DataFrame.

Conventions: every function takes and returns DataFrames; medians are exact and
skew-safe (see `quantiles`); per-group samples go through ranked windows with a
constant bound, so a hot group is cut before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.functions import geo, text
from dwellspark.lineage import cut_lineage
from dwellspark.operators.joins import near_equal_join, with_scalars
from dwellspark.operators.quantiles import grouped_quantiles, join_null_safe
from dwellspark.schema import MARKET_MAX, MARKET_MIN


def market_sales(df: DataFrame, lo: float = MARKET_MIN, hi: float = MARKET_MAX) -> DataFrame:
    """Full-market-price rows within the price bounds (aggregates only)."""
    return df.where(~F.col("not_full_market_price") & F.col("price").between(lo, hi))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group; the bound is pushed below the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_overall(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of the whole table with their rank."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def price_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, exact median, mean, price range and date range per group."""
    prices = grouped_quantiles(df, by, "price", {"median_price": 0.5})
    dates = df.groupBy(*by).agg(F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"))
    out = join_null_safe(prices, dates, by) if by else with_scalars(prices, dates)
    return _price_names(out)


def _price_names(df: DataFrame) -> DataFrame:
    return (df.withColumnRenamed("mean_value", "mean_price")
            .withColumnRenamed("min_value", "min_price").withColumnRenamed("max_value", "max_price"))


def price_trends(df: DataFrame, by: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """Per group and year: count, median, mean, min and max of market sales."""
    by = list(by or [])
    yearly = market_sales(df).select(*by, F.year("sale_date").alias("year"), "price")
    out = _price_names(grouped_quantiles(yearly, [*by, "year"], "price", {"median_price": 0.5}))
    if rounded:
        out = (out.withColumn("median_price", F.round("median_price"))
               .withColumn("mean_price", F.round("mean_price")))
    return out


def county_summary(df: DataFrame) -> DataFrame:
    """Sales per county with median and mean over market rows."""
    counts = df.groupBy("county").agg(F.count("*").alias("all_sales"))
    prices = _price_names(grouped_quantiles(market_sales(df), ["county"], "price", {"median_price": 0.5}))
    return (join_null_safe(counts, prices, ["county"], "left")
            .select("county", "all_sales", F.coalesce("n", F.lit(0)).alias("market_sales"),
                    "median_price", "mean_price"))


def routing_key_stats(df: DataFrame) -> DataFrame:
    """One row per valid postcode prefix: main county, counts, span, medians."""
    valid = df.where(F.col("routing_key").rlike(text.VALID_ROUTING_KEY))
    base = valid.groupBy("routing_key").agg(
        F.mode("county", True).alias("primary_county"), F.count("*").alias("property_count"),
        F.array_sort(F.collect_set("county")).alias("counties"),
        F.min("sale_date").alias("earliest_sale"), F.max("sale_date").alias("latest_sale"),
        F.count("latitude").alias("geocoded_count"),
        (F.count("latitude") / F.count("*")).alias("geocoded_pct"))
    # the three medians share one pass: each row becomes up to three (kind, value) pairs
    market = F.when(~F.col("not_full_market_price"), F.col("price").cast("double"))
    pairs = F.array(F.struct(F.lit("price").alias("kind"), market.alias("value")),
                    F.struct(F.lit("lat").alias("kind"), F.col("latitude").alias("value")),
                    F.struct(F.lit("lon").alias("kind"), F.col("longitude").alias("value")))
    long = valid.select("routing_key", F.explode(pairs).alias("p")).select("routing_key", "p.kind", "p.value")
    width = F.when(F.col("kind") == "price", 1000.0).otherwise(0.001)
    medians = grouped_quantiles(long, ["routing_key", "kind"], "value", {"m": 0.5}, width, False)
    return _with_medians(base, medians)


def routing_key_state(df: DataFrame) -> DataFrame:
    """Mergeable form of `routing_key_stats`: how many rows of each valid key have each county, day, market price and
    coordinate, as (routing_key, kind, label, value, n). States of disjoint deliveries add up."""
    valid = df.where(F.col("routing_key").rlike(text.VALID_ROUTING_KEY))
    part = lambda kind, label=None, value=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(label).cast("string").alias("label") if label is None else label.cast("string").alias("label"),
        F.lit(value).cast("double").alias("value") if value is None else value.cast("double").alias("value"))
    price = F.when(~F.col("not_full_market_price"), F.col("price"))
    parts = F.array(part("county", F.col("county")), part("day", F.col("sale_date")), part("price", value=price),
                    part("lat", value=F.col("latitude")), part("lon", value=F.col("longitude")))
    long = valid.select("routing_key", F.explode(parts).alias("p")).select("routing_key", "p.*")
    return (long.where((F.col("kind") == "county") | F.col("label").isNotNull() | F.col("value").isNotNull())
            .groupBy("routing_key", "kind", "label", "value").agg(F.count("*").alias("n")))


def merge_key_states(states: DataFrame) -> DataFrame:
    return states.groupBy("routing_key", "kind", "label", "value").agg(F.sum("n").alias("n"))


def stats_of_state(state: DataFrame) -> DataFrame:
    """`routing_key_stats` of a merged state, or of the keys of it that are given."""
    of = lambda kind, what: F.when(F.col("kind") == kind, what)
    n, label = F.col("n"), F.col("label")
    located = F.coalesce(F.sum(of("lat", n)), F.lit(0))
    base = state.groupBy("routing_key").agg(
        F.min_by("label", F.when((F.col("kind") == "county") & label.isNotNull(), F.struct((-n).alias("n"), "label"))).alias("primary_county"),
        F.sum(of("county", n)).alias("property_count"), F.array_sort(F.collect_set(of("county", label))).alias("counties"),
        F.min(of("day", label)).cast("date").alias("earliest_sale"), F.max(of("day", label)).cast("date").alias("latest_sale"),
        located.alias("geocoded_count"), (located / F.sum(of("county", n))).alias("geocoded_pct"))
    width = F.when(F.col("kind") == "price", 1000.0).otherwise(0.001)
    medians = grouped_quantiles(state.where("kind in ('price', 'lat', 'lon')"), ["routing_key", "kind"], "value", {"m": 0.5}, width, False, weight="n")
    return _with_medians(base, medians)


def _with_medians(base: DataFrame, medians: DataFrame) -> DataFrame:
    pick = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("m"))).alias(name)
    wide = medians.groupBy("routing_key").agg(
        pick("price", "median_price"), pick("lat", "centroid_lat"), pick("lon", "centroid_lon"))
    return base.join(wide, "routing_key", "left")


def postcode_reference(df: DataFrame) -> DataFrame:
    """Centroid, spread and main county of every full postcode, in-bounds rows."""
    code = text.normalize_postcode("eircode")
    rows = df.where(geo.in_bounds("latitude", "longitude") & (F.length(code) == 7))
    return rows.groupBy(code.alias("postcode")).agg(
        geo.exact_mean("latitude").alias("latitude"), geo.exact_mean("longitude").alias("longitude"),
        F.count("*").alias("property_count"), F.mode("county", True).alias("county"),
        F.stddev_samp("latitude").alias("lat_stddev"), F.stddev_samp("longitude").alias("lon_stddev"))


def postcode_prefix_summary(reference: DataFrame) -> DataFrame:
    return (reference.groupBy(F.substring("postcode", 1, 3).alias("routing_key"))
            .agg(F.count("*").alias("postcodes"), F.sum("property_count").alias("properties"),
                 F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
                 F.avg("property_count").alias("mean_per_postcode")))


def shared_coordinates(df: DataFrame, threshold: int = 10, high: int = 100) -> DataFrame:
    """Points used by at least `threshold` distinct addresses, with a severity."""
    return (df.where("latitude is not null").groupBy("latitude", "longitude")
            .agg(F.countDistinct("address").alias("distinct_addresses"),
                 F.count("*").alias("total_sales"),
                 F.array_sort(F.collect_set("county")).alias("county_list"),
                 F.min("sale_date").alias("earliest_sale"), F.max("sale_date").alias("latest_sale"))
            .where(F.col("distinct_addresses") >= threshold)
            .withColumn("counties", F.size("county_list"))
            .withColumn("severity", F.when(F.col("distinct_addresses") >= high, "high").otherwise("medium")))


def at_shared_points(df: DataFrame, threshold: int) -> DataFrame:
    """Sales within 1e-6 degrees of a shared point."""
    points = (shared_coordinates(df, threshold).select(
        F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), "distinct_addresses"))
    return near_equal_join(df, points, ["latitude", "longitude"], ["p_lat", "p_lon"], 1e-6)


def shared_coordinate_impact(df: DataFrame, threshold: int) -> DataFrame:
    """Affected sales by county, with and without postcode, and overall share."""
    hit = at_shared_points(df, threshold)
    total = df.agg(F.count("*").alias("all_sales"))
    per_county = hit.where("county is not null").groupBy("county").agg(
        F.count("*").alias("affected"),
        F.count_if(F.coalesce("eircode", F.lit("")) != "").alias("high_priority"))
    return (with_scalars(per_county, total)
            .select("county", "affected", "high_priority",
                    (F.col("affected") - F.col("high_priority")).alias("medium_priority"),
                    (F.col("affected") * 100.0 / F.col("all_sales")).cast("double").alias("pct_of_all")))


def place_scatter(df: DataFrame, min_sales: int = 10, spread: float = 0.05, n: int = 30) -> DataFrame:
    """Places (last comma part) whose sales are scattered too widely."""
    place = F.trim(F.element_at(F.split("address", ","), -1))
    stats = (df.where(F.col("latitude").isNotNull() & F.col("address").contains(","))
             .withColumn("place", place).where(F.length("place") >= 4).groupBy("place")
             .agg(F.count("*").alias("n"), geo.exact_mean("latitude").alias("mean_lat"),
                  geo.exact_mean("longitude").alias("mean_lon"), F.stddev_samp("latitude").alias("std_lat"),
                  F.stddev_samp("longitude").alias("std_lon"))
             .where(F.col("n") >= min_sales))
    a, b = F.coalesce("std_lat", F.lit(0.0)), F.coalesce("std_lon", F.lit(0.0))
    return stats.where((a > spread) | (b > spread)).orderBy((a + b).desc(), "place").limit(n)


def inconsistent_addresses(df: DataFrame) -> DataFrame:
    """Addresses with more than one coordinate, bedroom count or dwelling type.

    More than one distinct non-null value is min <> max, so no distinct
    aggregation is needed."""
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return (df.groupBy("address").agg(
        (differ("latitude") | differ("longitude")).alias("coordinates_differ"),
        differ("bedrooms").alias("bedrooms_differ"), differ("property_type").alias("type_differs"),
        F.count("*").alias("n"))
        .where("coordinates_differ or bedrooms_differ or type_differs"))


def ambiguous_addresses(df: DataFrame) -> DataFrame:
    return (df.where("county is not null").groupBy("address")
            .agg(F.array_sort(F.collect_set("county")).alias("c"), F.count("*").alias("n"))
            .where(F.size("c") > 1)
            .select("address", "n", F.size("c").alias("counties"), F.array_join("c", ", ").alias("county_list")))


def repeat_sales(df: DataFrame) -> DataFrame:
    return (df.groupBy("address").agg(F.count("*").alias("c")).where("c > 1")
            .agg(F.count("*").alias("unique_properties"), F.sum("c").alias("total_records"),
                 F.max("c").alias("max_sales")))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Informational only: same-key rows are legitimate and never removed."""
    return (df.groupBy("address_normalized", "sale_date", "price").agg(F.count("*").alias("c")).where("c > 1")
            .agg(F.count("*").alias("duplicate_groups"),
                 F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("redundant_rows")))


def coverage(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Long form (group, column, total, present, pct) from one pass."""
    by = list(by or [])
    wide = df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in cols])
    return (wide.unpivot([*by, "total"], cols, "column_name", "present")
            .withColumn("missing", F.col("total") - F.col("present"))
            .withColumn("pct", geo.round_to(F.col("present") * 100.0 / F.col("total"), 1)))


def share_of_total(df: DataFrame, count: str = "n", out: str = "pct") -> DataFrame:
    """Add each row's percentage of the column total; `df` is an aggregate result."""
    total = df.agg(F.sum(count).alias("_all"))
    return (with_scalars(df, total)
            .withColumn(out, geo.round_to(F.col(count) * 100.0 / F.col("_all"), 1)).drop("_all"))


MISSING_DIMENSIONS = {
    "county": lambda: F.col("county"),
    "has_postcode": lambda: F.when(F.coalesce("eircode", F.lit("")) != "", "yes").otherwise("no"),
    "year": lambda: F.year("sale_date").cast("string"),
    "length": lambda: text.length_bucket("address"),
    "type": lambda: text.type_indicator("address"),
}


def missing_breakdown(df: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Rows without coordinates by each dimension with their percentage.

    All dimensions come from one scan: each row is tagged once per dimension and
    the tags are partially aggregated before the shuffle."""
    dims = dimensions or list(MISSING_DIMENSIONS)
    tags = F.array(*[F.struct(F.lit(d).alias("dimension"), MISSING_DIMENSIONS[d]().alias("bucket")) for d in dims])
    counts = (df.where("latitude is null").select(F.explode(tags).alias("t"))
              .groupBy("t.dimension", "t.bucket").agg(F.count("*").alias("n")))
    w = Window.partitionBy("dimension")
    return counts.withColumn("pct", geo.round_to(F.col("n") * 100.0 / F.sum("n").over(w), 1))


def enrichment_progress(df: DataFrame, year: int) -> DataFrame:
    """None/partial/full counts of the year, in total and per month."""
    b, t = F.col("bedrooms").isNotNull(), F.col("property_type").isNotNull()
    rows = df.where((F.col("sale_date") >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
                    & (F.col("sale_date") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))
    per_month = rows.groupBy(F.date_format("sale_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total"), F.count_if(~b & ~t).alias("none"),
        F.count_if(b & t).alias("full"), F.count_if(b != t).alias("partial"))
    overall = per_month.agg(F.lit("all").alias("month"), *[F.sum(c).alias(c) for c in ("total", "none", "full", "partial")])
    return per_month.unionByName(overall)


def provenance_counts(df: DataFrame) -> DataFrame:
    return (df.where("property_type is not null").groupBy("property_type_source")
            .agg(F.count("*").alias("n")))


def api_usage_summary(usage: DataFrame, since, limit: int = 100_000, warn_at: float = 0.8,
                      as_of: str | None = None) -> DataFrame:
    """Totals, by source and by day in one grouping-sets pass; the total row
    carries the remaining allowance, percentage used, daily average and state."""
    day = F.to_date("ts")
    rows = (usage.where(F.col("ts") >= F.lit(since).cast("timestamp"))
            .withColumn("day", day))
    grouped = (rows.groupingSets([[], ["source"], ["day"]], "source", "day")
               .agg(F.coalesce(F.sum("request_count"), F.lit(0)).alias("requests"),
                    F.coalesce(F.sum("success_count"), F.lit(0)).alias("success"),
                    F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"),
                    F.grouping_id().alias("level")))
    total = F.col("level") == 3
    days = F.dayofmonth(F.lit(as_of).cast("date")) if as_of else F.lit(1)
    used = F.col("requests") * 100.0 / limit
    return grouped.select(
        F.when(total, "total").when(F.col("level") == 1, "source").otherwise("day").alias("kind"),
        F.when(total, "").when(F.col("level") == 1, F.col("source")).otherwise(F.col("day").cast("string")).alias("name"),
        "requests", "success", "errors",
        F.when(total, F.lit(limit) - F.col("requests")).alias("remaining"),
        F.when(total, used.cast("double")).alias("percent_used"),
        F.when(total, (F.col("requests") / days).cast("double")).alias("daily_average"),
        F.when(total, F.when(F.col("requests") >= limit, "stop")
               .when(used >= warn_at * 100, "warn").otherwise("ok")).alias("state"))


def trim_quantiles(df: DataFrame, lo: float = 0.01, hi: float = 0.99, value: str = "price") -> DataFrame:
    """Rows whose value lies within the two quantiles (a scalar subquery)."""
    q = grouped_quantiles(df, [], value, {"_qlo": lo, "_qhi": hi}, stats=False)
    return (with_scalars(df, q)
            .where(F.col(value).cast("double").between(F.col("_qlo"), F.col("_qhi"))).drop("_qlo", "_qhi"))


def county_page(df: DataFrame, n: int = 10) -> DataFrame:
    """Per county: total, latest-year median and mean, year span, newest rows."""
    trends = price_trends(df.where("county is not null"), ["county"])
    latest = trends.groupBy("county").agg(
        F.max_by("median_price", "year").alias("median_price"), F.max_by("mean_price", "year").alias("mean_price"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    counts = df.groupBy("county").agg(F.count("*").alias("total_count"))
    newest = top_n(df.where("county is not null"), ["county"], [F.col("sale_date").desc(), F.col("id")], n)
    recent = newest.groupBy("county").agg(
        F.avg(F.col("price").cast("double")).alias("recent_mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "sale_date", "price"))),
                    lambda s: s.dropFields("rank")).alias("recent"))
    return counts.join(latest, "county").join(recent, "county")


def address_history(df: DataFrame) -> DataFrame:
    """Per address: sales, newest date and price, range and upper-median price."""
    base = df.groupBy("address").agg(
        F.max("sale_date").alias("latest_date"),
        F.max_by("price", F.struct("sale_date", "id")).cast("double").alias("latest_price"))
    prices = _price_names(grouped_quantiles(df, ["address"], "price", {"median_price": "upper"}))
    return base.join(prices, "address").drop("mean_price")


def rating_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """Share per energy grade with the A-B and D-G shares of each group."""
    counts = df.where("ber_rating is not null").groupBy(*by, "ber_rating").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.sum("n").over(w)
    band = F.substring("ber_rating", 1, 1)
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).over(w) * 100.0 / total
    return counts.select(*by, "ber_rating", "n",
                         (F.col("n") * 100.0 / total).cast("double").alias("share"),
                         part(band <= "B").cast("double").alias("share_ab"),
                         part(band >= "D").cast("double").alias("share_dg"))


def rating_extremes(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Groups with the highest and the lowest A-B share."""
    band = F.substring("ber_rating", 1, 1)
    shares = (df.where("ber_rating is not null").groupBy(by)
              .agg((F.count_if(band <= "B") * 100.0 / F.count("*")).cast("double").alias("share_ab")))
    best = top_overall(shares, [F.col("share_ab").desc(), F.col(by)], n).withColumn("list", F.lit("top"))
    worst = top_overall(shares, [F.col("share_ab"), F.col(by)], n).withColumn("list", F.lit("bottom"))
    return best.unionByName(worst)


def postcode_league(df: DataFrame, prefix: str = "D") -> DataFrame:
    """Market sales per routing key of a city, with the city-wide picks."""
    rows = market_sales(df).where(F.col("routing_key").startswith(prefix))
    league = _price_names(grouped_quantiles(rows, ["routing_key"], "price", {"median_price": 0.5}))
    medians = grouped_quantiles(league, [], "median_price", {"median_of_medians": "upper"}, stats=False)
    picks = league.agg(
        F.max_by("routing_key", F.struct("median_price", "routing_key")).alias("dearest"),
        F.min_by("routing_key", F.struct("median_price", "routing_key")).alias("cheapest"),
        F.max_by("routing_key", F.struct("n", "routing_key")).alias("most_active"))
    return with_scalars(with_scalars(league.select("routing_key", "n", "median_price", "mean_price"),
                                     picks), medians)


def geocoder_comparison(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per source: success rate, mean error in metres and whether it is best."""
    err = geo.haversine_m("latitude", "longitude", "cand_lat", "cand_lon")
    joined = truth.where("latitude is not null").join(candidates, "id").withColumn("err", err)
    per = joined.groupBy("source").agg(
        F.count("*").alias("tried"), F.count("err").alias("found"), F.avg("err").alias("mean_error"))
    best = per.agg(F.min_by("source", F.struct("mean_error", "source")).alias("_best"))
    return (with_scalars(per, best).select(
        "source", "tried", "found", (F.col("found") * 100.0 / F.col("tried")).cast("double").alias("success_pct"),
        geo.round_to("mean_error", 2).alias("mean_error_m"), (F.col("source") == F.col("_best")).alias("best")))


def source_quality_profile(df: DataFrame) -> DataFrame:
    """Per coordinate source: gaps, bounds, shared points, mismatches, grade."""
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    out_of_box = has & ~geo.in_bounds("latitude", "longitude")
    mismatch = has & ~F.coalesce(
        geo.in_county_box("latitude", "longitude", text.normalize_county("county")), F.lit(True))
    base = df.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(~has).alias("missing"),
        F.count_if(out_of_box).alias("out_of_bounds"), F.count_if(mismatch).alias("county_mismatch"))
    points = (df.where(has).groupBy("source", geo.round_to("latitude", 6).alias("la"),
                                    geo.round_to("longitude", 6).alias("lo")).agg(F.count("*").alias("c"))
              .groupBy("source").agg(F.count_if(F.col("c") >= 100).alias("shared_high"),
                                     F.count_if(F.col("c").between(10, 99)).alias("shared_medium")))
    issues = ((F.col("shared_high") >= 50).cast("int") + (F.col("shared_medium") >= 200).cast("int")
              + (F.col("out_of_bounds") > 0).cast("int")
              + (F.col("county_mismatch") > F.col("total") * 0.01).cast("int"))
    return (base.join(points, "source", "left").fillna(0, ["shared_high", "shared_medium"])
            .withColumn("issues", issues)
            .withColumn("grade", F.when(issues == 0, "excellent").when(issues == 1, "good")
                        .when(issues == 2, "fair").otherwise("needs attention")))


def precision_histogram(df: DataFrame) -> DataFrame:
    return (df.where("latitude is not null")
            .groupBy("source", geo.decimals("latitude").alias("lat_decimals"),
                     geo.decimals("longitude").alias("lon_decimals")).agg(F.count("*").alias("n")))


# ------------------------------------------------------------ index, streets, seasons


def county_price_index(df: DataFrame, start: str, lo: float = 50_000, hi: float = 5_000_000,
                       min_n: int = 10) -> DataFrame:
    """Monthly county medians divided by the county's first month."""
    rows = (market_sales(df, lo, hi)
            .where((F.col("sale_date") >= F.lit(start).cast("date")) & F.col("county").isNotNull())
            .select("county", F.trunc("sale_date", "month").alias("month"), "price"))
    monthly = (grouped_quantiles(rows, ["county", "month"], "price", {"median_price": 0.5})
               .where(F.col("n") >= min_n))
    w = Window.partitionBy("county").orderBy("month")
    return monthly.select("county", "month", "median_price", F.col("n").alias("sale_count"),
                          (F.col("median_price") / F.first("median_price").over(w)).alias("price_index"))


def with_street_key(df: DataFrame, address: str = "address_normalized") -> DataFrame:
    # explode keeps the key expression from being copied into every consumer
    key = F.filter(F.array(text.street_key(address, "county")), lambda k: k.isNotNull())
    return (df.select("*", F.explode(key).alias("_k"))
            .select("*", F.col("_k.street").alias("street"), F.col("_k.area").alias("area"),
                    F.col("_k.county").alias("county_key"), "_k.street_display", "_k.area_display",
                    "_k.is_apartment").drop("_k"))


STREET = ["street", "area", "county_key"]


def street_ranking(df: DataFrame, address: str = "address_normalized", floor: int = 3, min_value: int = 8,
                   n_value: int = 30, n_volume: int = 20, apartment_share: float = 0.5) -> DataFrame:
    """Dearest streets by median, then the busiest ones not already listed."""
    market = df.where(~F.col("not_full_market_price") & (F.col("price") > 0)
                      & F.col("county").isNotNull() & F.col(address).isNotNull())
    # the street is read off each address once, not off each sale
    book = cut_lineage(with_street_key(market.groupBy(address, "county").agg(F.count("*").alias("_sales")), address))
    rows = market.select(address, "county", "price").join(book.select(address, "county", *STREET), [address, "county"])
    shape = book.groupBy(*STREET).agg(
        F.sum(F.when(F.col("is_apartment"), F.col("_sales")).otherwise(0)).alias("_apt"), F.max("street_display").alias("street_display"),
        F.max("area_display").alias("area_display"), F.max("county").alias("county"))
    stats = (grouped_quantiles(rows, STREET, "price", {"median_price": 0.5})
             .where(F.col("n") >= floor).join(shape, STREET)
             .where(~F.col("street_display").rlike(text.BLOCK_NAME)
                    & (F.col("_apt") / F.col("n") < apartment_share))
             .select(*STREET, "street_display", "area_display", "county",
                     F.col("n").alias("tx_count"), "median_price", F.col("mean_value").alias("mean_price")))
    ties = [F.col(k) for k in STREET]
    value = top_overall(stats.where(F.col("tx_count") >= min_value),
                        [F.col("median_price").desc(), *ties], n_value)
    volume = top_overall(stats.join(value.select(*STREET), STREET, "left_anti"),
                         [F.col("tx_count").desc(), *ties], n_volume)
    return (value.withColumn("rank_type", F.lit("value"))
            .unionByName(volume.withColumn("rank_type", F.lit("volume"))))


def street_slugs(df: DataFrame) -> DataFrame:
    """Slug of street and area; the county is appended where slugs collide."""
    short = text.slugify(F.concat_ws(" ", "street_display", "area_display"))
    long = text.slugify(F.concat_ws(" ", "street_display", "area_display", "county"))
    clashes = F.count("*").over(Window.partitionBy("_s"))
    return (df.withColumn("_s", short)
            .withColumn("slug", F.when(clashes > 1, long).otherwise(F.col("_s"))).drop("_s"))


def street_registry(ranking: DataFrame) -> DataFrame:
    """Ranked streets as published entries (the ranking has a fixed size)."""
    median = F.format_number(F.floor("median_price"), 0)
    sales = F.col("tx_count").cast("string")
    value = F.concat(F.lit("Ranks among the dearest streets: half of its "), sales, F.lit(" sales went above €"), median, F.lit("."))
    volume = F.concat(F.lit("Ranks among the busiest streets: "), sales, F.lit(" sales, half of them above €"), median, F.lit("."))
    return street_slugs(ranking).select(
        "slug", F.regexp_replace("street_display", "^the\\b", "The").alias("name"),
        F.col("area_display").alias("area"), "county", text.slugify("county").alias("county_slug"),
        F.col("rank_type").alias("category"), "rank",
        F.concat_ws("|", "street", "area", "county_key").alias("normalized_key"),
        F.when(F.col("rank_type") == "value", value).otherwise(volume).alias("description"))


def street_pages(df: DataFrame, registry: DataFrame, address: str = "address_normalized",
                 newest: int = 50) -> DataFrame:
    """Nested document per registered street: stats, yearly trends, newest rows.

    The street is read off each address once; only the sales of registered streets are kept, and read three times."""
    market = df.where(~F.col("not_full_market_price") & (F.col("price") > 0))
    book = (with_street_key(market.select(F.col(address).alias("_address"), F.col("county").alias("county")).distinct(), "_address")
            .withColumn("normalized_key", F.concat_ws("|", *STREET))
            .join(registry.select("normalized_key", "slug"), "normalized_key").select("_address", "county", "slug"))
    rows = market.select("id", "sale_date", "address", F.col(address).alias("_address"), "county", "price", "bedrooms", "property_type", "eircode")
    rows = cut_lineage(join_null_safe(rows, book, ["_address", "county"]).withColumn("year", F.year("sale_date")).drop("_address", "county"))
    point = lambda: [F.col("n").alias("count"), F.bround("median_price").cast("long").alias("median"),
                     F.bround("mean_value").cast("long").alias("avg"), F.bround("min_value").cast("long").alias("min"),
                     F.bround("max_value").cast("long").alias("max")]
    overall = grouped_quantiles(rows, ["slug"], "price", {"median_price": 0.5})
    yearly = grouped_quantiles(rows, ["slug", "year"], "price", {"median_price": 0.5})
    trends = yearly.groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("year", *point()))).alias("trends"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    recent = (top_n(rows, ["slug"], [F.col("sale_date").desc(), F.col("id")], newest)
              .groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct(
                  "rank", F.col("sale_date").alias("date"), F.col("address"),
                  F.bround(F.col("price").cast("double")).cast("long").alias("price"),
                  "bedrooms", "property_type", "eircode"))), lambda s: s.dropFields("rank")).alias("transactions")))
    return (overall.join(trends, "slug").join(recent, "slug")
            .select("slug", F.struct(*point(), "first_year", "last_year").alias("stats"), "trends",
                    "transactions", F.col("n").alias("total_transactions")))


def seasonality(df: DataFrame, years: tuple[int, int], split: str | None = None) -> DataFrame:
    """Month share of its year's sales and month median over year median, averaged.

    `split` is a column name, or 'value' for above/below the year's median."""
    rows = (market_sales(df).withColumn("year", F.year("sale_date")).withColumn("month", F.month("sale_date"))
            .where(F.col("year").between(*years)))
    if split == "value":
        medians = grouped_quantiles(rows, ["year"], "price", {"_m": 0.5}, stats=False)
        rows = (rows.join(medians, "year")
                .withColumn("part", F.when(F.col("price").cast("double") > F.col("_m"), "above").otherwise("below")))
    else:
        rows = rows.withColumn("part", F.col(split) if split else F.lit("all"))
    rows = rows.select("part", "year", "month", "price")
    month = grouped_quantiles(rows, ["part", "year", "month"], "price", {"m": 0.5})
    year = (grouped_quantiles(rows, ["part", "year"], "price", {"y": 0.5})
            .select("part", "year", F.col("n").alias("yn"), "y"))
    return (month.join(year, ["part", "year"]).groupBy("part", "month")
            .agg(F.avg(F.col("n") * 100.0 / F.col("yn")).cast("double").alias("_s"),
                 F.avg(F.col("m") / F.col("y")).alias("_r"), F.count("*").alias("years"))
            .select("part", "month", "years", geo.round_to("_s", 4).alias("share_pct"),
                    geo.round_to("_r", 6).alias("price_ratio")))


def latest_coordinate(df: DataFrame) -> DataFrame:
    """Every sale takes the coordinate of its address's newest located sale."""
    pick = F.max_by(F.struct("latitude", "longitude"), F.struct("sale_date", "latitude", "longitude"))
    best = df.where("latitude is not null").groupBy("address").agg(pick.alias("_p"))
    return (df.join(best, "address", "left")
            .withColumn("latitude", F.coalesce("_p.latitude", "latitude"))
            .withColumn("longitude", F.coalesce("_p.longitude", "longitude")).drop("_p"))
