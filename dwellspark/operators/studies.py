"""Proximity studies, hedonic regression and loan schedules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.functions import geo
from dwellspark.lineage import cut_lineage
from dwellspark.operators.joins import nearest_join
from dwellspark.operators.quantiles import grouped_quantiles


def transport_classes() -> Column:
    cat = F.coalesce("category", F.lit(""))
    rail = (F.col("amenity_type") == "transport") & ~cat.contains("Bus") & ~cat.contains("Ferry") & ~cat.contains("Airport")
    tests = [("green", cat.contains("Green Line")), ("red", cat.contains("Red Line")), ("dart", cat.contains("DART")),
             ("any_rail", rail)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))


def school_classes() -> Column:
    school, level = F.col("amenity_type") == "school", F.coalesce("level", F.lit(""))
    tests = [("primary", school & level.isin("Primary", "Secondary & Primary")),
             ("secondary", school & level.isin("Secondary", "Secondary & Primary")),
             ("tertiary", school & (level == "Tertiary")), ("any_school", school)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))


def with_distances(df: DataFrame, amenities: DataFrame, classes: Column, names: list[str]) -> DataFrame:
    """Add d_<class>: metres to the nearest amenity of each class.

    Distances are found per distinct coordinate and joined back."""
    points = amenities.select(F.explode(classes).alias("class"), F.col("amenity_id").alias("point_id"),
                              F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    coords = df.where("latitude is not null and longitude is not null").select("latitude", "longitude").distinct()
    wide = nearest_join(coords, points).groupBy("latitude", "longitude").agg(*[
        F.max(F.when(F.col("class") == n, F.col("distance_m"))).alias(f"d_{n}") for n in names])
    return df.join(cut_lineage(wide), ["latitude", "longitude"])


def study_sales(df: DataFrame, county: str | None = "Dublin") -> DataFrame:
    rows = df.where(F.col("latitude").isNotNull() & ~F.coalesce("not_full_market_price", F.lit(False)) & (F.col("price") > 0))
    return rows.where(F.lower("county") == county.lower()) if county else rows


def _by_class(df: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("class"), F.col(f"d_{n}").alias("distance_m")) for n in names])
    return df.select("price", F.explode(pairs).alias("p")).select("price", "p.*").where("distance_m is not null")


def near_far_gap(df: DataFrame, names: list[str], near_m: float = 1_000.0) -> DataFrame:
    """Median price below and from 1 km per class, and the raw gap."""
    rows = _by_class(df, names).withColumn("near", F.col("distance_m") < near_m).select("class", "near", "price")
    med = grouped_quantiles(rows, ["class", "near"], "price", {"m": 0.5})
    side = lambda near, c, name: F.max(F.when(F.col("near") == near, F.col(c))).alias(name)
    return (med.groupBy("class").agg(side(True, "n", "near_n"), side(True, "m", "near_median"),
                                     side(False, "n", "far_n"), side(False, "m", "far_median"))
            .where("near_n is not null and far_n is not null")
            .withColumn("raw_gap", F.col("near_median") / F.col("far_median") - 1))


# Distance bands in metres.
BANDS = [(0, 250, "0-250m"), (250, 500, "250-500m"), (500, 1000, "500m-1km"), (1000, 2000, "1-2km"), (2000, 1e9, ">2km")]


def distance_bands(df: DataFrame, names: list[str]) -> DataFrame:
    d = F.col("distance_m")
    band = F.lit(None).cast("string")
    for lo, hi, label in reversed(BANDS):
        band = F.when((d >= lo) & (d < hi), label).otherwise(band)
    rows = _by_class(df, names).withColumn("band", band).where("band is not null").select("class", "band", "price")
    return grouped_quantiles(rows, ["class", "band"], "price", {"median_price": 0.5}).select("class", "band", "n", "median_price")


PREMIUM_SCHEMA = ("flag string, coefficient double, std_error double, premium double, premium_low double, premium_high double, "
                  "p_value double, r_squared double, n long, areas int")


def hedonic_cells(df: DataFrame, flags: list[str], effects: list[str]) -> DataFrame:
    """Every regressor is discrete, so the data enters the regression only through
    counts and sums per combination: this is the one pass over the sales."""
    y = F.log(F.col("price").cast("double"))
    return (df.groupBy(*[F.coalesce(F.col(f), F.lit(0)).cast("double").alias(f) for f in flags], *effects)
            .agg(F.count("*").alias("_n"), F.avg(y).alias("_y"), F.sum(y).alias("_sy"), F.sum(y * y).alias("_yy")))


def absorbed(cells: DataFrame, columns: list[str], effects: list[str], settled: float = 1e-11, sweeps: int = 500) -> DataFrame:
    """The columns less what the fixed effects explain: within every level of each effect by turns the weighted (_n) mean is
    taken off, until the means of a whole sweep are below `settled`. What is left of two columns has the slope that a
    regression with a dummy for every level would give, however many levels there are."""
    now = cells.withColumn("_moved", F.lit(0.0))
    for _ in range(sweeps):
        now = now.withColumn("_moved", F.lit(0.0))
        for e in effects:
            means = now.groupBy(e).agg(*[(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"_m{c}") for c in columns])
            taken = {c: F.col(c) - F.col(f"_m{c}") for c in columns}
            moved = F.greatest("_moved", *[F.abs(F.col(f"_m{c}")) for c in columns])
            now = now.join(means, e).withColumns({**taken, "_moved": moved}).drop(*[f"_m{c}" for c in columns])
        now = cut_lineage(now)
        if (now.agg(F.max("_moved")).first()[0] or 0.0) < settled:
            return now.drop("_moved")
    raise RuntimeError(f"fixed effects did not settle in {sweeps} sweeps")


def hedonic_premium(df: DataFrame, flags: list[str], area: str = "routing_key", effects: tuple[str, ...] = ("year",),
                    min_area: int = 50) -> DataFrame:
    """OLS of log price on 0/1 flags with area and other fixed effects, standard errors
    clustered by area: premium, interval and p per flag, with R2 and sizes.

    The effects are absorbed in Spark, and cross products and the products of the area sums of scores are summed there too, so that
    the driver sees matrices of flags by flags alone. A NULL flag counts as 0; a flag that the effects or other flags determine
    has the coefficient of least norm. Degrees of freedom take areas and the other effects as connected. Without an area
    of `min_area` sales the result is empty."""
    names = [area, *effects]
    sizes = df.where(F.col(area).isNotNull()).groupBy(area).agg(F.count("*").alias("_a")).where(F.col("_a") >= min_area)
    rows = df.join(sizes.select(area), area).where(" and ".join(f"{e} is not null" for e in names))
    cells = cut_lineage(hedonic_cells(rows, flags, names))
    total = cells.agg(F.sum("_n").alias("n"), F.sum("_sy").alias("sy"), F.sum("_yy").alias("yy"),
                      F.sum(F.col("_n") * F.col("_y") * F.col("_y")).alias("between"), *[F.count_distinct(e).alias(f"levels_{e}") for e in names]).first()
    if not total["n"]:
        return df.sparkSession.createDataFrame([], PREMIUM_SCHEMA)
    left = absorbed(cells, ["_y", *flags], names)
    columns = [*flags, "_y"]
    product = lambda a, b: F.sum(F.col("_n") * F.col(a) * F.col(b)).alias(f"{a}*{b}")
    sums = left.agg(*[product(a, b) for a in columns for b in columns]).first()
    xtx = np.array([[sums[f"{a}*{b}"] for b in flags] for a in flags])
    xty = np.array([sums[f"{a}*_y"] for a in flags])
    inverse = np.linalg.pinv(xtx, rcond=1e-9, hermitian=True)
    beta = inverse @ xty
    error = F.col("_y") - sum((F.lit(float(b)) * F.col(f) for f, b in zip(flags, beta)), F.lit(0.0))
    scores = left.withColumn("_e", F.col("_n") * error).groupBy(area).agg(*[F.sum(F.col("_e") * F.col(f)).alias(f) for f in flags])
    outer = scores.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a in flags for b in flags]).first()
    meat = np.array([[outer[f"{a}*{b}"] for b in flags] for a in flags])

    n, areas = int(total["n"]), int(total[f"levels_{area}"])
    rank = areas + sum(int(total[f"levels_{e}"]) - 1 for e in effects) + int(np.linalg.matrix_rank(xtx, hermitian=True))
    factor = areas / (areas - 1) * (n - 1) / (n - rank) if areas > 1 and n > rank else float("nan")
    cov = factor * inverse @ meat @ inverse
    rss = total["yy"] - total["between"] + sums["_y*_y"] - beta @ xty
    spread = total["yy"] - total["sy"] * total["sy"] / n
    r2 = float(1 - rss / spread) if spread > 0 else float("nan")
    out = []
    for i, f in enumerate(flags):
        b, se = float(beta[i]), math.sqrt(cov[i, i]) if cov[i, i] > 0 else 0.0 if cov[i, i] == cov[i, i] else float("nan")
        p = math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else float("nan")
        z = 1.959963984540054 * se
        out.append((f, b, se, math.exp(b) - 1, math.exp(b - z) - 1, math.exp(b + z) - 1, p, r2, n, areas))
    return df.sparkSession.createDataFrame(out, PREMIUM_SCHEMA)


def amortization_schedule(loans: DataFrame) -> DataFrame:
    """Yearly schedule per loan (loan_id, principal, annual_rate in percent, years) from
    the closed-form balance; no iteration and no window."""
    p, r, n = F.col("principal"), F.col("annual_rate") / 100.0 / 12.0, F.col("years") * 12
    growth = lambda m: F.pow(F.lit(1.0) + F.col("_r"), m)
    payment = F.when(F.col("_r") == 0, p / n).otherwise(p * F.col("_r") * growth(n) / (growth(n) - 1))
    balance = lambda m: F.when(F.col("_r") == 0, p - F.col("monthly_payment") * m).otherwise(
        p * growth(m) - F.col("monthly_payment") * (growth(m) - 1) / F.col("_r"))
    rows = (loans.withColumn("_r", r).withColumn("monthly_payment", payment)
            .withColumn("year", F.explode(F.sequence(F.lit(1), F.col("years"))))
            .withColumn("opening_balance", balance((F.col("year") - 1) * 12)).withColumn("closing_balance", balance(F.col("year") * 12)))
    paid = F.col("opening_balance") - F.col("closing_balance")
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return rows.select(
        "loan_id", "year", "monthly_payment", floor(F.col("opening_balance")).alias("opening_balance"),
        floor(paid).alias("principal_paid"), floor(F.col("monthly_payment") * 12 - paid).alias("interest_paid"),
        floor(F.col("closing_balance")).alias("closing_balance"), floor(p - F.col("closing_balance")).alias("cumulative_principal"),
        floor(F.col("monthly_payment") * 12 * F.col("year") - (p - F.col("closing_balance"))).alias("cumulative_interest"))
