"""Join shapes Spark has no operator for, rewritten as equi-joins.

No cross joins: proximity goes through grid cells, substring containment through
the rarest gram of the searched text, prefix containment through prefix tiers.
Join strategies are left to the planner (broadcast only where it knows the size);
hot keys are split by adaptive skew handling."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.functions import geo
from dwellspark.lineage import cut_lineage

# Leaf cells of the nearest join are about square at this latitude; any other is served too.
SQUARE_AT = 56.0
LON_STRETCH = 1.0 / math.cos(math.radians(SQUARE_AT))
# Radius classes double from this one on, in metres.
LEAST_RADIUS = 500.0


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result through a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s"))
    return df.withColumn("_sc", packed.scalar()).select("*", "_sc.*").drop("_sc")


def _neighbours(y: Column, x: Column) -> Column:
    return F.explode(F.array(*[F.struct((y + dy).alias("cy"), (x + dx).alias("cx"))
                               for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))


def shared_requests(requests: DataFrame, asks: list[str], key: str = "query_id", label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests that ask the same are looked up once, under the least of their ids: (requests with that id, (id, _first)).
    An id of several requests stays one group, as its rows are ranked together. `label` is a column that no look-up reads: requests
    that differ in it alone are equal. It stays with the id (`_label`), but in the requests where an id has several."""
    sets = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*asks, *([label] if label else [])))).alias("_set"))
    if label:
        one, none = F.size("_set") == 1, F.lit(None).cast(requests.schema[label].dataType)
        sets = sets.withColumn("_label", F.when(one, F.get("_set", F.lit(0))[label])).withColumn(
            "_set", F.when(one, F.transform("_set", lambda s: s.withField(label, none))).otherwise(F.col("_set")))
    sets = cut_lineage(sets)
    firsts = cut_lineage(sets.groupBy("_set").agg(F.min(key).alias("_first")))
    asked = firsts.select(F.col("_first").alias(key), F.explode("_set").alias("_q")).select(key, "_q.*")
    return asked, sets.join(firsts, "_set").select(key, "_first", *(["_label"] if label else []))


def for_each_request(rows: DataFrame, members: DataFrame, key: str = "query_id", label: str | None = None) -> DataFrame:
    """Rows of the shared requests, once for every request that asked for them, with its `label`."""
    found = rows.withColumnRenamed(key, "_shared")
    out = found.join(members, F.col("_first").eqNullSafe(F.col("_shared")))  # a row's requests in a row: such results pack well
    return out.select(*[F.coalesce(c, "_label").alias(c) if c == label else c for c in rows.columns])


def near_equal_join(left: DataFrame, right: DataFrame, left_cols, right_cols, eps: float) -> DataFrame:
    """Pairs whose two coordinates differ by less than `eps` each."""
    (ly, lx), (ry, rx) = left_cols, right_cols
    cells = right.select("*", _neighbours(geo.cell(ry, eps), geo.cell(rx, eps)).alias("_n")) \
        .select("*", F.col("_n.cy").alias("_cy"), F.col("_n.cx").alias("_cx")).drop("_n")
    keyed = left.withColumn("_cy", geo.cell(ly, eps)).withColumn("_cx", geo.cell(lx, eps))
    return (keyed.join(cells, ["_cy", "_cx"])
            .where((F.abs(F.col(ly) - F.col(ry)) < eps) & (F.abs(F.col(lx) - F.col(rx)) < eps))
            .drop("_cy", "_cx"))


def _columns_of(row: Column, size: Column) -> Column:
    """Number of columns in a grid row of `size` degrees: wide enough that points of a pair
    lie in neighbouring ones at any latitude, and going round the globe."""
    edge = F.greatest(F.abs(row * size), F.abs((row + 1) * size)) + size
    ratio = F.sin(F.radians(size) / 2) / F.cos(F.radians(F.least(edge, F.lit(89.9))))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio)))
    return F.when((edge >= 89.0) | (width >= 120.0), F.lit(1)).otherwise(F.floor(360.0 / width)).cast("long")


def _column(lon: str, columns: Column) -> Column:
    return F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * columns).cast("long"), columns)


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float | str, left_at=("q_lat", "q_lon"),
                 right_at=("latitude", "longitude")) -> DataFrame:
    """Pairs within `radius_m` metres, a number or a column of `left`, with `distance_m`.

    Rows of the left side (the smaller one) fall into radius classes that double; each
    class has a grid of its own width, so a small radius meets small cells. They are copied
    to their nine neighbour cells; the right side has a copy for each class in use (at
    most 17, as the globe ends there)."""
    (ly, lx), (ry, rx) = left_at, right_at
    radius = F.lit(float(radius_m)) if isinstance(radius_m, (int, float)) else F.col(radius_m).cast("double")
    step = F.greatest(F.lit(0), F.ceil(F.log2(F.least(radius, F.lit(3e7)) / LEAST_RADIUS))).cast("int")
    asked = left.where(F.col(ly).isNotNull() & F.col(lx).isNotNull() & (radius >= 0)).withColumn("_r", radius).withColumn(
        "_k", F.lit(0) if isinstance(radius_m, (int, float)) else F.when(radius > 0, step).otherwise(0))
    if isinstance(radius_m, (int, float)):
        used, size = [0], F.lit(max(float(radius_m), 1.0) / geo.M_PER_DEG * 1.000001)
    else:
        used = sorted(r["_k"] for r in asked.select("_k").distinct().collect())
        size = F.pow(F.lit(2.0), F.col("_k")) * (LEAST_RADIUS / geo.M_PER_DEG * 1.000001)
    row = lambda lat: F.floor(F.col(lat) / F.col("_s")).cast("long")
    near = (asked.withColumn("_s", size).withColumn("_cy", F.explode(F.array(*[row(ly) + d for d in (-1, 0, 1)])))
            .withColumn("_m", _columns_of(F.col("_cy"), F.col("_s"))).withColumn("_x", _column(lx, F.col("_m")))
            .withColumn("_cx", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_x") + d, F.col("_m")) for d in (-1, 0, 1)]))))
            .drop("_s", "_m", "_x"))
    keyed = (right.where(F.col(ry).isNotNull() & F.col(rx).isNotNull())
             .withColumn("_k", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>"))).withColumn("_s", size)
             .withColumn("_cy", row(ry)).withColumn("_cx", _column(rx, _columns_of(F.col("_cy"), F.col("_s")))).drop("_s"))
    return (near.join(keyed, ["_k", "_cy", "_cx"]).drop("_k", "_cy", "_cx")
            .withColumn("distance_m", geo.haversine_m(ly, lx, ry, rx))
            .where(F.col("distance_m") <= F.col("_r")).drop("_r"))


def _bundles(df: DataFrame, at: list[str], size: int) -> DataFrame:
    """Rows of one place in arrays `_rows` of about `size` rows, numbered by `_part`: (at, _part, _rows)."""
    rest = [c for c in df.columns if c not in at]
    many = df.groupBy(*at).count().where(F.col("count") > size).select(*at, F.ceil(F.col("count") / size).alias("_parts"))
    part = F.pmod(F.xxhash64(*rest), F.coalesce("_parts", F.lit(1)))
    return cut_lineage(df.join(many, at, "left").withColumn("_part", part).groupBy(*at, "_part").agg(F.collect_list(F.struct(*rest)).alias("_rows")))


def radius_rows(left: DataFrame, right: DataFrame, radius_m: float, left_at=("q_lat", "q_lon"), right_at=("latitude", "longitude"),
                bundle: int = 1024, digits: int | None = None) -> DataFrame:
    """Pairs of rows within `radius_m` metres, with `distance_m`, where both tables may hold many rows of one place.

    Places meet once and rows are paired only in the result: a place's rows travel in bundles, which are dealt to tasks one by one,
    so a place with a third of all rows is not one task. With `digits` the distance is rounded, once for two places and not for
    each of their rows."""
    a_at, b_at = list(left_at), list(right_at)
    located = lambda df, at: df.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    a, b = _bundles(located(left, a_at), a_at, bundle), _bundles(located(right, b_at), b_at, bundle)
    near = radius_pairs(a.select(*a_at).distinct(), b.select(*b_at).distinct(), radius_m, left_at, right_at)
    if digits is not None:
        near = near.withColumn("distance_m", geo.round_to("distance_m", digits))
    a, b = a.withColumnsRenamed({"_part": "_a", "_rows": "_lefts"}), b.withColumnsRenamed({"_part": "_b", "_rows": "_rights"})
    met = near.join(a.select(*a_at, "_a"), a_at).join(b.select(*b_at, "_b"), b_at)
    whole = met.join(a, [*a_at, "_a"]).join(b, [*b_at, "_b"])
    return (whole.select(*a_at, *b_at, "distance_m", "_rights", F.explode("_lefts").alias("_l"))
            .select(*a_at, *b_at, "distance_m", "_l", F.explode("_rights").alias("_r"))
            .select(*[F.col(c if c in a_at else f"_l.{c}") for c in left.columns],
                    *[F.col(c if c in b_at else f"_r.{c}") for c in right.columns], "distance_m"))


def _boxed_cells(df: DataFrame, y: str, x: str, by: list[str], prefix: str) -> DataFrame:
    """Non-empty cells (`by`) with the tight box of the points in them."""
    return df.groupBy(*by).agg(
        F.min(y).alias(prefix + "y0"), F.max(y).alias(prefix + "y1"), F.min(x).alias(prefix + "x0"), F.max(x).alias(prefix + "x1"))


def _box_bounds() -> tuple[Column, Column]:
    """Lower and upper bound of the squared half-chord between two boxes (a, b)."""
    c = F.col
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), c(lo2) - c(hi1), c(lo1) - c(hi2))
    span = lambda lo1, hi1, lo2, hi2: F.greatest(c(hi2) - c(lo1), c(hi1) - c(lo2))
    sin2 = lambda deg: F.pow(F.sin(F.radians(deg) / 2), 2)
    far = F.greatest(F.abs("ay0"), F.abs("ay1"), F.abs("by0"), F.abs("by1"))
    near = lambda p: F.when(F.signum(p + "y0") * F.signum(p + "y1") <= 0, F.lit(0.0)).otherwise(F.least(F.abs(p + "y0"), F.abs(p + "y1")))
    lower = sin2(gap("ay0", "ay1", "by0", "by1")) + F.pow(F.cos(F.radians(far)), 2) * sin2(gap("ax0", "ax1", "bx0", "bx1"))
    upper = (sin2(span("ay0", "ay1", "by0", "by1"))
             + F.cos(F.radians(near("a"))) * F.cos(F.radians(near("b"))) * sin2(span("ax0", "ax1", "bx0", "bx1")))
    return lower, upper


ROW_CELL, POINT_CELL = ["_cz", "_cy", "_cx"], ["_rz", "_ry", "_rx"]


def _best_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of a row cell and a point cell, with bounds, that can hold a nearest point."""
    limit = pairs.groupBy("class", *ROW_CELL).agg(F.min("_hi").alias("_best"))
    return (pairs.join(limit, ["class", *ROW_CELL]).where(F.col("_lo") <= F.col("_best") * (1 + 1e-9) + 1e-18)
            .select("class", *ROW_CELL, *POINT_CELL))


def _split(df: DataFrame, full: DataFrame, by: list[str], cell: list[str], y: str, x: str, cell_deg: float) -> DataFrame:
    """Rows with their cell of before in `_o...`; the cells in `full` give way to 4 x 4 smaller ones."""
    z, cy, cx = cell
    size = F.lit(cell_deg) / F.pow(F.lit(4.0), F.col(z) + 1)
    fine = F.col("_full").isNotNull()
    return (df.join(full.withColumn("_full", F.lit(True)), [*by, *cell], "left").withColumns({
        "_o" + z: F.col(z), "_o" + cy: F.col(cy), "_o" + cx: F.col(cx)}).withColumns({
        z: F.when(fine, F.col("_o" + z) + 1).otherwise(F.col("_o" + z)),
        cy: F.when(fine, F.floor(F.col(y) / size)).otherwise(F.col("_o" + cy)).cast("long"),
        cx: F.when(fine, F.floor(F.col(x) / (size * LON_STRETCH))).otherwise(F.col("_o" + cx)).cast("long")}).drop("_full"))


def _crowded(coords: DataFrame, placed: DataFrame, opened: DataFrame, leaf: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """Row cells and point cells to split: more than `leaf` members, or row cells that would meet more than `reach` points of a class."""
    sizes = placed.groupBy("class", *POINT_CELL).agg(F.count("*").alias("_n"))
    met = (opened.join(sizes, ["class", *POINT_CELL]).groupBy("class", *ROW_CELL).agg(F.sum("_n").alias("_n"))
           .where(F.col("_n") > reach).select(*ROW_CELL))
    many = coords.groupBy(*ROW_CELL).agg(F.count("*").alias("_n")).where(F.col("_n") > leaf).select(*ROW_CELL)
    return met.union(many).distinct(), sizes.where(F.col("_n") > leaf).drop("_n")


def nearest_candidates(df: DataFrame, points: DataFrame, at=("latitude", "longitude"), cell_deg: float = 0.01, tiers: int = 9,
                       leaf: int = 256, depth: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct coordinates in leaf cells, places in leaf cells, pairs of leaf cells to open) for `nearest_join`.

    Cells of more than `leaf` coordinates or places, and row cells that would meet more than 8 * `leaf` points, are split 4 x 4, both
    sides together and level by level. At each level a row cell keeps only the point cells that can beat its best upper
    bound, so a dense cell never meets another as a whole. Data without dense cells stop at the first level."""
    y, x = at
    cells = lambda d, yc, xc, names: d.withColumn(names[0], F.lit(0)).withColumn(names[1], geo.cell(yc, cell_deg)).withColumn(names[2], geo.cell(xc, cell_deg * LON_STRETCH))
    # each of these is read several times below
    coords = cut_lineage(cells(
        df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(y).alias("_y"), F.col(x).alias("_x")).distinct(), "_y", "_x", ROW_CELL))
    places = points.groupBy("class", "p_lat", "p_lon").agg(F.min("point_id").alias("point_id"))  # the least of equal points wins anyway
    placed = cut_lineage(cells(places, "p_lat", "p_lon", POINT_CELL))
    left = _boxed_cells(coords, "_y", "_x", ROW_CELL, "a")
    right = _boxed_cells(placed, "p_lat", "p_lon", ["class", *POINT_CELL], "b")
    up = lambda c, t: F.floor(F.col(c) / F.lit(4 ** t)).cast("long")

    def tiered(which, cy, cx):
        return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), up(cy, t).alias("ty"), up(cx, t).alias("tx")) for t in which]))

    own = right.withColumn("k", tiered(range(tiers + 3), "_ry", "_rx")).select("*", "k.*").drop("k")
    covered = (own.where(F.col("t") < tiers).select("class", "t", "ty", "tx").distinct()
               .select("class", "t", _neighbours(F.col("ty"), F.col("tx")).alias("n"))
               .select("class", "t", F.col("n.cy").alias("ty"), F.col("n.cx").alias("tx")).distinct())
    reach = (left.withColumn("k", tiered(range(tiers), "_cy", "_cx")).select(*ROW_CELL, "k.*").join(covered, ["t", "ty", "tx"])
             .groupBy(*ROW_CELL, "class")
             .agg((F.min("t") + F.when(F.abs(F.first("_cy")) * cell_deg > 65.0, 3).otherwise(1)).alias("t")))
    scale = F.pow(F.lit(4.0), F.col("t"))
    asked = (reach.join(left, ROW_CELL)
             .withColumn("n", _neighbours(F.floor(F.col("_cy") / scale).cast("long"), F.floor(F.col("_cx") / scale).cast("long")))
             .select("*", F.col("n.cy").alias("ty"), F.col("n.cx").alias("tx")).drop("n"))
    lower, upper = _box_bounds()
    bounds = [lower.alias("_lo"), upper.alias("_hi")]
    opened = _best_pairs(cut_lineage(asked.join(own, ["class", "t", "ty", "tx"]).select("class", *ROW_CELL, *POINT_CELL, *bounds)))
    for _ in range(depth):
        rows_full, points_full = _crowded(coords, placed, opened, leaf, 8 * leaf)
        if rows_full.isEmpty() and points_full.isEmpty():
            break
        coords = cut_lineage(_split(coords, rows_full, [], ROW_CELL, "_y", "_x", cell_deg))
        placed = cut_lineage(_split(placed, points_full, ["class"], POINT_CELL, "p_lat", "p_lon", cell_deg))
        old = lambda names: ["_o" + c for c in names]
        a = _boxed_cells(coords, "_y", "_x", [*ROW_CELL, *old(ROW_CELL)], "a")
        b = _boxed_cells(placed, "p_lat", "p_lon", ["class", *POINT_CELL, *old(POINT_CELL)], "b")
        before = opened.withColumnsRenamed({c: "_o" + c for c in ROW_CELL + POINT_CELL})
        pairs = before.join(a, old(ROW_CELL)).join(b, ["class", *old(POINT_CELL)]).select("class", *ROW_CELL, *POINT_CELL, *bounds)
        opened = _best_pairs(cut_lineage(pairs))
        coords, placed = coords.drop(*old(ROW_CELL)), placed.drop(*old(POINT_CELL))
    return coords, placed, opened


def nearest_join(df: DataFrame, points: DataFrame, at=("latitude", "longitude"), cell_deg: float = 0.01, tiers: int = 9,
                 leaf: int = 256) -> DataFrame:
    """Nearest point of every class for each row: adds class, point_id, distance_m.

    `points` is (class, point_id, p_lat, p_lon); points of one class on one place are one, the least. Rows and points are put into
    cells, whose number the served area bounds. Cell sizes grow fourfold per tier: the
    finest tier whose 3x3 neighbourhood holds a point limits the distance to about three
    cells, so the next tier's neighbourhood (three tiers on where cells narrow towards the
    poles) holds the nearest point for certain. The last tier's cells are wider than the
    globe, so every row finds every class. Of the
    point cells found there only those that can beat the best upper bound are opened, so
    coordinates far from all points do not meet every point; dense cells are split first (`nearest_candidates`).
    Boxes do not reach over the antimeridian: points beyond it count as on the far side."""
    y, x = at
    coords, placed, opened = nearest_candidates(df, points, at, cell_deg, tiers, leaf)
    best = (coords.join(opened, ROW_CELL).join(placed, ["class", *POINT_CELL])
            .withColumn("distance_m", geo.haversine_m("_y", "_x", "p_lat", "p_lon"))
            .groupBy("_y", "_x", "class").agg(F.min(F.struct("distance_m", "point_id")).alias("b"))
            .select("_y", "_x", "class", "b.point_id", "b.distance_m"))
    return df.join(best, (F.col(y) == F.col("_y")) & (F.col(x) == F.col("_x"))).drop("_y", "_x")


def asof_nearest(df: DataFrame, index: DataFrame, by: str, at: str, value: str = "price_index",
                 index_month: str = "month", policy: str = "nearest", out: str = "index_value") -> DataFrame:
    """Add the index of the row's group and month, else of the month nearest to the
    date (earlier on ties) or, with policy 'latest', of the newest; adds `<out>_exact`.

    Works on the distinct (group, date) keys, which the calendar bounds."""
    keys = df.select(F.col(by).alias("_g"), F.col(at).alias("_m")).where("_g is not null and _m is not null").distinct()
    idx = index.select(F.col(by).alias("_ig"), F.col(index_month).alias("_im"), F.col(value).alias("_iv"))
    same = (F.col("_g") == F.col("_ig")) & (F.trunc("_m", "month") == F.col("_im"))
    exact = keys.join(idx, same).select("_g", "_m", F.col("_iv").alias(out), F.lit(True).alias(f"{out}_exact"))
    gap = F.abs(F.datediff("_m", "_im"))
    pick = (F.min_by("_iv", F.struct(gap, F.col("_im"))) if policy == "nearest" else F.max_by("_iv", "_im"))
    filled = (keys.join(idx, same, "left_anti").join(idx, F.col("_g") == F.col("_ig")).groupBy("_g", "_m")
              .agg(pick.alias(out)).withColumn(f"{out}_exact", F.lit(False)))
    lookup = exact.unionByName(filled)
    return (df.join(lookup, (F.col(by) == F.col("_g")) & (F.col(at) == F.col("_m")), "left")
            .drop("_g", "_m"))


def fill_from(df: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Fill NULLs of `cols` from a source with one row per key."""
    src = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols])
    out = df.join(src, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(c, f"_s_{c}")).drop(f"_s_{c}")
    return out


def upsert_by_key(target: DataFrame, updates: DataFrame, keys: list[str], stamp: str | None = None) -> DataFrame:
    """Insert-or-replace on a natural key; updates must be unique per key.

    With `stamp`, replaced and inserted rows carry it in `updated_at`."""
    rest = [c for c in target.columns if c not in keys and c != "updated_at"]
    new = updates.select(*keys, F.struct(*rest).alias("_new"))
    old = target.select(*keys, F.struct(*rest).alias("_old"),
                        *([F.col("updated_at").alias("_at")] if stamp else []))
    both = old.join(new, keys, "full")
    row = F.coalesce("_new", "_old")
    cols = [*keys, *[row[c].alias(c) for c in rest]]
    if stamp:
        cols.append(F.when(F.col("_new").isNotNull(), F.lit(stamp).cast("timestamp"))
                    .otherwise(F.col("_at")).alias("updated_at"))
    return both.select(*cols)


def reapply_postcodes(df: DataFrame, source: DataFrame) -> DataFrame:
    """Replace every postcode by the source's for (date, address, price)."""
    keys = ["sale_date", "address", "price"]
    src = (source.where(F.coalesce("eircode", F.lit("")) != "").groupBy(*keys)
           .agg(F.min("eircode").alias("_e")))
    return (df.join(src, keys, "left").withColumn("eircode", F.col("_e")).drop("_e"))


# ------------------------------------------------------------ text joins

GRAM = 3


def _grams(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    count = F.length(text) - n + 1
    spans = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spans, lambda i: F.substring(text, i, n)))


def _gram_size(term: str) -> Column:
    return F.least(F.lit(GRAM), F.length(term))


@dataclass(frozen=True)
class GramIndex:
    """Dictionary texts by the grams that some asked term has: `entries` is (_scope, _gram, _text,
    text ids), `freq` the number of texts per gram in each scope (a county, or one for all)."""
    entries: DataFrame
    freq: DataFrame
    text_id: tuple[str, ...]

    def rarest(self, terms: DataFrame) -> DataFrame:
        """Rarest gram `_gram` and its frequency `_f` per asked (_term, _asked) and scope; a NULL `_asked` means
        every scope. A text with the term has all of its grams, so a scope that lacks one is left out."""
        grams = (terms.where(F.length("_term") > 0).distinct()
                 .withColumn("_g", _grams(F.col("_term"), _gram_size("_term")))
                 .select("_term", "_asked", F.size("_g").alias("_all"), F.explode("_g").alias("_gram")))
        # a term with a gram that no text has is in none: it is left out before the others meet every scope
        known = (grams.join(self.freq.select("_gram").distinct(), "_gram").groupBy("_term", "_all").agg(F.count_distinct("_gram").alias("_known"))
                 .where("_all = _known").select("_term"))
        grams = grams.join(known, "_term", "left_semi")
        return (grams.join(self.freq, "_gram").where(F.col("_asked").isNull() | (F.col("_asked") == F.col("_scope")))
                .groupBy("_term", "_asked", "_scope")
                .agg(F.first("_all").alias("_all"), F.count("*").alias("_known"), F.min(F.struct("_f", "_gram")).alias("_p"))
                .where("_all = _known").select("_term", "_asked", "_scope", "_p._f", "_p._gram"))


def gram_index(terms: DataFrame, term: str, dictionary: DataFrame, text: str, text_id: list[str],
               scope: str | None = None, stored: bool = True) -> GramIndex:
    """Index of a dictionary of distinct texts for all terms a query will ask; with `stored` it is written once
    and every look-up of the query reads it. Only gram lengths and grams that the terms have are kept."""
    asked = terms.select(F.col(term).alias("_term")).where(F.length("_term") > 0).distinct()
    used = asked.select(F.explode(_grams(F.col("_term"), _gram_size("_term"))).alias("_gram")).distinct()
    sizes = asked.agg(F.collect_set(_gram_size("_term")).alias("_sizes"))  # 3 values at most
    value = F.lit("") if scope is None else F.coalesce(scope, F.lit(""))
    entries = (dictionary.select(value.alias("_scope"), *text_id, F.col(text).alias("_text"))
               .withColumn("_sizes", sizes.scalar())
               .withColumn("_gram", F.explode(F.flatten(F.transform("_sizes", lambda n: _grams(F.col("_text"), n))))).drop("_sizes")
               .join(used, "_gram", "left_semi"))
    entries = cut_lineage(entries.repartition("_scope", "_gram")) if stored else entries
    return GramIndex(entries, entries.groupBy("_scope", "_gram").agg(F.count("*").alias("_f")), tuple(text_id))


def contains_join(terms: DataFrame, term: str, dictionary: DataFrame, text: str, text_id: list[str],
                  scope: str | None = None, asked: str | None = None, index: GramIndex | None = None) -> DataFrame:
    """(terms row, dictionary row) pairs where the text contains the term.

    Both sides must already be in one case; `dictionary` should be distinct. With `scope` (a dictionary column) and
    `asked` (its value wanted by a terms row, NULL for any) a term meets texts of that scope only.
    `index` is one that was made for these terms, among others."""
    index = index or gram_index(terms, term, dictionary, text, text_id, scope, stored=False)
    want = F.col(asked) if asked else F.lit(None).cast("string")
    picks = index.rarest(terms.select(F.col(term).alias("_term"), want.alias("_asked")))
    hits = (picks.join(index.entries, ["_scope", "_gram"]).where(F.contains(F.col("_text"), F.col("_term")))
            .select("_term", "_asked", "_text", *index.text_id))
    same = F.col(term) == F.col("_term")
    return (terms.join(hits, same & want.eqNullSafe(F.col("_asked")) if asked else same)
            .drop("_term", "_asked").withColumnRenamed("_text", text))


def contains_all_join(requests: DataFrame, dictionary: DataFrame, text: str, text_id: list[str],
                      scope: str | None = None, asked: str | None = None, index: GramIndex | None = None) -> DataFrame:
    """(request, text) pairs where every word group of the request has a variant in
    the text. `requests` is (query_id, variants ARRAY<ARRAY<STRING>>, further columns).

    In each scope candidates come from the word group that is rarest there by gram frequency; the other
    groups are checked on the candidate text, so common words drive no join. `scope`, `asked`, `index` as in
    `contains_join`."""
    want = F.col(asked) if asked else F.lit(None).cast("string")
    words = (requests.select("query_id", want.alias("_asked"), F.size("variants").alias("_n"), F.posexplode("variants").alias("_pos", "_vs"))
             .select("query_id", "_asked", "_n", "_pos", F.explode("_vs").alias("_term")))
    index = index or gram_index(words, "_term", dictionary, text, text_id, scope, stored=False)
    picks = index.rarest(words.select("_term", "_asked")).withColumnRenamed("_asked", "_for")
    priced = words.join(picks, "_term").where(F.col("_asked").eqNullSafe(F.col("_for")))
    best = (priced.groupBy("query_id", "_scope", "_pos").agg(F.sum("_f").alias("_cost"), F.first("_n").alias("_n"))
            .groupBy("query_id", "_scope").agg(F.count("*").alias("_known"), F.first("_n").alias("_n"), F.min(F.struct("_cost", "_pos")).alias("_b"))
            .where("_known = _n").select("query_id", "_scope", "_b._pos"))
    found = (priced.join(best, ["query_id", "_scope", "_pos"]).select("query_id", "_term", "_scope", "_gram")
             .join(index.entries, ["_scope", "_gram"]).where(F.contains(F.col("_text"), F.col("_term")))
             .select("query_id", "_text", *index.text_id).distinct())
    every = F.forall("variants", lambda vs: F.exists(vs, lambda v: F.contains(F.col("_text"), v)))
    return requests.join(found, "query_id").where(every).drop("variants").withColumnRenamed("_text", text)


PREFIX_TIERS = (1, 2, 4, 8, 16, 32)


def prefix_join(terms: DataFrame, term: str, dictionary: DataFrame, text: str) -> DataFrame:
    """(terms row, dictionary row) pairs where the text starts with the term."""
    t, n = F.col(term), F.length(term)
    tier = F.lit(PREFIX_TIERS[0])
    for size in PREFIX_TIERS[1:]:
        tier = F.when(n >= size, size).otherwise(tier)
    asked = terms.where(n > 0).withColumn("_tier", tier).withColumn("_key", t.substr(F.lit(1), F.col("_tier")))
    used = asked.select("_tier", "_key").distinct()
    keys = F.array(*[F.struct(F.lit(s).alias("_tier"), F.col(text).substr(1, s).alias("_key"))
                     for s in PREFIX_TIERS])
    index = (dictionary.select("*", F.explode(keys).alias("_k"))
             .select("*", "_k._tier", "_k._key").drop("_k").join(used, ["_tier", "_key"], "left_semi"))
    return (asked.join(index, ["_tier", "_key"]).where(F.col(text).startswith(t))
            .drop("_tier", "_key"))


def pattern_join(df: DataFrame, places: DataFrame, address: str = "address", place: str = "place") -> DataFrame:
    """Rows whose address contains any listed place, with the first such place."""
    low = places.select(place, F.lower(place).alias("_t")).distinct()
    dictionary = df.select(F.lower(address).alias("_a")).distinct()
    hits = (contains_join(low, "_t", dictionary, "_a", []).groupBy("_a").agg(F.min(place).alias(place)))
    return df.join(hits, F.lower(F.col(address)) == F.col("_a")).drop("_a")
