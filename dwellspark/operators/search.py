"""Searches, work lists and samples.

A search is a table of requests joined to the table of sales. Requests never meet
raw sales: sales are first cut to the newest `limit` rows per coordinate or address
(every such row has the same distance or match), so a point that holds a
third of all sales adds at most `limit` rows to a request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellspark.functions import geo, text
from dwellspark.lineage import cut_lineage
from dwellspark.operators.joins import for_each_request, near_equal_join, prefix_join, radius_pairs, shared_requests
from dwellspark.operators.quantiles import grouped_quantiles, join_null_safe, opened_buckets, ranked_values
from dwellspark.operators.stats import market_sales, top_n


def sale_filters(df: DataFrame, min_price=None, max_price=None, min_year=None, max_year=None,
                 county: str | None = None) -> DataFrame:
    """Optional bounds; years become date ranges so partitions can be pruned."""
    if min_price is not None:
        df = df.where(F.col("price") >= min_price)
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    if min_year is not None:
        df = df.where(F.col("sale_date") >= F.lit(f"{min_year}-01-01").cast("date"))
    if max_year is not None:
        df = df.where(F.col("sale_date") < F.lit(f"{max_year + 1}-01-01").cast("date"))
    if county is not None:
        df = df.where(F.lower("county") == county.lower())
    return df


def not_suspect(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("geocode_suspect", F.lit(False)))


def newest_first(*extra: Column) -> list[Column]:
    return [F.col("sale_date").desc(), *extra, F.col("id")]


# Optional columns of a request table; NULL means no bound.
BOUNDS = ("min_price", "max_price", "min_year", "max_year")


def _bounds_of(requests: DataFrame) -> list[str]:
    return [b for b in BOUNDS if b in requests.columns]


def _within(bounds: list[str]) -> Column:
    """The row's price and date lie within the bounds beside it."""
    day = lambda year: F.make_date(year, F.lit(1), F.lit(1))
    tests = {"min_price": lambda b: F.col("price") >= b, "max_price": lambda b: F.col("price") <= b,
             "min_year": lambda b: F.col("sale_date") >= day(b.cast("int")), "max_year": lambda b: F.col("sale_date") < day(b.cast("int") + 1)}
    return reduce(lambda a, b: a & b, [F.col(b).isNull() | tests[b](F.col(b)) for b in bounds], F.lit(True))


def _sales_within(places: DataFrame, df: DataFrame, key: list[str], bounds: list[str]) -> DataFrame:
    """Sales on the given places that lie within some set of bounds asked there, once for each such set. Requests with equal
    bounds share a set, so a busy place is opened once a set and not once a request."""
    asked = places.select(*key, *bounds).distinct()
    return join_null_safe(df, asked, key).where(_within(bounds))


# ------------------------------------------------------------ radius search

# Multiples of the asked radius that are tried in turn.
RING_FACTORS = (1, 2, 3, 5, 10)


def _choose_ring(requests: DataFrame, pairs: DataFrame, limit: int, max_km: float, min_results: int) -> DataFrame:
    """Requests with their chosen ring; `pairs` carry distance and row counts."""
    rings = [F.least(F.col("radius_km") * f, F.lit(max_km)) for f in RING_FACTORS] + [F.lit(max_km)]
    same = F.lower("county") == F.col("p_county")
    inside = lambda ring: F.col("distance_m") <= ring * 1000.0
    sums = []
    for i, ring in enumerate(rings):
        sums += [F.sum(F.when(inside(ring), F.col("n")).otherwise(0)).alias(f"a{i}"),
                 F.sum(F.when(inside(ring) & same, F.col("n")).otherwise(0)).alias(f"c{i}")]
    counted = requests.join(pairs.groupBy("query_id").agg(*sums), "query_id", "left")
    has = F.col("county").isNotNull()
    dropped = has & (F.coalesce("c0", F.lit(0)) == 0)
    chosen = F.lit(max_km)
    for i, ring in reversed(list(enumerate(rings))):
        n = F.coalesce(F.when(has & ~dropped, F.col(f"c{i}")).otherwise(F.col(f"a{i}")), F.lit(0))
        chosen = F.when((F.least(n, F.lit(limit)) >= min_results) | (ring >= max_km), ring).otherwise(chosen)
    return counted.select(*requests.columns, chosen.alias("ring_km"), dropped.alias("county_dropped"))


def radius_search(requests: DataFrame, df: DataFrame, limit: int = 200, sort: str = "date",
                  reaches_km: tuple[float, ...] = (2.0, 6.0), max_km: float = 20.0, min_results: int = 5) -> DataFrame:
    """`shared_radius_search` with the rows of every request."""
    return for_each_request(*shared_radius_search(requests, df, limit, sort, reaches_km, max_km, min_results))


def shared_radius_search(requests: DataFrame, df: DataFrame, limit: int = 200, sort: str = "date", reaches_km: tuple[float, ...] = (2.0, 6.0),
                         max_km: float = 20.0, min_results: int = 5) -> tuple[DataFrame, DataFrame]:
    """Expanding-radius search for a table of requests
    (query_id, q_lat, q_lon, radius_km, county or NULL).

    The county is dropped when it has no row at the asked radius. The ring is the
    first of r, 2r, 3r, 5r, 10r, 20 km with enough rows after the limit. Rings are
    counted on distinct coordinates in tiers of growing reach: a wider grid is opened only
    for requests that the ones before could not settle, so the neighbourhood of a busy
    place is met by those alone that lie near it or find too little elsewhere. Requests may carry bounds of their own
    (`BOUNDS`); rings then count, and show, sales within them only. Requests that ask the same are looked up once: the rows are
    those of the shared requests, and the second table tells which of them a request has (`shared_requests`)."""
    shown = not_suspect(df).where("latitude is not null and longitude is not null")
    keyed = shown.withColumn("p_county", F.lower("county"))
    place = ["latitude", "longitude", "p_county"]
    bounds = _bounds_of(requests)
    requests, members = shared_requests(requests.where("query_id is not null"), ["q_lat", "q_lon", "radius_km", "county", *bounds])
    requests = cut_lineage(requests)
    points = cut_lineage(keyed.groupBy(*place).agg(F.count("*").alias("n")))

    def hits(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
        keep = pairs.select("query_id", *place, "distance_m").join(chosen, "query_id").where(
            (F.col("distance_m") <= F.col("ring_km") * 1000.0)
            & (F.col("county").isNull() | F.col("county_dropped") | (F.lower("county") == F.col("p_county"))))
        asked = ["radius_km", "ring_km", "county_dropped", F.col("county").alias("asked_county"), *bounds]
        return keep.select("query_id", *place, "distance_m", *asked)

    rest, parts = requests, []
    for reach in [r for r in reaches_km if r < max_km] + [max_km]:
        asked = rest if reach == max_km else rest.where(F.col("radius_km") <= reach)
        pairs = radius_pairs(asked, points, reach * 1000.0)
        if bounds:
            pairs = cut_lineage(pairs)
            counts = _sales_within(pairs, keyed.drop(*bounds), place, bounds).groupBy(*place, *bounds).agg(F.count("*").alias("n"))
            pairs = join_null_safe(pairs.drop("n"), counts, [*place, *bounds])
        settled = cut_lineage(_choose_ring(asked, pairs, limit, max_km, min_results).where(F.col("ring_km") <= reach))
        parts.append(hits(settled, pairs))
        rest = rest.join(settled.select("query_id"), "query_id", "left_anti")
    found = cut_lineage(reduce(DataFrame.unionByName, parts))
    met = _sales_within(found, keyed, place, bounds)  # only places that some request shows are ranked
    newest = top_n(met, [*place, *bounds], newest_first(), limit, "_rn").drop("_rn")
    rows = join_null_safe(found, newest, [*place, *bounds])
    order = ([F.col("distance_m"), *newest_first()] if sort == "distance"
             else newest_first(F.col("distance_m")))
    shown = top_n(rows.drop("p_county"), ["query_id"], order, limit, "position")
    return shown.withColumn("radius_expanded", F.col("ring_km") != F.col("radius_km")), members


# Fixed value: width of the price buckets that a place's year is first counted in.
COARSE_PRICE = 65_536


def area_trends(requests: DataFrame, df: DataFrame, rounded: bool = True) -> DataFrame:
    """Yearly market-price trends around each point (query_id, q_lat, q_lon, radius_km).

    Areas meet places, and equal areas do so once. Of a place's year an area takes the sums of a few price buckets; single
    prices are met in the buckets alone that hold the area's median."""
    place, by = ["latitude", "longitude"], ["query_id", "year"]
    counts = (not_suspect(market_sales(df)).where("latitude is not null and longitude is not null and price is not null")
              .groupBy(*place, F.year("sale_date").alias("year"), "price").agg(F.count("*").alias("_w"))
              .withColumn("_b", F.floor(F.col("price").cast("double") / COARSE_PRICE).cast("long")))
    asked, members = shared_requests(requests, ["q_lat", "q_lon", "radius_km"])
    asked = asked.select("query_id", "q_lat", "q_lon", (F.col("radius_km") * 1000.0).alias("_reach"))
    near = cut_lineage(radius_pairs(asked, counts.select(*place).distinct(), "_reach").select("query_id", *place))
    coarse = counts.groupBy(*place, "year", "_b").agg(F.sum("_w").alias("_n"), F.sum(F.col("price") * F.col("_w")).alias("_s"),
                                                      F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    buckets = near.join(coarse, place).groupBy(*by, "_b").agg(
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    probs = {"median_price": 0.5}
    opened = cut_lineage(opened_buckets(buckets, by, probs))
    asks = join_null_safe(near, opened.select(*by, "_b"), ["query_id"])
    prices = (join_null_safe(asks, counts, [*place, "year", "_b"]).groupBy(*by, "_b", F.col("price").alias("_v"))
              .agg(F.sum("_w").alias("_c")))
    out = for_each_request(ranked_values(join_null_safe(prices, opened, [*by, "_b"]), by, probs), members).withColumnsRenamed(
        {"mean_value": "mean_price", "min_value": "min_price", "max_value": "max_price"})
    return (out.withColumn("median_price", F.round("median_price")).withColumn("mean_price", F.round("mean_price"))
            if rounded else out)


def area_summary(areas: DataFrame, df: DataFrame, n: int = 10, expand: bool = False) -> DataFrame:
    """Per area: latest-year median, year span, sales of the asked radius, and its newest `n` with their mean price. Trends and
    rows are of one area, the asked radius. With `expand` the rows are those of the expanding radius search, where a sparse area
    goes on to wider rings, and the total counts the rows shown."""
    areas = cut_lineage(areas)
    trends = area_trends(areas, df).groupBy("query_id").agg(
        F.max_by("median_price", "year").alias("median_price"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    if expand:
        hits = cut_lineage(radius_search(areas, df, limit=n))
        total = hits.groupBy("query_id").agg(F.count("*").alias("total_count"))
    else:
        hits, total = _newest_around(areas, df, n)
    recent = hits.groupBy("query_id").agg(
        F.floor(F.sum("price").cast("double") / F.count("*") + 0.5).alias("avg_price"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "sale_date", "price"))),
                    lambda s: s.dropFields("position")).alias("recent"))
    return areas.select("query_id").join(total, "query_id", "left").join(recent, "query_id", "left").join(trends, "query_id", "left")


def _newest_around(areas: DataFrame, df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(newest `n` sales within the asked radius, their number without that limit) per area."""
    shown = not_suspect(df).where("latitude is not null and longitude is not null")
    place = ["latitude", "longitude"]
    points = shown.groupBy(*place).agg(F.count("*").alias("_n"))
    asked = areas.select("query_id", "q_lat", "q_lon", (F.col("radius_km") * 1000.0).alias("_reach"))
    near = cut_lineage(radius_pairs(asked, points, "_reach").select("query_id", *place, "_n", "distance_m"))
    total = near.groupBy("query_id").agg(F.sum("_n").alias("total_count"))
    newest = top_n(shown.join(near.select(*place).distinct(), place, "left_semi"), place, newest_first(), n, "_rn").drop("_rn")
    return top_n(near.join(newest, place), ["query_id"], newest_first(F.col("distance_m")), n, "position"), total


# ------------------------------------------------------------ polygon search


def ring_cover(polygons: DataFrame, cell_deg: float = 0.02, side: int = 16) -> DataFrame:
    """Grid cells over the bounding box of each ring: poly_id, ring, level and cell. A level doubles the cells, and a ring takes
    the finest level whose cells meet its box at most (side + 1) times each way, so a country has no more cells than a street."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    wide = F.greatest(F.array_max(lats) - F.array_min(lats), F.array_max(lons) - F.array_min(lons))
    level = F.greatest(F.lit(0), F.ceil(F.log2(wide / (cell_deg * side))).cast("int"))
    span = lambda v: F.sequence(_level_cell(F.array_min(v), cell_deg), _level_cell(F.array_max(v), cell_deg))
    return (polygons.where(F.size("ring") >= 3).withColumn("_level", level)
            .select("poly_id", "ring", "_level", F.explode(span(lats)).alias("_cy"), span(lons).alias("_xs"))
            .select("poly_id", "ring", "_level", "_cy", F.explode("_xs").alias("_cx")))


def _level_cell(c, cell_deg: float) -> Column:
    return F.floor(c / (F.lit(cell_deg) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")


def polygon_search(polygons: DataFrame, df: DataFrame, limit: int = 50, cell_deg: float = 0.02) -> DataFrame:
    """Newest rows strictly inside each polygon (poly_id, ring), suspects hidden.

    Polygons are covered by a bounded number of grid cells; containment is tested once per distinct coordinate, and
    only sales of coordinates inside some polygon are ranked, within the polygon's own `BOUNDS` if it has any. The levels in use,
    20 at most, go to the driver. Equal polygons are looked up once."""
    bounds = _bounds_of(polygons)
    polygons, members = shared_requests(polygons, ["ring", *bounds], "poly_id")
    shown = not_suspect(df).where("latitude is not null and longitude is not null")
    covered = ring_cover(polygons, cell_deg)
    levels = sorted(r[0] for r in covered.select("_level").distinct().collect())
    points = (shown.select("latitude", "longitude").distinct()
              .withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
              .select("*", _level_cell(F.col("latitude"), cell_deg).alias("_cy"), _level_cell(F.col("longitude"), cell_deg).alias("_cx")))
    place = ["latitude", "longitude"]
    inside = (covered.join(points, ["_level", "_cy", "_cx"])
              .where(geo.point_in_polygon("latitude", "longitude", "ring"))
              .select("poly_id", *place))
    if bounds:
        inside = inside.join(polygons.select("poly_id", *bounds), "poly_id")
    newest = top_n(_sales_within(inside, shown, place, bounds), [*place, *bounds], newest_first(), limit, "_rn").drop("_rn")
    return for_each_request(top_n(join_null_safe(inside, newest, [*place, *bounds]), ["poly_id"], newest_first(), limit, "position"),
                            members, "poly_id")


# ------------------------------------------------------------ text searches


def all_terms_search(requests: DataFrame, df: DataFrame, limit: int = 100,
                     address: str = "address_normalized") -> DataFrame:
    """Rows whose address holds every term of the request (query_id, query, county), words compared by
    their stem, ranked by how much of the address the terms make up.

    Requests meet addresses on their rarest term only; the other terms are checked
    on the address, so common words never drive a join. An address stands by its newest sale, so of the hits only the first
    `limit` addresses of a request are opened, and requests that ask the same are looked up once."""
    asked, members = shared_requests(requests.where("query_id is not null"), ["query", "county"])
    own = df.withColumns({"_text": F.col(address), "_county": F.col("county")})
    hits = _first_hits(_term_hits(asked, own.select("_text", "_county").distinct()), own, limit)
    met = join_null_safe(own, hits.select("_text", "_county").distinct(), ["_text", "_county"], "left_semi")
    newest = top_n(met, ["_text", "_county"], newest_first(), limit, "_rn").drop("_rn")
    rows = join_null_safe(hits, newest, ["_text", "_county"]).drop("_text", "_county")
    return for_each_request(top_n(rows, ["query_id"], [F.col("rank_score").desc(), *newest_first()], limit, "position"), members)


def _first_hits(hits: DataFrame, df: DataFrame, limit: int) -> DataFrame:
    """Hits whose address is one of the request's first `limit` by score and newest sale: the first `limit` rows are on them."""
    best = top_n(df.select("_text", "_county", "sale_date", "id"), ["_text", "_county"], newest_first(), 1, "_rn").drop("_rn")
    rows = join_null_safe(hits, best, ["_text", "_county"])
    return cut_lineage(top_n(rows, ["query_id"], [F.col("rank_score").desc(), *newest_first()], limit, "_rn")
                       .select("query_id", "_text", "_county", "rank_score"))


def _term_hits(requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """query_id, _text, _county, rank_score of the dictionary's addresses that hold every term of a request."""
    terms = lambda c: F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), text.stem)
    asked = requests.withColumn("_terms", F.array_distinct(terms("query"))).where(F.size("_terms") > 0)
    dictionary = dictionary.withColumn("_tokens", terms("_text"))
    asked_terms = asked.select("query_id", F.explode("_terms").alias("_t"))
    index = (dictionary.select("_text", "_county", "_tokens", F.explode(F.array_distinct("_tokens")).alias("_t"))
             .join(asked_terms.select("_t").distinct(), "_t", "left_semi"))
    freq = index.groupBy("_t").agg(F.count("*").alias("_f"))
    picks = (asked_terms.join(freq, "_t", "left").groupBy("query_id")
             .agg(F.min(F.struct("_f", "_t")).alias("_p"), F.count("*").alias("_all"), F.count("_f").alias("_known"))
             .where("_all = _known").select("query_id", F.col("_p._t").alias("_t")))
    hits = (asked.join(picks, "query_id").join(index, "_t")
            .where((F.size(F.array_except("_terms", "_tokens")) == 0)
                   & (F.col("county").isNull() | (F.col("county") == F.col("_county")))))
    matched = F.size(F.filter("_tokens", lambda t: F.array_contains("_terms", t)))
    return hits.select("query_id", "_text", "_county",
                       geo.round_to(matched.cast("double") / F.size("_tokens"), 6).alias("rank_score"))


def exact_address_search(requests: DataFrame, df: DataFrame, limit: int = 100) -> DataFrame:
    """All sales whose canonical address starts with the canonical request, county
    case-sensitive, newest first (`position`); requests without any get the rows that hold all their terms.

    Both ways look in one dictionary of distinct addresses, and the sales of hit addresses are dealt once by address, with no
    column that the caller does not read; for the second way an address brings its newest `limit` sales, of the request's first
    `limit` addresses. Requests that ask the same are looked up once and meet again with the finished rows."""
    spelled = df.withColumns({"_text": F.coalesce("address_normalized", "address"), "_county": F.col("county")})
    asked, members = shared_requests(requests.select("query_id", "county", text.normalize_address("query").alias("_asked")), ["_asked", "county"])
    asked, same = cut_lineage(asked), ["_text", "_county"]
    age = F.coalesce(-F.unix_micros(F.col("sale_date").cast("timestamp")), F.lit(2**63 - 1))
    sizes = spelled.groupBy(*same, _quarter()).agg(F.count("*").alias("_n"), F.min(F.struct(age, "id", "sale_date")).alias("_newest"))
    dictionary = cut_lineage(sizes.groupBy(*same).agg(F.collect_list(F.struct("_quarter", "_n")).alias("_sizes"), F.min("_newest").alias("_newest")))
    hits = cut_lineage(prefix_join(asked, "_asked", dictionary.select(*same), "_text")
            .where(F.col("county").isNull() | (F.col("county") == F.col("_county")))
            .select("query_id", *same))
    left = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    terms = _first_hits(_term_hits(left.select("query_id", F.col("_asked").alias("query"), "county"), dictionary.select(*same)),
                        dictionary.select(*same, "_newest.sale_date", "_newest.id"), limit)
    place = lambda rows: rows.withColumn("_place", F.struct(*same)).drop(*same)  # noqa: E731  one key, equal where both counties are null
    sold = place(spelled)
    newest = top_n(sold.join(place(terms).select("_place").distinct(), "_place", "left_semi"), ["_place"], newest_first(), limit, "_rn").drop("_rn")
    by_terms = top_n(place(terms).join(newest, "_place"), ["query_id"], [F.col("rank_score").desc(), *newest_first()], limit, "position")
    held = (join_null_safe(hits, dictionary, same).select("query_id", F.explode("_sizes").alias("_s"))
            .groupBy("query_id", "_s._quarter").agg(F.sum("_s._n").alias("_n")))
    by_prefix = _dated_positions(place(hits).join(sold, "_place"), held)
    found = by_prefix.withColumn("found_by", F.lit("prefix")).unionByName(by_terms.drop("rank_score").withColumn("found_by", F.lit("terms")))
    return for_each_request(found.drop("_place"), members)


def _quarter() -> Column:
    """First day of the quarter of the sale; sales without a date are in the first of all, as they come last."""
    return F.coalesce(F.trunc("sale_date", "quarter"), F.make_date(F.lit(1), F.lit(1), F.lit(1))).alias("_quarter")


def _dated_positions(rows: DataFrame, held: DataFrame) -> DataFrame:
    """`position` of each row in its request, newest first, then by id. `held` are the rows of each request by `_quarter`, so a
    window holds one request's quarters or the rows of one quarter, however many rows a request has."""
    until = Window.partitionBy("query_id").orderBy(F.col("_quarter").desc())
    before = held.select("query_id", "_quarter", (F.sum("_n").over(until) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_quarter", _quarter()).join(before, ["query_id", "_quarter"])
    own = F.row_number().over(Window.partitionBy("query_id", "_quarter").orderBy(*newest_first()))
    return placed.withColumn("position", (F.col("_before") + own).cast("int")).drop("_quarter", "_before")


def substring_search(df: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    return (df.where(F.contains(F.lower("address"), F.lit(needle.lower())))
            .orderBy(*newest_first()).limit(limit))


def _matched_codes(codes: DataFrame, df: DataFrame, bounds: list[str] | None = None):
    bounds = bounds or []
    norm = codes.select(text.normalize_postcode("code").alias("_n"), *bounds).where("_n <> ''").distinct()
    full = F.length("_n") >= 5
    asked = norm.select(F.when(full, F.col("_n")).otherwise(F.substring("_n", 1, 3)).alias("code"),
                        F.when(full, "full_eircode").otherwise("routing_key").alias("match_type"), *bounds).distinct()
    compact = F.replace(F.upper("eircode"), F.lit(" "), F.lit(""))
    rows = df.where("eircode is not null").withColumn("_full", compact).withColumn("_key", F.substring("_full", 1, 3))
    return asked, rows


def postcode_search(codes: DataFrame, df: DataFrame, limit: int = 500) -> DataFrame:
    """Newest rows per full postcode or routing key, and per set of `BOUNDS` where the codes carry any."""
    bounds = _bounds_of(codes)
    asked, rows = _matched_codes(codes, df, bounds)
    def pick(col: str, kind: str) -> DataFrame:  # only asked codes are ranked
        wanted = asked.where(F.col("match_type") == kind)
        met = rows.withColumn("code", F.col(col)).join(wanted, "code").where(_within(bounds))
        return top_n(met, ["code", *bounds], newest_first(), limit, "position")
    return pick("_full", "full_eircode").unionByName(pick("_key", "routing_key")).drop("_full", "_key")


def postcode_search_stats(codes: DataFrame, df: DataFrame) -> DataFrame:
    """Unlimited market statistics for the same codes."""
    asked, rows = _matched_codes(codes, market_sales(df))
    both = rows.select("price", "sale_date", F.explode(F.array(
        F.struct(F.lit("full_eircode").alias("match_type"), F.col("_full").alias("code")),
        F.struct(F.lit("routing_key").alias("match_type"), F.col("_key").alias("code")))).alias("k")) \
        .select("price", "sale_date", "k.*").join(asked, ["code", "match_type"], "left_semi")
    by = ["code", "match_type"]
    prices = grouped_quantiles(both, by, "price", {"median_price": 0.5})
    dates = both.groupBy(*by).agg(F.min("sale_date").alias("earliest_sale"), F.max("sale_date").alias("latest_sale"))
    return prices.join(dates, by).select(
        *by, F.col("n").alias("total_count"), F.round("median_price").alias("median_price"),
        F.round("mean_value").alias("avg_price"), "earliest_sale", "latest_sale")


def routing_key_list(stats: DataFrame, sort: str = "count") -> DataFrame:
    order = [F.col("property_count").desc(), F.col("routing_key")] if sort == "count" else [F.col("routing_key")]
    return stats.orderBy(*order)


def routing_key_autocomplete(stats: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    return (stats.where(F.col("routing_key").startswith(prefix.upper()))
            .orderBy(F.col("property_count").desc(), "routing_key").limit(limit))


def rank_matches(rows: DataFrame, address: str = "address", asked: str = "query") -> DataFrame:
    """Display order of result rows: two same-street rows, exact, other same-street,
    rest; `rows` are search results (query_id, position), bounded by their limit."""
    rows = rows.withColumn("match_class", text.match_class(address, asked))
    nth = F.row_number().over(Window.partitionBy("query_id", "match_class").orderBy("position"))
    slot = (F.when((F.col("match_class") == "street") & (nth <= 2), 0).when(F.col("match_class") == "exact", 1)
            .when(F.col("match_class") == "street", 2).otherwise(3))
    rows = rows.withColumn("slot", slot)
    return rows.withColumn("display_position", F.row_number().over(
        Window.partitionBy("query_id").orderBy("slot", "position")))


def merge_pins(exact: DataFrame, pins: DataFrame) -> DataFrame:
    """Located exact hits first, then the pins not already present."""
    located = exact.where("latitude is not null and longitude is not null")
    cols = ["query_id", "id", "latitude", "longitude"]
    extra = pins.join(located.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return (located.select(*cols, F.lit("exact").alias("pin"))
            .unionByName(extra.select(*cols, F.lit("near").alias("pin"))))


# ------------------------------------------------------------ work lists


def geocoding_queue(df: DataFrame, n: int = 1) -> DataFrame:
    """Next rows to geocode by hand: above 500k first, then newest."""
    high = F.col("price") > 500_000
    return df.where("latitude is null").orderBy(high.desc(), *newest_first()).limit(n)


def price_tier() -> Column:
    return F.when(F.col("price") > 500_000, 1).when(F.col("price") > 300_000, 2).otherwise(3)


def needs_geocoding_worklist(df: DataFrame, n: int | None = None, postcode_first: bool = False) -> DataFrame:
    rows = df.where("needs_geocoding").withColumn("priority_tier", price_tier())
    has = (F.coalesce("eircode", F.lit("")) != "").desc()
    order = ([has, F.col("price").desc(), *newest_first()] if postcode_first
             else ["priority_tier", F.col("sale_date").desc(), F.col("price").desc(), "id"])
    rows = rows.orderBy(*order)
    return rows.limit(n) if n else rows


def regeocode_worklist(df: DataFrame) -> DataFrame:
    """Quality-flagged rows with their distance from the routing key's mean."""
    mean = (df.where("latitude is not null and routing_key is not null").groupBy("routing_key")
            .agg(geo.exact_mean("latitude").alias("_la"), geo.exact_mean("longitude").alias("_lo")))
    km = geo.haversine_m("latitude", "longitude", "_la", "_lo") / 1000.0
    return (df.where("geocode_quality_issue").join(mean, "routing_key", "left")
            .withColumn("distance_from_centroid_km", km)
            .withColumn("value_tier", F.when(F.col("price") > 500_000, 1).otherwise(2))
            .orderBy("value_tier", F.col("sale_date").desc(), F.col("routing_key").isNull(), "id")
            .drop("_la", "_lo"))


# County tiers of the postcode work list.
CITY_COUNTIES = ["Dublin", "Cork", "Galway", "Limerick", "Waterford"]
NEAR_COUNTIES = ["Louth", "Kildare", "Meath", "Wicklow"]


def postcode_enrichment_queue(df: DataFrame, n: int | None = None) -> DataFrame:
    numbered = F.col("address").rlike("^[0-9]+")
    tier = (F.when(F.col("county").isin(CITY_COUNTIES), 1).when(F.col("county").isin(NEAR_COUNTIES), 2).otherwise(3))
    rows = (df.where(F.col("eircode").isNull() & F.col("latitude").isNotNull()
                     & (F.col("county").isin(CITY_COUNTIES + NEAR_COUNTIES) | numbered))
            .withColumn("county_tier", tier).withColumn("number_tier", F.when(numbered, 1).otherwise(2))
            .orderBy("county_tier", "number_tier", *newest_first()))
    return rows.limit(n) if n else rows


def enrichment_queue(df: DataFrame, year: int, n: int | None = None, guess: str = "house_guess") -> DataFrame:
    """Rows of a year to enrich: never tried, address guesses, tried but empty."""
    none = F.col("bedrooms").isNull() & F.col("property_type").isNull()
    guessed = F.coalesce(F.col("property_type_source") == guess, F.lit(False))
    tier = (F.when(none & F.col("property_type_source").isNull(), 0).when(guessed, 1).otherwise(2))
    rows = (sale_filters(df, min_year=year, max_year=year).where(none | guessed)
            .withColumn("tier", tier).orderBy("tier", *newest_first()))
    return rows.limit(n) if n else rows


def recent_enrichment_queue(df: DataFrame, as_of: str, months: int) -> DataFrame:
    """Partly or not enriched rows of the last months, newest then dearest."""
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    return (df.where((F.col("sale_date") >= since) & F.col("address").isNotNull() & F.col("county").isNotNull()
                     & (F.col("bedrooms").isNull() | F.col("property_type").isNull()))
            .orderBy(F.col("sale_date").desc(), F.col("price").desc(), "id"))


def sliced_enrichment_queue(df: DataFrame, slices: list[dict]) -> DataFrame:
    """Union of priority slices, each a date range with its own cap."""
    open_rows = df.where("bedrooms is null or property_type is null")
    parts = []
    for i, s in enumerate(slices, 1):
        rows = open_rows.where((F.col("sale_date") >= F.lit(s["start"]).cast("date"))
                               & (F.col("sale_date") < F.lit(s["end"]).cast("date")))
        if "min_price" in s:
            rows = rows.where(F.col("price") >= s["min_price"])
        parts.append(rows.orderBy(F.col("price").desc(), *newest_first()).limit(s["cap"])
                     .withColumn("slice", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def apply_corrections(df: DataFrame, fixes: DataFrame, eps: float = 0.001) -> DataFrame:
    """Replace a known wrong coordinate of addresses that contain a word.

    `fixes` is (fix_id, word, wrong_lat, wrong_lon, right_lat, right_lon); the lowest
    fix_id wins where several apply. Distinct addresses on their place meet the first fix of each word and wrong coordinate."""
    at = ["address", "latitude", "longitude"]
    rows = df.where("latitude is not null").select("id", *at)
    first = (fixes.groupBy(F.lower("word").alias("_word"), "wrong_lat", "wrong_lon")
             .agg(F.min(F.struct("fix_id", "right_lat", "right_lon")).alias("_f")))
    found = (near_equal_join(rows.select(*at).distinct(), first, ["latitude", "longitude"], ["wrong_lat", "wrong_lon"], eps)
             .where(F.contains(F.lower("address"), F.col("_word"))).groupBy(*at).agg(F.min("_f").alias("_f")))
    hits = rows.join(found, at).groupBy("id").agg(F.min("_f").alias("_f"))
    return (df.join(hits, "id", "left")
            .withColumn("corrected", F.col("_f").isNotNull())
            .withColumn("latitude", F.coalesce("_f.right_lat", "latitude"))
            .withColumn("longitude", F.coalesce("_f.right_lon", "longitude")).drop("_f"))


def sample_order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string")))


def sample_sales(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Repeatable random sample: the order depends on id and seed alone."""
    return df.orderBy(sample_order(seed), "id").limit(n)


def sample_per_group(df: DataFrame, by: list[str], n: int, seed: int = 0) -> DataFrame:
    return top_n(df, by, [sample_order(seed), F.col("id")], n, "_rn").drop("_rn")


def validation_sample(df: DataFrame, n: int, as_of: str, months_back: int = 6, lo: float = 100_000,
                      hi: float = 1_000_000, seed: int = 0) -> DataFrame:
    """Located market sales of the last months within price bounds, sampled."""
    since = F.date_sub(F.lit(as_of).cast("date"), months_back * 30)
    rows = market_sales(df, lo, hi).where((F.col("sale_date") >= since) & F.col("latitude").isNotNull()
                                          & F.col("longitude").isNotNull())
    return sample_sales(rows, n, seed)
