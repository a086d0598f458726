"""Batch location resolution from the register's own data.

Each step of the cascade is one left join of the request table to a bounded or
keyed summary; substring steps meet a dictionary of distinct addresses that
carries partial sums, so no step touches raw sales per request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.functions import geo, text
from dwellspark.lineage import cut_lineage
from dwellspark.operators.joins import GramIndex, contains_all_join, contains_join, for_each_request, gram_index, prefix_join, shared_requests

# Sums are shifted to keep the variance well conditioned in double arithmetic.
_LAT0, _LON0 = 53.0, -7.0
SUMS = ["_n", "_lat", "_lon", "_y", "_yy", "_x", "_xx"]


def address_dictionary(df: DataFrame, address: str = "address") -> DataFrame:
    """Distinct lower-case (address, county) with coordinate sums of located sales."""
    y, x = F.col("latitude") - F.lit(_LAT0), F.col("longitude") - F.lit(_LON0)
    return (df.where("latitude is not null").groupBy(F.lower(address).alias("_a"), F.lower("county").alias("_c"))
            .agg(F.count("*").alias("_n"), geo.exact_sum("latitude").alias("_lat"), geo.exact_sum("longitude").alias("_lon"),
                 F.sum(y).alias("_y"), F.sum(y * y).alias("_yy"), F.sum(x).alias("_x"), F.sum(x * x).alias("_xx")))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def _mean(total: str) -> Column:
    return F.col(total).cast("double") / F.col("_n")


def _std(total: str, squares: str) -> Column:
    """Sample standard deviation; 0 where it is undefined."""
    var = (F.col(squares) - F.col(total) * F.col(total) / F.col("_n")) / (F.col("_n") - 1)
    return F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(F.lit(0.0))


def _located(source: str) -> list[Column]:
    return ["query_id", _mean("_lat").alias("lat"), _mean("_lon").alias("lon"), F.lit(source).alias("source")]


def _token_requests(requests: DataFrame) -> DataFrame:
    return (requests.withColumn("_tokens", text.address_tokens("query")).where(F.size("_tokens") > 0)
            .select("query_id", F.lower("county").alias("_asked"), F.size("_tokens").alias("_k"),
                    F.transform("_tokens", text.token_variants).alias("variants")))


def _fuzzy_terms(requests: DataFrame) -> DataFrame:
    """The request as a term and, for a plural, its singular as the second try."""
    low = F.lower("query")
    tries = F.array_compact(F.array(
        F.struct(F.lit(1).alias("no"), F.lower(F.trim("query")).alias("term")),
        F.when(low.endswith("s") & ~low.endswith("ss"),
               F.struct(F.lit(2).alias("no"), F.trim(F.lower(F.expr("left(query, length(query) - 1)"))).alias("term")))))
    return requests.select("query_id", F.explode(tries).alias("t")).select("query_id", "t.no", "t.term").where(F.length("term") > 0)


def book_index(book: DataFrame, tokens: DataFrame | None = None, fuzzy: DataFrame | None = None) -> GramIndex:
    """One stored gram index of the address dictionary, by county, for all terms of a query."""
    parts = []
    if tokens is not None:
        parts.append(tokens.select(F.explode(F.flatten("variants")).alias("term")))
    if fuzzy is not None:
        parts.append(fuzzy.select("term"))
    return gram_index(reduce(DataFrame.union, parts), "term", book, "_a", ["_c"], scope="_c")


def resolve_by_tokens(requests: DataFrame, df: DataFrame, book: DataFrame | None = None, index: GramIndex | None = None) -> DataFrame:
    """Mean point of the addresses holding every token (in any variant) of the
    request (query_id, query, county), if they form a tight cluster.

    `book` is a prepared `address_dictionary`, `index` its gram index for these tokens."""
    asked = _token_requests(requests)
    book = book if book is not None else cut_lineage(address_dictionary(df))
    index = index or book_index(book, tokens=asked)
    pairs = contains_all_join(asked, book, "_a", ["_c"], "_c", "_asked", index)
    found = pairs.join(book, ["_a", "_c"]).groupBy("query_id", "_k").agg(*_sums())
    limit = F.when(F.col("_k") >= 2, 0.02).otherwise(0.01)
    return found.where((_std("_y", "_yy") < limit) & (_std("_x", "_xx") < limit)).select(*_located("db_tokens"))


def resolve_fuzzy(requests: DataFrame, df: DataFrame, min_rows: int = 3,
                  book: DataFrame | None = None, index: GramIndex | None = None) -> DataFrame:
    """Mean point of sales whose address or county contains the request; a plural
    request without any hit counts in the singular. Both tries are looked up at once; a county
    that a term is part of counts whole, from its sums."""
    terms = _fuzzy_terms(requests)
    book = book if book is not None else cut_lineage(address_dictionary(df))
    index = index or book_index(book, fuzzy=terms)
    counties = book.groupBy("_c").agg(*_sums())
    by_address = contains_join(terms, "term", book, "_a", ["_c"], "_c", index=index).select("query_id", "no", "_a", "_c")
    by_county = contains_join(terms, "term", counties.select("_c"), "_c", []).select("query_id", "no", "_c")
    rest = by_address.join(by_county, ["query_id", "no", "_c"], "left_anti").join(book, ["_a", "_c"])
    cols = ["query_id", "no", *SUMS]
    tries = by_county.join(counties, "_c").select(*cols).unionByName(rest.select(*cols)).groupBy("query_id", "no").agg(*_sums())
    first = tries.groupBy("query_id").agg(F.min_by(F.struct(*SUMS), "no").alias("s")).select("query_id", "s.*")
    return first.where(F.col("_n") >= min_rows).select(*_located("db_fuzzy"))


def area_hint(requests: DataFrame, df: DataFrame, min_rows: int = 5, spread: float = 0.05) -> DataFrame:
    """Mean point of the trailing part (else the last two parts) of the request when
    enough sales contain it in a tight cluster."""
    parts = F.filter(F.transform(F.split("query", ","), lambda p: F.trim(p)), lambda p: p != "")
    last, pair = F.element_at("_p", -1), F.concat_ws(", ", F.try_element_at("_p", F.lit(-2)), F.element_at("_p", -1))
    tries = F.array_compact(F.array(
        F.struct(F.lit(1).alias("no"), F.lower(last).alias("term")),
        F.when(F.size("_p") >= 3, F.struct(F.lit(2).alias("no"), F.lower(pair).alias("term")))))
    asked = (requests.withColumn("_p", parts).where(F.size("_p") >= 2)
             .select("query_id", F.explode(tries).alias("t")).select("query_id", "t.no", "t.term").where(F.length("term") >= 4))
    book = cut_lineage(address_dictionary(df))
    terms = asked.select("term").distinct()
    sums = (contains_join(terms, "term", book, "_a", ["_c"], "_c", index=book_index(book, fuzzy=terms)).join(book, ["_a", "_c"])
            .groupBy("term").agg(*_sums()).where(F.col("_n") >= min_rows)
            .where((_std("_y", "_yy") < spread) & (_std("_x", "_xx") < spread)))
    return (asked.join(sums, "term").select("query_id", F.struct(
        "no", _mean("_lat").alias("lat"), _mean("_lon").alias("lon"), "term").alias("h"))
        .groupBy("query_id").agg(F.min("h").alias("h")).select("query_id", "h.lat", "h.lon", F.col("h.term").alias("hint")))


def postcode_means(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per prefix of 2 to 4 characters, per full postcode): count and mean point."""
    code = F.replace(F.upper("eircode"), F.lit(" "), F.lit(""))
    rows = df.where("latitude is not null and eircode is not null").select(code.alias("_code"), "latitude", "longitude")
    full = rows.groupBy("_code").agg(F.count("*").alias("_n"), geo.exact_sum("latitude").alias("_y"), geo.exact_sum("longitude").alias("_x"))
    prefixes = F.array_distinct(F.array(*[F.substring("_code", 1, n) for n in (2, 3, 4)]))
    short = (full.withColumn("_prefix", F.explode(prefixes)).groupBy("_prefix")
             .agg(F.sum("_n").alias("_n"), F.sum("_y").alias("_y"), F.sum("_x").alias("_x")))
    point = lambda d, key: d.select(key, "_n", _mean("_y").alias("_lat"), _mean("_x").alias("_lon"))
    return point(short, "_prefix"), point(full, "_code")


RAW_POINT = r"^(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)$"


def resolve_locations(requests: DataFrame, df: DataFrame, reference: DataFrame) -> DataFrame:
    """Cascade for (query_id, query, county): raw coordinates, routing-key mean,
    validated postcode mean (else flagged), postcode reference, key mean, token
    match, fuzzy match. Adds lat, lon, source and `flag_postcode`."""
    query = F.trim("query")
    norm = text.normalize_postcode("query")
    short, full = postcode_means(df)
    rows = (requests.withColumn("_raw", query.rlike(RAW_POINT)).withColumn("_key", query.rlike(text.ROUTING_SHAPE))
            .withColumn("_full", query.rlike(text.FULL_POSTCODE))
            .withColumn("_want", F.when(F.col("_key"), F.upper(query)).when(F.col("_full"), F.substring(norm, 1, 3)))
            .withColumn("_code", F.when(F.col("_full"), norm)))
    key = short.select(F.col("_prefix").alias("_want"), F.col("_n").alias("_kn"), F.col("_lat").alias("_klat"), F.col("_lon").alias("_klon"))
    one = full.select("_code", F.col("_n").alias("_en"), F.col("_lat").alias("_elat"), F.col("_lon").alias("_elon"))
    ref = reference.select(F.col("postcode").alias("_code"), F.col("latitude").alias("_rlat"), F.col("longitude").alias("_rlon"))
    rows = rows.join(key, "_want", "left").join(one, "_code", "left").join(ref, "_code", "left")
    near = geo.degree_gap_ok("_elat", "_elon", "_klat", "_klon")
    checked = F.coalesce(F.col("_kn") >= 5, F.lit(False))
    exact_ok = F.col("_en").isNotNull() & (~checked | F.coalesce(near, F.lit(False)))
    point = lambda la, lo, source: F.struct(la.alias("lat"), lo.alias("lon"), F.lit(source).alias("source"))
    c = F.col
    raw = lambda i: F.regexp_extract(query, RAW_POINT, i).try_cast("double")
    own = (F.when(c("_raw"), point(raw(1), raw(2), "raw"))
           .when(c("_key") & c("_kn").isNotNull(), point(c("_klat"), c("_klon"), "db_routing_key"))
           .when(c("_full") & exact_ok, point(c("_elat"), c("_elon"), "db_exact"))
           .when(c("_full") & c("_rlat").isNotNull(), point(c("_rlat"), c("_rlon"), "db_eircode_ref"))
           .when(c("_full") & c("_kn").isNotNull(), point(c("_klat"), c("_klon"), "db_routing_key")))
    rows = (rows.withColumn("_own", own)
            .withColumn("flag_postcode", F.when(c("_full") & c("_en").isNotNull() & checked & ~near, norm)))
    rows = cut_lineage(rows.select(*requests.columns, "_own", "flag_postcode"))
    # what no postcode or point settles is looked up in the addresses, equal requests once
    open_rows, members = shared_requests(rows.where("_own is null and query_id is not null"), ["query", "county"])
    open_rows = cut_lineage(open_rows)
    book = cut_lineage(address_dictionary(df))
    index = book_index(book, _token_requests(open_rows), _fuzzy_terms(open_rows))
    ranked = lambda d, rank: d.select("query_id", F.struct(F.lit(rank).alias("rank"), "lat", "lon", "source").alias("_hit"))
    own = rows.where("_own is not null").select("query_id", "_own.*")
    looked_up = ranked(resolve_by_tokens(open_rows, df, book, index), 1).unionByName(ranked(resolve_fuzzy(open_rows, df, book=book, index=index), 2))
    hits = ranked(own, 0).unionByName(for_each_request(looked_up, members))
    best = hits.groupBy("query_id").agg(F.min_by("_hit", "_hit.rank").alias("_hit"))
    return rows.join(best, "query_id", "left").select(
        *requests.columns, F.col("_hit.lat").alias("lat"), F.col("_hit.lon").alias("lon"), F.col("_hit.source").alias("source"), "flag_postcode")


def flag_bad_postcodes(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Set the quality flag on sales whose postcode failed the centroid check."""
    bad = resolved.where("flag_postcode is not null").select(F.col("flag_postcode").alias("_code")).distinct()
    code = F.replace(F.upper("eircode"), F.lit(" "), F.lit(""))
    return (df.withColumn("_code", code).join(bad.withColumn("_bad", F.lit(True)), "_code", "left")
            .withColumn("geocode_quality_issue", F.coalesce("geocode_quality_issue", F.lit(False)) | F.coalesce("_bad", F.lit(False)))
            .drop("_code", "_bad"))


def postcode_confidence(codes: DataFrame, reference: DataFrame, summary: DataFrame) -> DataFrame:
    """Coordinate of each code with a confidence from the spread; short codes fall to
    their prefix."""
    norm = F.replace(F.upper("code"), F.lit(" "), F.lit(""))
    ref = reference.select(F.col("postcode").alias("_k"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), "lat_stddev", "lon_stddev")
    pre = summary.select(F.col("routing_key").alias("_p"), F.col("latitude").alias("_pla"), F.col("longitude").alias("_plo"))
    tight = lambda t: F.coalesce((F.col("lat_stddev") < t) & (F.col("lon_stddev") < t), F.lit(False))
    hit = F.col("_k").isNotNull()
    return (codes.withColumn("_norm", norm).join(ref, F.col("_norm") == F.col("_k"), "left")
            .join(pre, (F.length("_norm") <= 4) & (F.substring("_norm", 1, 3) == F.col("_p")), "left")
            .select("code", F.coalesce("_la", "_pla").alias("lat"), F.coalesce("_lo", "_plo").alias("lon"),
                    F.when(hit, "postcode").when(F.col("_p").isNotNull(), "routing_key").alias("source"),
                    F.when(hit & tight(0.001), "high").when(hit & tight(0.01), "medium").when(hit, "low")
                    .when(F.col("_p").isNotNull(), "medium").alias("confidence"))
            .where("source is not null"))


# Words skipped when matching a valuation address by its words.
SKIP_WORDS = ["the", "and", "dublin", "ireland", "co", "county"]
SUBJECT_KEY_KM = 30.0


def resolve_subjects(requests: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """Valuation cascade for (request_id, address, eircode, county, bedrooms):
    county-scoped prefix match, then all of the first six words, then the routing
    key; a match over 30 km from the key's centroid yields to the centroid."""
    asked = requests.withColumn("_norm", text.normalize_address("address")) \
        .withColumn("_county", F.lower(F.coalesce("county", F.lit("Dublin")))).withColumn("query_id", F.col("request_id"))
    spelled = F.coalesce("address_normalized", "address")
    book = (df.where("latitude is not null and longitude is not null")
            .groupBy(spelled.alias("_a"), F.lower("county").alias("_c"))
            .agg(F.min(F.struct("id", "latitude", "longitude", "bedrooms")).alias("_first")))
    book = cut_lineage(book)
    prefix = (prefix_join(asked.select("query_id", "_norm", "_county"), "_norm", book, "_a").where("_c = _county")
              .groupBy("query_id").agg(F.min("_first").alias("_hit")))
    asked = cut_lineage(asked.join(prefix, "query_id", "left"))
    words = F.regexp_extract_all("_norm", F.lit(r"(\w+)"), F.lit(1))
    tokens = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(SKIP_WORDS))
    rest = (asked.where("_hit is null").withColumn("_t", tokens).where(F.size("_t") >= 3)
            .select("query_id", "_county", F.transform(F.slice("_t", 1, 6), lambda w: F.array(F.lower(w))).alias("variants")))
    low = book.select(F.lower("_a").alias("_l"), "_c", F.struct(F.length("_a").alias("_len"), "_first").alias("_r")) \
        .groupBy("_l", "_c").agg(F.min("_r").alias("_r"))
    index = gram_index(rest.select(F.explode(F.flatten("variants")).alias("term")), "term", low.select("_l", "_c"), "_l", ["_c"], "_c")
    flexible = (contains_all_join(rest, low, "_l", ["_c"], "_c", "_county", index)
                .join(low, ["_l", "_c"]).groupBy("query_id").agg(F.min("_r").alias("_r"))
                .select("query_id", F.col("_r._first").alias("_flex")))
    keys = (stats.where("property_count >= 5 and centroid_lat is not null")
            .select(F.col("routing_key").alias("_rk"), "centroid_lat", "centroid_lon",
                    F.least(F.lit(0.85), F.lit(0.70) + F.col("property_count") / F.lit(1000.0) * F.lit(0.15)).alias("_conf")))
    rows = (asked.join(flexible, "query_id", "left").withColumn("_hit", F.coalesce("_hit", "_flex"))
            .join(keys, F.upper(F.substring("eircode", 1, 3)) == F.col("_rk"), "left"))
    hit, key = F.col("_hit").isNotNull(), F.col("_rk").isNotNull()
    far = geo.haversine_m("_hit.latitude", "_hit.longitude", "centroid_lat", "centroid_lon") / 1000.0 > SUBJECT_KEY_KM
    use_hit = hit & ~F.coalesce(far, F.lit(False))
    return rows.select(
        "request_id", "address", "eircode", "county",
        F.when(use_hit, F.col("_hit.latitude")).otherwise(F.col("centroid_lat")).alias("lat"),
        F.when(use_hit, F.col("_hit.longitude")).otherwise(F.col("centroid_lon")).alias("lon"),
        F.when(use_hit, F.lit(0.80)).when(key, F.col("_conf")).alias("location_confidence"),
        F.when(use_hit, "database_exact").when(key, "eircode_routing_key").alias("method"),
        F.coalesce("bedrooms", F.when(use_hit, F.col("_hit.bedrooms"))).alias("bedrooms"))
