"""Coordinate and attribute repair, imputation and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.functions import geo, text
from dwellspark.operators.joins import contains_join, fill_from
from dwellspark.operators.stats import inconsistent_addresses


def apply_candidates(df: DataFrame, judged: DataFrame) -> DataFrame:
    """Take the best accepted candidate per sale and clear its flags."""
    best = (judged.where("accepted").groupBy("id")
            .agg(F.max_by(F.struct("cand_lat", "cand_lon"), F.struct("quality", "source")).alias("_c")))
    hit = F.col("_c").isNotNull()
    return (df.join(best, "id", "left")
            .withColumn("latitude", F.coalesce("_c.cand_lat", "latitude"))
            .withColumn("longitude", F.coalesce("_c.cand_lon", "longitude"))
            .withColumn("needs_geocoding", F.when(hit, False).otherwise(F.col("needs_geocoding")))
            .withColumn("geocode_suspect", F.when(hit, False).otherwise(F.col("geocode_suspect"))).drop("_c"))


def apply_manual_updates(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Hand-made coordinates (id, new_lat, new_lon, new_address, new_eircode); the
    last two are optional and applied only when given."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return (df.join(updates, "id", "left")
            .withColumn("latitude", F.coalesce("new_lat", "latitude")).withColumn("longitude", F.coalesce("new_lon", "longitude"))
            .withColumn("address", F.coalesce(given("new_address"), F.col("address")))
            .withColumn("eircode", F.coalesce(F.upper(given("new_eircode")), F.col("eircode")))
            .drop("new_lat", "new_lon", "new_address", "new_eircode"))


def canonical_coordinates(df: DataFrame, key: str = "address_normalized") -> DataFrame:
    """Per address: among unflagged rows (else all) the most frequent pair, then the
    newest, then the smallest."""
    flagged = F.coalesce("geocode_quality_issue", F.lit(False))
    pairs = (df.where("latitude is not null and longitude is not null")
             .groupBy(key, flagged.alias("_f"), "latitude", "longitude")
             .agg(F.count("*").alias("_n"), F.max("sale_date").alias("_d")))
    order = F.struct(~F.col("_f"), "_n", "_d", -F.col("latitude"), -F.col("longitude"))
    return (pairs.groupBy(key).agg(F.max_by(F.struct("latitude", "longitude"), order).alias("_p"))
            .select(key, F.col("_p.latitude").alias("canon_lat"), F.col("_p.longitude").alias("canon_lon")))


def canonical_attributes(df: DataFrame, key: str = "address_normalized",
                         cols: tuple[str, ...] = ("bedrooms", "property_type")) -> DataFrame:
    """Per address and field: most frequent non-null value, then newest, then dearest.

    All fields go through one pass: values are counted per (address, field, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(key, "sale_date", "price", F.explode(pairs).alias("_f")).where("_f.value is not null")
              .groupBy(key, "_f.field", "_f.value")
              .agg(F.count("*").alias("_n"), F.max("sale_date").alias("_d"), F.max("price").alias("_p")))
    order = F.struct("_n", "_d", "_p", "value")
    types = dict(df.dtypes)
    return counts.groupBy(key).agg(*[
        F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, order)).cast(types[c]).alias(f"canon_{c}")
        for c in cols])


def repair_inconsistent(df: DataFrame, key: str = "address") -> tuple[DataFrame, DataFrame]:
    """Rows of inconsistent addresses take the canonical values; also the audit of
    every changed field."""
    bad = inconsistent_addresses(df).select(F.col("address").alias(key), F.lit(True).alias("_bad"))
    # one row per address is assembled first, so the sales are joined (and a hot
    # address is split by adaptive skew handling) only once
    facts = bad.join(canonical_coordinates(df, key), key, "left").join(canonical_attributes(df, key), key, "left")
    rows = df.join(facts, key, "left")
    targets = {"latitude": "canon_lat", "longitude": "canon_lon", "bedrooms": "canon_bedrooms", "property_type": "canon_property_type"}
    fixed = rows
    for col, canon in targets.items():
        fixed = (fixed.withColumn(f"_old_{col}", F.col(col))
                 .withColumn(col, F.when(F.col("_bad"), F.coalesce(canon, col)).otherwise(F.col(col))))
    changes = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")),
               F.struct(F.lit(c).alias("field"), F.col(f"_old_{c}").cast("string").alias("old_value"),
                        F.col(c).cast("string").alias("new_value"))) for c in targets]))
    audit = fixed.select("id", key, F.explode(changes).alias("_x")).select("id", key, "_x.*")
    return fixed.select(*df.columns), audit


def lookup_plan(df: DataFrame, key: str = "address_normalized") -> DataFrame:
    """Per address: does it still need a coordinate, does it need enrichment?"""
    every = df.select(key).distinct()
    return (every.join(canonical_coordinates(df, key), key, "left").join(canonical_attributes(df, key), key, "left")
            .select(key, F.col("canon_lat").isNull().alias("needs_geocoding"),
                    (F.col("canon_lat").isNull() | F.col("canon_bedrooms").isNull()
                     | F.col("canon_property_type").isNull()).alias("needs_enrichment")))


def _top_point(df: DataFrame, by: list[str], min_rows: int = 1) -> DataFrame:
    counts = df.groupBy(*by, "latitude", "longitude").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= min_rows)
    order = F.struct("_n", -F.col("latitude"), -F.col("longitude"))
    return (counts.groupBy(*by).agg(F.max_by(F.struct("latitude", "longitude"), order).alias("_p"), F.max("_n").alias("_n"))
            .select(*by, F.col("_p.latitude").alias("imputed_lat"), F.col("_p.longitude").alias("imputed_lon"),
                    F.col("_n").alias("support")))


def _missing(df: DataFrame) -> DataFrame:
    return df.where("latitude is null and address is not null and county is not null")


def impute_exact(df: DataFrame) -> DataFrame:
    """Coordinate for rows without one, from the same county and match key."""
    key = text.match_key("address")
    known = (df.where("latitude is not null and county is not null").withColumn("_key", key)
             .groupBy("county", "_key", "latitude", "longitude").agg(F.count("*").alias("_n")))
    best = _top_point(known, ["county", "_key"])
    return (_missing(df).withColumn("_key", key).join(best, ["county", "_key"])
            .select("id", "imputed_lat", "imputed_lon", "support", F.lit(100).alias("quality")))


def _street_term() -> Column:
    return text.match_key(text.street_key("address", "county")["street"])


def impute_same_street(df: DataFrame, min_rows: int = 3) -> DataFrame:
    """Coordinate from a point in the county that at least three sales of addresses
    containing the street share; streets meet addresses of their county through rare grams."""
    missing = _missing(df).select("id", F.col("county").alias("_county"), _street_term().alias("street")).where("street is not null")
    known = (df.where("latitude is not null and county is not null")
             .groupBy("county", text.match_key("address").alias("_addr"), "latitude", "longitude")
             .agg(F.count("*").alias("_n")))
    dictionary = known.select("county", "_addr").distinct()
    terms = missing.select("_county", "street").distinct()
    pairs = (contains_join(terms, "street", dictionary, "_addr", ["county"], "county", "_county").where("county = _county")
             .select("county", "street", "_addr").distinct())
    best = _top_point(pairs.join(known, ["county", "_addr"]), ["county", "street"], min_rows)
    return (missing.withColumnRenamed("_county", "county").join(best, ["county", "street"])
            .select("id", "imputed_lat", "imputed_lon", "support", F.lit(80).alias("quality")))


def impute_street_mean(df: DataFrame) -> DataFrame:
    """Mean coordinate of the county's located sales with the same street pattern."""
    pattern = F.lower(text.street_pattern("address"))
    known = (df.where("latitude is not null and county is not null").withColumn("_p", pattern).where("_p is not null")
             .groupBy("county", "_p").agg(geo.exact_mean("latitude").alias("imputed_lat"), geo.exact_mean("longitude").alias("imputed_lon"),
                                          F.count("*").alias("support")).where("support >= 2"))
    return (_missing(df).where(F.length("address") > 20).withColumn("_p", pattern).join(known, ["county", "_p"])
            .select("id", "imputed_lat", "imputed_lon", "support",
                    F.when(F.col("support") >= 5, "high").otherwise("medium").alias("confidence")))


def propagate_postcodes(df: DataFrame, key: str = "address_normalized") -> DataFrame:
    """Fill a missing postcode where the address's postcodes agree on exactly one."""
    agreed = (df.where(F.coalesce(key, F.lit("")) != "").groupBy(key)
              .agg(F.min("eircode").alias("eircode"), F.max("eircode").alias("_hi"))
              .where("eircode is not null and eircode = _hi").drop("_hi"))
    return fill_from(df, agreed, [key], ["eircode"])


def apply_enrichment(df: DataFrame, results: DataFrame, fill_only: bool = False) -> DataFrame:
    """Spread listing results (result_id, address, eircode, bedrooms, property_type)
    to the sales of the address, unless both postcodes are known and differ.

    The newest result wins per field. Rows typed from their own address keep their
    type; sales of addresses that were looked up in vain are marked as tried."""
    code = lambda c: F.nullif(text.normalize_postcode(c), F.lit(""))
    found = results.withColumn("_rc", code("eircode"))
    newest = lambda col, cond=F.lit(True): F.max(F.when(cond & F.col(col).isNotNull(), F.struct("result_id", col)))
    free = F.col("_rc").isNull()
    by_address = found.groupBy("address").agg(
        newest("bedrooms").alias("_b_all"), newest("property_type").alias("_t_all"),
        newest("bedrooms", free).alias("_b_free"), newest("property_type", free).alias("_t_free"))
    by_code = (found.where(~free).groupBy("address", "_rc")
               .agg(newest("bedrooms").alias("_b_code"), newest("property_type").alias("_t_code")))
    rows = (df.withColumn("_rc", code("eircode")).join(by_address.withColumn("_tried", F.lit(True)), "address", "left")
            .join(by_code, ["address", "_rc"], "left"))
    pick = lambda f, col: F.when(F.col("_rc").isNull(), F.col(f"_{f}_all")[col]).otherwise(
        F.greatest(f"_{f}_free", f"_{f}_code")[col])
    bedrooms, kind = pick("b", "bedrooms"), pick("t", "property_type")
    own = F.coalesce(F.col("property_type_source") == "address_apartment", F.lit(False))
    take = kind.isNotNull() & ~own & (F.col("property_type").isNull() if fill_only else F.lit(True))
    empty = (F.col("_tried") & F.col("_b_all").isNull() & F.col("_t_all").isNull() & F.col("bedrooms").isNull()
             & F.col("property_type").isNull() & F.col("property_type_source").isNull())
    return rows.select(
        *[c for c in df.columns if c not in ("bedrooms", "property_type", "property_type_source")],
        (F.coalesce("bedrooms", bedrooms) if fill_only else F.coalesce(bedrooms, "bedrooms")).alias("bedrooms"),
        F.when(take, kind).otherwise(F.col("property_type")).alias("property_type"),
        F.when(take | F.coalesce(empty, F.lit(False)), "web_enrichment").otherwise(F.col("property_type_source"))
        .alias("property_type_source"))


# Words that do not tell one address from another.
LISTING_STOP = ["the", "and", "of", "co", "county", "ireland", "road", "street", "avenue", "drive", "close", "court",
                "park", "lane", "apt", "apartment", "flat", "unit", "block", "property", "properties", "town", "saint"]


def match_listing_blocks(address, county, eircode, blocks, page) -> Column:
    """Text of the result blocks about the property: those holding its postcode,
    else those with nearly the most distinctive address words, else the whole page.
    Row-local over the page's own ARRAY<STRING> of blocks."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    words = lambda x: F.regexp_extract_all(F.lower(c(x)), F.lit("([a-z]{3,})"), F.lit(1))
    stop = F.concat(F.array(*[F.lit(w) for w in LISTING_STOP]), F.coalesce(words(county), F.array().cast("array<string>")))
    code = F.nullif(F.replace(F.upper(c(eircode)), F.lit(" "), F.lit("")), F.lit(""))
    compact = lambda b: F.replace(F.upper(b), F.lit(" "), F.lit(""))
    coded = F.filter(c(blocks), lambda b: F.coalesce(F.contains(compact(b), code), F.lit(False)))

    def by_words(tokens):
        hits = lambda b: F.size(F.filter(tokens, lambda t: F.contains(F.lower(b), t)))

        def keep(best):
            floor = F.when(best >= 2, F.greatest(F.lit(2), best - 1)).when(best == 1, 1)
            return F.filter(c(blocks), lambda b: hits(b) >= floor)
        return text.bind(F.array_max(F.transform(c(blocks), hits)), keep)

    tokens = F.array_except(F.array_distinct(words(address)), stop)
    chosen = F.when(F.size(coded) > 0, coded).when(F.size(tokens) > 0, text.bind(tokens, by_words))
    return F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(c(page))


def page_text(html) -> Column:
    """Visible text of a page by tag removal (built-ins only)."""
    s = F.col(html) if isinstance(html, str) else html
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        s = F.regexp_replace(s, pattern, " ")
    return text.squeeze(s)


def extract_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Bedrooms (1..10) and dwelling type read off each page's visible text."""
    seen = pages.withColumn("_text", page_text(html))
    return (seen.withColumn("bedrooms", text.extract_bedrooms("_text"))
            .withColumn("property_type", text.keyword_property_type("_text")).drop("_text", html))
