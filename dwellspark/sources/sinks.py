"""Exports: street documents, work lists, account projection; cached geocodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.functions import text


def write_street_documents(pages: DataFrame, path: str) -> None:
    """One JSON document per street, in a folder per slug."""
    (pages.withColumn("slug_key", F.col("slug")).repartition("slug_key")
     .write.mode("overwrite").partitionBy("slug_key").json(path))


def with_blanks(df: DataFrame, blanks: list[str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("string").alias(b) for b in blanks])


def write_worklist_csv(df: DataFrame, path: str, blanks: tuple[str, ...] = ("new_latitude", "new_longitude")) -> None:
    """Work list with empty columns for people to fill in."""
    with_blanks(df, list(blanks)).write.mode("overwrite").option("header", True).csv(path)


def accounts_export(df: DataFrame, batch_date: str) -> DataFrame:
    """Account-shaped projection with the field lengths of the target system."""
    address = F.trim("address")
    county = F.coalesce(F.nullif(F.trim("county"), F.lit("")), F.lit("Unknown"))
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    return df.where(F.coalesce(address, F.lit("")) != "").select(
        F.substring(address, 1, 80).alias("name"), F.substring(address, 1, 255).alias("street"),
        F.substring(county, 1, 40).alias("city"),
        F.substring(F.coalesce(F.trim("eircode"), F.lit("")), 1, 20).alias("postal_code"), F.lit("Ireland").alias("country"),
        F.lit(batch_date).alias("import_date"),
        F.concat(F.lit("Sale Date: "), F.date_format("sale_date", "dd/MM/yyyy"), F.lit(", Price: €"),
                 F.format_number(F.bround(price, 0), 0)).alias("description"))


def geocode_query(address, county, eircode) -> Column:
    """Outgoing query text: the routing key when there is a postcode, else the
    address with its county unless it already names it."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    code = text.normalize_postcode(F.coalesce(c(eircode), F.lit("")))
    addr = text.squeeze(text.strip(c(address)))
    cty = F.trim(F.coalesce(c(county), F.lit("")))
    named = (cty == "") | F.contains(F.lower(addr), F.lower(cty))
    return (F.when(code != "", F.concat(F.substring(code, 1, 3), F.lit(", Ireland")))
            .when(named, addr).otherwise(F.concat_ws(", ", addr, cty)))


def apply_geocode_cache(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates from a query -> coordinate table (query, cached_lat, cached_lon):
    full postcode first, then the built query, then the bare address. Of rows that repeat a query the one with the smallest pair counts."""
    known = (cache.where("cached_lat is not null and query is not null")
             .groupBy("query").agg(F.min(F.struct("cached_lat", "cached_lon")).alias("_hit")))
    code = text.normalize_postcode(F.coalesce("eircode", F.lit("")))
    keys = [F.when(F.length(code) >= 7, F.concat(code, F.lit(", Ireland"))),
            geocode_query("address", "county", "eircode"), text.squeeze(text.strip("address"))]
    out = df
    for i, key in enumerate(keys):
        out = (out.withColumn(f"_q{i}", key)
               .join(known.withColumnsRenamed({"query": f"_k{i}", "_hit": f"_h{i}"}), F.col(f"_q{i}") == F.col(f"_k{i}"), "left"))
    hit = F.coalesce("_h0", "_h1", "_h2")
    return out.select(*[c for c in df.columns if c not in ("latitude", "longitude")],
                      F.round(hit["cached_lat"], 6).alias("latitude"), F.round(hit["cached_lon"], 6).alias("longitude"))
