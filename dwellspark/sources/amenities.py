"""Point-of-interest files to one validated schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwellspark.functions import geo


def _clean(name: str):
    return F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))


def _optional(df: DataFrame, name: str):
    return _clean(name) if name in df.columns else F.lit(None).cast("string")


def _unify(df: DataFrame, kind: str, name: str, source: str) -> DataFrame:
    spill = [c for c in df.columns if c.startswith("Unnamed") or c.startswith("_c")]
    return df.select(
        F.lit(kind).alias("amenity_type"), _clean(name).alias("name"), _optional(df, "Category").alias("category"),
        _optional(df, "Level").alias("level"),
        F.nullif(F.concat_ws(", ", _optional(df, "Description"), *[_clean(c) for c in spill]), F.lit("")).alias("description"),
        F.col("Latitude").try_cast("double").alias("latitude"), F.col("Longitude").try_cast("double").alias("longitude"),
        F.lit(None).cast("string").alias("attributes"), F.lit(source).alias("source"))


def read_amenities(transport: DataFrame, schools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, skipped): descriptions spilled into unnamed columns are re-joined;
    rows need a name and a coordinate inside the country."""
    rows = _unify(transport, "transport", "Infrastructure Name", "transport").unionByName(
        _unify(schools, "school", "School Name", "schools"))
    ok = F.col("name").isNotNull() & F.coalesce(geo.in_bounds("latitude", "longitude"), F.lit(False))
    return rows.where(ok), rows.where(~ok)
