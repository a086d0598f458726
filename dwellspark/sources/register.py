"""Register CSV ingestion: all-string scan, header aliases, typing, rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwellspark.functions import text

# Accepted header spellings per canonical column. A header matches
# exactly or, failing that, by prefix (currency signs arrive damaged).
HEADER_ALIASES = {
    "date_raw": ["Date of Sale (dd/mm/yyyy)", "Date of Sale"],
    "address_raw": ["Address"],
    "county_raw": ["County"],
    "eircode_raw": ["Eircode", "Postal Code"],
    "price_raw": ["Price (€)", "Price (EUR)", "Price"],
    "nfmp_raw": ["Not Full Market Price"],
    "vat_raw": ["VAT Exclusive"],
    "description_raw": ["Description of Property"],
    "size_raw": ["Property Size Description"],
    "latitude_raw": ["Latitude"],
    "longitude_raw": ["Longitude"],
}


def _clean_header(name: str) -> str:
    return name.replace("﻿", "").replace("ï»¿", "").strip()


def resolve_headers(columns: list[str]) -> dict[str, list[str]]:
    """Canonical column -> the file's columns for it, in order of preference."""
    out = {}
    for target, aliases in HEADER_ALIASES.items():
        exact = [c for a in aliases for c in columns if _clean_header(c) == a]
        prefix = [c for a in aliases for c in columns
                  if _clean_header(c).startswith(a) and c not in exact]
        out[target] = list(dict.fromkeys(exact + prefix))
    return out


def canonical_headers(raw: DataFrame) -> DataFrame:
    """Project a raw all-string frame onto the canonical raw columns."""
    found = resolve_headers(raw.columns)
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    cols = []
    for target, names in found.items():
        col = F.coalesce(*[blank(n) for n in names]) if names else F.lit(None).cast("string")
        cols.append(col.alias(target))
    return raw.select(*cols)


def parse_date(c) -> Column:
    s = F.trim(c)
    fmt = lambda f: F.try_to_timestamp(s, F.lit(f)).cast("date")
    return F.coalesce(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), fmt("d/M/yyyy")),
                      F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), fmt("yyyy-M-d")))


def parse_price(c) -> Column:
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("decimal(12,2)")


def parse_bool(c) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("yes", "true", "1"), F.lit(False))


def typed_register_rows(raw: DataFrame) -> DataFrame:
    """Canonical raw columns to typed sale columns, row by row, nothing dropped."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(
        parse_date("date_raw").alias("sale_date"), F.coalesce(F.trim("address_raw"), F.lit("")).alias("address"),
        text.normalize_address(F.coalesce("address_raw", F.lit(""))).alias("address_normalized"),
        blank("eircode_raw").alias("eircode"), F.coalesce(F.trim("county_raw"), F.lit("")).alias("county"),
        parse_price("price_raw").alias("price"), parse_bool("nfmp_raw").alias("not_full_market_price"),
        parse_bool("vat_raw").alias("vat_exclusive"), F.coalesce(F.trim("description_raw"), F.lit("")).alias("description"),
        blank("size_raw").alias("size_description"),
        F.col("latitude_raw").try_cast("double").alias("latitude"),
        F.col("longitude_raw").try_cast("double").alias("longitude"))


def split_rejects(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with date and price, and the others with the reason."""
    reason = (F.when(F.col("sale_date").isNull(), "no date").when(F.col("price").isNull(), "no price"))
    return (typed.where("sale_date is not null and price is not null"),
            typed.withColumn("reject_reason", reason).where("reject_reason is not null"))


# The code page's printable characters in the range Latin-1 leaves empty.
CP1252_RANGE = ("\u0080\u0082\u0084\u0085\u0091\u0092\u0093\u0094\u0095\u0096\u0097", "€‚„…‘’“”•–—")


#: Columns that a register file has at most.
WIDTH = 24
CELLS = ", ".join(f"c{i} string" for i in range(WIDTH))


def _is_header(cells: Column) -> Column:
    """Whether a line names the date, address and price columns."""
    named = lambda target: F.exists(cells, lambda c: F.coalesce(reduce(
        lambda a, b: a | b, [F.startswith(_bare(c), F.lit(a)) for a in HEADER_ALIASES[target]]), F.lit(False)))
    return named("date_raw") & named("address_raw") & named("price_raw")


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\ufeff|\u00ef\u00bb\u00bf", ""))


def bind_headers(lines: DataFrame, file: str = "file") -> DataFrame:
    """Canonical raw columns of lines (cells array<string>, file) by the header line of each file.

    Files may order and spell their columns each in its own way. The header lines are one small row a file and meet its lines in
    a join, so a file may be split over tasks. A header given twice counts once; lines of a file without a
    header have no values and end as rejects."""
    head = F.col("cells")
    place = lambda test: F.transform(F.filter(F.transform(head, lambda c, i: F.struct(_bare(c).alias("n"), i.alias("i"))),
                                              lambda s: test(s["n"])), lambda s: s["i"])
    found = [F.array_distinct(F.concat(*[place(lambda n, a=a: n == a) for a in aliases], *[place(lambda n, a=a: F.startswith(n, F.lit(a))) for a in aliases]))
             .alias(target) for target, aliases in HEADER_ALIASES.items()]
    heads = lines.where(_is_header(head)).groupBy(F.col(file).alias("_file")).agg(F.min("cells").alias("cells")).select("_file", *found)
    rows = lines.where(~_is_header(head)).join(heads, F.col(file) == F.col("_file"), "left")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    value = lambda target: F.get(F.filter(F.transform(F.col(target), lambda i: blank(F.get(F.col("cells"), i))), lambda v: v.isNotNull()), F.lit(0))
    return rows.select(*[value(target).alias(target) for target in HEADER_ALIASES])


def csv_lines(reader, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Lines of CSV files (batch or stream reader) as cells and the file they are from.

    The CSV reader does not know the code page windows-1252: such files are read as Latin-1, which
    keeps every byte, and the differing characters are translated."""
    old = encoding.lower() in ("windows-1252", "cp1252")
    raw = (reader.schema(CELLS).option("header", False).option("encoding", "ISO-8859-1" if old else encoding).option("multiLine", multi_line)
           .option("quote", '"').option("escape", '"').csv(path))
    cells = [F.translate(c, *CP1252_RANGE) if old else F.col(c) for c in (f"c{i}" for i in range(WIDTH))]
    return raw.select(F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("file"))


def read_register_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of register files, columns by the header of each file; pass encoding 'windows-1252' for old ones. Files are
    split over tasks unless quoted fields may hold line breaks (`multi_line`), which takes a task a file."""
    return split_rejects(typed_register_rows(bind_headers(csv_lines(spark.read, path, encoding, multi_line))))
