"""SQL forms of the scalar functions: expression bodies, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from dwellspark.functions import text

SQL_FUNCTIONS = {
    "normalize_postcode": "(code STRING) RETURNS STRING RETURN replace(upper(trim(code)), ' ', '')",
    "routing_key_of": "(code STRING) RETURNS STRING RETURN nullif(substring(replace(upper(code), ' ', ''), 1, 3), '')",
    "slugify": "(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', '')",
    "haversine_m": ("(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 12742000D * asin(sqrt("
                    "power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))"),
    "in_country": "(lat DOUBLE, lon DOUBLE) RETURNS BOOLEAN RETURN lat BETWEEN 51.4D AND 55.5D AND lon BETWEEN -10.7D AND -5.4D",
    "postcode_kind": (r"(code STRING) RETURNS STRING RETURN CASE WHEN trim(code) RLIKE '^[A-Za-z]\\d{1,2}\\s?[A-Za-z0-9]{4}$' THEN 'full' "
                      r"WHEN trim(code) RLIKE '^[A-Za-z]\\d{1,2}[A-Za-z]?$' THEN 'routing_key' ELSE 'other' END"),
}


def _rewritten(expr: str, rules) -> str:
    for pattern, becomes in rules:
        expr = f'regexp_replace({expr}, r"{pattern}", "{becomes}")'
    return expr


def _address_body(extended: bool) -> str:
    """SQL text of the address normaliser, from the rule tables of its column form."""
    words = lambda values: ", ".join(f"'{v}'" for v in values)
    s = _rewritten("a", [(r"^\s+|\s+$", ""), (r"\s+", " "), (r",\s*,+", ","), (r"(?i)^No\.?\s+(\d+)", "$1"), (r"(?i)\bApartment\b", "Apt")])
    if extended:
        s = _rewritten(s, [*[(p, " ") for p in text.NOISE_PATTERNS], (r"(?i)\bCo\.?\s+", "Co. "), (r"(?i)\bCo\s+Dublin\b", "Dublin")])
    s = _rewritten(s, [(rf"(?i)\b{short}\.?\b", full) for short, full in text.STREET_TYPES])
    s = _rewritten(s, [(r",\s*,", ","), (r"\s+,", ","), (r",\s+", ", "), (r"^[, ]+|[, ]+$", "")])
    first_upper = "concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))"
    return ("(a STRING) RETURNS STRING RETURN array_join(transform(filter(split(" + s + r', r"\s+"), w -> w <> ""), (w, i) -> '
            f"CASE WHEN i = 0 THEN {first_upper} WHEN w IN ({words(text.KEEP_WORDS)}) THEN w "
            f"WHEN lower(w) IN ({words(text.LOWER_WORDS)}) THEN lower(w) ELSE {first_upper} END), ' ')")


SQL_FUNCTIONS |= {"normalize_address": _address_body(False), "normalize_address_extended": _address_body(True)}


def register_index_function(spark: SparkSession, view: str) -> str:
    """`county_index_at(county, day)` over a view (county, month, price_index): the index of the day's month, else the
    county's newest, else 1. Look-ups are joins."""
    newest = f"SELECT max_by(price_index, month) FROM {view} WHERE county = c"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION county_index_at(c STRING, d DATE) RETURNS DOUBLE RETURN "
              f"coalesce(({newest} AND month = trunc(d, 'MONTH')), ({newest}), 1.0D)")
    return "county_index_at"


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
