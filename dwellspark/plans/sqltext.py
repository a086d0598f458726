"""Snippets of oracle SQL shared by the twins (DuckDB dialect)."""

from __future__ import annotations

PI_180 = "(pi()/180)"


def rewrite(expr: str, rules, flags: str = "g") -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', '{flags}')"
    return expr


def strip(expr: str, chars: str = r"\s") -> str:
    return f"regexp_replace({expr}, '^[{chars}]+|[{chars}]+$', '', 'g')"


# Fixed values in this function: patterns, abbreviations and words of the address rules.
def norm_address(expr: str, extended: bool = False) -> str:
    s = f"regexp_replace({strip(expr)}, '\\s+', ' ', 'g')"
    s = rewrite(s, [(r",\s*,+", ",")])
    s = rewrite(s, [(r"^No\.?\s+(\d+)", r"\1")], "i")
    s = rewrite(s, [(r"\bApartment\b", "Apt")], "gi")
    if extended:
        s = rewrite(s, [(r"\bMinisters?\s+Road\b", " "), (r"\bChurch\s+Fields\s+(East|West)\b", " "),
                        (r"\bMiller\s*[''S]*\s+Glen\b", " "), (r"\bStrawhall\b", " "),
                        (r"\bCo\.?\s+", "Co. "), (r"\bCo\s+Dublin\b", "Dublin")], "gi")
    s = rewrite(s, [(r"\bSt\.?\b", "Street"), (r"\bRd\.?\b", "Road"), (r"\bAve\.?\b", "Avenue"),
                    (r"\bDr\.?\b", "Drive"), (r"\bCl\.?\b", "Close"), (r"\bCt\.?\b", "Court"),
                    (r"\bPk\.?\b", "Park"), (r"\bSq\.?\b", "Square")], "gi")
    s = rewrite(s, [(r",\s*,", ","), (r"\s+,", ","), (r",\s+", ", ")])
    s = strip(s, ", ")
    cap = "concat(upper(w[1:1]), lower(w[2:]))"
    return (f"array_to_string(list_transform(list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> ''), "
            f"lambda w, i: CASE WHEN i = 1 THEN {cap} "
            "WHEN w IN ('Co.','Dublin','Cork','Galway','Limerick','Waterford') THEN w "
            "WHEN lower(w) IN ('and','the','of','de','von','van','na','an') THEN lower(w) "
            f"ELSE {cap} END), ' ')")


def compact_postcode(expr: str) -> str:
    return f"replace(upper(trim({expr})), ' ', '')"


def routing_key(expr: str) -> str:
    return f"nullif(replace(upper({expr}), ' ', '')[1:3], '')"


def match_key(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({expr}), '[.,\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


# Street words and their full forms.
STREET_WORDS = [(r"\brd\b", "road"), (r"\bave?\b", "avenue"), (r"\bdr\b", "drive"),
                (r"\btce\b", "terrace"), (r"\bterr\b", "terrace"), (r"\bcres\b", "crescent"),
                (r"\bgdns?\b", "gardens"), (r"\bsq\b", "square"), (r"\bpk\b", "park"),
                (r"\bblvd\b", "boulevard"), (r"\bmt\b", "mount"), (r"\bnth\b", "north"),
                (r"\bsth\b", "south"), (r"\bst\b", "street")]


def comparison_form(expr: str) -> str:
    s = rewrite(match_key(expr), STREET_WORDS + [(r"^no\.?\s*", ""), (r",?\s*co\.?\s+", " ")])
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def comparison_street(expr: str) -> str:
    s = f"trim(regexp_replace({comparison_form(expr)}, '^\\d+\\s+', ''))"
    return f"CASE WHEN {s} LIKE '% %' THEN {s} END"


def match_class(addr: str, query: str) -> str:
    """Over two expressions; callers give columns so the text stays short."""
    a, q = comparison_form(addr), comparison_form(query)
    sa, sq = comparison_street(addr), comparison_street(query)
    return (f"CASE WHEN starts_with({a}, {q}) THEN 'exact' "
            f"WHEN coalesce(contains({sa}, {sq}) OR contains({sq}, {sa}), false) THEN 'street' "
            "ELSE 'rest' END")


def tokens(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '[a-z0-9]+'), lambda t: length(t) > 1 AND "
            "NOT list_contains(['the','a','an','of','and','co','no','st','dublin','ireland'], t))")


TOKEN_ALT = ("CASE t WHEN 'rd' THEN 'road' WHEN 'ave' THEN 'avenue' WHEN 'dr' THEN 'drive' "
             "WHEN 'tce' THEN 'terrace' WHEN 'cres' THEN 'crescent' WHEN 'gdns' THEN 'gardens' "
             "WHEN 'sq' THEN 'square' WHEN 'pk' THEN 'park' WHEN 'mt' THEN 'mount' "
             "WHEN 'road' THEN 'rd' WHEN 'avenue' THEN 'ave' WHEN 'drive' THEN 'dr' "
             "WHEN 'terrace' THEN 'tce' WHEN 'crescent' THEN 'cres' WHEN 'gardens' THEN 'gdns' "
             "WHEN 'square' THEN 'sq' WHEN 'park' THEN 'pk' WHEN 'mount' THEN 'mt' END")
TOKEN_NUMBER = ("CASE WHEN t LIKE '%s' AND length(t) > 3 THEN t[1:-2] "
                "WHEN t NOT LIKE '%s' THEN t || 's' END")


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(12742000.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1})/2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1})/2), 2))))")


def bedrooms(expr: str) -> str:
    parts = []
    for p in (r"(\d+)\s*bed", r"(\d+)\s*-\s*bed", r"(\d+)\s*br\b", r"(\d+)\s*bedroom"):
        n = f"TRY_CAST(regexp_extract(lower({expr}), '{p}', 1) AS INT)"
        parts.append(f"CASE WHEN {n} BETWEEN 1 AND 10 THEN {n} END")
    return f"coalesce({', '.join(parts)})"


def dwelling_type(expr: str) -> str:
    s = rewrite(f"lower({expr})", [(r"\bhouses?\s*[/&]\s*apartments?\b", " "),
                                   (r"\bapartments?\s*[/&]\s*houses?\b", " "),
                                   (r"\bhouses?\s+and\s+apartments?\b", " ")])
    rules = [("semi-detached", r"semi[\s-]?detached|semi[\s-]?d\b"), ("detached", r"\bdetached\b"),
             ("terraced", r"\bterraced\b|\bterrace\b|end[\s-]?of[\s-]?terrace|\bmid[\s-]?terrace\b"),
             ("duplex", r"\bduplex\b"), ("bungalow", r"\bbungalow\b"), ("cottage", r"\bcottage\b"),
             ("apartment", r"\bapartment\b|\bapt\b"), ("house", r"\bhouse\b")]
    return "CASE " + " ".join(
        f"WHEN regexp_matches({s}, '{p}') THEN '{n}'" for n, p in rules) + " END"


PRICE_SUMMARY = ("count(*) AS n, quantile_cont(CAST(price AS DOUBLE), 0.5) AS median_price, "
                 "CAST(sum(price) AS DOUBLE) / count(*) AS mean_price, "
                 "CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price")
MARKET = "(NOT not_full_market_price AND price BETWEEN 10000 AND 20000000)"

# Street key columns from (address, county) of the row in scope.
STREET_KEY_CTES = r"""
sk0 AS (SELECT *, list_filter(list_transform(string_split(address, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM dwelling),
sk1 AS (SELECT *, trim(regexp_replace(parts[1], '^(?:(?:apartment|apt|unit|no\.?|flat|site)\s*)?\d+[a-z]?\s*(?:-\s*\d+[a-z]?\s*)?', '', 'i')) AS lead FROM sk0 WHERE len(parts) >= 2),
sk2 AS (SELECT *, (lead = '' OR length(lead) < 3 OR regexp_matches(lead, '^(the\s+)?(apartment|apartments|penthouse|ground floor|first floor|second floor|third floor|top floor|floor)\b', 'i')) AS second FROM sk1),
sk3 AS (SELECT *, CASE WHEN NOT second THEN lead WHEN len(parts) >= 3 THEN parts[2] END AS st,
        coalesce(CASE WHEN second THEN parts[3] ELSE parts[2] END, county) AS ar FROM sk2),
street_rows AS (SELECT * EXCLUDE (parts, lead, second, st, ar), lower(st) AS street, lower(ar) AS area, lower(county) AS county_key,
        st AS street_display, ar AS area_display,
        regexp_matches(parts[1], '^(?:the\s+)?(apartment|apt|penthouse|ground floor|first floor|second floor|third floor|top floor|floor|flat)\b', 'i') AS is_apartment
        FROM sk3 WHERE st IS NOT NULL AND regexp_matches(st, '[a-zA-Z]{3,}'))
"""


def mean(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(14,9))) AS DOUBLE) / count({expr})"


def stems(expr: str) -> str:
    """Stems of the words of a text, stated apart from the column form."""
    return (f"list_transform(regexp_extract_all(lower({expr}), '[a-z0-9]+'), lambda t: CASE WHEN length(t) <= 2 THEN t WHEN t LIKE '%sses' OR t LIKE '%ies' THEN t[:-3] "
            "WHEN t LIKE '%ss' OR t LIKE '%us' THEN t WHEN t LIKE '%s' THEN t[:-2] WHEN regexp_matches(t, '[^aeiou0-9]y$') THEN concat(t[:-2], 'i') ELSE t END)")
