"""Address, postcode and listing-text scalars as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Street-type abbreviations, applied in this order.
STREET_TYPES = [
    ("St", "Street"), ("Rd", "Road"), ("Ave", "Avenue"), ("Dr", "Drive"),
    ("Cl", "Close"), ("Ct", "Court"), ("Pk", "Park"), ("Sq", "Square"),
]
# Words kept lower-case, words kept as written.
LOWER_WORDS = ["and", "the", "of", "de", "von", "van", "na", "an"]
KEEP_WORDS = ["Co.", "Dublin", "Cork", "Galway", "Limerick", "Waterford"]
# Estate-name noise removed by the extended normaliser.
NOISE_PATTERNS = [
    r"(?i)\bMinisters?\s+Road\b",
    r"(?i)\bChurch\s+Fields\s+(East|West)\b",
    r"(?i)\bMiller\s*['S]*\s+Glen\b",
    r"(?i)\bStrawhall\b",
]
# Ordered abbreviation rewrites for outgoing queries.
QUERY_ABBREVIATIONS = [
    (r"(?i)\bRd\.?\b", "Road"),
    (r"(?i)\bAve?\.?\b", "Avenue"),
    (r"(?i)\bDr\.?\b", "Drive"),
    (r"(?i)\bTce\.?(?=\W|$)", "Terrace"),
    (r"(?i)\bTerr\.?(?=\W|$)", "Terrace"),
    (r"(?i)\bCres\.?\b", "Crescent"),
    (r"(?i)\bGdns?\.?\b", "Gardens"),
    (r"(?i)\bSq\.?\b", "Square"),
    (r"(?i)\bPk\.?\b", "Park"),
    (r"(?i)\bBlvd\.?\b", "Boulevard"),
    (r"(?i)\bMt\.?\b", "Mount"),
    (r"(?i)\bNth\.?\b", "North"),
    (r"(?i)\bSth\.?\b", "South"),
    (r"(?i)\bSt\.", "Street"),
    (r"(?i)^No\.?\s*", ""),
    (r"(?i),?\s*Co\.?\s+", ", "),
]
# Token stop words and the abbreviation pairs.
STOP_WORDS = ["the", "a", "an", "of", "and", "co", "no", "st", "dublin", "ireland"]
TOKEN_PAIRS = {
    "rd": "road", "ave": "avenue", "dr": "drive", "tce": "terrace", "cres": "crescent",
    "gdns": "gardens", "sq": "square", "pk": "park", "mt": "mount",
}
# Lower-case street words for comparing two addresses.
MATCH_WORDS = [
    (r"\brd\b", "road"), (r"\bave?\b", "avenue"), (r"\bdr\b", "drive"),
    (r"\btce\b", "terrace"), (r"\bterr\b", "terrace"), (r"\bcres\b", "crescent"),
    (r"\bgdns?\b", "gardens"), (r"\bsq\b", "square"), (r"\bpk\b", "park"),
    (r"\bblvd\b", "boulevard"), (r"\bmt\b", "mount"), (r"\bnth\b", "north"),
    (r"\bsth\b", "south"), (r"\bst\b", "street"),
]
# Leading unit/house number, generic first parts, block names.
LEAD_NUMBER = r"(?i)^(?:(?:apartment|apt|unit|no\.?|flat|site)\s*)?\d+[a-z]?\s*(?:-\s*\d+[a-z]?\s*)?"
GENERIC_PART = (r"(?i)^(the\s+)?(apartment|apartments|penthouse|ground floor|first floor|"
                r"second floor|third floor|top floor|floor)\b")
APARTMENT_PREFIX = (r"(?i)^(?:the\s+)?(apartment|apt|penthouse|ground floor|first floor|"
                    r"second floor|third floor|top floor|floor|flat)\b")
BLOCK_NAME = r"(?i)\b(block|building|apartments?)\b"
# Whole-word unit indicators.
APARTMENT_WORDS = r"(?i)\b(APT|APTS|APARTMENT|APARTMENTS|FLAT)\b"
UNIT_WORDS = r"(?i)\b(APT|APTS|APARTMENT|APARTMENTS|FLAT|BLOCK|UNIT|UNITS|DUPLEX)\b"
# Postcode shapes.
FULL_POSTCODE = r"^[A-Za-z]\d{1,2}\s?[A-Za-z0-9]{4}$"
ROUTING_SHAPE = r"^[A-Za-z]\d{1,2}[A-Za-z]?$"
VALID_ROUTING_KEY = r"^[A-Z][0-9][0-9W]$"
WELL_FORMED_START = r"^[A-Za-z][0-9][0-9Ww]"
EMAIL_SHAPE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# Bedroom patterns in order; dwelling types, most specific first.
BEDROOM_PATTERNS = [r"(\d+)\s*bed", r"(\d+)\s*-\s*bed", r"(\d+)\s*br\b", r"(\d+)\s*bedroom"]
TYPE_BOILERPLATE = [
    r"\bhouses?\s*[/&]\s*apartments?\b",
    r"\bapartments?\s*[/&]\s*houses?\b",
    r"\bhouses?\s+and\s+apartments?\b",
]
TYPE_PATTERNS = [
    ("semi-detached", r"semi[\s-]?detached|semi[\s-]?d\b"),
    ("detached", r"\bdetached\b"),
    ("terraced", r"\bterraced\b|\bterrace\b|end[\s-]?of[\s-]?terrace|\bmid[\s-]?terrace\b"),
    ("duplex", r"\bduplex\b"),
    ("bungalow", r"\bbungalow\b"),
    ("cottage", r"\bcottage\b"),
    ("apartment", r"\bapartment\b|\bapt\b"),
    ("house", r"\bhouse\b"),
]
TYPE_KEYWORDS = [
    ("semi-detached", ["semi-detached", "semi detached", "semidetached"]),
    ("detached", ["detached"]),
    ("terraced", ["terraced", "terrace", "townhouse"]),
    ("apartment", ["apartment", "apt", "flat"]),
    ("duplex", ["duplex"]),
    ("bungalow", ["bungalow"]),
    ("cottage", ["cottage"]),
    ("house", ["house"]),
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rewrite(c: Column, rules) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip(c, chars: str = r"\s") -> Column:
    """Remove leading and trailing characters of a regex class."""
    return F.regexp_replace(_c(c), rf"^[{chars}]+|[{chars}]+$", "")


def squeeze(c) -> Column:
    return F.regexp_replace(_c(c), r"\s+", " ")


def capitalize(c) -> Column:
    """First letter upper, rest lower (not word-wise)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def _register_case(word: Column, position: Column) -> Column:
    return (F.when(position == 0, capitalize(word))
            .when(word.isin(KEEP_WORDS), word)
            .when(F.lower(word).isin(LOWER_WORDS), F.lower(word))
            .otherwise(capitalize(word)))


def normalize_address(c, extended: bool = False) -> Column:
    """Canonical spelling of a register address; `extended` also drops estate
    noise and repairs the county prefix."""
    s = _rewrite(squeeze(strip(c)), [
        (r",\s*,+", ","),
        (r"(?i)^No\.?\s+(\d+)", "$1"),
        (r"(?i)\bApartment\b", "Apt"),
    ])
    if extended:
        s = _rewrite(s, [(p, " ") for p in NOISE_PATTERNS])
        s = _rewrite(s, [(r"(?i)\bCo\.?\s+", "Co. "), (r"(?i)\bCo\s+Dublin\b", "Dublin")])
    s = _rewrite(s, [(rf"(?i)\b{short}\.?\b", full) for short, full in STREET_TYPES])
    s = _rewrite(s, [(r",\s*,", ","), (r"\s+,", ","), (r",\s+", ", ")])
    s = strip(s, ", ")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, _register_case), " ")


# Plural endings and what they become, the first that fits.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("us", "us"), ("s", "")]


def stem(token: Column) -> Column:
    """Search form of a lower-case word: plurals lose their ending and a final y after a consonant becomes i, so
    `gardens` meets `garden` and `cherries` meets `cherry`. Words of two letters stay."""
    out = F.regexp_replace(token, "([^aeiou0-9])y$", "$1i")
    for ending, becomes in reversed(PLURALS):
        out = F.when(F.endswith(token, F.lit(ending)), F.regexp_replace(token, f"{ending}$", becomes)).otherwise(out)
    return F.when(F.length(token) <= 2, token).otherwise(out)


def normalize_postcode(c) -> Column:
    return F.replace(F.upper(F.trim(_c(c))), F.lit(" "), F.lit(""))


def routing_key(c) -> Column:
    """First three characters of the compact postcode; NULL when blank."""
    return F.nullif(F.substring(F.replace(F.upper(_c(c)), F.lit(" "), F.lit("")), 1, 3), F.lit(""))


def postcode_kind(c) -> Column:
    s = F.trim(_c(c))
    return (F.when(s.rlike(FULL_POSTCODE), "full")
            .when(s.rlike(ROUTING_SHAPE), "routing_key").otherwise("other"))


def postcode_malformed(c) -> Column:
    return ~_c(c).rlike(WELL_FORMED_START)


def expand_abbreviations(c) -> Column:
    s = _rewrite(_c(c), QUERY_ABBREVIATIONS)
    return strip(strip(F.regexp_replace(s, "  +", " "), ", "))


def normalize_query(c) -> Column:
    return F.regexp_replace(squeeze(F.lower(strip(c))), r"[.,;]+$", "")


def address_tokens(c) -> Column:
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1))


def token_variants(c) -> Column:
    """The token, its abbreviation or expansion, and its singular or plural."""
    t = _c(c)
    pairs = {**{v: k for k, v in TOKEN_PAIRS.items()}, **TOKEN_PAIRS}
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    other = (F.when(~t.endswith("s"), F.concat(t, F.lit("s")))
             .when(F.length(t) > 3, t.substr(F.lit(1), F.length(t) - 1)))
    return F.array_distinct(F.array_compact(F.array(t, F.element_at(lookup, t), other)))


def match_key(c) -> Column:
    """Lower case, punctuation to space, one space between words."""
    return F.trim(squeeze(F.regexp_replace(F.lower(_c(c)), r"[.,\-]", " ")))


def match_key_rich(c) -> Column:
    """`match_key` after dropping a leading "no. N" and expanding street words."""
    s = F.regexp_replace(F.lower(_c(c)), r"^no\.?\s*\d+\s*", "")
    return F.trim(squeeze(F.regexp_replace(_rewrite(s, MATCH_WORDS), r"[.,\-]", " ")))


def street_pattern(c) -> Column:
    """Address without its leading house number; NULL below 15 characters."""
    s = strip(F.regexp_replace(_c(c), r"(?i)^(no\.?\s*)?(\d+[a-z]?\s*,?\s*)", ""))
    return F.when(F.length(s) >= 15, s)


def bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def street_key(address, county) -> Column:
    """STRUCT of lower-case (street, area, county), their display forms and an
    apartment flag; NULL when no street can be read off the address."""
    county = _c(county)
    parts = F.filter(F.transform(F.split(_c(address), ","), lambda p: strip(p)), lambda p: p != "")
    norm = lambda x: squeeze(F.lower(strip(x)))

    def read(p):
        first = F.get(p, F.lit(0))
        return bind(strip(F.regexp_replace(first, LEAD_NUMBER, "")), lambda lead: bind(
            (lead == "") | lead.rlike(GENERIC_PART) | (F.length(lead) < 3),
            lambda second: build(p, first, lead, second)))

    def build(p, first, lead, second):
        street = F.when(~second, lead).when(F.size(p) >= 3, F.get(p, F.lit(1)))
        area = F.coalesce(F.get(p, F.when(second, 2).otherwise(1)), county)
        out = F.struct(
            norm(street).alias("street"), norm(area).alias("area"),
            F.lower(strip(county)).alias("county"),
            strip(street).alias("street_display"), strip(area).alias("area_display"),
            strip(county).alias("county_display"),
            first.rlike(APARTMENT_PREFIX).alias("is_apartment"))
        return F.when((F.size(p) >= 2) & street.rlike("[a-zA-Z]{3,}"), out)

    return bind(parts, read)


def slugify(c) -> Column:
    return strip(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-"), "-")


def is_apartment_address(c) -> Column:
    return _c(c).rlike(APARTMENT_WORDS)


def is_house_guess(address, property_type, sale_date, start="2010-01-01", end="2021-01-01") -> Column:
    """Untyped sale in [start, end) whose address opens with a place name."""
    a, d = _c(address), _c(sale_date)
    return ((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date"))
            & _c(property_type).isNull() & ~a.rlike(UNIT_WORDS) & a.rlike(r"^\s*[A-Za-z]"))


def extract_bedrooms(c) -> Column:
    """First pattern whose first hit is 1..10."""
    s = F.lower(_c(c))
    found = [F.regexp_extract(s, pattern, 1).try_cast("int") for pattern in BEDROOM_PATTERNS]
    return F.coalesce(*[F.when(n.between(1, 10), n) for n in found])


def extract_property_type(c) -> Column:
    s = _rewrite(F.lower(_c(c)), [(p, " ") for p in TYPE_BOILERPLATE])
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TYPE_PATTERNS):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def keyword_property_type(c) -> Column:
    """Plain substring variant of `extract_property_type`."""
    s = F.lower(_c(c))
    out = F.lit(None).cast("string")
    for name, words in reversed(TYPE_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | s.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def normalize_county(c) -> Column:
    """County name without its prefix; the alias forms reduce to two rules."""
    from dwellspark.schema import COUNTY_BOXES
    known = list(COUNTY_BOXES)
    s = F.trim(_c(c))
    bare = F.trim(F.regexp_replace(s, r"(?i)^co[. ]", ""))
    return (F.when(F.coalesce(s, F.lit("")) == "", "")
            .when(s == "Laoighis", "Laois")
            .when(s.isin("North Tipperary", "South Tipperary"), "Tipperary")
            .when(F.initcap(s).isin(known), F.initcap(s))
            .otherwise(F.initcap(bare)))


def length_bucket(c) -> Column:
    n = F.length(_c(c))
    return (F.when(n < 20, "Very short (<20 chars)").when(n < 40, "Short (20-40 chars)")
            .when(n < 60, "Medium (40-60 chars)").otherwise("Long (60+ chars)"))


def type_indicator(c) -> Column:
    a, low = _c(c), F.lower(_c(c))
    return (F.when(low.contains("apartment") | low.contains("apt"), "Apartments")
            .when(low.contains("unit"), "Units").when(low.contains("house"), "Houses")
            .when(a.rlike("[0-9]+ [A-Z]"), "Has number (likely house)")
            .otherwise("Other/Unknown"))


def comparison_form(c) -> Column:
    """Form in which an address and a query are compared for display."""
    s = F.trim(squeeze(F.regexp_replace(F.lower(_c(c)), r"[.,\-]", " ")))
    s = _rewrite(s, MATCH_WORDS + [(r"^no\.?\s*", ""), (r",?\s*co\.?\s+", " ")])
    return F.trim(squeeze(s))


def comparison_street(c) -> Column:
    """Comparison form without the house number; NULL below two words."""
    s = F.trim(F.regexp_replace(comparison_form(c), r"^\d+\s+", ""))
    return F.when(F.size(F.split(s, r"\s+")) >= 2, s)


def match_class(address, query) -> Column:
    """'exact' (prefix), 'street' (same or contained street) or 'rest'."""
    a, q = comparison_form(address), comparison_form(query)
    sa, sq = comparison_street(address), comparison_street(query)
    street = F.coalesce(F.contains(sa, sq) | F.contains(sq, sa), F.lit(False))
    return F.when(a.startswith(q), "exact").when(street, "street").otherwise("rest")


def valid_email(c) -> Column:
    return _c(c).rlike(EMAIL_SHAPE)
