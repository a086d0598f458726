"""Registered queries: text and geographic scalars over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.fixtures import ALL_BOXES_CTE, dwelling_sales, table
from dwellspark.functions import geo, text
from dwellspark.plans import sqltext as q
from dwellspark.plans.registry import over_sales, query

# ------------------------------------------------------------------ text


@query("normalize_address", over_sales(
    f"SELECT id, {q.norm_address('address')} AS address_normalized FROM dwelling"))
def _(spark, d):
    return dwelling_sales(spark, d).select(
        "id", text.normalize_address("address").alias("address_normalized"))


_NOISY = ("replace(address, ', TOWN', CASE WHEN k%3=0 THEN ', STRAWHALL, TOWN' WHEN k%3=1 "
          "THEN ', CO DUBLIN, , TOWN' ELSE ' , Ministers Road, TOWN' END)")


@query("normalize_address_extended", over_sales(
    f"SELECT id, {q.norm_address('a', True)} AS address_normalized "
    f"FROM (SELECT id, {_NOISY} AS a FROM dwelling)"))
def _(spark, d):
    noisy = (F.when(F.col("k") % 3 == 0, ", STRAWHALL, TOWN")
             .when(F.col("k") % 3 == 1, ", CO DUBLIN, , TOWN").otherwise(" , Ministers Road, TOWN"))
    a = F.replace(F.col("address"), F.lit(", TOWN"), noisy)
    return dwelling_sales(spark, d).select(
        "id", text.normalize_address(a, extended=True).alias("address_normalized"))


_SPOILED = ("CASE id%7 WHEN 0 THEN ' ' || lower(eircode) WHEN 1 THEN '' WHEN 2 THEN eircode[1:3] "
            "WHEN 3 THEN 'X-' || eircode ELSE eircode END")


def _spoiled_postcode():
    i, e = F.col("id") % 7, F.col("eircode")
    return (F.when(i == 0, F.concat(F.lit(" "), F.lower(e))).when(i == 1, F.lit(""))
            .when(i == 2, e.substr(1, 3)).when(i == 3, F.concat(F.lit("X-"), e)).otherwise(e))


def _with_postcodes(spark, d):
    return dwelling_sales(spark, d).select("id", _spoiled_postcode().alias("code"))


@query("normalize_postcode", over_sales(
    f"SELECT id, {q.compact_postcode('code')} AS postcode FROM (SELECT id, {_SPOILED} AS code FROM dwelling)"))
def _(spark, d):
    return _with_postcodes(spark, d).select("id", text.normalize_postcode("code").alias("postcode"))


@query("routing_key", over_sales(
    f"SELECT id, {q.routing_key('code')} AS routing_key FROM (SELECT id, {_SPOILED} AS code FROM dwelling)"))
def _(spark, d):
    return _with_postcodes(spark, d).select("id", text.routing_key("code").alias("routing_key"))


@query("postcode_kind", over_sales(
    r"""SELECT id, CASE WHEN regexp_matches(trim(code), '^[A-Za-z]\d{1,2}\s?[A-Za-z0-9]{4}$') THEN 'full'
        WHEN regexp_matches(trim(code), '^[A-Za-z]\d{1,2}[A-Za-z]?$') THEN 'routing_key' ELSE 'other' END AS kind,
        NOT regexp_matches(code, '^[A-Za-z][0-9][0-9Ww]') AS malformed
        FROM (SELECT id, """ + _SPOILED + " AS code FROM dwelling)"))
def _(spark, d):
    return _with_postcodes(spark, d).select(
        "id", text.postcode_kind("code").alias("kind"),
        text.postcode_malformed("code").alias("malformed"))


# The abbreviations and their full forms.
_ABBREV_SQL = q.strip(q.strip(q.rewrite(q.rewrite("a", [
    (r"\bRd\.?\b", "Road"), (r"\bAve?\.?\b", "Avenue"), (r"\bDr\.?\b", "Drive"),
    (r"\bTce\.?(\W|$)", r"Terrace\1"), (r"\bTerr\.?(\W|$)", r"Terrace\1"),
    (r"\bCres\.?\b", "Crescent"), (r"\bGdns?\.?\b", "Gardens"), (r"\bSq\.?\b", "Square"),
    (r"\bPk\.?\b", "Park"), (r"\bBlvd\.?\b", "Boulevard"), (r"\bMt\.?\b", "Mount"),
    (r"\bNth\.?\b", "North"), (r"\bSth\.?\b", "South"), (r"\bSt\.", "Street"),
    (r"^No\.?\s*", ""), (r",?\s*Co\.?\s+", ", ")], "gi"), [("  +", " ")]), ", "))


@query("expand_abbreviations", over_sales(
    f"""SELECT id, {_ABBREV_SQL} AS query FROM (SELECT id, replace(address, ', TOWN',
        CASE k%4 WHEN 0 THEN ' Nth, Oak Tce., Co. Cork, TOWN' WHEN 1 THEN ', 3 Elm Gdns, TOWN'
                 WHEN 2 THEN ', Bay Terr,  TOWN' ELSE ', TOWN' END) AS a FROM dwelling)"""))
def _(spark, d):
    extra = (F.when(F.col("k") % 4 == 0, " Nth, Oak Tce., Co. Cork, TOWN")
             .when(F.col("k") % 4 == 1, ", 3 Elm Gdns, TOWN")
             .when(F.col("k") % 4 == 2, ", Bay Terr,  TOWN").otherwise(", TOWN"))
    a = F.replace(F.col("address"), F.lit(", TOWN"), extra)
    return dwelling_sales(spark, d).select("id", text.expand_abbreviations(a).alias("query"))


@query("normalize_query", over_sales(
    r"""SELECT id, regexp_replace(regexp_replace(lower(trim(a)), '\s+', ' ', 'g'), '[.,;]+$', '') AS query
        FROM (SELECT id, concat('  ', replace(address, ', ', ' ,  '), CASE WHEN k%2=0 THEN ' .;' ELSE '., ' END) AS a FROM dwelling)"""))
def _(spark, d):
    a = F.concat(F.lit("  "), F.replace(F.col("address"), F.lit(", "), F.lit(" ,  ")),
                 F.when(F.col("k") % 2 == 0, " .;").otherwise("., "))
    return dwelling_sales(spark, d).select("id", text.normalize_query(a).alias("query"))


@query("address_tokens", over_sales(
    f"SELECT id, array_to_string({q.tokens('address')}, '|') AS tokens FROM dwelling"))
def _(spark, d):
    return dwelling_sales(spark, d).select(
        "id", F.array_join(text.address_tokens("address"), "|").alias("tokens"))


@query("token_variants", over_sales(
    f"""SELECT token, array_to_string(list_sort(list_distinct(list_filter([t, {q.TOKEN_ALT}, {q.TOKEN_NUMBER}],
        lambda v: v IS NOT NULL))), '|') AS variants, n
        FROM (SELECT t AS token, t, count(*) AS n FROM (SELECT unnest({q.tokens('address')}) AS t FROM dwelling) GROUP BY t)"""))
def _(spark, d):
    return (dwelling_sales(spark, d)
            .select(F.explode(text.address_tokens("address")).alias("token"))
            .groupBy("token").agg(F.count("*").alias("n"))
            .select("token", "n", F.array_join(F.array_sort(text.token_variants("token")), "|")
                    .alias("variants")))


@query("match_key", over_sales(
    f"""SELECT id, {q.match_key('address')} AS match_key,
        trim(regexp_replace(regexp_replace({q.rewrite("regexp_replace(lower(address), '^no[.]?[ ]*[0-9]+[ ]*', '')", q.STREET_WORDS)},
             '[.,\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS rich_key FROM dwelling"""))
def _(spark, d):
    return dwelling_sales(spark, d).select(
        "id", text.match_key("address").alias("match_key"),
        text.match_key_rich("address").alias("rich_key"))


@query("street_pattern", over_sales(
    r"""SELECT id, CASE WHEN length(p) >= 15 THEN p END AS pattern FROM (SELECT id,
        trim(regexp_replace(address, '^(no\.?\s*)?(\d+[a-z]?\s*,?\s*)', '', 'i')) AS p FROM dwelling)"""))
def _(spark, d):
    return dwelling_sales(spark, d).select("id", text.street_pattern("address").alias("pattern"))


@query("street_key", over_sales(
    "SELECT id, street, area, county_key, street_display, area_display, is_apartment FROM street_rows",
    q.STREET_KEY_CTES))
def _(spark, d):
    k = dwelling_sales(spark, d).select("id", text.street_key("address", "county").alias("s"))
    return k.where("s is not null").select(
        "id", "s.street", "s.area", F.col("s.county").alias("county_key"), "s.street_display",
        "s.area_display", "s.is_apartment")


@query("slugify", over_sales(
    "SELECT address, regexp_replace(regexp_replace(lower(address), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM dwelling GROUP BY address"))
def _(spark, d):
    return (dwelling_sales(spark, d).select("address").distinct()
            .select("address", text.slugify("address").alias("slug")))


@query("classify_from_address", over_sales(
    r"""SELECT id, regexp_matches(address, '\b(APT|APTS|APARTMENT|APARTMENTS|FLAT)\b', 'i') AS apartment_flag,
        sale_date >= DATE '1995-01-01' AND sale_date < DATE '2000-01-01' AND property_type IS NULL
        AND NOT regexp_matches(address, '\b(APT|APTS|APARTMENT|APARTMENTS|FLAT|BLOCK|UNIT|UNITS|DUPLEX)\b', 'i')
        AND regexp_matches(address, '^\s*[A-Za-z]') AS house_guess FROM dwelling"""))
def _(spark, d):
    return dwelling_sales(spark, d).select(
        "id", text.is_apartment_address("address").alias("apartment_flag"),
        text.is_house_guess("address", "property_type", "sale_date", "1995-01-01", "2000-01-01")
        .alias("house_guess"))


_LISTING = ("CASE doc_id%9 WHEN 0 THEN ' 3 bed semi-detached' WHEN 1 THEN ' 12 beds, 2 br Apt' "
            "WHEN 2 THEN ' House/Apartment 4 - bedroom bungalow' WHEN 3 THEN ' end of terrace 2bed' "
            "WHEN 4 THEN ' duplex, 5 bedrooms' WHEN 5 THEN ' houses and apartments' "
            "WHEN 6 THEN ' detached house' WHEN 7 THEN ' cottage 11 bed 1 br' ELSE '' END")


def listing_documents(spark, d):
    """Real texts with a listing phrase added by key (the raw data has none)."""
    phrases = [" 3 bed semi-detached", " 12 beds, 2 br Apt", " House/Apartment 4 - bedroom bungalow",
               " end of terrace 2bed", " duplex, 5 bedrooms", " houses and apartments",
               " detached house", " cottage 11 bed 1 br"]
    add = F.lit("")
    for i, p in enumerate(phrases):
        add = F.when(F.col("doc_id") % 9 == i, p).otherwise(add)
    return table(spark, d, "documents").select("doc_id", F.concat("text", add).alias("listing"))


@query("extract_bedrooms",
       f"SELECT doc_id, {q.bedrooms('listing')} AS bedrooms FROM (SELECT doc_id, text || {_LISTING} AS listing FROM documents)")
def _(spark, d):
    return listing_documents(spark, d).select(
        "doc_id", text.extract_bedrooms("listing").alias("bedrooms"))


@query("extract_property_type",
       f"""SELECT doc_id, {q.dwelling_type('listing')} AS property_type,
       CASE WHEN contains(l,'semi-detached') OR contains(l,'semi detached') OR contains(l,'semidetached') THEN 'semi-detached'
            WHEN contains(l,'detached') THEN 'detached'
            WHEN contains(l,'terrace') OR contains(l,'townhouse') THEN 'terraced'
            WHEN contains(l,'apartment') OR contains(l,'apt') OR contains(l,'flat') THEN 'apartment'
            WHEN contains(l,'duplex') THEN 'duplex' WHEN contains(l,'bungalow') THEN 'bungalow'
            WHEN contains(l,'cottage') THEN 'cottage' WHEN contains(l,'house') THEN 'house' END AS keyword_type
       FROM (SELECT doc_id, text || {_LISTING} AS listing, lower(text || {_LISTING}) AS l FROM documents)""")
def _(spark, d):
    return listing_documents(spark, d).select(
        "doc_id", text.extract_property_type("listing").alias("property_type"),
        text.keyword_property_type("listing").alias("keyword_type"))


@query("normalize_county", over_sales(
    """SELECT id, CASE WHEN id%6 = 4 THEN 'Laois' WHEN id%6 = 5 THEN 'Unknownshire' ELSE county END AS county_name FROM dwelling"""))
def _(spark, d):
    i, c = F.col("id") % 6, F.col("county")
    spoiled = (F.when(i == 0, F.concat(F.lit("Co. "), c)).when(i == 1, F.upper(c))
               .when(i == 2, F.concat(F.lit("co "), F.lower(c)))
               .when(i == 3, F.concat(F.lit(" "), c, F.lit(" ")))
               .when(i == 4, "Laoighis").otherwise("CO.unknownshire"))
    return dwelling_sales(spark, d).select("id", text.normalize_county(spoiled).alias("county_name"))


@query("address_shape", over_sales(
    """SELECT length_category, type_indicator, count(*) AS n FROM (SELECT
        CASE WHEN length(address) < 20 THEN 'Very short (<20 chars)' WHEN length(address) < 40 THEN 'Short (20-40 chars)'
             WHEN length(address) < 60 THEN 'Medium (40-60 chars)' ELSE 'Long (60+ chars)' END AS length_category,
        CASE WHEN lower(address) LIKE '%apartment%' OR lower(address) LIKE '%apt%' THEN 'Apartments'
             WHEN lower(address) LIKE '%unit%' THEN 'Units' WHEN lower(address) LIKE '%house%' THEN 'Houses'
             WHEN regexp_matches(address, '[0-9]+ [A-Z]') THEN 'Has number (likely house)' ELSE 'Other/Unknown' END AS type_indicator
        FROM dwelling) GROUP BY ALL"""))
def _(spark, d):
    return (dwelling_sales(spark, d)
            .groupBy(text.length_bucket("address").alias("length_category"),
                     text.type_indicator("address").alias("type_indicator"))
            .agg(F.count("*").alias("n")))


@query("match_class", over_sales(
    f"""SELECT address, query, {q.match_class('address', 'query')} AS match_class FROM (SELECT DISTINCT address,
        CASE k%3 WHEN 0 THEN replace(lower(address), 'rd', 'road') WHEN 1 THEN concat(CAST(k%50 AS VARCHAR), ' Main Street, Town', CAST(k%40 AS VARCHAR), ', ', county)
        ELSE '7 Merrion Road' END AS query FROM dwelling)"""))
def _(spark, d):
    k = F.col("k")
    asked = (F.when(k % 3 == 0, F.replace(F.lower("address"), F.lit("rd"), F.lit("road")))
             .when(k % 3 == 1, F.concat((k % 50).cast("string"), F.lit(" Main Street, Town"),
                                        (k % 40).cast("string"), F.lit(", "), F.col("county")))
             .otherwise("7 Merrion Road"))
    return (dwelling_sales(spark, d).select("address", asked.alias("query")).distinct()
            .withColumn("match_class", text.match_class("address", "query")))


@query("validate_email", r"""
SELECT id, email, regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS valid FROM (
 SELECT c_custkey AS id, replace(c_name, '#', '.') || CASE c_custkey%4 WHEN 0 THEN '@mail.ie' WHEN 1 THEN '@mail' WHEN 2 THEN ' @mail.ie' ELSE '@x.mail.com' END AS email FROM customer)""")
def _(spark, d):
    k = F.col("c_custkey")
    mail = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")),
                    F.when(k % 4 == 0, "@mail.ie").when(k % 4 == 1, "@mail")
                    .when(k % 4 == 2, " @mail.ie").otherwise("@x.mail.com"))
    return (table(spark, d, "customer").select(k.alias("id"), mail.alias("email"))
            .withColumn("valid", text.valid_email("email")))


# ------------------------------------------------------------------ geography

_CITY = "CAST(53.3498 AS DOUBLE)", "CAST(-6.2603 AS DOUBLE)"


def _city():
    return F.lit(53.3498), F.lit(-6.2603)


@query("haversine_m", over_sales(
    f"SELECT id, round({q.haversine('latitude', 'longitude', *_CITY)}, 3) AS metres FROM dwelling"))
def _(spark, d):
    return dwelling_sales(spark, d).select(
        "id", geo.round_to(geo.haversine_m("latitude", "longitude", *_city()), 3).alias("metres"))


@query("spheroid_distance_m", over_sales(
    f"""SELECT id, CASE WHEN h = 0 THEN 0.0::DOUBLE ELSE round(6378137.0 * (s - f/2 * (
          (s - sin(s)) * pow(sin((b1+b2)/2) * cos((b2-b1)/2) / cos(s/2), 2) +
          (s + sin(s)) * pow(cos((b1+b2)/2) * sin((b2-b1)/2) / sin(s/2), 2))), 2) END AS metres
        FROM (SELECT *, 2*asin(sqrt(h)) AS s FROM (SELECT *, pow(sin((b2-b1)/2),2) + cos(b1)*cos(b2)*pow(sin(radians({_CITY[1]}-longitude)/2),2) AS h
        FROM (SELECT *, atan((1-f)*tan(radians(latitude))) AS b1, atan((1-f)*tan(radians({_CITY[0]}))) AS b2 FROM
        (SELECT id, latitude, longitude, 1/298.257223563::DOUBLE AS f FROM dwelling))))"""))
def _(spark, d):
    m = geo.distance_m("latitude", "longitude", *_city(), model="spheroid")
    return dwelling_sales(spark, d).select("id", geo.round_to(m, 2).alias("metres"))


@query("within_radius", over_sales(
    f"SELECT id, county FROM dwelling WHERE {q.haversine('latitude', 'longitude', *_CITY)} <= 10000"))
def _(spark, d):
    return (dwelling_sales(spark, d)
            .where(geo.within_radius("latitude", "longitude", *_city(), F.lit(10_000.0)))
            .select("id", "county"))


def l_shape(minlat, maxlat, minlon, maxlon):
    """Six-corner ring over a box: the box without its upper right quarter."""
    mid_lat, mid_lon = (minlat + maxlat) / 2, (minlon + maxlon) / 2
    corners = [(minlat, minlon), (maxlat, minlon), (maxlat, mid_lon), (mid_lat, mid_lon),
               (mid_lat, maxlon), (minlat, maxlon)]
    return F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in corners])


@query("point_in_polygon", over_sales(
    """SELECT id, (lat > 53.2 AND lat < 53.5 AND lon > -6.5 AND lon < -6.0 AND NOT (lat >= 53.35 AND lon >= -6.25)) AS inside
       FROM (SELECT id, latitude AS lat, longitude AS lon FROM dwelling WHERE latitude IS NOT NULL)"""))
def _(spark, d):
    ring = l_shape(F.lit(53.2), F.lit(53.5), F.lit(-6.5), F.lit(-6.0))
    return (dwelling_sales(spark, d).where("latitude is not null")
            .select("id", geo.point_in_polygon("latitude", "longitude", ring).alias("inside")))


@query("region_check", over_sales(
    """SELECT id, CASE WHEN b.n IS NULL THEN true ELSE lat > minlat AND lat < maxlat AND lon > minlon AND lon < maxlon
        AND NOT (lat >= (minlat+maxlat)/2 AND lon >= (minlon+maxlon)/2) END AS region_ok
       FROM (SELECT id, county, latitude AS lat, longitude AS lon FROM dwelling WHERE latitude IS NOT NULL) s
       LEFT JOIN (SELECT * FROM bounds WHERE n % 5 <> 0) b USING (county)"""))
def _(spark, d):
    from dwellspark.operators.quality import region_check
    from dwellspark.schema import county_boxes
    # Boundaries of four counties in five; each is one ring, given as a list of rings.
    known = [c for i, c in enumerate(_county_names()) if i % 5]
    regions = county_boxes(spark).where(F.col("box_county").isin(known)).select(
        F.col("box_county").alias("region"),
        F.array(l_shape(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon")))
        .alias("rings"))
    return (region_check(dwelling_sales(spark, d).where("latitude is not null"), regions)
            .select("id", "region_ok"))


def _county_names():
    from dwellspark.schema import COUNTY_BOXES
    return list(COUNTY_BOXES)[:25]


@query("in_bounds", over_sales(
    "SELECT id, (latitude + id%3 BETWEEN 51.4 AND 55.5 AND longitude BETWEEN -10.7 AND -5.4) AS ok FROM dwelling"))
def _(spark, d):
    return dwelling_sales(spark, d).select(
        "id", geo.in_bounds(F.col("latitude") + F.col("id") % 3, "longitude").alias("ok"))


@query("county_check", over_sales(
    """SELECT id, coalesce(bool_or(CASE WHEN box_county = county THEN latitude BETWEEN b_minlat AND b_maxlat AND longitude BETWEEN b_minlon AND b_maxlon END), true) AS county_ok,
        coalesce(bool_or(CASE WHEN box_county = county THEN latitude BETWEEN b_minlat-0.2 AND b_maxlat+0.2 AND longitude BETWEEN b_minlon-0.2 AND b_maxlon+0.2 END), true) AS padded_ok,
        CASE WHEN coalesce(bool_or(CASE WHEN box_county = county THEN latitude BETWEEN b_minlat AND b_maxlat AND longitude BETWEEN b_minlon AND b_maxlon END), true) THEN ''
             ELSE coalesce(string_agg(CASE WHEN latitude BETWEEN b_minlat AND b_maxlat AND longitude BETWEEN b_minlon AND b_maxlon THEN box_county END, ', ' ORDER BY box_county), '') END AS candidates
       FROM dwelling, boxes WHERE latitude IS NOT NULL GROUP BY id""", ALL_BOXES_CTE))
def _(spark, d):
    from dwellspark.operators.quality import county_check
    return (county_check(dwelling_sales(spark, d).where("latitude is not null"), margin=0.2)
            .select("id", "county_ok", "padded_ok", F.array_join("candidates", ", ").alias("candidates")))


@query("coordinate_precision", over_sales(
    r"""SELECT lat_decimals, lon_decimals, count(*) AS n FROM (SELECT length(regexp_extract(CAST(latitude AS VARCHAR), '^-?\d+\.(\d+)$', 1)) AS lat_decimals,
        length(regexp_extract(CAST(longitude AS VARCHAR), '^-?\d+\.(\d+)$', 1)) AS lon_decimals FROM dwelling) GROUP BY ALL"""))
def _(spark, d):
    return (dwelling_sales(spark, d)
            .groupBy(geo.decimals("latitude").alias("lat_decimals"),
                     geo.decimals("longitude").alias("lon_decimals"))
            .agg(F.count("*").alias("n")))


@query("low_precision_flag", over_sales(
    """SELECT id, latitude = 0 OR longitude = 0 OR (latitude*100 = floor(latitude*100) AND longitude*100 = floor(longitude*100)) AS low
       FROM (SELECT id, CASE WHEN id%3=0 THEN floor(latitude*4)/4 ELSE latitude END AS latitude,
             CASE WHEN id%3=0 THEN floor(longitude*4)/4 WHEN id%7=0 THEN 0 ELSE longitude END AS longitude FROM dwelling)"""))
def _(spark, d):
    i = F.col("id")
    lat = F.when(i % 3 == 0, F.floor(F.col("latitude") * 4) / 4).otherwise(F.col("latitude"))
    lon = (F.when(i % 3 == 0, F.floor(F.col("longitude") * 4) / 4).when(i % 7 == 0, F.lit(0.0))
           .otherwise(F.col("longitude")))
    return dwelling_sales(spark, d).select("id", geo.low_precision(lat, lon).alias("low"))


@query("polygon_span_km", over_sales(
    """SELECT c_custkey AS id, greatest((w*0.01) * 111, (h*0.01) * 85) <= 4 AS allowed
       FROM (SELECT c_custkey, c_custkey%7 AS w, c_custkey%11 AS h FROM customer)"""))
def _(spark, d):
    k = F.col("c_custkey")
    ring = l_shape(F.lit(53.0), F.lit(53.0) + (k % 7) * 0.01, F.lit(-6.5), F.lit(-6.5) + (k % 11) * 0.01)
    return table(spark, d, "customer").select(
        k.alias("id"), (geo.polygon_span_km(ring) <= 4.0).alias("allowed"))


@query("degree_gap_check", over_sales(
    """SELECT id, abs(latitude - m_lat) < 0.05 AND abs(longitude - m_lon) < 0.08 AS near,
        round(sqrt(pow(abs(latitude - m_lat)*111.0, 2) + pow(abs(longitude - m_lon)*85.0, 2)), 3) AS km
       FROM dwelling JOIN (SELECT county, avg(latitude) AS m_lat, avg(longitude) AS m_lon FROM dwelling GROUP BY county) USING (county)
       WHERE latitude IS NOT NULL"""))
def _(spark, d):
    s = dwelling_sales(spark, d)
    mean = s.groupBy("county").agg(F.avg("latitude").alias("m_lat"), F.avg("longitude").alias("m_lon"))
    return s.where("latitude is not null").join(mean, "county").select(
        "id", geo.degree_gap_ok("latitude", "longitude", "m_lat", "m_lon").alias("near"),
        geo.round_to(geo.degree_gap_km("latitude", "longitude", "m_lat", "m_lon"), 3).alias("km"))
