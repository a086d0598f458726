"""Canonical schemas and fixed reference values."""

from pyspark.sql import types as T

SALE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sale_date", T.DateType(), False),
    T.StructField("address", T.StringType(), False),
    T.StructField("county", T.StringType()),
    T.StructField("eircode", T.StringType()),
    T.StructField("price", T.DecimalType(12, 2), False),
    T.StructField("not_full_market_price", T.BooleanType()),
    T.StructField("vat_exclusive", T.BooleanType()),
    T.StructField("description", T.StringType()),
    T.StructField("size_description", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("address_normalized", T.StringType()),
    T.StructField("routing_key", T.StringType()),
    T.StructField("needs_geocoding", T.BooleanType()),
    T.StructField("geocode_quality_issue", T.BooleanType()),
    T.StructField("geocode_suspect", T.BooleanType()),
    T.StructField("bedrooms", T.IntegerType()),
    T.StructField("property_type", T.StringType()),
    T.StructField("property_type_source", T.StringType()),
    T.StructField("ber_rating", T.StringType()),
])

AMENITY_SCHEMA = T.StructType([
    T.StructField("amenity_type", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("category", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("attributes", T.StringType()),
    T.StructField("source", T.StringType()),
])

# County bounding boxes (min_lat, max_lat, min_lon, max_lon).
COUNTY_BOXES = {
    "Carlow": (52.58, 52.90, -6.99, -6.66),
    "Cavan": (53.75, 54.15, -7.66, -6.85),
    "Clare": (52.58, 53.20, -9.80, -8.38),
    "Cork": (51.42, 52.30, -9.90, -7.65),
    "Donegal": (54.45, 55.44, -8.55, -7.40),
    "Dublin": (53.20, 53.50, -6.50, -6.00),
    "Galway": (52.98, 53.70, -10.30, -8.15),
    "Kerry": (51.70, 52.50, -10.50, -9.20),
    "Kildare": (52.99, 53.42, -7.22, -6.50),
    "Kilkenny": (52.48, 52.82, -7.54, -7.00),
    "Laois": (52.75, 53.20, -7.80, -7.15),
    "Leitrim": (54.02, 54.47, -8.35, -7.65),
    "Limerick": (52.40, 52.75, -9.20, -8.30),
    "Longford": (53.58, 53.87, -8.00, -7.50),
    "Louth": (53.75, 54.16, -6.70, -6.17),
    "Mayo": (53.50, 54.30, -10.15, -8.60),
    "Meath": (53.50, 53.95, -7.30, -6.35),
    "Monaghan": (54.00, 54.35, -7.30, -6.60),
    "Offaly": (53.05, 53.43, -8.10, -7.18),
    "Roscommon": (53.53, 54.15, -8.65, -7.85),
    "Sligo": (54.05, 54.50, -8.95, -8.20),
    "Tipperary": (52.35, 52.95, -8.40, -7.40),
    "Waterford": (51.95, 52.40, -8.10, -6.95),
    "Westmeath": (53.38, 53.73, -7.90, -7.18),
    "Wexford": (52.20, 52.73, -6.95, -6.28),
    "Wicklow": (52.78, 53.28, -6.75, -5.99),
}

# Country box (min_lat, max_lat, min_lon, max_lon), inclusive.
COUNTRY_BOX = (51.4, 55.5, -10.7, -5.4)
# Market-sale price bounds used by aggregates.
MARKET_MIN, MARKET_MAX = 10_000, 20_000_000


def county_boxes(spark):
    """County boxes as a 26-row DataFrame (bounded by the constant above)."""
    rows = [(c, *b) for c, b in COUNTY_BOXES.items()]
    return spark.createDataFrame(
        rows, "box_county string, min_lat double, max_lat double, min_lon double, max_lon double")
