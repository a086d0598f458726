"""Golden values of the text and geographic scalars."""

import math

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import geo, text
from dwellspark.functions.register import register_functions


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [
    ("No. 12 MAIN ST., TOWN", "12 Main Street., Town"),
    ("  apartment 4,, the PARK ,dublin ", "Apt 4, the Park,dublin"),
    ("O'BRIEN-X rd", "O'brien-x Road"),
    ("3 Church Rd, Co. Cork", "3 Church Road, Co. Cork"),
])
def test_normalize_address(spark, raw, want):
    assert one(spark, text.normalize_address("a"), a=raw) == want


@pytest.mark.parametrize("addr, county, want", [
    ("30 HAMPTON GREEN, NAVAN RD, DUBLIN 7", "Dublin", ("hampton green", "navan rd", "dublin", False)),
    ("APARTMENT 5, THE MILL, CORK", "Cork", ("the mill", "cork", "cork", True)),
])
def test_street_key(spark, addr, county, want):
    k = one(spark, text.street_key("a", "c"), a=addr, c=county)
    assert (k["street"], k["area"], k["county"], k["is_apartment"]) == want


def test_street_key_unreadable(spark):
    assert one(spark, text.street_key("a", "c"), a="12", c="Cork") is None
    assert one(spark, text.street_key("a", "c"), a="1, 22", c="Cork") is None


def test_token_variants(spark):
    assert one(spark, text.token_variants("t"), t="road") == ["road", "rd", "roads"]
    assert one(spark, text.token_variants("t"), t="gardens") == ["gardens", "gdns", "garden"]
    assert one(spark, text.token_variants("t"), t="gas") == ["gas"]


def test_listing_extraction(spark):
    assert one(spark, text.extract_bedrooms("t"), t="12 beds or 3 - bed") == 3
    assert one(spark, text.extract_bedrooms("t"), t="no rooms") is None
    assert one(spark, text.extract_property_type("t"), t="House/Apartment: semi-D home") == "semi-detached"
    assert one(spark, text.extract_property_type("t"), t="houses and apartments") is None


def test_postcode_and_county(spark):
    assert one(spark, text.routing_key("c"), c=" d04 xy12") == "D04"
    assert one(spark, text.routing_key("c"), c="") is None
    assert one(spark, text.normalize_county("c"), c="Co Cork") == "Cork"
    assert one(spark, text.normalize_county("c"), c="Laoighis") == "Laois"
    assert one(spark, text.postcode_kind("c"), c="D04XY12") == "full"


def test_distances(spark):
    d = one(spark, geo.haversine_m("a", "b", "c", "d"), a=53.0, b=-6.0, c=54.0, d=-6.0)
    assert d == pytest.approx(6371000 * math.radians(1), rel=1e-12)
    assert one(spark, geo.haversine_m("a", "b", "c", "d"), a=None, b=-6.0, c=54.0, d=-6.0) is None
    # one degree of latitude near 53.5 degrees is about 111.3 km on the ellipsoid
    s = one(spark, geo.spheroid_distance_m("a", "b", "c", "d"), a=53.0, b=-6.0, c=54.0, d=-6.0)
    assert s == pytest.approx(111_293, abs=30)
    assert one(spark, geo.spheroid_distance_m("a", "b", "c", "d"), a=53.0, b=-6.0, c=53.0, d=-6.0) == 0


def test_polygon_boundary_is_outside(spark):
    ring = F.array(*[F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]])
    inside = lambda y, x: one(spark, geo.point_in_polygon(F.lit(y), F.lit(x), ring), z=0)
    assert inside(2.0, 2.0) and not inside(0.0, 2.0) and not inside(4.0, 4.0) and not inside(5.0, 2.0)


def test_decimals(spark):
    assert one(spark, geo.decimals("v"), v=53.123456) == 6
    assert one(spark, geo.decimals("v"), v=1e-9) == 0


def test_sql_functions(spark):
    assert "haversine_m" in register_functions(spark)
    r = spark.sql("SELECT normalize_postcode(' d04 xy12 ') a, slugify('St. Mary''s, Rd') b, postcode_kind('D04') c, "
                  "haversine_m(53D, -6D, 54D, -6D) d").first()
    assert (r["a"], r["b"], r["c"]) == ("D04XY12", "st-mary-s-rd", "routing_key")
    assert r["d"] == pytest.approx(111194.9, abs=1)
