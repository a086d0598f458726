"""Geographic scalars and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dwellspark.schema import COUNTRY_BOX, COUNTY_BOXES

EARTH_RADIUS_M = 6_371_000.0
# WGS84 semi-major axis and flattening.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
M_PER_DEG = EARTH_RADIUS_M * 3.141592653589793 / 180.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c, digits: int) -> Column:
    """Half-away rounding done in double arithmetic, no negative zero."""
    scale = F.lit(float(10 ** digits))
    return F.round(_c(c) * scale) / scale + F.lit(0.0)


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = F.sin((b - a) / 2)
    dlon = F.sin(F.radians(_c(lon2) - _c(lon1)) / 2)
    return dlat * dlat + F.cos(a) * F.cos(b) * dlon * dlon


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    h = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h)))


def spheroid_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Andoyer-Lambert: first-order flattening correction over reduced latitudes."""
    flat = F.lit(1 - WGS84_F)
    b1 = F.atan(flat * F.tan(F.radians(_c(lat1))))
    b2 = F.atan(flat * F.tan(F.radians(_c(lat2))))
    half_lon = F.sin(F.radians(_c(lon2) - _c(lon1)) / 2)
    half_lat = F.sin((b2 - b1) / 2)
    h = half_lat * half_lat + F.cos(b1) * F.cos(b2) * half_lon * half_lon
    h = F.when(h > 1.0, F.lit(1.0)).otherwise(h)
    sigma = F.lit(2.0) * F.asin(F.sqrt(h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    sp, cp, sq_, cq = F.sin(p), F.cos(p), F.sin(q), F.cos(q)
    ch, sh = F.cos(sigma / 2), F.sin(sigma / 2)
    x = (sigma - F.sin(sigma)) * (sp * sp * cq * cq) / (ch * ch)
    y = (sigma + F.sin(sigma)) * (cp * cp * sq_ * sq_) / (sh * sh)
    d = F.lit(WGS84_A) * (sigma - F.lit(WGS84_F / 2) * (x + y))
    return F.when(h == 0.0, F.lit(0.0)).otherwise(d)


def distance_m(lat1, lon1, lat2, lon2, model: str = "sphere") -> Column:
    fn = {"sphere": haversine_m, "spheroid": spheroid_distance_m}[model]
    return fn(lat1, lon1, lat2, lon2)


def within_radius(lat, lon, lat0, lon0, radius_m) -> Column:
    """Inclusive; the degree box is tested first because it is cheap and pushable."""
    pad = _c(radius_m) / F.lit(M_PER_DEG) * 1.000001
    box = F.abs(_c(lat) - _c(lat0)) <= pad
    return box & (haversine_m(lat, lon, lat0, lon0) <= _c(radius_m))


def close_ring(ring) -> Column:
    ring = _c(ring)
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(first == last, ring).otherwise(F.concat(ring, F.array(first)))


def point_in_polygon(lat, lon, ring) -> Column:
    """Strictly inside by even-odd crossings; boundary points are outside.

    `ring` is ARRAY<STRUCT<lat, lon>>; it is closed when open."""
    lat, lon, closed = _c(lat), _c(lon), close_ring(ring)
    edges = F.zip_with(
        F.slice(closed, F.lit(1), F.size(closed) - 1),
        F.slice(closed, F.lit(2), F.size(closed) - 1),
        lambda a, b: F.struct(a["lat"].alias("y1"), a["lon"].alias("x1"),
                              b["lat"].alias("y2"), b["lon"].alias("x2")))
    side = lambda e: ((e["x2"] - e["x1"]) * (lat - e["y1"])
                      - (lon - e["x1"]) * (e["y2"] - e["y1"]))
    crosses = lambda e: (((e["y1"] > lat) != (e["y2"] > lat))
                         & ((side(e) > 0) == (e["y2"] < e["y1"])))
    on_edge = lambda e: ((side(e) == 0)
                         & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
                         & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])))
    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, on_edge)


def in_bounds(lat, lon, box=COUNTRY_BOX) -> Column:
    return _c(lat).between(box[0], box[1]) & _c(lon).between(box[2], box[3])


def in_county_box(lat, lon, county, margin: float = 0.0) -> Column:
    """Inside the stated county's box; NULL for an unknown county.

    The box is looked up once a row: a branch for each county would repeat the county's expression in all of them, more
    code than a compiled stage can hold."""
    lat, lon = _c(lat), _c(lon)
    boxes = F.create_map(*[part for name, (a, b, c, d) in COUNTY_BOXES.items() for part in (
        F.lit(name), F.array(F.lit(a - margin), F.lit(b + margin), F.lit(c - margin), F.lit(d + margin)))])
    inside = lambda box: lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    return F.get(F.transform(F.array(F.try_element_at(boxes, _c(county))), inside), F.lit(0))


def candidate_counties(lat, lon) -> Column:
    """Names of every county box holding the point, in alphabetical order."""
    lat, lon = _c(lat), _c(lon)
    return F.array_compact(F.array(*[
        F.when(lat.between(a, b) & lon.between(c, d), F.lit(name))
        for name, (a, b, c, d) in COUNTY_BOXES.items()]))


def decimals(c) -> Column:
    """Digits after the point in the shortest printed form; 0 for exponent forms."""
    return F.length(F.regexp_extract(_c(c).cast("string"), r"^-?\d+\.(\d+)$", 1))


def low_precision(lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    whole = lambda x: x * 100 == F.floor(x * 100)
    return (lat == 0) | (lon == 0) | (whole(lat) & whole(lon))


def polygon_span_km(ring) -> Column:
    lats, lons = F.transform(_c(ring), lambda p: p["lat"]), F.transform(_c(ring), lambda p: p["lon"])
    return F.greatest((F.array_max(lats) - F.array_min(lats)) * 111.0,
                      (F.array_max(lons) - F.array_min(lons)) * 85.0)


def degree_gap_ok(lat, lon, lat0, lon0) -> Column:
    return (F.abs(_c(lat) - _c(lat0)) < 0.05) & (F.abs(_c(lon) - _c(lon0)) < 0.08)


def degree_gap_km(lat, lon, lat0, lon0) -> Column:
    dy, dx = F.abs(_c(lat) - _c(lat0)) * 111.0, F.abs(_c(lon) - _c(lon0)) * 85.0
    return F.sqrt(dy * dy + dx * dx)


def cell(c, size: float) -> Column:
    return F.floor(_c(c) / F.lit(size)).cast("long")


def exact_sum(c) -> Column:
    """Sum of degrees in decimals: it does not depend on the order of the rows."""
    return F.sum(_c(c).cast("decimal(14,9)"))


def exact_mean(c) -> Column:
    """Mean of degrees to nine decimals (0.1 mm), the same for every partitioning."""
    return exact_sum(c).cast("double") / F.count(c)
