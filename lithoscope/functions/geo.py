"""Geodesy as column expressions. Angles in degrees, lengths in metres, order lon, lat, elevation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, and the WGS84 axes.
EARTH_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
WGS84_E2 = 1 - (WGS84_B / WGS84_A) ** 2


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Haversine distance, in the form that stays exact for antipodes."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Straight line through the sphere between two surface points."""
    dot = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return 2 * radius * F.sin(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) / 2)


def on_sphere(lon: Column, lat: Column, elevation: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column, Column]:
    """Cartesian coordinates on a sphere."""
    r = elevation + radius
    return r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), r * F.sin(F.radians(lat))


def from_sphere(x: Column, y: Column, z: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column, Column]:
    """lon, lat, elevation of a point in Cartesian coordinates on a sphere."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(z / r)), r - radius


def ecef(lon: Column, lat: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates on the WGS84 ellipsoid."""
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(F.radians(lat)), F.lit(2)))
    flat = (n + elevation) * F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), (n * (1 - WGS84_E2) + elevation) * F.sin(F.radians(lat))


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """lon, lat, elevation by Bowring's closed form."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_A, p * WGS84_B)
    second = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    lat = F.atan2(z + second * WGS84_B * F.pow(F.sin(theta), F.lit(3)), p - WGS84_E2 * WGS84_A * F.pow(F.cos(theta), F.lit(3)))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(lat), F.lit(2)))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), p * F.cos(lat) + z * F.sin(lat) - WGS84_A * WGS84_A / n


def distance(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum((F.pow(a - b, F.lit(2)) for a, b in zip(p, q)), F.lit(0.0)))


def hypocentral(lon1: Column, lat1: Column, elevation1: Column, lon2: Column, lat2: Column, elevation2: Column, ellipsoid: bool = True) -> Column:
    """Straight line between two points below or above the surface."""
    system = ecef if ellipsoid else on_sphere
    return distance(system(lon1, lat1, elevation1), system(lon2, lat2, elevation2))


def enu(lon: Column, lat: Column, elevation: Column, lon0: Column, lat0: Column, elevation0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a point from an origin."""
    dx, dy, dz = (a - b for a, b in zip(ecef(lon, lat, elevation), ecef(lon0, lat0, elevation0)))
    so, co, sa, ca = F.sin(F.radians(lon0)), F.cos(F.radians(lon0)), F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    return -so * dx + co * dy, -sa * co * dx - sa * so * dy + ca * dz, ca * co * dx + ca * so * dy + sa * dz


def from_enu(east: Column, north: Column, up: Column, lon0: Column, lat0: Column, elevation0: Column) -> tuple[Column, Column, Column]:
    """lon, lat, elevation of a point given by its east, north and up from an origin."""
    so, co, sa, ca = F.sin(F.radians(lon0)), F.cos(F.radians(lon0)), F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    x, y, z = ecef(lon0, lat0, elevation0)
    outward = ca * up - sa * north
    return from_ecef(x + co * outward - so * east, y + so * outward + co * east, z + ca * north + sa * up)


def azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, from 0 up to 360."""
    d = F.radians(lon2 - lon1)
    east = F.sin(d) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def geocentric_radius(lat: Column) -> Column:
    c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
    top = F.pow(WGS84_A**2 * c, F.lit(2)) + F.pow(WGS84_B**2 * s, F.lit(2))
    return F.sqrt(top / (F.pow(WGS84_A * c, F.lit(2)) + F.pow(WGS84_B * s, F.lit(2))))


def sinusoidal(lon: Column, lat: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    return radius * F.radians(lon) * F.cos(F.radians(lat)), radius * F.radians(lat)


def from_sinusoidal(x: Column, y: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    return F.degrees(x / (radius * F.cos(y / radius))), F.degrees(y / radius)


def normalize_longitude(lon: Column) -> Column:
    """Into -180 up to, not including, 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def dms_to_degrees(text: Column) -> Column:
    """``12 30 36.5 S`` and the like; the signs of degrees and hemisphere count."""
    part = lambda k: F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.lit(k)).cast("double"), F.lit(0.0))
    sign = F.when(text.rlike(r"^\s*-|[SsWwOo]\s*$"), -1.0).otherwise(1.0)
    return sign * (part(1) + part(2) / 60 + part(3) / 3600)


def utm_zone(lon: Column) -> Column:
    return (F.floor((normalize_longitude(lon) + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing (Snyder's series, scale 0.9996); no false northing in the south."""
    zone = utm_zone(lon) if zone is None else zone
    e2, e4, e6 = WGS84_E2, WGS84_E2**2, WGS84_E2**3
    prime = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2)))
    t, c, a = F.pow(F.tan(phi), F.lit(2)), prime * F.pow(F.cos(phi), F.lit(2)), F.cos(phi) * lam
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    power = lambda k: F.pow(a, F.lit(k))
    east = 0.9996 * n * (a + (1 - t + c) * power(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * prime) * power(5) / 120) + 500000
    north = 0.9996 * (m + n * F.tan(phi) * (power(2) / 2 + (5 - t + 9 * c + 4 * c * c) * power(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * prime) * power(6) / 720))
    return east, north


def bounding_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Smallest lon and lat, largest lon and lat of a ring of (lon, lat) structs; null for none."""
    side = lambda name: F.transform(ring, lambda p: p[name])
    return F.array_min(side("lon")), F.array_min(side("lat")), F.array_max(side("lon")), F.array_max(side("lat"))


def mean_point(ring: Column) -> tuple[Column, Column]:
    """Mean lon and lat of a ring's vertices, an approximate centroid; null for none."""
    total = lambda name: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[name])
    return tuple(F.try_divide(total(name), F.size(ring)) for name in ("lon", "lat"))


def shoelace(ring: Column) -> Column:
    """Signed area of a ring of (x, y) structs, closed or not."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def polygon_area(ring: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Area in square metres of a ring of (lon, lat) structs, in the sinusoidal projection."""
    projected = F.transform(ring, lambda p: F.struct(*(c.alias(n) for c, n in zip(sinusoidal(p["lon"], p["lat"], radius), "xy"))))
    return F.abs(shoelace(projected))


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd ray cast; an edge counts from its lower end (excluded) to its upper end (included)."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))

    def crossed(p: Column, q: Column) -> Column:
        spans = (lat > F.least(p["lat"], q["lat"])) & (lat <= F.greatest(p["lat"], q["lat"]))
        return spans & (lon <= (lat - p["lat"]) * (q["lon"] - p["lon"]) / (q["lat"] - p["lat"]) + p["lon"])

    hits = F.zip_with(ring, following, lambda p, q: F.when(p["lat"] == q["lat"], F.lit(False)).otherwise(crossed(p, q)))
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def in_polygon(parts: Column, lon: Column, lat: Column) -> Column:
    """Inside any part of a polygon of several rings."""
    return F.exists(parts, lambda ring: in_ring(ring, lon, lat))
