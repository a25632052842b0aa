"""Positions as column expressions; degrees in, metres out, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres, geohash alphabet.
EARTH_RADIUS_M = 6371008.8
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def is_valid_coord(lat: Column, lon: Column) -> Column:
    """In range and not the null island."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def parse_latlng(text: Column) -> Column:
    """struct(lat, lon) of "35.1°, 139.2°" or "geo:35.1,139.2"; null if it is neither or not valid."""
    pattern = r"^\s*(?:geo:)?\s*([+-]?\d+(?:\.\d+)?)\s*°?\s*,\s*([+-]?\d+(?:\.\d+)?)\s*°?\s*$"
    lat = F.regexp_extract(text, pattern, 1).try_cast("double")
    lon = F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(is_valid_coord(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Inclusive; ``bbox`` is (west, south, east, north). Plain comparisons, so Parquet can skip by them."""
    west, south, east, north = bbox
    return (lat >= south) & (lat <= north) & (lon >= west) & (lon <= east)


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """A box that the scan can skip by, then the true distance."""
    d_lat = math.degrees(metres / EARTH_RADIUS_M)
    d_lon = d_lat / max(1e-6, math.cos(math.radians(min(89.9, abs(lat0) + d_lat)))) if abs(lat0) + d_lat < 89.9 else 180.0
    west, east, south, north = lon0 - d_lon, lon0 + d_lon, lat0 - d_lat, lat0 + d_lat
    if d_lon >= 180:
        box = (lat >= south) & (lat <= north)
    elif west < -180 or east > 180:  # across the date line: two boxes
        box = in_bbox(lat, lon, ((west + 180) % 360 - 180, south, 180, north)) | in_bbox(lat, lon, (-180, south, (east + 180) % 360 - 180, north))
    else:
        box = in_bbox(lat, lon, (west, south, east, north))
    return box & (haversine_m(lat, lon, F.lit(lat0), F.lit(lon0)) <= metres)


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Cells by integer bins; a value on a boundary falls to the lower cell."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def bins(x: Column, low: float, span: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.ceil((x - low) / span * (1 << n)).cast("long") - 1)

    i, j = bins(lon, -180.0, 360.0, lon_bits), bins(lat, -90.0, 180.0, lat_bits)
    # A letter's five bits alternate: three of one axis and two of the other, which take turns, longitude first.
    turned = "".join(GEOHASH_ALPHABET[(a >> 2) << 4 | (b >> 1) << 3 | (a >> 1 & 1) << 2 | (b & 1) << 1 | a & 1] for a in range(8) for b in range(4))
    letters = []
    for p in range(precision):
        three, two, of_three, of_two = (i, j, lon_bits, lat_bits) if p % 2 == 0 else (j, i, lat_bits, lon_bits)
        high = F.shiftright(three, of_three - 1 - (5 * p + 4) // 2).bitwiseAND(F.lit(7).cast("long"))
        low = F.shiftright(two, of_two - 1 - (5 * p + 3) // 2).bitwiseAND(F.lit(3).cast("long"))
        letters.append(F.substring(F.lit(turned), (high * 4 + low + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*letters))


def redact_position(lat: Column, lon: Column) -> Column:
    """A cell of some 20 km, for logs."""
    return geohash(lat, lon, 4)


def point_dedup_key(user: Column, ts: Column, lat: Column, lon: Column) -> Column:
    """Equal for pings of one user in one second within a metre."""
    return F.sha2(F.concat_ws("|", user.cast("string"), F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd HH:mm:ss"), F.format_string("%.5f", lat), F.format_string("%.5f", lon)), 256)


def accuracy_ok(accuracy: Column, max_m: float = 500.0) -> Column:
    return accuracy.isNull() | (accuracy <= max_m)


def lerp_position(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ratio: Column) -> Column:
    """The point at ``ratio`` of the way: along the great circle, or in the plane below 10 km."""
    d = haversine_m(lat1, lon1, lat2, lon2) / EARTH_RADIUS_M
    a, b = F.sin((1 - ratio) * d) / F.sin(d), F.sin(ratio * d) / F.sin(d)
    p1, l1, p2, l2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    flat = d * EARTH_RADIUS_M < 10_000
    return F.struct(
        F.when(flat, lat1 + (lat2 - lat1) * ratio).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("lat"),
        F.when(flat, lon1 + (lon2 - lon1) * ratio).otherwise(F.degrees(F.atan2(y, x))).alias("lon"),
    )


def mercator_world(lat: Column, lon: Column, scale: float = 1.0) -> Column:
    """struct(x, y) on a square of side ``scale``, latitude clamped."""
    s = F.sin(F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))))
    return F.struct(((lon + 180.0) / 360.0 * scale).alias("x"), ((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * scale).alias("y"))


def tile_of(lat: Column, lon: Column, z: int) -> Column:
    """struct(z, x, y) of the map tile."""
    n = 1 << z
    w = mercator_world(lat, lon, float(n))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    return F.struct(F.lit(z).alias("z"), clamp(w["x"]).alias("x"), clamp(w["y"]).alias("y"))


def coarsen(value: Column, grid_m: float = 10_000.0) -> Column:
    """The nearest multiple of a grid step, in degrees of latitude."""
    step = grid_m / 111_320.0
    return F.round(value / step) * step


def seeded_unit(seed: Column, index: Column) -> Column:
    """A number in [0, 1) that is always the same for a seed and an index."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), index.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") % 1_000_000 / 1e6


def dms_to_degrees(parts: Column, ref: Column) -> Column:
    """Degrees of [degrees, minutes, seconds] and N/S/E/W."""
    value = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60 + F.get(parts, F.lit(2)) / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def speed_to_mps(value: Column, unit: Column) -> Column:
    """Metres a second; K: km/h, M: miles an hour, N: knots."""
    return value * F.when(F.upper(unit) == "M", 0.44704).when(F.upper(unit) == "N", 1852 / 3600).otherwise(1 / 3.6)


def signed_altitude(value: Column, ref: Column) -> Column:
    """Metres above the sea, below it where the reference says 1."""
    return F.when(ref == 1, -value).otherwise(value)


def semicircles_to_deg(value: Column) -> Column:
    return value * (180.0 / 2**31)


def centroid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Aggregates: the mean of unit vectors, right across the date line."""
    p, q = F.radians(lat), F.radians(lon)
    x, y, z = F.avg(F.cos(p) * F.cos(q)), F.avg(F.cos(p) * F.sin(q)), F.avg(F.sin(p))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))
