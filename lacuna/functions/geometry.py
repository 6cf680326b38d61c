"""Shapes as text and in other coordinates: column functions only."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scalar import col

NUMBER = r"-?\d+\.?\d*(?:[eE][+-]?\d+)?"

# The ellipsoids, the projection of the national grid and the datum shift, as published by
# its mapping agency.
WGS84 = (6378137.0, 6356752.314245)
AIRY = (6377563.396, 6356256.909)
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, radians(49.0), radians(-2.0), 400_000.0, -100_000.0
SHIFT = (-446.448, 125.157, -542.060)
SHIFT_PPM = 20.4894
TURN_SECONDS = (-0.1502, -0.2470, -0.8421)

_N = (AIRY[0] - AIRY[1]) / (AIRY[0] + AIRY[1])
_ARC = (1 + _N + 5 / 4 * _N**2 + 5 / 4 * _N**3, 3 * _N + 3 * _N**2 + 21 / 8 * _N**3, 15 / 8 * _N**2 + 15 / 8 * _N**3, 35 / 24 * _N**3)
#: Length of the meridian from the equator to the grid's origin.
_M0 = AIRY[1] * SCALE * (_ARC[0] * LAT0 - _ARC[1] * sin(LAT0) * cos(LAT0) + _ARC[2] * sin(2 * LAT0) * cos(2 * LAT0) - _ARC[3] * sin(3 * LAT0) * cos(3 * LAT0))


def wkt(ring: Column | str = "ring") -> Column:
    """POLYGON text of rings array<array<struct<x, y>>> without closing points; POLYGON EMPTY without rings."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    closed = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), point), ", "), F.lit(")"))
    return F.when(F.size(col(ring)) > 0, F.concat(F.lit("POLYGON ("), F.array_join(F.transform(col(ring), closed), ", "), F.lit(")"))).otherwise(F.lit("POLYGON EMPTY"))


def rings(text: Column | str) -> Column:
    """The rings of POLYGON text, without closing points (I10); null for other texts."""
    part = F.transform(F.regexp_extract_all(col(text), F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.split(p, r"\s+")))
    ring = F.transform(part, lambda r: F.transform(F.slice(r, 1, F.size(r) - 1), lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))))
    return F.when(F.upper(col(text)).startswith("POLYGON"), ring)


def rounded_wkt(text: Column | str, places: int = 6) -> Column:
    """Every number of the text with so many decimals, so that equal shapes are equal texts."""
    numbers = F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0))
    between = F.split(col(text), NUMBER)
    shown = F.transform(numbers, lambda v: F.format_string(f"%.{places}f", v.cast("double")))
    return F.when(col(text).isNotNull(), F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(shown, i), F.lit("")))), ""))


def circle(x: Column | str, y: Column | str, radius: Column | str, corners: int = 64) -> Column:
    """The outline of a circle, closed: corners + 1 points from the east, anticlockwise."""
    angle = lambda i: i * F.lit(2 * pi / corners)
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.struct((col(x) + col(radius) * F.cos(angle(i))).alias("x"), (col(y) + col(radius) * F.sin(angle(i))).alias("y")))


def expanded(x0: str, y0: str, x1: str, y1: str, by: Column | float) -> list[Column]:
    """The box grown by that share of its own width and height on each side."""
    share = by if isinstance(by, Column) else F.lit(float(by))
    w, h = (F.col(x1) - F.col(x0)) * share, (F.col(y1) - F.col(y0)) * share
    return [(F.col(x0) - w).alias(x0), (F.col(y0) - h).alias(y0), (F.col(x1) + w).alias(x1), (F.col(y1) + h).alias(y1)]


def mixed_colour(low: str, high: str, share: Column | str) -> Column:
    """The colour `share` of the way from one #rrggbb to the other, each channel cut to an integer."""
    s = F.least(F.greatest(col(share), F.lit(0.0)), F.lit(1.0))
    a, b = ([int(c.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)] for c in (low, high))
    return F.format_string("#%02x%02x%02x", *[(F.lit(p) + (q - p) * s).cast("int") for p, q in zip(a, b, strict=True)])


def _steps(df: DataFrame, *steps: dict[str, str]) -> DataFrame:
    for s in steps:
        df = df.withColumns({name: F.expr(e) for name, e in s.items()})
    return df


def _earth_centred(lat: str, lon: str, ellipsoid: tuple[float, float]) -> list[dict[str, str]]:
    a, b = ellipsoid
    e2 = 1 - b * b / (a * a)
    return [{"_v": f"{a!r}D / sqrt(1 - {e2!r}D * sin({lat}) * sin({lat}))"}, {"_x": f"_v * cos({lat}) * cos({lon})", "_y": f"_v * cos({lat}) * sin({lon})", "_z": f"_v * {1 - e2!r}D * sin({lat})"}]


def _shifted(sign: int) -> list[dict[str, str]]:
    tx, ty, tz = (sign * t for t in SHIFT)
    rx, ry, rz = (sign * radians(t / 3600) for t in TURN_SECONDS)
    s = 1 + sign * SHIFT_PPM / 1e6
    return [{"_sx": f"{tx!r}D + {s!r}D * _x - ({rz!r}D) * _y + ({ry!r}D) * _z", "_sy": f"{ty!r}D + ({rz!r}D) * _x + {s!r}D * _y - ({rx!r}D) * _z", "_sz": f"{tz!r}D - ({ry!r}D) * _x + ({rx!r}D) * _y + {s!r}D * _z"}]


def _geodetic(ellipsoid: tuple[float, float]) -> list[dict[str, str]]:
    """Latitude and longitude of an earth-centred point near the surface, by one parametric step."""
    a, b = ellipsoid
    e2, d2 = 1 - b * b / (a * a), a * a / (b * b) - 1
    return [{"_p": "sqrt(_sx * _sx + _sy * _sy)"}, {"_t": f"atan2(_sz * {a!r}D, _p * {b!r}D)"}, {"_lat": f"atan2(_sz + {d2 * b!r}D * pow(sin(_t), 3), _p - {e2 * a!r}D * pow(cos(_t), 3))", "_lon": "atan2(_sy, _sx)"}]


def _radii(lat: str) -> list[dict[str, str]]:
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    return [
        {"_sin": f"sin({lat})", "_cos": f"cos({lat})", "_w": f"1 - {e2!r}D * sin({lat}) * sin({lat})", "_t2": f"tan({lat}) * tan({lat})"},
        {"_v": f"{a * SCALE!r}D / sqrt(_w)", "_r": f"{a * SCALE * (1 - e2)!r}D / (_w * sqrt(_w))"},
        {"_n2": "_v / _r - 1"},
    ]


TEMPORARY = ["_lat", "_lon", "_v", "_x", "_y", "_z", "_sx", "_sy", "_sz", "_p", "_t", "_sin", "_cos", "_w", "_t2", "_r", "_n2", "_m", "_d"]


def project(df: DataFrame, lat: str, lon: str, x: str = "x", y: str = "y") -> DataFrame:
    """Grid metres of latitudes and longitudes (radians) on the grid's own ellipsoid: Transverse Mercator by its series."""
    arc = f"{_ARC[0]!r}D * ({lat} - {LAT0!r}D) - {_ARC[1]!r}D * sin({lat} - {LAT0!r}D) * cos({lat} + {LAT0!r}D) + {_ARC[2]!r}D * sin(2 * ({lat} - {LAT0!r}D)) * cos(2 * ({lat} + {LAT0!r}D)) - {_ARC[3]!r}D * sin(3 * ({lat} - {LAT0!r}D)) * cos(3 * ({lat} + {LAT0!r}D))"
    north = "_v / 2 * _sin * _cos * pow(_d, 2) + _v / 24 * _sin * pow(_cos, 3) * (5 - _t2 + 9 * _n2) * pow(_d, 4) + _v / 720 * _sin * pow(_cos, 5) * (61 - 58 * _t2 + _t2 * _t2) * pow(_d, 6)"
    east = "_v * _cos * _d + _v / 6 * pow(_cos, 3) * (_v / _r - _t2) * pow(_d, 3) + _v / 120 * pow(_cos, 5) * (5 - 18 * _t2 + _t2 * _t2 + 14 * _n2 - 58 * _t2 * _n2) * pow(_d, 5)"
    out = _steps(df, *_radii(lat), {"_d": f"{lon} - ({LON0!r}D)", "_m": f"{AIRY[1] * SCALE!r}D * ({arc})"}, {"_gx": f"{EAST0!r}D + {east}", "_gy": f"_m + ({NORTH0!r}D) + {north}"})
    return out.withColumns({x: F.col("_gx"), y: F.col("_gy")}).drop("_gx", "_gy", *TEMPORARY)


def to_grid(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds x, y in metres of the national grid for degrees on WGS84 (G15), by the published seven-parameter shift (some metres exact)."""
    start = df.withColumns({"_la": F.radians(lat), "_lo": F.radians(lon)})
    own = _steps(start, *_earth_centred("_la", "_lo", WGS84), *_shifted(1), *_geodetic(AIRY)).withColumns({"_la": F.col("_lat"), "_lo": F.col("_lon")})
    return project(own, "_la", "_lo", x, y).drop("_la", "_lo")


def to_degrees(df: DataFrame, x: str, y: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds lon, lat in degrees on WGS84 for metres of the national grid."""
    n = _N
    foot = f"_m + {1.5 * n - 27 / 32 * n**3!r}D * sin(2 * _m) + {21 / 16 * n**2 - 55 / 32 * n**4!r}D * sin(4 * _m) + {151 / 96 * n**3!r}D * sin(6 * _m) + {1097 / 512 * n**4!r}D * sin(8 * _m)"
    back = "tan(_f) / (2 * _r * _v) * pow(_d, 2) - tan(_f) / (24 * _r * pow(_v, 3)) * (5 + 3 * _t2 + _n2 - 9 * _t2 * _n2) * pow(_d, 4) + tan(_f) / (720 * _r * pow(_v, 5)) * (61 + 90 * _t2 + 45 * _t2 * _t2) * pow(_d, 6)"
    side = "_d / (_v * _cos) - pow(_d, 3) / (6 * pow(_v, 3) * _cos) * (_v / _r + 2 * _t2) + pow(_d, 5) / (120 * pow(_v, 5) * _cos) * (5 + 28 * _t2 + 24 * _t2 * _t2) - pow(_d, 7) / (5040 * pow(_v, 7) * _cos) * (61 + 662 * _t2 + 1320 * _t2 * _t2 + 720 * pow(_t2, 3))"
    first = _steps(df, {"_d": f"{x} - {EAST0!r}D", "_m": f"({y} - ({NORTH0!r}D) + {_M0!r}D) / {AIRY[1] * SCALE * _ARC[0]!r}D"}, {"_f": foot}, *_radii("_f"), {"_la": f"_f - ({back})", "_lo": f"{LON0!r}D + {side}"})
    out = _steps(first, *_earth_centred("_la", "_lo", AIRY), *_shifted(-1), *_geodetic(WGS84))
    return out.withColumns({"_ld": F.degrees("_lon"), "_pd": F.degrees("_lat")}).withColumns({lon: F.col("_ld"), lat: F.col("_pd")}).drop("_ld", "_pd", "_la", "_lo", "_f", *TEMPORARY)
