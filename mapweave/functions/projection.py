"""Coordinates to pixels in four projections, as column expressions and, for one point, in Python."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84, and the latitude at which Mercator's square ends.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
MERCATOR_LIMIT = 180 / math.pi * (2 * math.atan(math.exp(math.pi)) - math.pi / 2)
#: Half the width of the polar maps in metres.
ARCTIC_EXTENT, ANTARCTIC_EXTENT = math.sqrt(2.0) * 6371007.2, 12367396.21845986
TILE_SIZES = (256, 512, 1024, 2048, 4096)
MAX_ZOOM = 16


@dataclass(frozen=True)
class Schema:
    """Tiles at zoom 0, and whether the map goes on beyond its left and right edge."""

    wide: int
    high: int
    wraps: bool
    polar: bool


SCHEMAS = {
    "EPSG:3857": Schema(1, 1, True, False),
    "EPSG:4326": Schema(2, 1, True, False),
    "EPSG:3575": Schema(1, 1, False, True),
    "EPSG:3031": Schema(1, 1, False, True),
}


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E * s) / (1 + E * s)) / (2 * E))


def _t(phi: float) -> float:
    s = E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (E / 2)


Q_POLE = _q(math.pi / 2)
_F = math.radians(71.0)
STEREO = A * (math.cos(_F) / math.sqrt(1 - E2 * math.sin(_F) ** 2)) / _t(_F)


def plottable(epsg: str, lat: Column, lng: Column) -> Column:
    low, high = {"EPSG:3857": (-MERCATOR_LIMIT, MERCATOR_LIMIT), "EPSG:4326": (-90.0, 90.0), "EPSG:3575": (0.0, 90.0), "EPSG:3031": (-90.0, 0.0)}[epsg]
    return lat.between(F.lit(low), F.lit(high)) & lng.between(F.lit(-180.0), F.lit(180.0))


def global_xy(epsg: str, tile_size: int, z: int, lat: Column, lng: Column) -> tuple[Column, Column]:
    """Pixels from the map's upper left corner, as doubles."""
    pixels = float(tile_size << z)
    if epsg == "EPSG:3857":
        s = F.sin(lat * F.lit(math.pi / 180))
        return (lng + 180) / 360 * F.lit(pixels), (F.lit(0.5) - F.ln((1 + s) / (1 - s)) / F.lit(4 * math.pi)) * F.lit(pixels)
    if epsg == "EPSG:4326":
        return (lng + 180) * F.lit(pixels / 180), (-lat + 90) * F.lit(pixels / 180)
    radians = F.lit(math.pi / 180)
    if epsg == "EPSG:3575":
        s = F.sin(lat * radians)
        q = F.lit(1 - E2) * (s / (1 - F.lit(E2) * s * s) - F.ln((1 - F.lit(E) * s) / (1 + F.lit(E) * s)) / F.lit(2 * E))
        rho = F.lit(A) * F.sqrt(F.greatest(F.lit(Q_POLE) - q, F.lit(0.0)))
        turn = (lng - 10) * radians
        x, y, extent = rho * F.sin(turn), -rho * F.cos(turn), ARCTIC_EXTENT
    else:
        phi = -lat * radians
        s = F.lit(E) * F.sin(phi)
        rho = F.lit(STEREO) * (F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2)))
        turn = lng * radians
        x, y, extent = rho * F.sin(turn), rho * F.cos(turn), ANTARCTIC_EXTENT
    k = pixels / (2 * extent)
    return (x + F.lit(extent)) * F.lit(k), F.lit(pixels) - (y + F.lit(extent)) * F.lit(k)


def pixel(epsg: str, tile_size: int, z: int, lat: Column, lng: Column) -> Column:
    """``struct<x:int,y:int>``, cut towards zero; null where the point is not on the map."""
    x, y = global_xy(epsg, tile_size, z, lat, lng)
    return F.when(plottable(epsg, lat, lng), F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def forward(epsg: str, tile_size: int, z: int, lat: float, lng: float) -> tuple[float, float]:
    """One point, as ``global_xy``."""
    pixels = float(tile_size << z)
    if epsg == "EPSG:3857":
        s = math.sin(lat * (math.pi / 180))
        return (lng + 180) / 360 * pixels, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * pixels
    if epsg == "EPSG:4326":
        return (lng + 180) * (pixels / 180), (-lat + 90) * (pixels / 180)
    if epsg == "EPSG:3575":
        rho, turn, extent, down = A * math.sqrt(max(Q_POLE - _q(math.radians(lat)), 0.0)), math.radians(lng - 10), ARCTIC_EXTENT, -1
    else:
        rho, turn, extent, down = STEREO * _t(math.radians(-lat)), math.radians(lng), ANTARCTIC_EXTENT, 1
    k = pixels / (2 * extent)
    return (rho * math.sin(turn) + extent) * k, pixels - (down * rho * math.cos(turn) + extent) * k


def inverse(epsg: str, tile_size: int, z: int, px: float, py: float) -> tuple[float, float]:
    """(latitude, longitude) of a pixel of any map; on a polar one a latitude of NaN beyond it."""
    pixels = float(tile_size << z)
    if epsg == "EPSG:3857":
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * py / pixels)))), px / pixels * 360 - 180
    if epsg == "EPSG:4326":
        return 90 - py / (pixels / 180), px / (pixels / 180) - 180
    extent = ARCTIC_EXTENT if epsg == "EPSG:3575" else ANTARCTIC_EXTENT
    x, y = px * 2 * extent / pixels - extent, (pixels - py) * 2 * extent / pixels - extent
    rho = math.hypot(x, y)
    if epsg == "EPSG:3575":
        lng = math.degrees(math.atan2(x, -y)) + 10
        target = Q_POLE - (rho / A) ** 2
        lat = _solve(_q, target, True) if target >= -Q_POLE else math.nan
    else:
        lng, lat = math.degrees(math.atan2(x, y)), -_solve(_t, rho / STEREO, False)
    return lat, lng - 360 if lng > 180 else lng + 360 if lng <= -180 else lng


def inverse_xy(epsg: str, tile_size: int, z: int, x: Column, y: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of pixels of the two maps whose inverse is an expression."""
    pixels = float(tile_size << z)
    if epsg == "EPSG:3857":
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / F.lit(pixels))))), x / F.lit(pixels) * 360 - 180
    if epsg == "EPSG:4326":
        return 90 - y / F.lit(pixels / 180), x / F.lit(pixels / 180) - 180
    raise ValueError("polar maps are inverted point by point, with inverse")


def _solve(f, target: float, rises: bool) -> float:
    """Degrees at which a monotonous function of the latitude has a value, by halving."""
    low, high = -math.pi / 2, math.pi / 2
    for _ in range(200):
        mid = (low + high) / 2
        if (f(mid) < target) == rises:
            low = mid
        else:
            high = mid
    return math.degrees((low + high) / 2)


def to_180(lng: float) -> float:
    return lng - 360 if lng > 180 else lng + 360 if lng < -180 else lng


def is_pole_tile(epsg: str, z: int, x: int, y: int) -> bool:
    half = (1 << z) // 2
    return SCHEMAS[epsg].polar and z > 0 and x in (half, half - 1) and y in (half, half - 1)


def tile_boundary(epsg: str, z: int, x: int, y: int, buffer: float = 0.0, tile_size: int = 512) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a tile with a buffer, in shares of a tile; on the driver, one tile a request."""
    if epsg == "EPSG:4326":
        degrees = 180 / (1 << z)
        more = buffer * degrees
        west = to_180(degrees * x - 180 - more)
        north = min(90 - degrees * y + more, 90)
        return west, max(north - degrees - 2 * more, -90), to_180(west + degrees + 2 * more), north
    if epsg == "EPSG:3857":
        if z == 0:
            buffer = 0
        lat = lambda row: min(MERCATOR_LIMIT, max(-MERCATOR_LIMIT, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / (1 << z)))))))
        lng = lambda column: to_180(column / (1 << z) * 360 - 180)
        return lng(x - buffer), lat(y + buffer + 1), lng(x + 1 + buffer), lat(y - buffer)
    return _polar_boundary(epsg, z, x, y, buffer, tile_size)


def _polar_boundary(epsg: str, z: int, x: int, y: int, buffer: float, size: int) -> tuple[float, float, float, float]:
    """The box around a tile's corners in longitude and latitude: two corners lie along a radius, two across it."""
    north = epsg == "EPSG:3575"
    if z == 0:
        return (-180.0, 0.0, 180.0, 90.0) if north else (-180.0, -90.0, 180.0, 0.0)
    seam, pole = (1 << z) // 2, is_pole_tile(epsg, z, x, y)

    def corner(right: bool, low: bool, grow: float) -> tuple[float, float]:
        lat, lng = inverse(epsg, size, z, (x + (1 + grow if right else -grow)) * size, (y + (1 + grow if low else -grow)) * size)
        return (-math.inf if north else math.inf) if math.isnan(lat) else lat, lng

    diagonal = (x < seam) == (y < seam)
    along = [corner(False, False, buffer), corner(True, True, buffer)] if diagonal else [corner(True, False, buffer), corner(False, True, buffer)]
    lats = [p[0] for p in along]
    south_edge, north_edge = (max(min(lats), 0.0), max(max(lats), 0.0)) if north else (min(min(lats), 0.0), min(max(lats), 0.0))
    if pole:
        south_edge, north_edge = (south_edge, 90.0) if north else (-90.0, north_edge)
    grow = 0.0 if pole else buffer
    inner = {(x < seam, y < seam)} if pole else set()  # the pole itself has no longitude
    lngs = sorted({to_180(round(corner(r, l, grow)[1], 9)) for r in (False, True) for l in (False, True) if (r, l) not in inner})
    # The narrowest arc that has all corners; at a pole tile a quarter of the circle.
    _, i = max(((lngs[(i + 1) % len(lngs)] - lngs[i]) % 360 or 360, i) for i in range(len(lngs)))
    west, east = lngs[(i + 1) % len(lngs)], lngs[i]
    if x < seam and east == 180:  # on the left half the antimeridian is the western edge
        west, east = -180.0, min(lngs, key=lambda v: (v == 180, v))
    return west, south_edge, east, north_edge
