"""Tile addresses of global pixels, with neighbours' buffers. Zoom may be a number or a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.projection import SCHEMAS

ADDRESS = "array<struct<tileX:int,tileY:int,pixelX:int,pixelY:int>>"


def tiles_across(n: int, z: int | Column) -> Column:
    """``n * 2**z``."""
    return F.lit(n << z) if isinstance(z, int) else F.call_function("shiftleft", F.lit(n), z)


def tile_xy(epsg: str, z: int | Column, x: Column, y: Column, size: int) -> tuple[Column, Column]:
    """Address of the tile that holds a pixel, held to the map."""
    s = SCHEMAS[epsg]
    at = lambda v, n: F.least(F.greatest(F.floor(v / size), F.lit(0)), tiles_across(n, z) - 1).cast("int")
    return at(x, s.wide), at(y, s.high)


def local_xy(epsg: str, z: int | Column, x: Column, y: Column, tx: Column, ty: Column, size: int, buffer: int) -> tuple[Column, Column]:
    """The pixel counted from a tile's corner, cut down; beyond the date line where it is in that buffer."""
    s = SCHEMAS[epsg]
    across = x - tx * size
    if s.wraps:
        tiles = tiles_across(s.wide, z)
        pixels = tiles * size
        wrapped = F.when((tx == 0) & (x >= pixels - buffer), x - pixels).when((tx == tiles - 1) & (x < buffer), x + pixels - tx * size).otherwise(across)
        if s.wide > 1:
            across = wrapped
        elif isinstance(z, int):  # the single tile of zoom 0 is its own neighbour
            across = wrapped if z > 0 else across
        else:
            across = F.when(z > 0, wrapped).otherwise(across)
    return F.floor(across).cast("int"), F.floor(y - ty * size).cast("int")


def buffered_addresses(epsg: str, z: int | Column, x: Column, y: Column, size: int, buffer: int, clip: bool = True) -> Column:
    """Distinct (tile, local pixel) of a pixel: its own tile, and neighbours in whose buffer it lies.

    Neighbours wrap in both axes, which gives pixels far off their tile; ``clip`` drops these, and keeps
    what an encoder with this buffer keeps (both ends included).
    """
    s = SCHEMAS[epsg]
    tx, ty = tile_xy(epsg, z, x, y, size)
    px, py = local_xy(epsg, z, x, y, tx, ty, size, buffer)
    wide, high = tiles_across(s.wide, z), tiles_across(s.high, z)
    near = {-1: lambda v: v < buffer, 0: lambda v: F.lit(True), 1: lambda v: v >= size - buffer}
    found = []
    for dy in (0, -1, 1):
        for dx in (0, -1, 1):
            nx, ny = F.pmod(tx + dx, wide), F.pmod(ty + dy, high)
            lx, ly = local_xy(epsg, z, x, y, nx, ny, size, buffer)
            address = F.struct(nx.cast("int").alias("tileX"), ny.cast("int").alias("tileY"), lx.alias("pixelX"), ly.alias("pixelY"))
            found.append(F.when(near[dx](px) & near[dy](py), address))
    out = F.array_distinct(F.array_compact(F.array(*found)))
    inside = lambda v: v.between(-buffer, size + buffer)
    out = F.filter(out, lambda a: inside(a.pixelX) & inside(a.pixelY)) if clip else out
    # Most pixels are in no neighbour's buffer, and at one tile wide their own tile is their neighbour: nothing to look up.
    amid = px.between(buffer, size - buffer - 1) & py.between(buffer, size - buffer - 1)
    return F.when(amid, F.array(F.struct(tx.alias("tileX"), ty.alias("tileY"), px.alias("pixelX"), py.alias("pixelY")))).otherwise(out)


def tile_contains(epsg: str, z: int, tx: int, ty: int, x: Column, y: Column, size: int, buffer: int) -> Column:
    """Whether a pixel lies on a tile or in its buffer, beyond the date line too."""
    s = SCHEMAS[epsg]
    pixels = (s.wide << z) * size
    beside = x.between(tx * size - buffer, tx * size + size + buffer)
    if s.wraps and (z > 0 or s.wide > 1):
        if tx == 0:
            beside = beside | (x >= pixels - buffer)
        if tx == (s.wide << z) - 1:
            beside = beside | (x < buffer)
    return beside & y.between(ty * size - buffer, ty * size + size + buffer)
