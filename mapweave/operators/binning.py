"""Hexagon and square bins of tile pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.tiles import without_buffer

EXTENT, HEX_PER_TILE, SQUARE = 4096, 51, 16
#: Fixed value: hexagons that a tile's grid has beyond those across the tile.
GRID_MARGIN = 8


def hex_size(per_tile: int = HEX_PER_TILE, extent: int = EXTENT) -> tuple[float, float]:
    """Radius and height of a flat-top hexagon of which so many lie across a tile."""
    width = extent / (1.5 * (per_tile + 1) / 2)
    return width / 2, math.sqrt(3) / 2 * width


def hex_cell(x: Column, y: Column, per_tile: int = HEX_PER_TILE, extent: int = EXTENT) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon nearest to a global position, with a centre on the map's corner."""
    radius, height = hex_size(per_tile, extent)
    q = x / F.lit(1.5 * radius)
    r = y / F.lit(height) - q / 2
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr).cast("long")


def on_grid(q: Column, r: Column, tile_x: Column, tile_y: Column, per_tile: int = HEX_PER_TILE, extent: int = EXTENT) -> Column:
    """Whether a hexagon is on its tile's grid: a rectangle of columns and rows that begins a little before the tile's corner.

    The grid lies on the lattice of the whole map, moved by a whole number of periods for each tile. Which columns it has
    follows from remainders of doubles, rounding included, so these are taken as they are.
    """
    radius, height = hex_size(per_tile, extent)
    width = 2 * radius
    across, down = per_tile + (per_tile + 1) % 2 + GRID_MARGIN, math.ceil(extent / height) + GRID_MARGIN
    corner_x, corner_y = tile_x * F.lit(float(extent)), tile_y * F.lit(float(extent))
    x = q * F.lit(1.5 * radius) - corner_x + corner_x % F.lit(1.5 * width) + F.lit(1.25 * width)
    y = (r + q / 2) * F.lit(height) - corner_y + corner_y % F.lit(height) + F.lit(2 * height)
    column = F.floor((x - F.lit(radius)) / F.lit(1.5 * radius) + F.lit(0.5))
    row = F.floor((y - F.lit(height / 2) * (1 + F.pmod(column, F.lit(2)))) / F.lit(height) + F.lit(0.5))
    return column.between(0, across - 1) & row.between(0, down - 1)


def hex_bins(rows: DataFrame, per_tile: int = HEX_PER_TILE, size: int = 512, yearly: bool = False) -> DataFrame:
    """Totals per hexagon of a tile, pixels of its buffer included where they are on its grid; ``yearly`` adds a row per year."""
    scale = EXTENT / size
    x = F.col("tileX") * F.lit(float(EXTENT)) + F.col("pixelX") * F.lit(scale)
    y = F.col("tileY") * F.lit(float(EXTENT)) + F.col("pixelY") * F.lit(scale)
    q, r = hex_cell(x, y, per_tile)
    placed = rows.withColumns({"q": q, "r": r})
    return placed.where(on_grid(F.col("q"), F.col("r"), F.col("tileX"), F.col("tileY"), per_tile)).groupBy("z", "tileX", "tileY", "q", "r", *(["year"] if yearly else [])).agg(F.sum("cnt").alias("total"))


def hex_polygon(q: int, r: int, per_tile: int = HEX_PER_TILE) -> list[tuple[float, float]]:
    """Six corners and the first again, in global positions."""
    radius, height = hex_size(per_tile)
    cx, cy = 1.5 * radius * q, height * (r + q / 2)
    corners = [(cx + radius * math.cos(math.pi / 3 * k), cy + radius * math.sin(math.pi / 3 * k)) for k in range(6)]
    return [*corners, corners[0]]


def ring(corners: list[tuple[Column, Column]]) -> Column:
    """Corners as an array of whole x and y, halves rounded up."""
    whole = lambda v: F.floor(v + F.lit(0.5)).cast("int")
    return F.array(*(F.struct(whole(x).alias("x"), whole(y).alias("y")) for x, y in corners))


def hex_ring(per_tile: int = HEX_PER_TILE) -> Column:
    """Six corners of the hexagon (q, r), counted from the corner of the tile (tileX, tileY)."""
    radius, height = hex_size(per_tile)
    x = F.col("q") * F.lit(1.5 * radius) - F.col("tileX") * F.lit(float(EXTENT))
    y = (F.col("r") + F.col("q") / 2) * F.lit(height) - F.col("tileY") * F.lit(float(EXTENT))
    return ring([(x + F.lit(radius * math.cos(math.pi / 3 * k)), y + F.lit(radius * math.sin(math.pi / 3 * k))) for k in range(6)])


def square_ring(square: int = SQUARE) -> Column:
    """Four corners of the cell (cellX, cellY)."""
    x, y = F.col("cellX") * square, F.col("cellY") * square
    return ring([(x, y), (x + square, y), (x + square, y + square), (x, y + square)])


def square_bins(rows: DataFrame, square: int = SQUARE, size: int = 512) -> DataFrame:
    """Totals per square cell of a tile, its buffer left out."""
    if square < 1 or square > EXTENT or square & (square - 1):
        raise ValueError("a square's size is a power of two up to 4096")
    cell = lambda c: F.floor(F.col(c) * (EXTENT // size) / square).cast("int")
    return without_buffer(rows, size).groupBy("z", "tileX", "tileY", cell("pixelX").alias("cellX"), cell("pixelY").alias("cellY")).agg(F.sum("cnt").alias("total"))


def cell_key(cell_x: Column, cell_y: Column) -> Column:
    """A square cell as one number; ``cell_of`` takes it apart."""
    return F.call_function("shiftleft", cell_x.cast("long"), F.lit(32)).bitwiseOR(cell_y.cast("long"))


def cell_of(key: Column) -> tuple[Column, Column]:
    return F.call_function("shiftright", key, F.lit(32)).cast("int"), key.bitwiseAND(0xFFFFFFFF).cast("int")
