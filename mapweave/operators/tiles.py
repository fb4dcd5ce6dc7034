"""Tiles as rows, and the queries on them: filters, masks, flattening and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.projection import global_xy, plottable
from mapweave.functions.tiling import buffered_addresses, local_xy, tile_contains
from mapweave.operators.pixels import unpacked

COLUMNS = ("mapKey", "z", "tileX", "tileY", "pixelX", "pixelY", "bor", "year", "cnt")


def tiles(levels: DataFrame, epsg: str, size: int = 512, buffer: int = 64) -> DataFrame:
    """(mapKey, z, tileX, tileY, pixelX, pixelY, bor, year, cnt), buffers included and clipped."""
    at = buffered_addresses(epsg, F.col("z"), F.col("x"), F.col("y"), size, buffer)
    rows = levels.select("mapKey", "z", "borYear", "occCount", F.inline(at))
    return unpacked(rows).select(*COLUMNS)


def one_tile(prepared: DataFrame, key: str, z: int, x: int, y: int) -> DataFrame:
    """Rows of one tile among rows of many; of a written layout ``store.stored_tile`` reads one folder only."""
    return prepared.where((F.col("mapKey") == key) & (F.col("z") == z) & (F.col("tileX") == x) & (F.col("tileY") == y))


def point_tile(listed: DataFrame, key: str, epsg: str, z: int, x: int, y: int, size: int = 512, buffer: int = 64) -> DataFrame:
    """Rows of a tile made from a point list, projected once and then filtered."""
    lat, lng = F.col("lat"), F.col("lng")
    gx, gy = global_xy(epsg, size, z, lat, lng)
    rows = listed.where((F.col("mapKey") == key) & plottable(epsg, lat, lng)).select("mapKey", "borYear", "occCount", gx.alias("gx"), gy.alias("gy"))
    rows = rows.where(tile_contains(epsg, z, x, y, F.col("gx"), F.col("gy"), size, buffer))
    px, py = local_xy(epsg, z, F.col("gx"), F.col("gy"), F.lit(x), F.lit(y), size, buffer)
    return unpacked(rows.select("mapKey", F.lit(z).alias("z"), F.lit(x).alias("tileX"), F.lit(y).alias("tileY"), px.alias("pixelX"), py.alias("pixelY"), "borYear", "occCount"))


def from_points(listed: DataFrame, epsg: str, z: int, size: int = 512, buffer: int = 64) -> DataFrame:
    """Rows of all tiles of a zoom made from point lists, without a pyramid."""
    lat, lng = F.col("lat"), F.col("lng")
    gx, gy = global_xy(epsg, size, z, lat, lng)
    placed = listed.where(plottable(epsg, lat, lng)).select("mapKey", F.lit(z).alias("z"), gx.cast("int").alias("x"), gy.cast("int").alias("y"), "borYear", "occCount")
    return tiles(placed.groupBy("mapKey", "z", "x", "y", "borYear").agg(F.sum("occCount").alias("occCount")), epsg, size, buffer)


def in_years(year: Column, low: int | None, high: int | None) -> Column:
    """Inclusive, open where an end is None; a null year passes only an unbounded range."""
    out = F.lit(True)
    if low is not None:
        out = out & (year >= low)
    if high is not None:
        out = out & (year <= high)
    return F.coalesce(out, F.lit(low is None and high is None))


def filtered(rows: DataFrame, years: tuple[int | None, int | None] = (None, None), bases: list[str] | None = None) -> DataFrame:
    """By year and basis of record; no bases, or an empty list, keep all. Undated records are year 0."""
    out = rows.where(in_years(F.col("year"), *years))
    return out.where(F.col("bor").isin([b.upper() for b in bases])) if bases else out


def flattened(rows: DataFrame, verbose: bool = False) -> DataFrame:
    """Counts per pixel over all bases of record; ``verbose`` adds a row per year."""
    place = [c for c in ("mapKey", "z", "tileX", "tileY", "pixelX", "pixelY") if c in rows.columns]
    total = rows.groupBy(*place).agg(F.sum("cnt").alias("total"))
    if not verbose:
        return total
    yearly = rows.groupBy(*place, "year").agg(F.sum("cnt").alias("cnt"))
    return yearly.join(total, place)


def masked(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows on pixels that the mask has too; counts on a shared pixel stay whole."""
    return rows.join(mask.select("tileX", "tileY", "pixelX", "pixelY").distinct(), ["tileX", "tileY", "pixelX", "pixelY"], "left_semi")


def tiles_or_points(prepared: DataFrame, from_points: DataFrame) -> DataFrame:
    """Prepared rows, and for keys without any those made from points."""
    return prepared.unionByName(from_points.join(prepared.select("mapKey").distinct(), "mapKey", "left_anti"))


def without_buffer(rows: DataFrame, size: int = 512) -> DataFrame:
    return rows.where(F.col("pixelX").between(0, size - 1) & F.col("pixelY").between(0, size - 1))


def heat_children(levels: DataFrame, size: int = 512) -> DataFrame:
    """Totals of a tile's four children under their parent's address: (mapKey, z, tileX, tileY, childX, childY, total)."""
    child = lambda c: F.floor(F.col(c) / size).cast("int")
    rows = levels.select("mapKey", (F.col("z") - 1).alias("z"), child("x").alias("childX"), child("y").alias("childY"), "occCount").where(F.col("z") >= 0)
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(1))
    return rows.groupBy("mapKey", "z", up("childX").alias("tileX"), up("childY").alias("tileY"), "childX", "childY").agg(F.sum("occCount").alias("total"))


def years_by_basis(rows: DataFrame) -> DataFrame:
    """One row per pixel and basis of record with a map of counts by year, as a stored tile has them."""
    yearly = rows.groupBy(*COLUMNS[:-2], "year").agg(F.sum("cnt").alias("cnt"))
    return yearly.groupBy(*COLUMNS[:-2]).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "cnt")))).alias("years"))


def readdressed(rows: DataFrame, tile_x: int, tile_y: int, size: int = 512, buffer: int = 64) -> DataFrame:
    """Rows of neighbouring tiles as seen from one tile, clipped to its buffer."""
    moved = rows.withColumns({"pixelX": F.col("pixelX") + (F.col("tileX") - tile_x) * size, "pixelY": F.col("pixelY") + (F.col("tileY") - tile_y) * size, "tileX": F.lit(tile_x), "tileY": F.lit(tile_y)})
    return moved.where(F.col("pixelX").between(-buffer, size + buffer) & F.col("pixelY").between(-buffer, size + buffer))
