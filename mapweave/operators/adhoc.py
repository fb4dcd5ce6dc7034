"""Maps of any filtered set of records on a grid made at query time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.projection import SCHEMAS, global_xy, is_pole_tile, plottable, tile_boundary
from mapweave.functions.tiling import local_xy
from mapweave.operators import binning, mvt

#: Cells a request returns at most, as a search index does; the largest stay.
BUCKET_LIMIT = 10_000


def in_box(west: float, south: float, east: float, north: float) -> Column:
    """Records in a box, which goes over the date line if its west is beyond its east."""
    lat, lng = F.col("decimalLatitude"), F.col("decimalLongitude")
    across = (lng >= west) | (lng <= east) if west > east else lng.between(west, east)
    return lat.between(south, north) & across


def grid_cells(occurrences: DataFrame, precision: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(cellX, cellY, count, centroid, bounds, and the extent of its records) of the geohash-like grid with ``precision`` bits on each axis.

    Cells halve the world's longitudes and latitudes ``precision`` times; a box without area has none.
    """
    if box and (box[0] == box[2] or box[1] == box[3]):
        return grid_cells(occurrences.limit(0), precision)
    rows = occurrences.where(in_box(*box)) if box else occurrences
    n = 1 << precision
    cell = lambda v, low, span: F.least(F.floor((v - low) / F.lit(span / n)), F.lit(n - 1)).cast("int")
    rows = rows.select(cell(F.col("decimalLongitude"), -180.0, 360.0).alias("cellX"), cell(F.col("decimalLatitude"), -90.0, 180.0).alias("cellY"), "decimalLatitude", "decimalLongitude")
    out = rows.groupBy("cellX", "cellY").agg(F.count("*").alias("total"), F.avg("decimalLatitude").alias("lat"), F.avg("decimalLongitude").alias("lng"), *(f(f"decimal{c}").alias(f"{f.__name__}{c}") for c in ("Latitude", "Longitude") for f in (F.min, F.max)))
    edge = lambda c, low, span: F.lit(low) + c * F.lit(span / n)
    return out.select("cellX", "cellY", "total", "lat", "lng", "minLatitude", "maxLatitude", "minLongitude", "maxLongitude", edge(F.col("cellX"), -180.0, 360.0).alias("west"), edge(F.col("cellY"), -90.0, 180.0).alias("south"), edge(F.col("cellX") + 1, -180.0, 360.0).alias("east"), edge(F.col("cellY") + 1, -90.0, 180.0).alias("north"))


def bounds(occurrences: DataFrame, precision: int, box=None) -> DataFrame:
    return grid_cells(occurrences, precision, box).select("cellX", "cellY", "total", "west", "south", "east", "north")


def centroids(occurrences: DataFrame, precision: int, box=None) -> DataFrame:
    return grid_cells(occurrences, precision, box).select("cellX", "cellY", "total", "lat", "lng")


def largest(cells: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    return cells.orderBy(F.desc("total"), "cellX", "cellY").limit(limit)


def request_boxes(epsg: str, z: int, x: int, y: int, buffer: float = 0.125) -> list[tuple[float, float, float, float]]:
    """The boxes that together cover a tile: one, or the four tiles around the pole for a tile that touches it."""
    if not is_pole_tile(epsg, z, x, y):
        return [tile_boundary(epsg, z, x, y, buffer)]
    left, top = (0 if z == 1 else (v + 1) // 2 * 2 - 1 for v in (x, y))
    return [tile_boundary(epsg, z, left + i, top + j, buffer) for i in (0, 1) for j in (0, 1)]


def near_tile(epsg: str, z: int, x: int, y: int, buffer: float = 0.125) -> Column:
    """Whether a record can be on a tile or in its buffer: comparisons on bare columns, which reach the scan."""
    inside = F.lit(False)
    for box in request_boxes(epsg, z, x, y, buffer):
        inside = inside | in_box(*box)
    return inside


def tile(occurrences: DataFrame, epsg: str, z: int, x: int, y: int, precision: int, predicate: Column | None = None, buffer: float = 0.125) -> DataFrame:
    """Grid cells of the records of a tile that meet a predicate; a record in several boxes counts once."""
    rows = occurrences if predicate is None else occurrences.where(predicate)
    return grid_cells(rows.where(near_tile(epsg, z, x, y, buffer)), precision)


def box_text(box: tuple[float, float, float, float]) -> str:
    """A box as search parameters have it: ``west,south,east,north``."""
    return ",".join(repr(float(v)) for v in box)


def shapes(cells: DataFrame, epsg: str, z: int, x: int, y: int, size: int = 512, buffer: int = 64, centroids: bool = False) -> DataFrame:
    """(z, tileX, tileY, ring, centreX, centreY, total): cells as seen from one tile.

    A cell's ring is the rectangle around its records, and one point where that has no area; with ``centroids``
    always the point of their mean position. Corners that the map does not show are left out with their cell.
    """

    def placed(lat: str, lng: str) -> tuple[Column, Column]:
        gx, gy = global_xy(epsg, size, z, F.col(lat), F.col(lng))
        return local_xy(epsg, z, gx, gy, F.lit(x), F.lit(y), size, buffer)

    on_map = lambda lat, lng: plottable(epsg, F.col(lat), F.col(lng))
    if centroids:
        px, py = placed("lat", "lng")
        rows = cells.where(on_map("lat", "lng")).select("total", px.alias("x0"), py.alias("y0"), px.alias("x1"), py.alias("y1"))
    else:
        (x0, y0), (x1, y1) = placed("maxLatitude", "minLongitude"), placed("minLatitude", "maxLongitude")
        rows = cells.where(on_map("maxLatitude", "minLongitude") & on_map("minLatitude", "maxLongitude")).select("total", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    centre = [F.col("x0") + (F.col("x1") - F.col("x0")) / 2, F.col("y0") + (F.col("y1") - F.col("y0")) / 2]
    corners = [(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    flat = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    return rows.select(F.lit(z).alias("z"), F.lit(x).alias("tileX"), F.lit(y).alias("tileY"), F.when(flat, binning.ring([tuple(centre)])).otherwise(binning.ring(corners)).alias("ring"), centre[0].alias("centreX"), centre[1].alias("centreY"), "total")


def encoded(cells: DataFrame, epsg: str, z: int, x: int, y: int, bin: str | None = None, mode: str = "bounds", per_tile: int = binning.HEX_PER_TILE, square: int = binning.SQUARE, size: int = 512, buffer: int = 64) -> DataFrame:
    """The bytes of one tile of an ad-hoc map: no row where the tile is empty.

    ``mode`` is ``bounds`` or ``centroid``; ``bin`` none, ``hex`` or ``square``, which count cells by their centres.
    """
    if mode not in ("bounds", "centroid") or bin not in (None, "hex", "square"):
        raise ValueError("modes are bounds and centroid, bins are hex and square")
    rows = shapes(cells, epsg, z, x, y, size, buffer, mode == "centroid")
    if bin is None:
        return mvt.encoded_polygons(rows, size)
    whole = lambda c: F.floor(F.col(c) + F.lit(0.5)).cast("int")
    at = rows.select("z", "tileX", "tileY", whole("centreX").alias("pixelX"), whole("centreY").alias("pixelY"), F.col("total").alias("cnt"))
    if bin == "hex":
        return mvt.encoded_polygons(binning.hex_bins(at, per_tile, size).withColumn("ring", binning.hex_ring(per_tile)), binning.EXTENT)
    return mvt.encoded_polygons(binning.square_bins(at, square, size).withColumn("ring", binning.square_ring(square)), binning.EXTENT)


#: The digits of a geohash.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lng: Column, length: int) -> Column:
    """The geohash of a position: bits of longitude and latitude by turns, five to a digit."""
    n_lng, n_lat = (5 * length + 1) // 2, 5 * length // 2
    cut = lambda v, low, span, n: F.least(F.floor((v - low) / F.lit(span / (1 << n))), F.lit((1 << n) - 1)).cast("long")
    x, y = cut(lng, -180.0, 360.0, n_lng), cut(lat, -90.0, 180.0, n_lat)
    bit = lambda v, n, k: F.call_function("shiftright", v, F.lit(n - 1 - k)).bitwiseAND(1)
    digits = []
    for d in range(length):
        value = F.lit(0).cast("long")
        for k in range(5 * d, 5 * d + 5):
            value = value * 2 + (bit(x, n_lng, k // 2) if k % 2 == 0 else bit(y, n_lat, k // 2))
        digits.append(F.substr(F.lit(GEOHASH), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)


def geohash_cells(occurrences: DataFrame, length: int) -> DataFrame:
    """(geohash, total, lat, lng): counts and mean positions of the records of each geohash cell."""
    hashed = occurrences.select(geohash(F.col("decimalLatitude"), F.col("decimalLongitude"), length).alias("geohash"), "decimalLatitude", "decimalLongitude")
    return hashed.groupBy("geohash").agg(F.count("*").alias("total"), F.avg("decimalLatitude").alias("lat"), F.avg("decimalLongitude").alias("lng"))


def tiles_wide(epsg: str, z: int) -> int:
    return SCHEMAS[epsg].wide << z


class Predicates:
    """Saved conditions by a hash of their SQL, for requests that name one."""

    def __init__(self) -> None:
        self.saved: dict[str, str] = {}

    def save(self, sql: str) -> str:
        import hashlib

        key = hashlib.sha256(sql.encode()).hexdigest()[:16]
        self.saved[key] = sql
        return key

    def get(self, key: str) -> Column:
        return F.expr(self.saved[key])
