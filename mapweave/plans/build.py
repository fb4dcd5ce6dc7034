"""The batch build of tiles and point lists, and the online query over what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import keys as K
from mapweave.functions import params
from mapweave.operators import binning, extent, mvt, pixels, raster, regression, tiles
from mapweave.sources import store
from mapweave.sources.occurrence import base_filter


def build(spark: SparkSession, occurrences: DataFrame, config: store.Config) -> store.Pointers:
    """Write tiles of large keys in every projection, point lists of the others, and the pointers to both.

    Everything goes to a folder of this run; readers see it once the pointers are renamed into place, and what
    these named before stays until it is retired. The filtered records are written once, the counted pixels
    once for each projection; kinds of keys are parts of these. Keys with at least the threshold of records are
    written too: their number is known then, and decides whether they are broadcast.
    """
    target = f"{config.directory()}/{uuid.uuid4().hex[:12]}"
    found = base_filter(occurrences)
    found = found.coalesce(config.input_files) if config.input_files else found
    found.write.option("maxRecordsPerFile", config.records_per_file).parquet(f"{target}/input")
    records = spark.read.parquet(f"{target}/input")
    keyed = pixels.keyed(records)
    pixels.large_keys(keyed, config.threshold).write.parquet(f"{target}/keys")
    large = spark.read.parquet(f"{target}/keys")
    n = large.count()
    taxon = F.col("mapKey").startswith(f"{K.TAXON}:")
    kinds = {"nonTaxon": ~taxon} | {c: F.col("mapKey").startswith(f"{K.TAXON}:{c}|") for c in config.checklists}
    wanted = F.lit(False)
    for part in kinds.values():
        wanted = wanted | part
    for epsg in config.projections:
        prepared = f"{target}/pixels/{epsg.replace(':', '_')}"
        chosen = pixels.with_keys(keyed.where(wanted), large, True, n)
        pixels.pixels(chosen, epsg, config.tile_size, config.max_zoom).write.parquet(prepared)
        for kind, part in kinds.items():
            levels = pixels.pyramid(spark.read.parquet(prepared).where(part), config.max_zoom)
            store.write_tiles(tiles.tiles(levels, epsg, config.tile_size, config.buffer), f"{target}/tiles", config.modulus, epsg, kind)
    store.write_points(pixels.points(pixels.with_keys(keyed, large, False, n)), f"{target}/points", config.modulus)
    return store.write_pointers(spark, pointers_of(config), store.Pointers(f"{target}/points", f"{target}/tiles", {c: f"{target}/tiles" for c in config.checklists}))


def pointers_of(config: store.Config) -> str:
    return f"{config.target}_pointers"


def served(spark: SparkSession, config: store.Config, epsg: str, z: int, x: int, y: int, request: dict[str, list[str]], key: str | None = None) -> DataFrame:
    """The rows that a request by parameters gets: one tile of a map, filtered, masked, and binned or flattened.

    Keys, years and bases come from the parameters, or the key as it is, tables from the pointers as they stand. A
    stored tile is read from its folder; a key that has none on this map is made from its point list.
    """
    pointers = store.read_pointers(spark, pointers_of(config))
    key, mask = (key, None) if key else params.map_keys(request)
    first = lambda name, other=None: (request.get(name) or [other])[0]

    def rows_of(k: str) -> DataFrame:
        rows = store.stored_tile(spark, pointers.table_of(k), epsg, k, z, x, y, config.modulus).select(*tiles.COLUMNS)
        if pointers.points and not rows.limit(1).count():
            listed = store.stored_points(spark, pointers.points, k, config.modulus)
            rows = tiles.point_tile(listed, k, epsg, z, x, y, config.tile_size, config.buffer).select(*tiles.COLUMNS)
        return tiles.filtered(rows, params.years(first("year")), request.get("basisOfRecord"))

    rows = rows_of(key)
    if mask:
        rows = tiles.masked(rows, rows_of(mask))
    return shaped(rows, first("bin"), first("verbose") == "true", int(first("hexPerTile", binning.HEX_PER_TILE)), int(first("squareSize", binning.SQUARE)), config.tile_size)


def served_bytes(spark: SparkSession, config: store.Config, epsg: str, z: int, x: int, y: int, request: dict[str, list[str]]) -> DataFrame:
    """``served`` as the bytes of a tile, no row where it is empty: points, or the polygons of bins, with their totals."""
    rows, kind = served(spark, config, epsg, z, x, y, request), (request.get("bin") or [None])[0]
    if kind:
        ring = binning.hex_ring(int((request.get("hexPerTile") or [binning.HEX_PER_TILE])[0])) if kind == "hex" else binning.square_ring(int((request.get("squareSize") or [binning.SQUARE])[0]))
        return mvt.encoded_polygons(rows.withColumn("ring", ring), binning.EXTENT)
    if "year" in rows.columns:  # a pixel's years as attributes beside its total
        place = [c for c in rows.columns if c not in ("year", "cnt", "total")]
        rows = rows.groupBy(*place, "total").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "cnt")))).alias("years"))
    point = F.array(F.struct(F.col("pixelX").alias("x"), F.col("pixelY").alias("y")))
    return mvt.encoded_polygons(rows.withColumn("ring", point), config.tile_size)


def served_trends(spark: SparkSession, config: store.Config, epsg: str, z: int, x: int, y: int, request: dict[str, list[str]], group: str, min_years: int = 2) -> DataFrame:
    """Trends by hexagon (q, r) of a request's map within the map with the key ``group``, from records fit for trends."""

    def yearly(key_request: dict[str, list[str]], key: str | None = None) -> DataFrame:
        asked = {k: v for k, v in key_request.items() if k in ("year", *params.MAP_TYPES, "checklistKey")} | {"bin": ["hex"], "verbose": ["true"], "basisOfRecord": list(regression.SUITABLE)}
        rows = served(spark, config, epsg, z, x, y, asked, key)
        return rows.where("year > 0").select("q", "r", "year", F.col("total").alias("n"))

    return regression.trends(yearly(request), yearly({k: v for k, v in request.items() if k == "year"}, group), ["q", "r"], min_years)


def served_image(spark: SparkSession, config: store.Config, epsg: str, z: int, x: int, y: int, request: dict[str, list[str]]) -> DataFrame:
    """``served`` as an image in the style that the request names; points only, no row where the tile is empty."""
    points = {k: v for k, v in request.items() if k not in ("bin", "verbose")}
    return raster.rendered(served(spark, config, epsg, z, x, y, points), (request.get("style") or [None])[0], config.tile_size)


def served_capabilities(spark: SparkSession, config: store.Config, request: dict[str, list[str]]) -> DataFrame:
    """What a request's map covers, from both hemispheres' tiles at zoom 0 in plate carree; years and bases aren't filtered."""
    pointers = store.read_pointers(spark, pointers_of(config))
    key, _ = params.map_keys(request)
    rows = None
    for x in (0, 1):
        one = store.stored_tile(spark, pointers.table_of(key), "EPSG:4326", key, 0, x, 0, config.modulus).select(*tiles.COLUMNS)
        if pointers.points and not one.limit(1).count():
            one = tiles.point_tile(store.stored_points(spark, pointers.points, key, config.modulus), key, "EPSG:4326", 0, x, 0, config.tile_size, config.buffer).select(*tiles.COLUMNS)
        rows = one if rows is None else rows.unionByName(one)
    return extent.capabilities(rows, config.tile_size)


def tile_json(spark: SparkSession, config: store.Config, kind: str, key: str) -> DataFrame:
    """A map's extent as the first interface asked for it and answers: one JSON document."""
    name = params.V1_TYPES.get(kind)
    return extent.as_json(extent.first_interface(served_capabilities(spark, config, {name: [key]} if name else {})))


def density_tile(prepared: DataFrame, listed: DataFrame | None, key: str, epsg: str, z: int, x: int, y: int, years=(None, None), bases=None, verbose: bool = False, mask: str | None = None, bin: str | None = None, hex_per_tile: int = binning.HEX_PER_TILE, square: int = binning.SQUARE, size: int = 512, buffer: int = 64) -> DataFrame:
    """One tile of one map: prepared rows or else those of the point list, filtered, masked, and binned or flattened."""

    def rows_of(k: str) -> DataFrame:
        rows = tiles.one_tile(prepared, k, z, x, y).select(*tiles.COLUMNS)
        if listed is not None:
            rows = tiles.tiles_or_points(rows, tiles.point_tile(listed, k, epsg, z, x, y, size, buffer).select(*tiles.COLUMNS))
        return tiles.filtered(rows, years, bases)

    rows = rows_of(key)
    if mask:
        rows = tiles.masked(rows, rows_of(mask))
    return shaped(rows, bin, verbose, hex_per_tile, square, size)


def shaped(rows: DataFrame, bin: str | None, verbose: bool, hex_per_tile: int = binning.HEX_PER_TILE, square: int = binning.SQUARE, size: int = 512) -> DataFrame:
    """A tile's rows in bins, or flattened."""
    if bin == "hex":
        return binning.hex_bins(rows, hex_per_tile, size, verbose)
    if bin == "square":
        return binning.square_bins(rows, square, size)
    if bin:
        raise ValueError("bins are hex or square")
    return tiles.flattened(rows, verbose)


def capabilities(prepared: DataFrame, key: str) -> DataFrame:
    """Extents of a map, from both hemispheres' tiles at zoom 0 in plate carree."""
    return extent.capabilities(prepared.where((F.col("mapKey") == key) & (F.col("z") == 0)))
