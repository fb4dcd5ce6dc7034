"""Records to counted pixels, large and small keys, points, and the zoom pyramid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import keys as K
from mapweave.functions.projection import MAX_ZOOM, pixel

#: Keys up to this many are broadcast to filter; more are joined by Spark's own choice.
BROADCAST_KEYS = 200_000
#: Levels whose cells of 2**SPLIT pixels stay together while they are summed up.
SPLIT = 8


def keyed(occurrences: DataFrame, keys=None) -> DataFrame:
    """One row per record and map key."""
    kept = ("decimalLatitude", "decimalLongitude", "basisOfRecord", "year")
    return occurrences.select(*(c for c in kept if c in occurrences.columns), F.explode(K.map_keys() if keys is None else keys).alias("mapKey"))


def key_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mapKey").agg(F.count("*").alias("n"))


def large_keys(rows: DataFrame, threshold: int) -> DataFrame:
    """Keys with at least ``threshold`` records, which get tiles; the others get point lists."""
    return key_counts(rows).where(F.col("n") >= threshold)


def with_keys(rows: DataFrame, keys: DataFrame, allow: bool, counted: int | None = None) -> DataFrame:
    """Rows whose key is, or is not, among ``keys``; broadcast only where ``counted`` says that they are few."""
    chosen = keys.select("mapKey")
    if counted is not None and counted <= BROADCAST_KEYS:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, "mapKey", "left_semi" if allow else "left_anti")


def dictionary(keys: DataFrame) -> DataFrame:
    """Keys with dense numbers in key order, from 0.

    Meant for large keys: each has at least the threshold of records, so there are at most as many as
    records by key over the threshold, and one ordered window holds them.
    """
    return keys.select("mapKey").distinct().select("mapKey", (F.row_number().over(Window.orderBy("mapKey")) - 1).cast("int").alias("code"))


def hemisphere(epsg: str) -> Column:
    """A comparison on the bare latitude, which reaches the scan: what a polar map can show, and a degree more."""
    lat = F.col("decimalLatitude")
    return lat > -1 if epsg == "EPSG:3575" else lat < 1 if epsg == "EPSG:3031" else F.lit(True)


def pixels(rows: DataFrame, epsg: str, tile_size: int = 512, zoom: int = MAX_ZOOM) -> DataFrame:
    """(mapKey, x, y, borYear, occCount) at one zoom; records off the map or of an unknown basis are left out."""
    rows = rows.where(hemisphere(epsg))
    at = pixel(epsg, tile_size, zoom, F.col("decimalLatitude"), F.col("decimalLongitude"))
    placed = rows.select("mapKey", at.alias("xy"), K.encode_bor_year(F.col("basisOfRecord"), F.col("year")).alias("borYear"))
    placed = placed.where(F.col("xy").isNotNull() & F.col("borYear").isNotNull()).select("mapKey", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"), "borYear")
    return placed.groupBy("mapKey", "x", "y", "borYear").agg(F.count("*").alias("occCount"))


def pyramid(at_zoom: DataFrame, zoom: int = MAX_ZOOM, lowest: int = 0) -> DataFrame:
    """(mapKey, z, x, y, borYear, occCount) for every zoom down to ``lowest``, from pixels at ``zoom``.

    Rows are dealt once by key and coarse cell, so that the most popular key is spread over the map, and
    all levels down to that cell are summed where they are. Only the sums of one level are dealt again,
    for the few coarse levels below it.
    """
    down = lambda c, n: F.call_function("shiftright", c, n)
    split = max(lowest, zoom - SPLIT)
    cells = at_zoom.withColumns({"cx": down(F.col("x"), F.lit(zoom - split)), "cy": down(F.col("y"), F.lit(zoom - split))}).repartition("mapKey", "cx", "cy")
    levels = cells.withColumn("z", F.explode(F.sequence(F.lit(split), F.lit(zoom))))
    fine = levels.select("mapKey", "cx", "cy", "z", down(F.col("x"), zoom - F.col("z")).alias("x"), down(F.col("y"), zoom - F.col("z")).alias("y"), "borYear", "occCount")
    fine = fine.groupBy("mapKey", "cx", "cy", "z", "x", "y", "borYear").agg(F.sum("occCount").alias("occCount")).drop("cx", "cy")
    if split == lowest:
        return fine
    base = cells.groupBy("mapKey", F.col("cx").alias("x"), F.col("cy").alias("y"), "borYear").agg(F.sum("occCount").alias("occCount"))
    coarse = base.withColumn("z", F.explode(F.sequence(F.lit(lowest), F.lit(split - 1))))
    coarse = coarse.select("mapKey", "z", down(F.col("x"), split - F.col("z")).alias("x"), down(F.col("y"), split - F.col("z")).alias("y"), "borYear", "occCount")
    coarse = coarse.groupBy("mapKey", "z", "x", "y", "borYear").agg(F.sum("occCount").alias("occCount"))
    return fine.unionByName(coarse)


def points(rows: DataFrame, legacy_counts: bool = False) -> DataFrame:
    """(mapKey, lat, lng, borYear, occCount): the lists of small keys, with real counts.

    With ``legacy_counts`` every place, basis and year counts once, as older lists had it.
    """
    packed = rows.select("mapKey", F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lng"), K.encode_bor_year(F.col("basisOfRecord"), F.col("year")).alias("borYear"))
    count = F.lit(1).cast("long") if legacy_counts else F.count("*")
    return packed.where(F.col("borYear").isNotNull()).groupBy("mapKey", "lat", "lng", "borYear").agg(count.alias("occCount"))


def unpacked(counted: DataFrame) -> DataFrame:
    """``borYear`` as columns ``bor`` and ``year``, and the count as ``cnt``."""
    return counted.withColumns({"bor": K.decode_bor(F.col("borYear")), "year": K.decode_year(F.col("borYear"))}).withColumnRenamed("occCount", "cnt").drop("borYear")
