"""What a map covers: bounds, years, totals, and the narrowest span of longitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.projection import MERCATOR_LIMIT
from mapweave.operators.tiles import without_buffer

#: Longitudes are compared in whole parts of a degree.
PARTS = 512


def centred_spread(values: DataFrame, period: int, column: str = "v") -> DataFrame:
    """(left, right) of the narrowest span of a circle that has all distinct values; no row if there are none.

    It leaves out the largest gap; of equal gaps the last. There are at most ``period`` distinct values,
    so the one ordered window is bounded however many rows there are.
    """
    distinct = values.select(F.col(column).cast("long").alias("v")).where(F.col("v").isNotNull()).distinct()
    ordered = Window.orderBy("v")
    whole = Window.partitionBy()
    after = distinct.select("v", F.lead("v").over(ordered).alias("next"), F.row_number().over(ordered).alias("at"), F.min("v").over(whole).alias("first"))
    gaps = after.select("v", "at", F.coalesce("next", "first").alias("next"), (F.coalesce(F.col("next"), F.col("first") + period) - F.col("v")).alias("gap"))
    return gaps.agg(F.max_by(F.struct(F.col("next").alias("left"), F.col("v").alias("right")), F.struct("gap", "at")).alias("s")).where(F.col("s").isNotNull()).select("s.left", "s.right")


def capabilities(rows: DataFrame, size: int = 512) -> DataFrame:
    """One row of bounds, years and total, from the plate carree tiles of zoom 0; years and bases aren't filtered.

    Latitudes are floored and ceiled, and an empty map gets the whole world. Year 0 is no year.
    """
    inside = without_buffer(rows, size)
    lng = F.lit(-180.0) + F.lit(180.0) * F.col("tileX") + F.lit(180.0) * F.col("pixelX") / size
    lat = F.lit(90.0) - F.lit(180.0) * F.col("pixelY") / size
    located = inside.select(lat.alias("lat"), F.floor(lng * PARTS + 0.5).alias("v"), F.when(F.col("year") > 0, F.col("year")).alias("year"), "cnt")
    spread = centred_spread(located, 360 * PARTS)
    total = located.agg(F.min("lat").alias("low"), F.max("lat").alias("high"), F.min("year").alias("minYear"), F.max("year").alias("maxYear"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
    both = total.join(F.broadcast(spread), F.lit(True), "left")  # one row each
    right = F.col("right") + F.when(F.col("left") > F.col("right"), 360 * PARTS).otherwise(0)
    return both.select(
        F.coalesce(F.floor("low"), F.lit(-90)).cast("int").alias("minLat"), F.coalesce(F.floor(F.col("left") / PARTS), F.lit(-180)).cast("int").alias("minLng"),
        F.coalesce(F.ceil("high"), F.lit(90)).cast("int").alias("maxLat"), F.coalesce(F.ceil(right / PARTS), F.lit(180)).cast("int").alias("maxLng"),
        "minYear", "maxYear", "total",
    )


def as_json(extents: DataFrame) -> DataFrame:
    """The row of ``capabilities`` as one JSON document; values that aren't known are left out."""
    return extents.select(F.to_json(F.struct(*extents.columns)).alias("json"))


def first_interface(extents: DataFrame) -> DataFrame:
    """Count and bounds as the first interface named them, latitudes held to Mercator's square."""
    held = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))
    return extents.select(F.col("total").alias("count"), held("minLat").alias("minimumLatitude"), F.col("minLng").cast("double").alias("minimumLongitude"), held("maxLat").alias("maximumLatitude"), F.col("maxLng").cast("double").alias("maximumLongitude"))
