"""Trends of a species within its group: shares by year, for a search or for each hexagon."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mapweave.operators import binning, mvt

#: Bases of record that are fit for trends.
SUITABLE = ("OBSERVATION", "HUMAN_OBSERVATION", "MACHINE_OBSERVATION", "MATERIAL_CITATION", "MATERIAL_SAMPLE", "PRESERVED_SPECIMEN", "OCCURRENCE", "LITERATURE", "UNKNOWN")
FACETS = 300


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(t := 1 - (a + b) * x / (a + 1)), tiny) * (1 if t >= 0 else -1)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def significance(slope: float, error: float, n: int) -> float:
    """Two-sided probability of a slope so far from zero, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or not error >= 0 or math.isnan(slope):
        return math.nan
    if error == 0:
        return 0.0 if slope else math.nan
    t, free = abs(slope) / error, n - 2
    return _beta(free / 2, 0.5, free / (free + t * t))


@F.pandas_udf(DoubleType())
def significance_of(slope: pd.Series, error: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([significance(s if s is not None else math.nan, e if e is not None else math.nan, int(k)) for s, e, k in zip(slope, error, n, strict=True)])


def year_facet(rows: DataFrame, limit: int = FACETS) -> DataFrame:
    """Counts by year of suitable records, the most frequent years only, as a search index's facet."""
    kept = rows.where(F.col("basisOfRecord").isin(*SUITABLE) & (F.col("year") > 0))
    return kept.groupBy("year").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "year").limit(limit)


def shares(species: DataFrame, group: DataFrame, by: list[str]) -> DataFrame:
    """(by..., year, y): the species' part of the group's count, 0 in years without the species."""
    joined = group.where(F.col("n") > 0).withColumnRenamed("n", "groupN").join(species.withColumnRenamed("n", "speciesN"), [*by, "year"], "left")
    return joined.select(*by, "year", (F.coalesce("speciesN", F.lit(0)) / F.col("groupN")).alias("y"))


def fit(points: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Least squares of y on year; nulls where there are too few years for a value."""
    x, y = F.col("year").cast("double"), F.col("y")
    sums = points.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mean"))
    sxx = F.when(F.col("sxx") > 0, F.col("sxx"))
    sums = sums.withColumn("sse", F.when(sxx.isNotNull(), F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / sxx)))
    sums = sums.withColumn("mse", F.when(F.col("n") > 2, F.col("sse") / F.when(F.col("n") > 2, F.col("n") - 2)))
    out = sums.withColumns({"slopeStdErr": F.sqrt(F.col("mse") / sxx), "interceptStdErr": F.sqrt(F.col("mse") * (1 / F.col("n") + F.col("mean") * F.col("mean") / sxx))})
    return out.select(*by, "n", *(F.round(c, digits).alias(c) for c in ("slope", "intercept", "sse", "mse", "slopeStdErr", "interceptStdErr")))


def trends(species: DataFrame, group: DataFrame, by: list[str], min_years: int = 2) -> DataFrame:
    """Fits per cell, for cells with at least ``min_years`` years of the species; all years of the group count."""
    enough = species.where("n > 0").groupBy(*by).agg(F.count_distinct("year").alias("years")).where(F.col("years") >= min_years).select(*by) if by else None
    cells = group.join(enough, by, "left_semi") if by else group
    fitted = fit(shares(species, cells, by), by)
    return fitted.withColumn("significance", significance_of("slope", "slopeStdErr", "n"))


def as_json(species: DataFrame, group: DataFrame) -> DataFrame:
    """A search's trend as one JSON document: the fit, and both counts by year as JSON texts inside it."""
    by_year = lambda df, name: df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string"), "n"))))).alias(name))  # noqa: E731  years are few
    both = trends(species, group, []).join(F.broadcast(by_year(group, "groupCounts")), F.lit(True), "left").join(F.broadcast(by_year(species, "speciesCounts")), F.lit(True), "left")  # one row each
    return both.select(F.to_json(F.struct(*both.columns)).alias("json"))


def encoded(fits: DataFrame, z: int, x: int, y: int, per_tile: int = binning.HEX_PER_TILE) -> DataFrame:
    """The bytes of a tile of hexagons (q, r) with their fits as texts, ``id`` naming the hexagon alike on every tile."""
    values = [c for c in fits.columns if c not in ("q", "r")]
    texts = F.map_from_arrays(F.array(*(F.lit(c) for c in ("id", *values))), F.array(F.concat_ws(":", "q", "r"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values)))
    rows = fits.select(F.lit(z).alias("z"), F.lit(x).alias("tileX"), F.lit(y).alias("tileY"), "q", "r", F.col("n").alias("total"), texts.alias("texts"))
    return mvt.encoded_polygons(rows.withColumn("ring", binning.hex_ring(per_tile)), binning.EXTENT, "regression")
