"""A text quality classifier: a sparse ensemble of rules over statistics of the text.

Shallow trees are grown in numpy on random parts of the labelled rows; every path from a root is a
conjunctive rule. A logistic model with an L1 penalty over all distinct rules keeps few of them, and
these are compiled into one Spark expression, so scoring is a projection. Statistics are made in Spark,
once for all documents; the label, the language, the source and the id are no part of them.

Only the fitting sample passes through the driver: at most ``SAMPLE`` different labelled rows, each a dozen
numbers and how often it occurs. Where there are more, a share of them is drawn by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.quality import STATS, stats
from mapweave.llm.session import checkpointed

#: Different labelled rows that are fitted at most.
SAMPLE = 20_000
FOLDS, CUT = 5, 0.3
TREES, DEPTH, PART, SPLITS, LEAST_ROWS, PENALTY = 40, 3, 3000, 24, 5, 0.001
FEATURES = ("words", "word_length", "symbols", "repeats", "dup_lines", "exclaims", "capitals", "commas", "lines", "digits")
_COUNTED = {"exclaims": "!", "commas": ",", "digits": "0123456789"}
_P = "rule_feature_"


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with the features, doubles named with a prefix; all are 0 for an empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = {}
    for name, characters in _COUNTED.items():
        left = text
        for c in characters:
            left = F.replace(left, F.lit(c), F.lit(""))
        counts[f"{_P}n_{name}"] = F.length(text) - F.length(left)
    counts[f"{_P}n_capitals"] = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    out = stats(docs, text_col, _P).withColumns(counts)
    n, chars = F.greatest(F.col(f"{_P}n_words"), F.lit(1)), F.greatest(F.col(f"{_P}word_chars"), F.lit(1))
    made = {
        "words": F.log1p(F.col(f"{_P}n_words").cast("double")),
        "word_length": F.col(f"{_P}word_chars") / n,
        "symbols": F.col(f"{_P}n_symbols") / chars,
        "repeats": F.col(f"{_P}n_repeat_words") / n,
        "dup_lines": F.col(f"{_P}n_dup_lines") / F.greatest(F.col(f"{_P}n_lines"), F.lit(1)),
        "exclaims": F.col(f"{_P}n_exclaims") / n,
        "capitals": F.col(f"{_P}n_capitals") / chars,
        "commas": F.col(f"{_P}n_commas") / n,
        "lines": F.col(f"{_P}n_lines") / n,
        "digits": F.col(f"{_P}n_digits") / chars,
    }
    return out.withColumns({f"{_P}{k}": v.cast("double") for k, v in made.items()}).drop(text_col, *(f"{_P}{s}" for s in STATS), *counts)


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold) hold; ``above`` means greater, else at most."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            out &= (x[:, f] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            c = F.col(f"{_P}{FEATURES[f]}")
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


def grown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: tuple = (), depth: int = DEPTH) -> list[Rule]:
    """Rules of all paths below a node that splits the rows by the greatest fall of squared error."""
    if depth == 0 or len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return []
    best = None
    for f in rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, SPLITS + 2)[1:-1], method="lower"))
        order = np.argsort(x[:, f], kind="stable")
        sums, values = np.concatenate([[0.0], np.cumsum(y[order])]), x[order, f]
        at = np.searchsorted(values, cuts, "right")
        fine = (at >= LEAST_ROWS) & (len(y) - at >= LEAST_ROWS)
        if not fine.any():
            continue
        at, cuts = at[fine], cuts[fine]
        gain = sums[at] ** 2 / at + (sums[-1] - sums[at]) ** 2 / (len(y) - at)
        k = int(gain.argmax())
        if best is None or gain[k] > best[0]:
            best = (gain[k], int(f), float((values[at[k] - 1] + values[at[k]]) / 2))
    if best is None:
        return []
    _, f, t = best
    out, low = [], x[:, f] <= t
    for above, rows in ((False, low), (True, ~low)):
        longer = (*path, (f, above, t))
        out += [Rule(longer), *grown(x[rows], y[rows], rng, longer, depth - 1)]
    return out


def lasso(a: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty on the weights, by accelerated proximal steps."""
    n, p = times.sum(), a.shape[1]
    a1 = np.column_stack([np.ones(len(a)), a])
    size = np.linalg.norm(a1 * np.sqrt(times)[:, None], 2) ** 2 / (4 * n)
    w, z, t = np.zeros(p + 1), np.zeros(p + 1), 1.0
    for _ in range(steps):
        gradient = a1.T @ (times * (1 / (1 + np.exp(-np.clip(a1 @ z, -30, 30))) - y)) / n
        new = z - gradient / size
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / size, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + sum((w * r.holds(x) for w, r in self.rules), np.zeros(len(x))), -30, 30)))

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for w, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))


def fitted(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, seed: int = 5) -> Ensemble:
    """With one class only, or no rows, the ensemble has no rules and gives the smoothed share of label 1.

    Row ``i`` counts as ``times[i]`` rows, else as one.
    """
    times = np.ones(len(y)) if times is None else times
    share = ((times * y).sum() + 1) / (times.sum() + 2)
    constant = Ensemble(float(np.log(share / (1 - share))), ())
    if not len(y) or y.min() == y.max():
        return constant
    rng, rules, seen, columns = np.random.default_rng(seed), [], set(), []
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), PART), p=times / times.sum())
        for rule in grown(x[rows], y[rows], rng):
            column = rule.holds(x)
            key = column.tobytes()
            if key not in seen and (~column).tobytes() not in seen and 0 < column.sum() < len(column):
                seen.add(key)
                rules.append(rule)
                columns.append(column)
    if not rules:
        return constant
    intercept, weights = lasso(np.array(columns, float).T, y, times, PENALTY)
    return Ensemble(intercept, tuple((float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def taught(made: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """The ensemble fitted on rows of ``features`` whose id is not held out; equal rows pass as one with its count."""
    pairs = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("double").alias("label"))
    pairs = pairs.where(F.col("label").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"))).groupBy("label_id", "label").agg(F.count("*").alias("times"))
    names = [f"{_P}{f}" for f in FEATURES]
    rows = made.join(pairs, F.col("doc_id") == F.col("label_id")).groupBy("label_id", "label", *names).agg(F.sum("times").cast("double").alias("times"))
    rows, parts = checkpointed(rows), 1 << 24
    n = rows.count()
    if n > sample:  # low enough that chance does not pass the bound (six deviations)
        rows = rows.where(F.pmod(F.xxhash64("label_id", "label", *names), F.lit(parts)) < int(parts * (sample - 6 * sample**0.5) / n))
    fit = rows.orderBy("label_id", "label", *names).select("times", "label", *names).toPandas().to_numpy(float)  # the same order each time
    return fitted(fit[:, 2:], fit[:, 1], fit[:, 0])


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score (likelihood of label 1) and predicted (score at least 0.3).

    Null and empty texts are scored as texts without words; very long ones are read whole. Repeated rows repeat
    their score, and count each when fitting, repeated labels too; a document with two labels counts under both;
    rows with a null label or id teach nothing. Without labels every score is 0.5. An empty table gives an empty
    result; other columns of either table, whatever their names, are dropped.
    """
    made = checkpointed(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    score = taught(made, labels, label, sample).column()
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
