"""Quality rules whose thresholds adapt to each language and source, in DataFrame functions only.

Every statistic of a document is a whole number. Its sketch in a group is a histogram over buckets of
bounded relative width; sketches of parts merge by adding counts, so partial aggregation does the work
before any shuffle and a source with a third of all rows costs no more than another. A threshold is an
outlier fence, ``q75 + spread * max(q75 - q25, least)``, read from the sketch of the document's
language and source; groups under ``least_docs`` documents use the sketch merged over the language,
and small languages the one merged over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.session import checkpointed, unused_prefix, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: Statistics with a fence, in thousandths, and the least quartile distance that the fence assumes.
FENCED = {"symbols": 10, "repeats": 100, "dup_lines": 150}
SPREAD, LEAST_DOCS = 3, 100
#: Groups whose thresholds are broadcast at most; more are joined by Spark's own choice.
BROADCAST_GROUPS = 50_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The documents with the statistics added, as longs named with ``prefix``; null texts have no words."""
    p = f"__{prefix}"
    trimmed = F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    bare = F.coalesce(F.col(text_col), F.lit(""))
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = docs.withColumns({
        f"{p}words": F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")),
        f"{p}lines": lines,
        f"{prefix}n_symbols": (F.length(F.coalesce(F.col(text_col), F.lit(""))) - F.length(bare)).cast("long"),
    })
    words = F.col(f"{p}words")
    out = out.withColumns({
        f"{prefix}n_words": F.size(words).cast("long"),
        f"{prefix}word_chars": F.length(F.array_join(words, "")).cast("long"),
        f"{prefix}n_lines": F.size(f"{p}lines").cast("long"),
        f"{prefix}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        f"{p}hashes": F.when(
            F.size(words) >= 3,
            F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<long>")),
    }).drop(f"{p}lines", f"{p}words")
    hashes = F.col(f"{p}hashes")
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    out = out.withColumn(f"{p}sorted", F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    near = F.col(f"{p}sorted")
    twins = F.filter(near, lambda e, i: ((i > 0) & (F.get(near, i - 1).h == e.h)) | F.coalesce(F.get(near, i + 1).h == e.h, F.lit(False)))
    at = F.sort_array(F.transform(twins, lambda e: e.i))
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a.n)
    return out.withColumn(f"{prefix}n_repeat_words", covered.cast("long")).drop(f"{p}hashes", f"{p}sorted")


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > REPEATED_PERCENT * n)


def _shares(prefix: str = "") -> dict[str, Column]:
    """Thousandths, zero where there is nothing to share."""
    c = lambda name: F.col(f"{prefix}{name}")
    share = lambda part, whole: F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("long")
    return {"symbols": share(c("n_symbols"), c("word_chars")), "repeats": share(c("n_repeat_words"), c("n_words")), "dup_lines": share(c("n_dup_lines"), c("n_lines"))}


def bucket(value: Column) -> Column:
    """Lower bound of a whole number's bucket: exact below 64, then 32 buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, prefix: str = "", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, stat, bucket, n): the mergeable sketch of each fenced statistic in each group."""
    pairs = F.array(*(F.struct(F.lit(k).alias("stat"), bucket(v).alias("bucket")) for k, v in _shares(prefix).items()))
    return measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(pairs)).groupBy("lang", "source", "stat", "bucket").agg(F.count("*").alias("n"))


def fences(histograms: DataFrame, least_docs: int = LEAST_DOCS, spread: int = SPREAD) -> DataFrame:
    """Rows (lang, source, and the highest share allowed of each fenced statistic), from sketches."""
    merged = [
        histograms.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n")).select(*(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("lang", "source")), F.lit(len(keys)).alias("level"), "stat", "bucket", "n")
        for keys in ([], ["lang"], ["lang", "source"])
    ]
    levels = merged[0].unionByName(merged[1]).unionByName(merged[2])
    # A sketch has at most a few hundred buckets, so a list of them is small at any size of the corpus.
    sketch = levels.groupBy("level", "lang", "source", "stat").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("bars"), F.sum("n").alias("docs"))

    def quantile(percent: int) -> Column:
        def add(a, bar):
            seen = a.seen + bar.n
            return F.struct(seen.alias("seen"), F.coalesce(a.at, F.when(100 * seen >= percent * F.col("docs"), bar.bucket)).alias("at"))

        return F.aggregate("bars", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), add, lambda a: a.at)

    least = F.create_map(*(F.lit(x) for kv in FENCED.items() for x in kv))
    fence = sketch.select("level", "lang", "source", "stat", "docs", quantile(25).alias("low"), quantile(75).alias("high")).select("level", "lang", "source", "stat", "docs", (F.col("high") + spread * F.greatest(F.col("high") - F.col("low"), F.element_at(least, F.col("stat")))).alias("fence"))
    wide = fence.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *(F.max(F.when(F.col("stat") == k, F.col("fence"))).alias(k) for k in FENCED))
    of = lambda level, name: wide.where(F.col("level") == level).select(*(F.col(c).alias(f"{name}_{c}") for c in wide.columns))
    own, lang, every = of(2, "own"), of(1, "lang"), of(0, "every")
    joined = own.join(lang, F.col("own_lang").eqNullSafe(F.col("lang_lang")), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    pick = lambda k: F.when(F.col("own_docs") >= least_docs, F.col(f"own_{k}")).when(F.col("lang_docs") >= least_docs, F.col(f"lang_{k}")).otherwise(F.col(f"every_{k}"))
    return joined.select(F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), *(pick(k).alias(k) for k in FENCED))


def judged(measured: DataFrame, prefix: str = "", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents with statistics, with ``<prefix>base_failed`` and ``<prefix>kept`` added; other columns stay as they are.

    No column of ``measured`` but the statistics may begin with the prefix and ``fence_``.
    """
    p = f"{prefix}fence_"
    limits = fences(checkpointed(sketches(measured, prefix, lang, source)))
    limits = checkpointed(limits.select(*(F.col(c).alias(f"{p}{c}") for c in limits.columns)))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = measured.join(limits, F.col(lang).eqNullSafe(F.col(f"{p}lang")) & F.col(source).eqNullSafe(F.col(f"{p}source")), "left")
    within = F.lit(True)
    for k, share in _shares(prefix).items():
        within = within & (share <= F.col(f"{p}{k}"))
    # One expression over both sides of the join: a conjunct of the documents' own columns would be pushed
    # below it as a filter, where every use of a statistic would compute it again.
    kept = F.when(base_failed(prefix), F.lit(False)).otherwise(F.coalesce(within, F.lit(False)))
    return out.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}kept": kept}).drop(*(f"{p}{c}" for c in ("lang", "source", *FENCED)))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the statistics, base_failed and kept; statistics are made once, without the text.

    Null, empty and blank texts have no words and fail. Null languages and sources are groups of their
    own. Repeated rows are judged each, and count each; a share equal to its fence is kept. Very long texts
    are read whole. An empty table gives an empty result; columns of any other names change nothing.
    """
    measured = checkpointed(stats(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", *STATS))
    return judged(measured).select("doc_id", *STATS, "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns and whatever their names.

    The cases are those of ``report``. Statistics cost far more than reading, so they are made once and written
    beside the documents; thresholds and the filter read that table. Texts are never shuffled.
    """
    own = unused_prefix("quality_rule_", docs)
    measured = written(stats(docs, prefix=own))
    return judged(measured, own).where(F.col(f"{own}kept")).select(*docs.columns)
