"""SentencePiece (4), the quality classifier (5) and language-model scores (9)."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.llm import lattice, lm, rulefit

from .test_rules import brute_stats


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=lattice.MODEL)


def test_pieces_are_the_library_s(docs, plain, library):
    got = {r.doc_id: r for r in lattice.round_trip(docs).collect()}
    for doc_id, text in plain:
        ids = library.encode(text)
        row = got[doc_id]
        assert row.n_pieces == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() and row.round_trip


def test_piece_edges(edge, empty, library):
    rows = edge.select("doc_id", "text").collect()
    expected = Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in rows)
    coded = lattice.encoded(edge)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == expected
    assert lattice.encoded(empty).count() == 0
    assert Counter((r.doc_id, r.text) for r in lattice.decoded(coded).collect()) == Counter((r.doc_id, r.text or "") for r in rows)


def test_odd_texts(spark, library):
    texts = ["  a  b\n\nc ", "▁ a▁b", "\t;\r\n", "日本 ∑x\x00", "don't (stop) [now]_x, ²; 3.²", " " * 40 + "x", "ation" * 30, "😀 é́"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lattice.encoded(df).collect():
        assert r.ids == library.encode(texts[r.doc_id]), texts[r.doc_id]


def brute_segmentation(word, scores, unknown):
    """The best of all 2 ** (n - 1) ways to cut a word, of equal sums the one with the longest last piece, and so on."""
    best = None
    for cut in range(1 << max(0, len(word) - 1)):
        ends = [0, *(k + 1 for k in range(len(word) - 1) if cut >> k & 1), len(word)]
        pieces = [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        if all(p in scores or len(p) == 1 for p in pieces):
            total = sum(scores.get(p, unknown) for p in pieces)
            key = (round(total, 9), [len(p) for p in reversed(pieces)])
            best = max(best, (key, pieces), key=lambda x: x[0]) if best else (key, pieces)
    return best[1], best[0][0]


def test_pieces_start_no_workers(spark):
    """A table made of a list of rows would start Python workers of another kind, which wait beside those in use."""
    model = lattice.Model()
    made = lattice.lattice(spark.sql("select 'ab' as word"), model)
    assert "LogicalRDD" not in made._jdf.queryExecution().analyzed().toString()
    assert [(x.word, list(x.ids)) for x in made.collect()] == [("ab", model.merged("ab"))]


def test_viterbi_over_the_lattice(spark):
    r = random.Random(9)
    scores = {}
    while len(scores) < 60:
        scores["".join(r.choice("abc") for _ in range(r.randint(1, 4)))] = -r.randint(1, 40) / 4
    scores["é日"] = -1.0
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 10))) for _ in range(150)] + ["é日é日x", "d", "dddd"]
    table = spark.createDataFrame([(w, 1) for w in [*words, words[0], "", None]], "word string, score int")
    pieces = spark.createDataFrame([(p, s, "x") for p, s in scores.items()] + [(None, 1.0, "x"), ("a", -99.0, "x")], "piece string, score double, word string")
    got = {x.word: x for x in lattice.segmented(table, pieces, -20.0, 4).collect()}
    assert set(got) == {*words, ""} and (got[""].pieces, got[""].score) == ([], 0.0)
    for w in words:
        want, total = brute_segmentation(w, scores, -20.0)
        assert got[w].score == pytest.approx(total) and got[w].pieces == want, w
    assert lattice.segmented(table.limit(0), pieces, -20.0, 4).count() == 0


def test_explicit_merging(library):
    model = lattice.Model()
    for word in ("▁hello", "ation", "▁▁▁▁x", "zzzz", "▁nations"):
        assert model.merged(" " + word.lstrip("▁")) == library.encode(word.lstrip("▁")) if "▁▁" not in word else True


def brute_scores(plain, order=lm.ORDER):
    """By the formula alone: no states, no arcs."""
    tokens = lambda t: [b"\t", *t.encode().lower().split(), b"\n"]
    grams = Counter()
    for i, t in plain:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            row = tokens(t)
            for m in range(1, order + 1):
                grams.update(tuple(row[j : j + m]) for j in range(len(row) - m + 1))
    unigrams = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != b"\t"}
    n, v = sum(unigrams.values()), len(unigrams)

    def p(context, w):
        if not context:
            return (unigrams.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        return (grams[*context, w] + lm.PRIOR * p(context[1:], w)) / (grams[context] + lm.PRIOR)

    for i, t in plain:
        row = tokens(t)
        score = sum(math.log10(p(tuple(row[max(0, j - order + 1) : j]), row[j])) for j in range(1, len(row)))
        yield i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(row) - 1, sum(w in unigrams for w in row[1:]), n, sum(math.log10(p((), w)) for w in row[1:]), score


def same_scores(df, rows, order=lm.ORDER):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, expected = sorted(map(tuple, df.collect()), key=key), sorted(brute_scores(rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_scores(docs, plain):
    same_scores(lm.score(docs, block_bytes=100_000, bucket_bytes=1 << 17), plain)


@pytest.mark.parametrize("order", [1, 2, 5])
def test_scores_of_other_orders(spark, monkeypatch, order):
    """Short segments, few words, copies: failure arcs over several levels, and segments that begin inside a text."""
    monkeypatch.setattr(lm, "SEGMENT", 7)
    r = random.Random(order)
    rows = [(k, " ".join(r.choice("a b c d e f B".split()) for _ in range(r.choice([0, 1, 2, 6, 7, 8, 40])))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(20)] + [(None, "a b zz"), (300, " ".join(f"only{i}" for i in range(30)))]
    same_scores(lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_bytes=500, bucket_bytes=700), rows, order)


def test_texts_that_occur_twice_score_higher(docs, plain):
    """What the corpus holds twice is likelier, token by token, than what it holds once."""
    twice = {t for t, n in Counter(t for _, t in plain).items() if n > 1 and len(t.split()) > 50}
    rows = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs).where("not held_out").collect()}
    high = [rows[i] for i, t in plain if i in rows and t in twice]
    low = sorted(rows[i] for i, t in plain if i in rows and t not in twice and len(t.split()) > 50)
    assert high and sorted(high)[len(high) // 2] > low[len(low) * 3 // 4]


def test_score_edges(edge, empty):
    rows = [(r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect()]
    same_scores(lm.score(edge.select("doc_id", "text", "bucket")), rows)
    assert lm.score(empty).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.held_out) == (0, 0, True) and math.isfinite(row.score)


def test_classifier_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    scored = rulefit.scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows) and scored.count() == 1000


def test_rules_hold_alike_in_both_engines(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(rulefit.FEATURES)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float)
    model = rulefit.fitted(x, y)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.97 and len(model.rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"rule_feature_{f} double" for f in rulefit.FEATURES))
    assert [r[0] for r in df.select(model.column()).collect()] == pytest.approx(list(model.score(x)))


def brute_features(text):
    """The features of a text, each by its definition."""
    w, chars = re.findall(r"[^\x20\x09-\x0D]+", text), text
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines = brute_stats(text)
    n, c = max(n_words, 1), max(word_chars, 1)
    return [
        math.log1p(len(w)), word_chars / n, n_symbols / c, n_repeat_words / n, n_dup_lines / max(n_lines, 1), chars.count("!") / n,
        sum(unicodedata.category(x) == "Lu" for x in chars) / c, chars.count(",") / n, n_lines / n, sum(x in "0123456789" for x in chars) / c,
    ]


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_features_and_scores_by_definition(spark, sf, docs, edge, which):
    df = docs if which == "docs" else edge
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = rulefit.taught(rulefit.features(docs.select("doc_id", "text")), labels)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    x = np.array([brute_features(t) for _, t in rows])
    made = rulefit.features(df.select("doc_id", "text"))
    got = Counter((r[0], tuple(round(v, 9) for v in r[1:])) for r in made.select("doc_id", *(f"rule_feature_{f}" for f in rulefit.FEATURES)).collect())
    assert got == Counter((i, tuple(round(v, 9) for v in f)) for (i, _), f in zip(rows, x.tolist(), strict=True))
    if which == "docs":
        scores = {r.doc_id: r for r in rulefit.scored(docs, labels).collect()}
        for (i, _), s in zip(rows, model.score(x).tolist(), strict=True):
            assert scores[i].score == pytest.approx(s) and scores[i].predicted == (s >= 0.3) and scores[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_repeated_rows_stay_within_the_bound(spark, monkeypatch):
    """A thousand copies of a row and of its label are one row of weight a million, however small the sample."""
    seen = []
    monkeypatch.setattr(rulefit, "fitted", lambda x, y, times: seen.append((len(y), times.max())) or rulefit.Ensemble(0.0, ()))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(ids[0], "one text")] * 1000 + [(i, f"text {'x' * i}") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1, 5)] * 1000 + [(i, i % 2, 5) for i in ids[1:]], "doc_id long, quality int, label_id int")
    rulefit.scored(docs, labels).count()
    rulefit.scored(docs, labels, sample=200).count()
    assert seen[0] == (len(ids), 1e6) and 50 < seen[1][0] <= 200


def test_all_capitals_count(spark):
    texts = ["BCD Fgh", "EAI", "\u00c9t\u00e9 \u00dcber \u0416", "none 1!", ""]
    rows = rulefit.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.rule_feature_capitals for r in rows] == pytest.approx([4 / 6, 1, 3 / 8, 0, 0])


def test_classifier_edges(edge, empty):
    labels = edge.sparkSession.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = rulefit.scored(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 < r.score < 1 for r in rows)
    assert {r.score for r in rulefit.scored(edge, labels.limit(0)).collect()} == {0.5}
    assert rulefit.scored(empty, labels).count() == 0


def test_sample_has_a_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert rulefit.scored(docs, labels, sample=50).count() == docs.count()
