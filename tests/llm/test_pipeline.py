"""The pipeline and its stages against brute force, and on tables of odd rows and names."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mapweave.llm import lattice, quality, secrets

from .test_repeats import brute_join, brute_matches
from .test_rules import brute_stats

STAGES = dict(corpus_pipeline.STAGES)


def brute_quality(rows):
    """Rows (doc_id, text, lang, source) that stay, with thresholds from sorted lists of bucketed shares."""

    def shares(s):
        part = lambda a, b: 1000 * a // b if b else 0
        return {"symbols": part(s[2], s[1]), "repeats": part(s[4], s[0]), "dup_lines": part(s[3], s[5])}

    def low(v):
        shift = max(0, v.bit_length() - 6)
        return v >> shift << shift

    groups, stats = defaultdict(list), [brute_stats(r[1] or "") for r in rows]
    for r, s in zip(rows, stats, strict=True):
        for key in ((), (r[2],), (r[2], r[3])):
            groups[key].append(shares(s))

    def fence(key, k):
        values = sorted(low(x[k]) for x in groups[key])
        at = lambda percent: values[-(-len(values) * percent // 100) - 1]
        return at(75) + quality.SPREAD * max(at(75) - at(25), quality.FENCED[k])

    def stays(r, s):
        if s[0] < 50 or 100 * s[4] > 50 * s[0]:
            return False
        key = next(k for k in ((r[2], r[3]), (r[2],), ()) if len(groups[k]) >= quality.LEAST_DOCS or k == ())
        return all(v <= fence(key, k) for k, v in shares(s).items())

    return [r for r, s in zip(rows, stats, strict=True) if stays(r, s)]


def brute_redacted(text):
    """The rules as Python patterns; a private key runs on over its tail."""
    spans = []
    for rule in secrets.RULES:
        pattern = rule.pattern + (f"(?:{rule.tail})?" if rule.tail else "")
        for m in re.finditer(pattern, text, re.ASCII):
            value = re.match(rule.head, m[0], re.ASCII).end() if rule.head else 0
            if m.end() - m.start() - value >= rule.least:
                spans.append((m.start(), m.end(), rule))
    base = [x for x in spans if x[2].base]
    spans = base + [x for x in spans if not x[2].base and not any(s <= x[0] and x[1] <= e for s, e, _ in base)]
    out, at = [], 0
    for s, e, rule in sorted(spans, key=lambda x: (x[0], secrets.RULES.index(x[2]))):
        if s >= at:
            out += [text[at:s], f"[{rule.kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def expected(spark, sf):
    """The documents after each stage, by brute force."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = [brute_quality(docs)]
    classes = brute_join([(i, t or "") for i, t, *_ in out[-1]])
    first = {i for i, c, _ in classes if i == c}
    out.append([r for r in out[-1] if r[0] in first])
    bad = {d for d, *_ in brute_matches([(i, t or "") for i, t, *_ in out[-1]], items)}
    out.append([r for r in out[-1] if r[0] not in bad])
    out.append([(r[0], r[1] and brute_redacted(r[1]), *r[2:]) for r in out[-1]])
    return docs, out


def test_stages_by_brute_force(spark, sf, expected, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == names
        rows = docs.collect()
        assert Counter((r.doc_id, r.text, r.lang, r.source) for r in rows) == Counter(expected[1][k]), name
        assert all(r.n_chars == len(r.text or "") for r in rows)
    assert len({len(x) for x in expected[1]}) == 3 and expected[1][2] != expected[1][3]  # every stage does something


def test_pipeline_by_brute_force(spark, sf, expected):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=lattice.MODEL)
    want = Counter((i, len(ids), tuple(ids)) for i, t, *_ in expected[1][3] for ids in [library.encode(t or "")])
    assert Counter((r.doc_id, r.n_pieces, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == want


@pytest.mark.parametrize("name", STAGES)
def test_edges_of_every_stage(spark, sf, edge, empty, name):
    assert STAGES[name](spark, empty, sf).count() == 0
    got = STAGES[name](spark, edge, sf)
    ids = Counter(r.doc_id for r in got.collect())
    if name != "sentencepiece":
        assert got.columns == edge.columns
    if name in ("decontamination", "secret scan", "sentencepiece"):
        assert ids == Counter(r.doc_id for r in edge.collect())
    if name == "near duplicates":
        assert ids[6] == 1 and 7 not in ids and ids[None] == 2
    if name == "quality rules":
        assert set(ids) == {5}


@pytest.mark.parametrize("name", STAGES)
def test_any_names_pass_through_every_stage(spark, sf, name):
    """Names that operators use inside, in any case, come back with their values."""
    inside = ("quality_rule_n_words", "_quality_rule_kept", "fence_lang", "Fence_Symbols", "contaminated", "away", "rows", "salt", "_salt", "key", "block", "word", "place", "set_id", "tokens", "class_id", "n_words", "kept")
    text = " ".join(f"w{k % 61}x{k}" for k in range(120))
    rows = [(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, text[::-1], None, None, len(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in inside})
    got = STAGES[name](spark, docs, sf)
    if name == "sentencepiece":
        assert got.columns == ["doc_id", "n_pieces", "ids"] and got.count() == 3
    else:
        assert got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in docs.collect() if name != "near duplicates" or r.doc_id != 2}


def test_a_secret_deep_in_a_very_long_text_is_masked(spark, sf):
    text = "word " * 200_000 + "token = 'abcdefghijklmnop' " + "word " * 10
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    row = STAGES["secret scan"](spark, docs, sf).first()
    assert row.text == brute_redacted(text) != text and row.n_chars == len(row.text)
