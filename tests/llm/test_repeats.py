"""Decontamination (2), substring deduplication (3) and the Jaccard join (8)."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mapweave.llm import blocks, decontaminate, jaccard, substrings
from mapweave.llm import components as components_module
from mapweave.llm.components import components


def shingle_set(text, k=5):
    w = text.encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_removed(plain, k=13):
    first = {}
    words = [(i, t.encode().split()) for i, t in plain]
    for i, w in words:
        for j in range(len(w) - k + 1):
            s = tuple(w[j : j + k])
            first[s] = min(first.get(s, math.inf), math.inf if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (math.inf if i is None else i):
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_substrings(docs, plain):
    got = substrings.deduplicated(docs, block_bytes=100_000, bucket_bytes=1 << 17).drop("kept")
    assert Counter(map(tuple, got.collect())) == brute_removed(plain)


def test_substring_edges(edge, empty):
    rows = [(r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect()]
    assert Counter(map(tuple, substrings.deduplicated(edge).drop("kept").collect())) == brute_removed(rows)
    assert substrings.deduplicated(empty).count() == 0


def test_windows_of_one_key_but_other_words_stay(docs, plain, monkeypatch):
    """With a first key of three bits nearly all windows clash in it; the second one tells them apart."""
    one = substrings.windows
    monkeypatch.setattr(substrings, "windows", lambda w, e, k, f=0: (lambda x: x if k < 13 or f else (x[0] >> np.uint64(61), *x[1:]))(one(w, e, k, f) if f else one(w, e, k)))
    got = substrings.deduplicated(docs, block_bytes=100_000, bucket_bytes=1 << 17).drop("kept")
    assert Counter(map(tuple, got.collect())) == brute_removed(plain)


def brute_matches(rows, items):
    out = Counter()
    for i, t in items:
        k = min(5, len((t or "").split()))
        wanted = shingle_set(t, k) if k else frozenset()
        for d, text in rows:
            if wanted and (n := len(wanted & shingle_set(text, k))) * 100 >= 80 * len(wanted):
                out[d, i, n, len(wanted)] += 1
    return out


def test_decontamination(spark, sf, docs, plain):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontaminate.matches(docs, items)
    assert Counter(map(tuple, found.collect())) == brute_matches(plain, [(r.item_id, r.text) for r in items.collect()])
    bad = {r.doc_id for r in found.collect()}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {i for i, _ in plain} - bad


def test_partial_items_are_found(spark):
    item = [f"q{i}" for i in range(40)]
    near, far = " ".join(item[:33]), " ".join(item[:31])
    docs = spark.createDataFrame([(1, "a b c " + near + " d"), (2, "a " + far), (3, " ".join(item[::-1]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "not there"), (9, None)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, items).collect()] == [(1, 7, 29, 36)]


def test_items_of_all_sizes_against_brute_force(spark, monkeypatch):
    """Items of 1 to 300 words, whole or with words lost, in texts of all lengths; several slices."""
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 40)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 20, 60, 300])))) for k in range(90)]
    items += [(500, items[3][1]), (501, ""), (502, " \n"), (503, None)]
    rows = []
    for k in range(150):
        parts = [" ".join(word() for _ in range(r.choice([0, 1, 4, 30, 200])))]
        for _, t in r.sample(items[:90], 3):
            parts.append(" ".join(w for w in t.split() if r.random() > r.choice([0, 0, 0.02, 0.05, 0.1])))
        rows.append((k, " ".join(parts)))
    rows += [(900, " ".join(word() for _ in range(50_000)) + " " + items[50][1]), (901, None), (902, "")]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_matches([(d, t or "") for d, t in rows], items)


@pytest.mark.parametrize("names", [("contaminated", "item_id"), ("Contaminated", "_contaminated"), ("n_shared", "text_")])
def test_names_pass_through_clean(spark, names):
    docs = spark.createDataFrame([(1, "x y four words only here z", 5, 6), (2, "nothing to see", 7, 8), (None, None, 9, 9)], ["doc_id", "text", *names])
    items = spark.createDataFrame([(7, "four words only here")], "item_id long, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [(None, None, 9, 9), (2, "nothing to see", 7, 8)]


def test_decontamination_edges(edge, empty):
    from .conftest import SAME

    spark = edge.sparkSession
    items = spark.createDataFrame([(1, SAME), (2, SAME), (3, "")], "item_id long, text string")
    got = decontaminate.matches(edge, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(6, 1): 2, (6, 2): 2, (7, 1): 1, (7, 2): 1, (8, 1): 1, (8, 2): 1, (None, 1): 1, (None, 2): 1})
    assert decontaminate.matches(empty, items).count() == decontaminate.matches(edge, items.limit(0)).count() == 0
    kept = decontaminate.clean(edge, items)
    assert kept.columns == edge.columns and 6 not in {r.doc_id for r in kept.collect()}


def brute_join(rows):
    """Rows by position; classes by union-find over links at 0.8."""
    sets = [shingle_set(t) or (frozenset([tuple(t.encode().split())]) if t.split() else frozenset()) for _, t in rows]
    having, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    for ks in having.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    up, links = list(range(len(rows))), Counter()

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for (a, b), n in shared.items():
        if n * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((i, low[root(k)] if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows))


def test_join(docs, plain):
    assert Counter(map(tuple, jaccard.joined(docs).collect())) == brute_join(plain)


def test_join_edges(edge, empty):
    rows = [(r.doc_id, (r.text or "").replace("\x1c", "x").replace("\xa0", "x")) for r in edge.select("doc_id", "text").collect()]
    assert Counter(map(tuple, jaccard.joined(edge).collect())) == brute_join(rows)
    assert jaccard.joined(empty).count() == 0
    kept = jaccard.distinct(edge)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == edge.columns and ids[6] == 1 and 7 not in ids and 8 not in ids and ids[None] == 2


def test_join_of_a_large_group(spark):
    """Near copies of one text, more than a bucket or a block holds, beside copies and an unrelated text."""
    base = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(base[:60] + [f"v{k}"] + base[61:])) for k in range(300)] + [(1000 + k, " ".join(base)) for k in range(50)] + [(5000, " ".join(f"u{i}" for i in range(90)))]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_join(rows)


def test_join_of_a_group_in_many_blocks(spark, monkeypatch):
    """Copies of one text with edits at all rates: blocks that the pivot decides, and blocks that meet in tiles."""
    monkeypatch.setattr(jaccard, "BLOCK_LEAST", 100)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "NAMES_AT_ONCE", 100)
    r = random.Random(5)
    base, rows = [f"t{i}" for i in range(200)], []
    for k in range(260):
        rate = r.choice([0, 0.002, 0.004, 0.01, 0.02, 0.05])
        rows.append((k, " ".join(r.choice(["x", f"v{k}", f"y{r.randrange(5)}"]) if r.random() < rate else w for w in base)))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_join(rows)


def test_join_with_many_hot_paths(spark, monkeypatch):
    """A passage in every document: paths that must be split, beyond what may be broadcast."""
    monkeypatch.setattr(jaccard, "BROADCAST_PATHS", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "PART", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_MEMBERS", 0)
    monkeypatch.setattr(jaccard, "BLOCK_LEAST", 100)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, f"{' '.join(f'a{k // 2}x{i}' for i in range(60))} {passage}{' more' * (k % 2)}") for k in range(120)]
    rows += [(1000 + k, " ".join(f"t{i}" if i != k else f"v{k}" for i in range(120))) for k in range(100)]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_join(rows)


@pytest.mark.parametrize("gathered", [1000, 4])
def test_join_of_pairs_in_hot_paths_only(spark, monkeypatch, gathered):
    """Pairs that share nothing but passages of many documents: every bucket that holds both is dealt in parts."""
    monkeypatch.setattr(jaccard, "DEPTH", 1)
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(jaccard, "GATHERED", gathered)
    passages = [" ".join(f"p{a}x{i}" for i in range(40)) for a in range(5)]
    pairs = [(a, b) for a in range(5) for b in range(a)]
    rows = [(10 * k + side, f"{passages[a]} v{k}x{side} {passages[b]} w{k}x{side}") for k, (a, b) in enumerate(pairs) for side in (0, 1)]
    rows += [(1000 + k, f"{passages[k % 5]} {' '.join(f'o{k}x{i}' for i in range(60))}") for k in range(200)]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_join(rows)


def test_distinct_loses_no_pair_at_the_threshold(spark):
    """Three thousand pairs with 36 shingles of 45 in common: the runs miss some of them."""
    r, rows = random.Random(3), []
    for k in range(3000):
        words = [f"w{r.randrange(10**9)}" for _ in range(49)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[9:]))]
    kept = jaccard.distinct(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(0, 6000, 2))


def test_links_need_no_run(spark, monkeypatch):
    """Without a single run the covering step finds the same links: sets of many sizes, with and without a common passage."""
    monkeypatch.setattr(jaccard, "runs_needed", lambda target: 0)
    r, rows, passage = random.Random(1), [], [f"c{i}" for i in range(30)]
    for k in range(400):
        n = r.choice([1, 3, 5, 8, 9, 10, 13, 20, 49, 60, 120, 400])
        words = passage * (k % 3 == 0) + [f"w{r.randrange(10**9)}" for _ in range(n)]
        other = words[r.choice([0, 1, 2, max(1, n // 9), max(1, n // 5)]) :]
        if other and k % 2:
            other[r.randrange(len(other))] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_join(rows)


def two_workers(plan: str) -> bool:
    """Whether a Python function reads the rows of another in the same task, which takes a worker for each."""
    above: list[tuple[int, str]] = []
    for line in plan.splitlines():
        node = re.sub(r"^(\*\(\d+\))? *", "", line.lstrip(" :+-"))
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        if node.startswith("MapInArrow"):
            for _, name in reversed(above):
                if name.startswith("Exchange"):
                    break
                if name.startswith("MapInArrow"):
                    return True
        above.append((depth, node))
    return False


def test_no_task_of_the_join_holds_two_workers(spark, docs, monkeypatch):
    plans = []
    for module in (jaccard, components_module):
        monkeypatch.setattr(module, "written", lambda df, one=module.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or one(df))
    one = docs.select("doc_id", "text").mapInArrow(lambda batches: batches, "doc_id long, text string")
    assert not two_workers(one._jdf.queryExecution().executedPlan().toString())
    assert two_workers(one.where("doc_id > 1").mapInArrow(lambda batches: batches, "doc_id long, text string")._jdf.queryExecution().executedPlan().toString())
    jaccard.joined(docs).count()
    assert any("MapInArrow" in p for p in plans) and not any(map(two_workers, plans))


def test_few_results_make_few_files(spark, monkeypatch):
    """Each file that a task writes starts processes: edges, links and nodes below large buckets are few, so are their files, and no bucket is kept twice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    files, levels, repeated = {}, [], []

    def written(df, one):
        out = one(df)
        files.setdefault(",".join(out.columns), []).append(len(out.inputFiles()))
        if out.columns == ["token", "keys"]:
            repeated.append(out.count() - out.distinct().count())
        return out

    def checkpointed(df, one=jaccard.checkpointed):
        out = one(df)
        if "sub" in out.columns:
            levels.append(out.rdd.getNumPartitions())
        return out

    try:
        for module in (jaccard, components_module):
            monkeypatch.setattr(module, "written", lambda df, one=module.written: written(df, one))
        monkeypatch.setattr(jaccard, "checkpointed", checkpointed)
        monkeypatch.setattr(jaccard, "SMALL", 8)
        rows = [(k, " ".join(f"w{k // 4}x{i}" if i != k % 4 else f"v{k}" for i in range(60))) for k in range(240)]
        rows += [(1000 + k, f"{' '.join(f'p{i}' for i in range(40))} {' '.join(f'o{k}x{i}' for i in range(5))}") for k in range(40)]
        got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(24))
        assert Counter(map(tuple, got.collect())) == brute_join(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(levels) == jaccard.DEPTH - 1 and max(levels) <= 8
    assert max(files["set_id,links,to"]) <= 4 and files["u,v"][0] <= 4
    assert repeated == [0]


@pytest.mark.parametrize("names", [("away", "rows"), ("_away", "AWAY"), ("salt", "set_id"), ("class_id", "n_links")])
def test_names_pass_through_distinct(spark, names):
    rows = [(1, "a b c d e f g", 5, 6), (2, "a b c d e f g", 7, 8), (2, "a b c d e f g", 7, 8), (3, "other words that stand alone here", 1, 2), (3, "and more words that stand alone", 3, 4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = jaccard.distinct(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(tuple(r) in rows for r in got)


def test_runs_meet_the_target():
    assert jaccard.runs_needed(0.9) < jaccard.runs_needed(0.99) < 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (7, 7), (900, 900), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in (500, 501, 502)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "path of stars"])
def test_components_in_many_chunks(spark, monkeypatch, shape):
    """Ten thousand links against chunks of 1,500: the rounds are few, whatever the shape."""
    made = {
        "chain": [(i, i + 1) for i in range(10_000)],
        "star": [(7777, i) for i in range(10_000) if i != 7777],
        "path of stars": [(100 * (i // 100), i) for i in range(10_000) if i % 100] + [(i, i + 100) for i in range(0, 9900, 100)],
    }[shape]
    rounds, one = [], components_module._round
    monkeypatch.setattr(components_module, "_round", lambda edges, k: rounds.append(k) or one(edges, k))
    order = np.random.default_rng(4).permutation(len(made)).tolist()
    rows = components(spark.createDataFrame([made[i] for i in order], "u long, v long"), 1500).collect()
    nodes = {x for e in made for x in e}
    assert {r.node for r in rows} == nodes and len(rows) == len(nodes) and {r.root for r in rows} == {0}
    assert 0 < len(rounds) <= 8


def test_arrays_pack():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (blocks.inflate_sorted(blocks.deflate_sorted(x)) == x).all() and len(blocks.inflate(b"", np.int64)) == 0
