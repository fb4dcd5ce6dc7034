"""A Jaccard join of documents on their five-word shingles by chosen paths.

Equal shingle sets fall together first, so copies are joined however many there are. Then every run
splits the sets on sampled tokens: a set goes down from a node to each of its tokens whose hash with
the node's path is below ``1 / (LAMBDA * size)``, which similar sets mostly agree on. A bucket of at
most ``SMALL`` sets is compared by brute force; a larger one splits again, down to ``DEPTH`` tokens.
What is larger still holds sets that agree in every split: near copies, or sets around a common passage.
It is dealt by hash into parts of about ``PART`` sets, otherwise in each bucket and run, so that near
copies join up in some part, and every bucket costs rows in proportion to its sets. Sets that agree in
part only also meet in small buckets, along their other tokens. Runs repeat until a pair at the threshold
is met with the target probability. Nothing here gathers a bucket that is not small: sizes are counted first.
Comparisons in these buckets use 256-bit minwise sketches with a wide margin.

Runs, parts and sketches can each lose a pair, so ``covering`` closes what they leave: one step of a path on which every
set goes down to so many of its first tokens, in one order for all sets, that two sets at the threshold share a child
for certain. A bucket there is split by parity bits, which are never further apart than the sets are; one too
large to be gathered goes into one group as a whole, sizes permitting. No pair at the threshold is lost.

Both give candidate groups (as spanning edges, never as pairs). Inside a group links are exact: its sets are cut into blocks by distance
from a pivot, which decides most pairs of blocks by the triangle inequality; where it does not, the blocks
meet and all pairs across them are compared by their whole shingle sets. So every link inside a group
is found and counted, also those that no bucket held. A group is cut into ``BLOCKS`` blocks at most, so that
no set is sent more often than that, until blocks reach ``BLOCK_TOKENS``; beyond, sets that the pivot does not
decide are sent in proportion to their group, and those within 0.1 of the pivot still not at all. Tokens
move only for sets in a group, as long as the ids of those can be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.blocks import deflate_sorted, inflate_sorted
from mapweave.llm.components import Forest, components, forests
from mapweave.llm.session import attached, checkpointed, documents, fewer, gathered, prepare, release, unused, written
from mapweave.llm.words import U, WordKeys, keyed, mix, windows

SHINGLE, PERCENT, TARGET_RECALL = 5, 80, 0.99
LAMBDA, DEPTH, SMALL, PART = 0.8, 3, 100, 256
#: Tokens of a block at least and at most, and blocks of a group between the two.
BLOCK_LEAST, BLOCK_TOKENS, BLOCKS = 8_000, 2_000_000, 30
#: Sets of a tile, and distinct tokens that a product of tiles takes at once.
TILE, NAMES_AT_ONCE = 512, 8192
BROADCAST_PATHS, BROADCAST_BYTES, BROADCAST_MEMBERS = 1_000_000, 16 << 20, 4_000_000
#: Words of a sketch.
SKETCH_WORDS = 4
CHUNK_BYTES = 3 << 20
#: Sets that a task remembers, in order to emit a set's tokens once; a set it has forgotten is emitted again.
REMEMBERED = 500_000
#: Sets whose tokens are counted for the order of ``covering``: one in ``ORDER_SHARE``, and about ``ORDER_SETS`` at least.
ORDER_SETS, ORDER_SHARE = 10_000, 64
#: Tokens that the order puts last at most, and sets of a bucket that ``covering`` compares by bits.
FREQUENT, GATHERED = 500_000, 1000
#: Parity bits of a set at least and at most; more bits tell more, and fewer lose nothing.
BITS_LEAST, BITS_MOST = 64, 1 << 15
SETS = "doc_id long, set_id binary, n int, sketch binary, bits binary, tokens binary, paths array<struct<path:long,sub:binary>>"
NODES = "path long, set_id binary, n int, sketch binary, sub binary"
FAR = "root binary, set_id binary, n int, copies long, tokens binary, far double"


def runs_needed(target: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    Of two such sets, one child on average is chosen by both, Poisson by number; a pair has met in a run
    if it still shares a path at the depth that is reached.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - target) / math.log(1 - meet))


def chosen(tokens: np.ndarray, ends: np.ndarray, owner: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes (owner, path): the index of the parent node, and the child's path."""
    sizes = np.diff(ends)[owner]
    at = np.repeat(ends[owner] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    node = np.repeat(np.arange(len(owner)), sizes)
    h = mix(tokens[at] ^ path[node])
    limit = np.minimum(2.0**64 / (LAMBDA * np.maximum(np.diff(ends), 1)), 2.0**64 - 2048).astype(U)
    take = np.flatnonzero(h < limit[owner][node])
    return node[take], mix(h[take] + U(1))


def sketches(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One bit for each of 256 bins of every set: of the smallest hash in it, or in the next bin that has one."""
    bins, n = 64 * SKETCH_WORDS, len(ends) - 1
    h = mix(tokens + U(0x51ED270B))
    of = np.repeat(np.arange(n), np.diff(ends))
    low = np.full((n, bins), np.iinfo(np.uint64).max, U)
    np.minimum.at(low.reshape(-1), of * bins + (h & U(bins - 1)).astype(np.int64), h >> U(8))
    for shift in (1, 2, 4, 8, 16, 32, 64, 128):
        empty = low == np.iinfo(np.uint64).max
        if not empty.any():
            break
        low = np.where(empty, np.roll(low, -shift, axis=1), low)
    bits = (low & U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(U)


def parity(tokens: np.ndarray) -> bytes:
    """For each of about as many bins as there are tokens, whether it holds an odd number of them.

    A token more or less changes one bit, so two sets differ in as many tokens as their bits differ at least.
    """
    bins = min(max(BITS_LEAST, 1 << (len(tokens) - 1).bit_length()), BITS_MOST)
    return np.packbits((np.bincount((tokens & U(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def shingled(docs: DataFrame, runs: int) -> DataFrame:
    """Per document: its set's id and size, and where the task meets the set first its sketch, bits, tokens and paths."""
    seeds = [int(mix(np.array([r + 1], U))[0]) for r in range(runs)]

    def some(ids, texts, keys, seen):
        words, ends = keyed(texts, keys)
        hashes, _, of = windows(words, ends, SHINGLE)
        short = [(i, mix(words[ends[i] : ends[i + 1]])) for i in range(len(texts)) if 0 < ends[i + 1] - ends[i] < SHINGLE]
        if short:  # a text under five words is one shingle
            hashes = np.concatenate([hashes, [U(xxhash.xxh3_64_intdigest(x.tobytes())) for _, x in short]]).astype(U)
            of = np.concatenate([of, [i for i, _ in short]])
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        first = np.ones(len(of), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        tokens, of = hashes[first], of[first]
        ends = np.searchsorted(of, np.arange(len(texts) + 1))
        set_ids = [xxhash.xxh3_128_digest(tokens[ends[i] : ends[i + 1]].tobytes()) if ends[i] < ends[i + 1] else None for i in range(len(texts))]
        fresh = []
        for i, s in enumerate(set_ids):
            if s is not None and s not in seen:
                if len(seen) < REMEMBERED:
                    seen.add(s)
                fresh.append(i)
        sizes = np.diff(ends)
        kept = np.concatenate([np.empty(0, np.int64), *(np.arange(ends[i], ends[i + 1]) for i in fresh)]).astype(np.int64)
        mine, mine_ends = tokens[kept], np.concatenate([[0], np.cumsum(sizes[fresh])]).astype(np.int64) if fresh else np.zeros(1, np.int64)
        sketch = sketches(mine, mine_ends) if fresh else None
        paths: list[list] = [[] for _ in fresh]
        for seed in seeds if fresh else ():
            owner = np.arange(len(fresh))
            node1, path1 = chosen(mine, mine_ends, owner, np.full(len(fresh), seed, U))
            owner1 = owner[node1]
            node2, path2 = chosen(mine, mine_ends, owner1, path1)
            node3, path3 = chosen(mine, mine_ends, owner1[node2], path2)
            b2, b3 = np.searchsorted(node2, np.arange(len(path1) + 1)), np.searchsorted(node3, np.arange(len(path2) + 1))
            for k, o in enumerate(owner1.tolist()):
                sub = b"".join(path2[j : j + 1].tobytes() + int(b3[j + 1] - b3[j]).to_bytes(2, "big") + path3[b3[j] : b3[j + 1]].tobytes() for j in range(b2[k], b2[k + 1]))
                paths[o].append({"path": int(path1[k].view(np.int64)), "sub": sub})
        place = {i: k for k, i in enumerate(fresh)}
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(set_ids, pa.binary()), pa.array(sizes, pa.int32()),
                pa.array([sketch[place[i]].tobytes() if i in place else None for i in range(len(ids))], pa.binary()),
                pa.array([parity(tokens[ends[i] : ends[i + 1]]) if i in place else None for i in range(len(ids))], pa.binary()),
                pa.array([deflate_sorted(tokens[ends[i] : ends[i + 1]]) if i in place else None for i in range(len(ids))], pa.binary()),
                pa.array([paths[place[i]] if i in place else None for i in range(len(ids))], pa.list_(pa.struct([("path", pa.int64()), ("sub", pa.binary())]))),
            ],
            names=["doc_id", "set_id", "n", "sketch", "bits", "tokens", "paths"],
        )

    def run(batches):
        keys, seen = WordKeys(), set()
        for batch in batches:
            ids, texts, start = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), 0
            while start < len(ids):
                stop, size = start, 0
                while stop < len(ids) and (stop == start or size < CHUNK_BYTES):
                    size += len(texts[stop] or b"")
                    stop += 1
                yield some(ids[start:stop], texts[start:stop], keys, seen)
                release()
                start = stop
            del ids, texts
        del keys, seen
        release()

    return documents(docs).mapInArrow(run, SETS)


def _children(sub: bytes, level: int) -> Iterator[tuple[int, bytes | None]]:
    """(path, what lies below it) of the children packed in ``sub`` of a node at a level, the last but one at 2."""
    if level == 2:
        for at in range(0, len(sub), 8):
            yield int.from_bytes(sub[at : at + 8], "little", signed=True), None
        return
    at = 0
    while at < len(sub):
        n = int.from_bytes(sub[at + 8 : at + 10], "big")
        yield int.from_bytes(sub[at : at + 8], "little", signed=True), sub[at + 10 : at + 10 + 8 * n]
        at += 10 + 8 * n


def _descend(level: int) -> Callable:
    """Rows of nodes at a level as rows of their children."""

    def run(batches):
        for batch in batches:
            kids = [(k, path, rest) for k, sub in enumerate(batch["sub"].to_pylist()) for path, rest in _children(sub, level)]
            at = pa.array([k for k, _, _ in kids], pa.int64())
            columns = [pa.array([p for _, p, _ in kids], pa.int64()), *(batch[c].take(at) for c in ("set_id", "n", "sketch")), pa.array([r for _, _, r in kids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "set_id", "n", "sketch", "sub"])

    return run


def _segments(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    held_rows, key_held = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != key_held:
                if held_rows > 1:
                    yield pa.Table.from_batches(held)
                held, held_rows, key_held = [], 0, key
            held.append(batch.slice(a, b - a))
            held_rows += b - a
    if held_rows > 1:
        yield pa.Table.from_batches(held)


def _grouped(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric matrix of links is joined to."""
    labels = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, labels[None, :], len(labels)).min(1)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def _likely(n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Pairs that can be at the threshold, by size and by sketch with a margin of four deviations."""
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    same = np.zeros((len(n), len(n)), np.int64)
    for k in range(sketch.shape[1]):
        same += np.bitwise_count(sketch[:, None, k] ^ sketch[None, :, k])
    expected = (1 + PERCENT / 100) / 2
    least = expected - 4 * np.sqrt(expected * (1 - expected) / np.minimum(low, 64 * SKETCH_WORDS))
    return (low * 100 >= PERCENT * high) & (1 - same / (64.0 * SKETCH_WORDS) >= least)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every bucket the edges of a forest that joins the sets which can be at the threshold."""
    out: list[tuple] = []

    def flush():
        rows = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names=["u", "v"])

    for table in _segments(batches, ["path", "part"]):
        ids, n, sketch = table["set_id"].to_pylist(), table["n"].to_numpy(), table["sketch"].to_pylist()
        keep = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        if len(keep) > 1:
            bits = np.frombuffer(b"".join(sketch[i] for i in keep), U).reshape(len(keep), SKETCH_WORDS)
            out += [(ids[keep[i]], ids[keep[k]]) for i, k in enumerate(_grouped(_likely(n[keep], bits)).tolist()) if i != k]
        if len(out) >= 20_000:
            yield flush()
    if out:
        yield flush()
    release()


def _thinned(found: Callable) -> Callable:
    """``found`` with its edges as forests, in one worker: a second function on its rows would hold a second worker for each core."""
    return lambda batches: forests()(found(batches))


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (u, v) that join the sets of every group that the paths find; their number is bounded by that of the nodes."""
    rows = sets.where(F.col("paths").isNotNull()).select(F.inline("paths"), "set_id", "n", "sketch").select("path", "set_id", "n", "sketch", "sub")
    buckets, spark = None, sets.sparkSession
    for level in range(1, DEPTH + 1):
        large = written(rows.groupBy("path").agg(F.count("*").alias("sets")).where(F.col("sets") > SMALL))
        # At most one path for every SMALL rows; beyond what may be broadcast, a path's rows are dealt to many tasks.
        marked = rows.join(F.broadcast(large), "path", "left") if large.count() <= BROADCAST_PATHS else attached(rows, large, ["path"], "set_id")
        small = marked.where(F.col("sets").isNull() | F.lit(level == DEPTH))
        parts = F.coalesce(F.ceil(F.col("sets") / PART).cast("int"), F.lit(1))
        small = small.select("path", F.pmod(F.xxhash64("path", "set_id"), parts).cast("int").alias("part"), "set_id", "n", "sketch")
        buckets = small if buckets is None else buckets.union(small)
        if level < DEPTH:
            rows = marked.where(F.col("sets").isNotNull()).select("path", "set_id", "n", "sketch", "sub").mapInArrow(_descend(level), NODES)
            rows = checkpointed(rows.coalesce(max(fewer(spark), spark.sparkContext.defaultParallelism)))
    return buckets.repartition("path", "part").sortWithinPartitions("path", "part", "set_id").mapInArrow(_thinned(_compare), "u binary, v binary")


def covering_length(n: int) -> int:
    """So many first tokens of a set of n that all others together are fewer than any set at the threshold shares with it."""
    return n - -(-PERCENT * n // 100) + 1


def _frequent(sets: DataFrame) -> np.ndarray:
    """Tokens for the end of the order, sorted: those that are frequent in a share of the sets.

    Every order finds every pair, and so any share will do: one that puts frequent tokens last has smaller buckets. Counted
    are twice the tokens that a set goes down to, as others take the place of those put last.
    """
    share = min(1, max(1 / ORDER_SHARE, ORDER_SETS / max(sets.count(), 1)))

    def run(batches):
        for batch in batches:
            for packed in batch["tokens"].to_pylist():
                tokens = inflate_sorted(packed)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[: 2 * covering_length(len(tokens))].view(np.int64))], names=["token"])

    some = sets.where(F.pmod(F.xxhash64("set_id", F.lit("order")), F.lit(1 << 20)) < int(share * (1 << 20))).select("tokens").mapInArrow(run, "token long")
    counts = some.groupBy("token").agg(F.count("*").alias("sets")).where(F.col("sets") >= max(3, math.ceil(SMALL * share)))
    return np.sort(counts.orderBy(F.desc("sets"), "token").limit(FREQUENT).toArrow()["token"].to_numpy().view(U))


def _covering(frequent: np.ndarray) -> Callable:
    """Rows (token, key) of the tokens that each set goes down to: the first ones that are not frequent, then the frequent ones."""

    def common(tokens):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        return frequent[at] == tokens

    def run(batches):
        for batch in batches:
            keys, firsts, held = [], [], 0
            for key, packed in zip(batch["key"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                tokens = inflate_sorted(packed)
                length = covering_length(len(tokens))
                first = tokens[:length]
                if len(frequent) and common(first).any():
                    last = common(tokens)
                    first = np.concatenate([tokens[~last][:length], tokens[last]])[:length]
                keys.append(key)
                firsts.append(first)
                held += length
                if held > 100_000:
                    yield children(keys, firsts)
                    keys, firsts, held = [], [], 0
            if keys:
                yield children(keys, firsts)
        release()

    def children(keys, firsts):
        columns = [np.concatenate(firsts).view(np.int64), np.repeat(np.array(keys, np.int64), [len(x) for x in firsts])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (token, key) as the buckets of two keys or more; one that is too large as a row for each key, with its token."""

    def made(tokens, keys, token):
        """Buckets of whole runs; or with a token, rows of a run that is too large."""
        starts = np.arange(len(keys)) if token is not None else np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        take = np.ones(len(starts), bool) if token is not None else sizes > 1
        ends = np.concatenate([[0], np.cumsum(sizes[take])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.repeat(take, sizes)]))
        return pa.RecordBatch.from_arrays([pa.array([token] * len(lists), pa.int64()), lists], names=["token", "keys"])

    def gathered():
        rows, size = [], 0
        for batch in batches:
            rows.append((batch["token"].to_numpy(), batch["key"].to_numpy()))
            size += batch.num_rows
            if size >= 50_000:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows

    tokens, keys, flowing = np.empty(0, np.int64), np.empty(0, np.int64), None
    for rows in gathered():
        tokens, keys = np.concatenate([tokens, *(t for t, _ in rows)]), np.concatenate([keys, *(k for _, k in rows)])
        if not len(tokens):
            continue
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])])  # a set may come from several tasks
        tokens, keys = tokens[fresh], keys[fresh]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(tokens)]]))
        over = (sizes > GATHERED) | (tokens[starts] == flowing if flowing is not None else False)
        for a, n in zip(starts[over].tolist(), sizes[over].tolist(), strict=True):
            yield made(None, keys[a : a + n], int(tokens[a]))
        whole = ~over
        whole[-1] = False
        whole = np.repeat(whole, sizes)
        if whole.any():
            yield made(tokens[whole], keys[whole], None)
        flowing = int(tokens[-1]) if over[-1] else None
        tokens, keys = (tokens[:0], keys[:0]) if over[-1] else (tokens[starts[-1] :], keys[starts[-1] :])
    if len(tokens):
        yield made(tokens, keys, None)
    release()


def _possible(n: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Pairs that sizes and parity bits allow to be at the threshold: all that are, and few others."""
    width, out = np.array([len(b) for b in bits]), np.zeros((len(n), len(n)), bool)

    def signs(rows, w, at):
        flat = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint8).reshape(-1, w)) for k in rows])
        return 1 - 2 * np.unpackbits(flat[:, at : at + 512], axis=1).astype(np.float32)

    for w in np.unique(width).tolist():
        rows, columns = np.flatnonzero(width == w), np.flatnonzero((width == w) | (width == 2 * w))
        alike = np.zeros((len(rows), len(columns)), np.float32)
        for at in range(0, w, 512):
            alike += signs(rows, w, at) @ signs(columns, w, at).T
        a, b = n[rows][:, None], n[columns][None, :]
        far = (8 * w - alike) / 2
        out[np.ix_(rows, columns)] = (np.minimum(a, b) * 100 >= PERCENT * np.maximum(a, b)) & (far * (100 + PERCENT) <= (100 - PERCENT) * (a + b))
    return out | out.T


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every bucket of ``covering`` the edges of a forest that joins the sets which may be at the threshold."""
    us: list[bytes] = []
    vs: list[bytes] = []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (us, vs)], names=["u", "v"])
        us.clear()
        vs.clear()
        return out

    for table in _segments(batches, ["bucket"]):
        ids, n, bits = table["set_id"].to_pylist(), table["n"].to_numpy().astype(np.int64), table["bits"].to_pylist()
        keep = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        if len(keep) > 1:
            for i, k in enumerate(_grouped(_possible(n[keep], [bits[i] for i in keep])).tolist()):
                if i != k:
                    us.append(ids[keep[i]])
                    vs.append(ids[keep[k]])
        if len(us) >= 20_000:
            yield flush()
    if us:
        yield flush()
    release()


def covering(sets: DataFrame) -> DataFrame:
    """Edges (u, v) such that all sets at the threshold are joined, whatever the paths have missed.

    Of two sets at the threshold the smaller has ``PERCENT`` of the larger's size, and each as much of itself in common
    with the other; so the first token in common, in any order, is among the ``covering_length`` first of both. Sets of under
    four tokens are linked with equal ones only. Sets are known by 64 bits until they are compared: should two
    agree in these, both are compared.
    """
    sets = sets.where(F.col("tokens").isNotNull() & (F.col("n") > 3)).select("set_id", F.xxhash64("set_id").alias("key"), "n", "bits", "tokens")
    rows = sets.select("key", "tokens").mapInArrow(_covering(_frequent(sets)), "token long, key long")
    found = written(rows.repartition("token").sortWithinPartitions("token", "key").mapInArrow(_buckets, "token long, keys array<long>").distinct())
    buckets = found.where("token is null").select(F.xxhash64("keys").alias("bucket"), F.explode("keys").alias("key"))
    rows = buckets.join(sets.select("key", "set_id", "n", "bits"), "key").select("bucket", "set_id", "n", "bits")
    edges = rows.repartition("bucket").sortWithinPartitions("bucket", "set_id").mapInArrow(_thinned(_split), "u binary, v binary")
    large = found.where("token is not null")
    if not large.limit(1).count():
        return edges
    # Sizes at the threshold are in one band or in neighbours: bands are wider than the threshold allows sizes to differ.
    band = F.floor(F.log(F.col("n")) / math.log(104 / PERCENT)).cast("int")
    large = written(large.select("token", F.col("keys")[0].alias("key")).join(sets.select("key", "set_id", "n"), "key").select("token", "set_id", band.alias("band")))
    heads = written(large.groupBy("token", "band").agg(F.min("set_id").alias("head")))
    within = attached(large, heads, ["token", "band"], "set_id").select(F.col("set_id").alias("u"), F.col("head").alias("v"))
    above = heads.select("token", (F.col("band") - 1).alias("band"), F.col("head").alias("v"))
    across = heads.join(above, ["token", "band"]).select(F.col("head").alias("u"), "v")
    return edges.union(within.union(across).where("u <> v").distinct().mapInArrow(forests(), "u binary, v binary"))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat, other = np.concatenate(left), np.concatenate(right)
    names = np.intersect1d(flat, other)
    row, column = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])

    def placed(tokens, of):
        at = np.searchsorted(names, tokens)
        here = at < len(names)
        here[here] = names[at[here]] == tokens[here]
        at, of = at[here], of[here]
        order = np.argsort(at, kind="stable")
        return at[order], of[order]

    (a, row), (b, column) = placed(flat, row), placed(other, column)
    for low in range(0, len(names), NAMES_AT_ONCE):
        width = min(NAMES_AT_ONCE, len(names) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for matrix, at, of in ((x, a, row), (y, b, column)):
            i, j = np.searchsorted(at, [low, low + width])
            matrix[of[i:j], at[i:j] - low] = 1
        out += x @ y.T
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: how many documents each set is linked with, and a set that it is linked to.

    A block meets itself (x = y), or another block; then only pairs across count. Tiles of a fixed number of sets
    bound what is held beside the packed tokens of two blocks.
    """
    for table in _segments(batches, ["root", "x", "y"]):
        ids, own, copies = table["set_id"].to_pylist(), table["own"].to_numpy(), table["copies"].to_numpy()
        x, y, packed = table["x"][0].as_py(), table["y"][0].as_py(), table["tokens"].to_pylist()
        sides = [np.flatnonzero(own == x), np.flatnonzero(own == y)]
        links, forest = np.zeros(len(ids), np.int64), Forest()
        for i in range(0, len(sides[0]), TILE):
            rows = sides[0][i : i + TILE]
            left = [inflate_sorted(packed[k]) for k in rows]
            n_left = np.array([len(t) for t in left])
            for j in range(i if x == y else 0, len(sides[1]), TILE):
                columns, same = sides[1][j : j + TILE], x == y and i == j
                right = left if same else [inflate_sorted(packed[k]) for k in columns]
                n_right = n_left if same else np.array([len(t) for t in right])
                shared = _shared(left, right)
                linked = shared * 100 >= PERCENT * (n_left[:, None] + n_right[None, :] - shared)
                if same:
                    np.fill_diagonal(linked, False)
                links[rows] += linked @ copies[columns].astype(np.int64)
                if not same:
                    links[columns] += copies[rows].astype(np.int64) @ linked
                both = np.zeros((len(rows) + len(columns),) * 2, bool)
                both[: len(rows), len(rows) :] = linked
                for a, b in enumerate(_grouped(both | both.T).tolist()):
                    if a != b:
                        forest.join(*(int(rows[k]) if k < len(rows) else int(columns[k - len(rows)]) for k in (a, b)))
        yield pa.RecordBatch.from_arrays([table["set_id"].combine_chunks(), pa.array(links, pa.int64()), pa.array([ids[forest.root(k)] for k in range(len(ids))], pa.binary())], names=["set_id", "links", "to"])
    release()


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Jaccard distance of each set from its group's pivot."""
    for batch in batches:
        pivots, out = {}, []
        for mine, pivot in zip(batch["tokens"].to_pylist(), batch["pivot"].to_pylist(), strict=True):
            if pivot not in pivots:
                pivots = {pivot: inflate_sorted(pivot)}
            a, b = inflate_sorted(mine), pivots[pivot]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append(1 - shared / (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("root", "set_id", "n", "copies", "tokens")), pa.array(out, pa.float64())], names=["root", "set_id", "n", "copies", "tokens", "far"])


def _fitting(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str, size: Column) -> DataFrame:
    """``rows`` joined with a table that has each key once: broadcast where its size is small, else dealt."""
    return rows.join(F.broadcast(table), on) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else attached(rows, table, on, salt_by, "inner")


def _blocked(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How the sets of the groups that fill several blocks meet: rows for ``_links``, and what needs no comparison.

    Blocks are ranges of the distance from the group's pivot. That distance is a metric: of two blocks whose
    greatest distances add up to no more than 0.2 all pairs are linked, of two that lie more than 0.2 apart none
    is. Only other pairs of blocks meet. Second come edges (u, v) to the pivot, third rows (set_id, links) of
    the pairs known to be linked.
    """
    limit, slack = 1 - PERCENT / 100, 1e-9
    pivots = groups.select("root", F.col("pivot").alias("set_id")).join(members.select("root", "set_id", "tokens"), ["root", "set_id"]).select("root", F.col("tokens").alias("pivot"))
    rows = _fitting(members.join(groups.select("root"), "root", "left_semi"), written(pivots), ["root"], "set_id", F.length("pivot") + 64)
    rows = written(rows.select("root", "set_id", "n", "copies", "tokens", "pivot").mapInArrow(_distances, FAR)).withColumn("cell", F.floor(F.col("far") * 1000).cast("int"))
    cells = rows.groupBy("root", "cell").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("root").orderBy("cell")) - F.col("size")  # over at most 1001 cells of a group
    place = lambda t: F.floor(t * F.col("blocks") / F.col("total")).cast("int")
    cells = cells.withColumn("before", before).join(groups.select("root", "blocks", "total"), "root")
    cells = written(cells.select("root", "cell", place(F.col("before")).alias("first"), place(F.col("before") + F.col("size") - 1).alias("last")))
    own = F.col("first") + F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("last") - F.col("first") + 1).cast("int")
    rows = written(_fitting(rows, cells, ["root", "cell"], "set_id", F.lit(48)).select("root", own.alias("own"), "set_id", "copies", "tokens", "far"))
    blocks = written(rows.groupBy("root", "own").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.sum("copies").alias("inside")))
    a = blocks.select("root", F.col("own").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"), F.col("inside").alias("x_inside"))
    b = blocks.select("root", F.col("own").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"), F.col("inside").alias("y_inside"))
    pairs = a.join(b, "root").where(F.col("x") <= F.col("y"))  # of blocks, not of sets
    sure = F.col("x_high") + F.col("y_high") <= limit - slack
    apart = F.greatest(F.col("x_low") - F.col("y_high"), F.col("y_low") - F.col("x_high")) > limit + slack
    pairs = written(pairs.select("root", "x", "y", "x_inside", "y_inside", sure.alias("sure"), (~sure & ~apart).alias("meet")))
    ends = F.array(F.col("x"), F.col("y"))
    meets = pairs.where("meet").select("root", "x", "y", F.explode(F.array_distinct(ends)).alias("own"))
    dealt = rows.join(meets, ["root", "own"]).select("root", "x", "y", "own", "set_id", "copies", "tokens")
    known = pairs.where("sure")
    known = known.select("root", F.col("x").alias("own"), F.col("y_inside").alias("inside")).union(known.where("x <> y").select("root", F.col("y").alias("own"), F.col("x_inside").alias("inside")))
    known = known.groupBy("root", "own").agg(F.sum("inside").alias("inside"))
    alone = pairs.where("sure and x = y").select("root", F.col("x").alias("own"), F.lit(1).alias("itself"))
    known = written(known.join(alone, ["root", "own"], "left"))
    known = _fitting(rows.select("root", "own", "set_id", "copies"), known, ["root", "own"], "set_id", F.lit(48)).select("set_id", (F.col("inside") - F.when(F.col("itself") == 1, F.col("copies")).otherwise(0)).alias("links"))
    stars = _fitting(rows.where(F.col("far") <= limit - slack).select("root", "set_id"), groups.select("root", "pivot"), ["root"], "set_id", F.lit(64)).select(F.col("set_id").alias("u"), F.col("pivot").alias("v"))
    return dealt, stars, known


def joined(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its connected near duplicates), n_links.

    Two documents are linked if their shingle sets have a Jaccard similarity of 0.8 or more, just 0.8 too; ``n_links``
    counts the linked documents, copies included. A text under five words is one shingle; very long texts are
    compared whole. Texts without words, null ones too, are linked to none and are their own class. Rows with one id
    are documents of their own, repeated rows too; a null id makes a class id only where its class has no other. An
    empty table gives an empty result; other columns, whatever their names, are dropped.
    """
    prepare(docs.sparkSession)
    sets = checkpointed(shingled(docs, runs_needed(target_recall)))
    groups = components(candidates(sets).union(covering(sets)), thinned=True)
    copies = written(sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low")))
    members = groups.select(F.col("node").alias("set_id"), "root").join(copies.select("set_id", "copies"), "set_id")
    tokens = sets.where(F.col("tokens").isNotNull()).select("set_id", "n", "tokens")
    if groups.count() <= BROADCAST_MEMBERS:  # as 64-bit numbers; the exact join follows
        tokens = tokens.withColumn("key", F.xxhash64("set_id")).join(F.broadcast(groups.select(F.xxhash64("node").alias("key"))), "key", "left_semi").drop("key")
    members = written(tokens.join(members, "set_id").dropDuplicates(["set_id"]).select("root", "set_id", "n", "copies", "tokens"))
    total = F.sum("n")
    blocks = F.ceil(total / F.least(F.lit(BLOCK_TOKENS), F.greatest(F.lit(BLOCK_LEAST), total / BLOCKS))).cast("int")
    sizes = members.groupBy("root").agg(total.alias("total"), blocks.alias("blocks"), F.max_by("set_id", F.struct("copies", "set_id")).alias("pivot"))
    large = written(sizes.where("blocks > 1"))
    dealt, stars, known = _blocked(members, large)
    dealt = members.join(large, "root", "left_anti").select("root", *(F.lit(0).alias(c) for c in ("x", "y", "own")), "set_id", "copies", "tokens").union(dealt)
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "set_id")
    links = written(gathered(dealt.mapInArrow(_links, "set_id binary, links long, to binary")))
    classes = components(links.select(F.col("set_id").alias("u"), F.col("to").alias("v")).union(stars)).withColumnRenamed("node", "set_id")
    low = classes.join(copies, "set_id").groupBy("root").agg(F.min("low").alias("class_id"))
    counts = links.select("set_id", "links").union(known).groupBy("set_id").agg(F.sum("links").alias("links"))
    found = copies.join(attached(classes, low, ["root"], "set_id"), "set_id", "left").join(counts, "set_id", "left")
    found = written(found.select("set_id", F.coalesce("class_id", "low").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = attached(sets.select("doc_id", "set_id"), found, ["set_id"], "doc_id")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with its columns, one document of each class: the one with the smallest id.

    Of rows that share that id one stays. Rows with a null id stay, as nothing tells them from another. Null, empty
    and blank texts are in no class and stay; very long texts are compared whole; an empty table gives an empty
    result. Columns of any name pass through unchanged.
    """
    away, rows = unused("away", docs), unused("rows", docs)
    found = joined(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    gone = written(found.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias(away)).distinct())
    kept = docs.join(gone, docs[id_col] == gone[away], "left_anti")
    shared = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(away)).agg(F.count("*").alias(rows)).where(F.col(rows) > 1).select(away))
    if not shared.limit(1).count():
        return kept
    once = kept.join(shared, kept[id_col] == shared[away], "left_semi").dropDuplicates([id_col])
    return kept.join(shared, kept[id_col] == shared[away], "left_anti").unionByName(once)
