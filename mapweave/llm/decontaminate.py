"""Finding benchmark items inside documents by size-partitioned MinHash containment search.

Jaccard similarity says little when a short item lies in a long document, so the search is by
containment: the share of the item's shingles that the document has. Items are partitioned by the number
of their shingles, a class for each doubling. A class has its own sketch, the ``s`` smallest hashes (a
bottom-s MinHash) of an item's shingles, with ``s`` as many as an item of the class may miss and some more, so
that larger items ask for more agreement; and two bounds of its own: an item of n shingles that may miss m has at
least ``s - m`` of its sketch in every document that contains it to the threshold, and such a document has
at least the shingles that the class's smallest item needs. Neither bound loses an item, whatever the
document's length. Each text is hashed once and probed against the sketches of the classes it is long enough
for; documents that hit are verified by exact containment over their whole shingle sets, word by word.

An item of fewer words than a shingle is one shingle of its own length, sought among the windows of that length.

The queries are the benchmark's items, a stated set against all documents: they go to the workers in slices of
a fixed number, each slice searched in a pass over all documents, so what the driver and a worker hold is
bounded however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.session import checkpointed, documents, prepare, release, unused
from mapweave.llm.words import U, WordKeys, keyed, windows

SHINGLE, THRESHOLD_PERCENT = 5, 80
#: Items a pass, and bytes of text an item counts at most; a longer one makes its slice shorter, never its text.
SLICE_ITEMS, SLICE_BYTES = 50_000, 32 << 20
#: Words of documents that a worker holds at once.
CHUNK_BYTES = 4 << 20
#: Upper bits of a hash that tell most shingles from all that is in a sketch.
SEEN_BITS = 22
RESULT = "doc_id long, item_id long, n_shared long, n_shingles long"


def shingles(words: list[bytes], k: int) -> frozenset[bytes]:
    """Distinct runs of k words."""
    return frozenset(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def needed(n: int, percent: int) -> int:
    """Shingles of n that make up the threshold."""
    return -(-n * percent // 100)


class _SizeClass:
    """The sketches of items whose number of shingles has the same bit length."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], percent: int) -> None:
        smallest, largest = min(len(h) for _, h in rows), max(len(h) for _, h in rows)
        sketch = largest - needed(largest, percent) + largest.bit_length()
        #: Shingles that a document must have at least, and hashes of an item's sketch, by the item's number.
        self.least = needed(smallest, percent)
        self.bound = {at: min(len(h), sketch) - (len(h) - needed(len(h), percent)) for at, h in rows}
        pairs = sorted((x, at) for at, h in rows for x in np.sort(h)[:sketch].tolist())
        self.hashes, self.items = np.array([x for x, _ in pairs], U), np.array([at for _, at in pairs], np.int64)

    def candidates(self, hashes: np.ndarray, of: np.ndarray, n_windows: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
        """(document, item) with as much of the item's sketch as the bound asks for; each (document, hash) comes once."""
        fit = n_windows[of] >= self.least
        hashes, of = hashes[fit], of[fit]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        times = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        pairs, met = np.unique(np.repeat(of, times) * n_items + self.items[at], return_counts=True)
        for pair, n in zip(pairs.tolist(), met.tolist(), strict=True):
            if n >= self.bound[pair % n_items]:
                yield divmod(pair, n_items)


class Sketches:
    """The size classes of a slice of items, for each length of shingle; items of equal shingles are one."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, percent: int) -> None:
        self.percent, keys = percent, WordKeys()
        known: dict[tuple[int, frozenset[bytes]], list[int]] = {}
        for item, text in items:
            if words := text.split():
                size = min(k, len(words))
                known.setdefault((size, shingles(words, size)), []).append(item)
        self.items = [(size, mine, ids) for (size, mine), ids in known.items()]
        rows: dict[int, dict[int, list]] = {}
        for at, (size, mine, _) in enumerate(self.items):
            words, ends = keyed(list(mine), keys)
            rows.setdefault(size, {}).setdefault(len(mine).bit_length(), []).append((at, np.unique(windows(words, ends, size)[0])))
        self.classes = {size: [_SizeClass(x, percent) for _, x in sorted(by.items())] for size, by in sorted(rows.items())}
        self.seen = {}
        for size, classes in self.classes.items():
            self.seen[size] = np.zeros(1 << SEEN_BITS, bool)
            for c in classes:
                self.seen[size][c.hashes >> U(64 - SEEN_BITS)] = True

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) that the sketches let pass."""
        found: set[tuple[int, int]] = set()
        for size, classes in self.classes.items():
            hashes, _, of = windows(words, ends, size)
            n_windows = np.bincount(of, minlength=len(ends) - 1)
            near = np.flatnonzero(self.seen[size][hashes >> U(64 - SEEN_BITS)])
            hashes, of = hashes[near], of[near]
            order = np.lexsort((hashes, of))
            hashes, of = hashes[order], of[order]
            first = np.ones(len(of), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
            for c in classes:
                found.update(c.candidates(hashes[first], of[first], n_windows, len(self.items)))
        return found

    def verified(self, text: bytes, items: list[int]) -> Iterator[tuple[int, int, int]]:
        """(item id, shared shingles, its shingles) of those items that the text has to the threshold."""
        words, own = text.split(), {}
        for at in items:
            size, mine, ids = self.items[at]
            if size not in own:
                own[size] = shingles(words, size)
            shared = len(mine & own[size])
            if shared >= needed(len(mine), self.percent):
                for item in ids:
                    yield item, shared, len(mine)


def matches(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = THRESHOLD_PERCENT, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_shingles) for documents that contain an item to the threshold.

    Null, empty and blank texts, and such items, match nothing; an item under ``k`` words is one shingle. Very
    long texts are searched whole. A share just at the threshold matches. Items with equal texts match each; repeated
    rows repeat their matches; empty tables give an empty result. Other columns, whatever their names, are dropped.
    """
    prepare(docs.sparkSession)
    docs = documents(docs)
    queries = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    out = None
    for part in _slices(queries):
        found = docs.mapInArrow(_search(Sketches(part, k, percent)), RESULT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def _slices(queries: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for row in queries.toLocalIterator():
        if held and (len(held) >= SLICE_ITEMS or size + len(row["text"]) > SLICE_BYTES):
            yield held
            held, size = [], 0
        held.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
    if held:
        yield held


def _search(sketches: Sketches):
    def run(batches):
        keys = WordKeys()
        for batch in batches:
            ids, texts, start = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), 0
            while start < len(ids):
                stop, size = start, 0
                while stop < len(ids) and (stop == start or size < CHUNK_BYTES):
                    size += len(texts[stop] or b"")
                    stop += 1
                by_doc: dict[int, list[int]] = {}
                for d, at in sorted(sketches.candidates(*keyed(texts[start:stop], keys))):
                    by_doc.setdefault(d, []).append(at)
                rows = [(ids[start + d], *x) for d, mine in by_doc.items() for x in sketches.verified(texts[start + d], mine)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_shared", "n_shingles"])
                start = stop
            release()
        del keys
        release()

    return run


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with its columns, whatever their names.

    Rows go by id: of rows that share an id all go if one matches, and rows with a null id stay unless one of them
    matched. The other cases are those of ``matches``: null, empty and blank texts stay, empty tables change nothing.
    """
    gone = unused("contaminated", docs)
    found = matches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, **options)
    found = checkpointed(found.select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(found, docs[id_col].eqNullSafe(found[gone]), "left_anti")
