"""Removing passages that a document with a smaller id holds too, found by fixed-block anchors.

A window of ``window`` consecutive words always covers a whole block of ``(window + 1) // 2`` words of
any cutting into non-overlapping blocks. So the blocks of every document are the index, every rolling
window of block length is a probe, and where both meet across documents a repeat can lie. Hits are
extended: all windows that hold a hit are compared exactly by key, and the runs of windows that a
document with a smaller id holds too are the maximal exact repeats, which are removed.

Probes carry short keys, as many bits as keep chance hits rare for the size of the corpus: a chance
hit costs one more comparison and changes nothing. Full windows carry 64 bits, mixed word by word.
Every probe is made, over whole texts; keys travel as described in ``blocks``, so a passage in a third
of all documents is one entry for each block of documents and forms no group of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapweave.llm import blocks as B
from mapweave.llm.session import checkpointed
from mapweave.llm.words import SECOND, U, WordKeys, keyed, windows

WINDOW = 13
#: Bits of a probe's key beyond those that number the corpus's bytes.
SPARE_BITS = 10
MANY, INDEXED = 1, 2
NO_DOC = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class _Anchors:
    """Rolling probes and non-overlapping index blocks of the documents in one block of documents."""

    def __init__(self, docs: bytes, window: int, bits: int) -> None:
        self.ids, self.texts = B.unpacked(docs)
        self.words, self.ends = keyed(self.texts, WordKeys())
        k = (window + 1) // 2
        key, self.at, self.of = windows(self.words, self.ends, k)
        key >>= U(64 - bits)
        indexed = (self.at - self.ends[self.of]) % k == 0
        self.keys, self.inverse = np.unique(key, return_inverse=True)
        ids = np.array([NO_DOC if i is None else i for i in self.ids], np.int64)[self.of]
        low, high = np.full(len(self.keys), NO_DOC), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.inverse, ids)
        np.maximum.at(high, self.inverse, ids)
        self.flags = (low < high).astype(np.uint8) * MANY
        self.flags |= (np.bincount(self.inverse[indexed], minlength=len(self.keys)) > 0).astype(np.uint8) * INDEXED


class _Windows:
    """Windows that hold a hit, as (position, document), and the smallest document of each distinct pair of keys."""

    def __init__(self, docs: bytes, window: int, bits: int, hits: np.ndarray) -> None:
        a = _Anchors(docs, window, bits)
        self.ids, self.texts, self.ends = a.ids, a.texts, a.ends
        hit = np.zeros(len(a.words) + 1, np.int64)
        hit[a.at + 1] = hits[a.inverse]
        before = np.cumsum(hit)  # hits among the probes that start before a position
        key, at, of = windows(a.words, a.ends, window)
        held = before[at + window - (window + 1) // 2 + 1] > before[at]
        self.at, self.of = at[held], of[held]
        self.doc = np.array([NO_DOC if i is None else i for i in self.ids], np.int64)[self.of]
        self.keys, self.checks, self.inverse = distinct(key[held], windows(a.words, a.ends, window, SECOND)[0][held])
        self.low = np.full(len(self.keys), NO_DOC)
        np.minimum.at(self.low, self.inverse, self.doc)


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, keys and checks, and which of them each pair is."""
    order = np.lexsort((checks, keys))
    key, check = keys[order], checks[order]
    first = np.ones(len(order), bool)
    first[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return key[first], check[first], inverse


def _joined(replies: dict[int, dict[int, bytes]], part: int, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(B.inflate(x, kind) for _, x in sorted(replies.get(part, {}).items()))])


def deduplicated(docs: DataFrame, window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES, bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the kept words joined by a space.

    A word goes if a window of the input that covers it also starts in a document with a smaller id.
    Null and empty texts have no words and keep the empty string, as does a text that goes wholly.
    Texts shorter than a window keep every word; very long ones are read whole. Rows with equal ids, repeated ones too,
    count as one document's and remove nothing from each other; a null id counts as larger than every other id. An
    empty table gives an empty result, and other columns, whatever their names, are dropped.
    """
    packed, total = B.packed(docs, block_bytes)
    n, bits = B.bucket_count(total, bucket_bytes), min(64, max(1, total).bit_length() + SPARE_BITS)

    def probe(block: bytes):
        a = _Anchors(block, window, bits)
        bounds = B.bucket_bounds(a.keys, n, bits)
        for b in range(n):
            if (i := bounds[b]) < (j := bounds[b + 1]):
                yield b, 1, B.framed(B.deflate_sorted(a.keys[i:j]), B.deflate(a.flags[i:j]))

    def meet(parts, requests):
        asked = [(B.inflate_sorted(k), B.inflate(f, np.uint8)) for k, f in map(B.unframed, requests)]
        keys, at, times = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True, return_counts=True)
        flags = np.concatenate([f for _, f in asked])
        many = (times > 1) | (np.bincount(at, flags & MANY, len(keys)) > 0)
        hit = (many & (np.bincount(at, flags & INDEXED, len(keys)) > 0)).astype(np.uint8)
        return [B.deflate(hit[np.searchsorted(keys, k)]) for k, _ in asked], (0, 0)

    def smallest(parts, requests):
        asked = []
        for request in requests:
            keys, rest = B.unframed(request)
            checks, low = B.unframed(rest)
            asked.append((B.inflate_sorted(keys), B.inflate(checks, U), B.inflate(low, np.int64)))
        keys, _, at = distinct(*(np.concatenate([x[k] for x in asked]) for k in (0, 1)))
        low = np.full(len(keys), NO_DOC)
        np.minimum.at(low, at, np.concatenate([x[2] for x in asked]))
        parted = np.split(low[at], np.cumsum([len(x[0]) for x in asked])[:-1])
        return [B.deflate(x) for x in parted], (0, 0)

    def extend(block: bytes, replies):
        w = _Windows(block, window, bits, _joined(replies, 1, np.uint8))
        bounds = B.bucket_bounds(w.keys, n)
        rows = [(b, B.framed(B.deflate_sorted(w.keys[i:j]), B.framed(B.deflate(w.checks[i:j]), B.deflate(w.low[i:j])))) for b in range(n) if (i := bounds[b]) < (j := bounds[b + 1])]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "part": pa.array([2] * len(rows), pa.int32()), "keys": pa.array([x for _, x in rows], pa.binary())})

    def remove(block: bytes, replies):
        w = _Windows(block, window, bits, _joined(replies, 1, np.uint8))
        low = _joined(replies, 2, np.int64)
        repeated = w.at[low[w.inverse] < w.doc]
        edges = np.zeros(int(w.ends[-1]) + 1, np.int64)
        np.add.at(edges, repeated, 1)
        np.add.at(edges, repeated + window, -1)
        gone = np.cumsum(edges[:-1]) > 0
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
        for k, text in enumerate(w.texts):
            away = gone[w.ends[k] : w.ends[k + 1]]
            words = (text or b"").split()
            kept = b" ".join(x for x, g in zip(words, away.tolist(), strict=True) if not g)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(away.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        kept = pa.array(out.pop("kept"), pa.binary()).cast(pa.string())
        return pa.table({"doc_id": pa.array(w.ids, pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": kept})

    hits = checkpointed(B.answered(B.requested(packed, probe), meet))
    wanted = B.met(packed, hits, extend, B.REQUESTS, keep_block=True)
    lows = checkpointed(B.answered(wanted, smallest))
    return B.met(packed, hits.unionByName(lows), remove, RESULT)
