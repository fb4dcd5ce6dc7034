"""Scoring texts with a smoothed n-gram model of the corpus, run as a weighted backoff automaton.

All n-grams up to an order are counted over all training documents, none is dropped. Smoothing is Dirichlet,
level by level: ``p(w|context) = (c(context w) + k * p(w|shorter context)) / (c(context) + k)`` above an additive
unigram model, which sums to one over the known words, the end and one unknown word. In automaton form:
a state for the empty context (the root) and one for every known context of up to ``order - 1`` tokens; an arc
for every known n-gram, with its log-probability, to the longest known context that it ends in; and from every
state but the root a failure arc to the context without its first token, with weight ``log10(k / (c(context) + k))``.
The root has an arc for every token. A text is scored in one left-to-right traversal that carries the state: where
a state has no arc for a token, its failure arcs are followed, their weights added, until one has.

A state is known after ``order - 1`` tokens whatever came before, so texts are traversed in segments side by
side, each from the root through the tokens before it.

A block of documents builds the part of the automaton that its own n-grams can reach, from the counts
that the key buckets return (see ``blocks``); counts never pass through the driver. Unigrams are counted as words,
longer n-grams by a hash that has ``SPARE_BITS`` bits more than number the corpus's bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm import blocks as B
from mapweave.llm.session import checkpointed
from mapweave.llm.words import U, mix

ADD = 0.1
ORDER = 3
#: Weight of the shorter context within a probability, in observations.
PRIOR = 4.0
FOLDS = 10
SPARE_BITS = 20
#: Bytes of text in a block and per key bucket, and tokens of a segment.
BLOCK_BYTES, BUCKET_BYTES, SEGMENT = 4 << 20, 12 << 20, 512
#: Tokens that can't be words, which hold no tab or line feed.
START, END = b"\t", b"\n"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


class Grams:
    """Distinct n-grams of one block, in the order in which they are asked for, and those that end at each place.

    Places are all tokens of all documents in a row, each document from its start to its end. ``at[m - 1]`` holds
    per place the number of the m-gram that ends there, or -1 where it would begin before the document.
    """

    def __init__(self, docs: bytes, n_buckets: int, bits: int, order: int, folds: int) -> None:
        self.ids, texts = B.unpacked(docs)
        self.held = [held_out(x, folds) for x in self.ids]
        vocab: dict[bytes, int] = {START: 0, END: 1}
        rows = []
        for text in texts:
            row = [0, *(vocab.setdefault(w, len(vocab)) for w in (text or b"").lower().split()), 1]
            rows.append(np.array(row, np.int32))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), U, len(vocab))
        names = np.empty(len(vocab), object)
        names[:] = list(vocab)
        self.order = np.lexsort((np.arange(len(vocab)), hashes))  # ties between equal hashes: order of first use, the same each time
        self.words, self.bounds = names[self.order], B.bucket_bounds(hashes[self.order], n_buckets)
        flat = np.concatenate([np.empty(0, np.int32), *rows])
        self.ends = np.cumsum([0, *map(len, rows)])
        train = np.repeat(~np.array(self.held, bool), np.diff(self.ends)).astype(np.int64)
        self.at, self.counts = [flat], [np.bincount(flat, train, len(vocab)).astype(np.int64)]
        self.keys, self.key_bounds = [], []
        begin = np.repeat(self.ends[:-1], np.diff(self.ends))
        own, key = hashes[flat], hashes[flat]
        for m in range(2, order + 1):
            longer = np.empty_like(key)
            longer[1:] = mix(key[:-1] * U(0x9E3779B97F4A7C15) + own[1:] + U(m))
            key = longer
            whole = np.arange(len(flat)) - begin >= m - 1
            distinct, inverse = np.unique(key[whole] >> U(64 - bits), return_inverse=True)
            place = np.full(len(flat), -1, np.int32)
            place[whole] = inverse
            self.at.append(place)
            self.counts.append(np.bincount(inverse, train[whole], len(distinct)).astype(np.int64))
            self.keys.append(distinct)
            self.key_bounds.append(B.bucket_bounds(distinct, n_buckets, bits))


class Automaton:
    """States, arcs and failure arcs of a block's n-grams; arcs are numbered like the n-grams, level by level.

    ``counts[m - 1]`` has the training count of each m-gram of the block, ``base`` the log-probability of its unigrams.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], base: np.ndarray, prior: float) -> None:
        at, order = grams.at, len(counts)
        self.order, self.at = order, at
        levels = np.cumsum([0, *map(len, counts)])
        #: Number of the first arc of each level, and of the state after an n-gram that is a context, else -1.
        self.arcs, state = levels[:-1], np.full(int(levels[-1]), -1)
        n_states = 1
        for m in range(1, order):
            known = np.flatnonzero(counts[m - 1] > 0)
            state[levels[m - 1] + known] = n_states + np.arange(len(known))
            n_states += len(known)
        self.depth, self.fail, self.fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states, np.int64), np.zeros(n_states)
        self.weight, self.next = np.zeros(int(levels[-1])), np.full(int(levels[-1]), -1)
        self.weight[: len(base)], lower = base, None
        for m in range(1, order + 1):
            low, c = levels[m - 1], counts[m - 1]
            place = self._places(at[m - 1], len(c))  # where each m-gram of the block ends
            here = state[low : low + len(c)]
            if m > 1:
                before = np.where(place > 0, at[m - 2][place - 1], 0)  # its context
                lower = at[m - 2][place]  # and what it is without its first token
                k = prior / (counts[m - 2][before] + prior)
                self.weight[low : low + len(c)] = np.log10(c / (counts[m - 2][before] + prior) + k * 10.0 ** self.weight[levels[m - 2] + lower])
            # Without an arc of its own an n-gram never leads anywhere; the root has one for every token.
            follow = self.next[levels[m - 2] + lower] if m > 1 else np.zeros(len(c), np.int64)
            self.next[low : low + len(c)] = np.where(here >= 0, here, follow if m == 1 or m == order else -1)
            self.next[low : low + len(c)] = np.where((c > 0) | (m == 1), self.next[low : low + len(c)], -1)
            if m < order:
                mine = here >= 0
                self.depth[here[mine]] = m
                self.fail[here[mine]] = state[levels[m - 2] + lower[mine]] if m > 1 else 0
                self.fail_weight[here[mine]] = np.log10(prior / (c[mine] + prior))

    @staticmethod
    def _places(at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        there = np.flatnonzero(at >= 0)
        out[at[there]] = there
        return out

    def scores(self, ends: np.ndarray) -> np.ndarray:
        """Log10 probability of the token at every place, the starts' as 0."""
        out, warm = np.zeros(int(ends[-1])), self.order - 1
        cuts = [np.arange(a, b, SEGMENT) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        begin = np.concatenate([np.empty(0, np.int64), *cuts])
        first, last = np.repeat(ends[:-1], [len(c) for c in cuts]), np.repeat(ends[1:], [len(c) for c in cuts])
        stop, now = np.minimum(begin + SEGMENT, last), np.maximum(begin - warm, first)
        order = np.argsort(now - stop, kind="stable")  # the longest first: those that are done lie at the end
        begin, stop, now = begin[order], stop[order], now[order]
        state = np.zeros(len(now), np.int64)
        while len(now):
            todo, s, sums = np.arange(len(now)), state, np.zeros(len(now))
            after = np.zeros(len(now), np.int64)
            while len(todo):
                level = self.depth[s]
                arc = self.arcs[level] + self._grams(level, now[todo])
                to = self.next[arc]
                taken = to >= 0
                sums[todo] += np.where(taken, self.weight[arc], self.fail_weight[s])
                after[todo[taken]] = to[taken]
                todo, s = todo[~taken], self.fail[s[~taken]]
            scored = now >= begin
            out[now[scored]] = sums[scored]
            state, now = after, now + 1
            on = now < stop
            if not on.all():
                begin, stop, now, state = begin[on], stop[on], now[on], state[on]
        out[ends[:-1]] = 0
        return out

    def _grams(self, level: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = self.at[0][place].astype(np.int64)
        for m in range(1, self.order):
            deep = level == m
            out[deep] = self.at[m][place[deep]]
        return out


def model(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, int, int]:
    """Blocks of the documents, the training counts of each block's n-grams, the number of key buckets, and bits of a key."""
    packed, total = B.packed(docs, block_bytes)
    n, bits = B.bucket_count(total * (order - 1), bucket_bytes), min(64, max(1, total).bit_length() + SPARE_BITS)

    def ask(block: bytes):
        g, pack = Grams(block, n, bits, order, folds), zstandard.ZstdCompressor(level=1).compress
        unigrams = g.counts[0][g.order]
        for b in range(n):
            if (i := g.bounds[b]) < (j := g.bounds[b + 1]):
                yield b, 1, B.framed(pack(b" ".join(g.words[i:j])), B.deflate(unigrams[i:j]))
            for m, keys, bounds in zip(range(2, order + 1), g.keys, g.key_bounds, strict=True):
                if (i := bounds[b]) < (j := bounds[b + 1]):
                    yield b, m, B.framed(B.deflate_sorted(keys[i:j]), B.deflate(g.counts[m - 1][i:j]))

    def answer(parts, requests):
        unpack, total, replies = zstandard.ZstdDecompressor().decompress, {}, [b""] * len(parts)
        words = {i: (unpack(x[0]).split(b" "), B.inflate(x[1], np.int64)) for i, p in enumerate(parts) if p == 1 and (x := B.unframed(requests[i]))}
        for names, counts in words.values():
            for w, c in zip(names, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        for i, (names, _) in words.items():
            replies[i] = B.deflate(np.fromiter(map(total.__getitem__, names), np.int64))
        for m in sorted(set(parts) - {1}):
            rows = [i for i, p in enumerate(parts) if p == m]
            asked = [(B.inflate_sorted(x[0]), B.inflate(x[1], np.int64)) for x in (B.unframed(requests[i]) for i in rows)]
            keys, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([c for _, c in asked]), len(keys)).astype(np.int64)
            at = np.split(at, np.cumsum([len(k) for k, _ in asked])[:-1])
            for i, mine in zip(rows, at, strict=True):
                replies[i] = B.deflate(sums[mine])
        total.pop(START, None)
        return replies, (sum(total.values()), sum(c > 0 for c in total.values()))

    return packed, checkpointed(B.answered(B.requested(packed, ask), answer)), n, bits


def score(docs: DataFrame, prior: float = PRIOR, order: int = ORDER, folds: int = FOLDS, **sizes: int) -> DataFrame:
    """Log10 probability of every whole text, with the unigram base score beside it.

    Null, empty and blank texts have one token, the end. Rows with one id are scored apart; a null id is
    training; repeated rows count each. Tokens no training document has get the unknown word's share. Over an empty
    table the result is empty; where no document is training, N and V are 0 and every token is unknown. Other
    columns, whatever their names, are dropped. All of a text is read however long it is.
    """
    packed, counts, n, bits = model(docs, order, folds, **sizes)
    n_tokens, n_types = (int(x or 0) for x in counts.agg(F.sum("total_a"), F.sum("total_b")).first())

    def use(block: bytes, replies):
        g = Grams(block, n, bits, order, folds)
        known = [np.zeros(len(c), np.int64) for c in g.counts]
        for m, mine in enumerate(known, 1):
            got = np.concatenate([np.empty(0, np.int64), *(B.inflate(x, np.int64) for _, x in sorted(replies.get(m, {}).items()))])
            mine[g.order if m == 1 else slice(None)] = got
        base = np.log10((known[0] + ADD) / (n_tokens + ADD * (n_types + 1)))
        base[0], words = 0, g.at[0]
        scores = Automaton(g, known, base, prior).scores(g.ends)
        sums = lambda x: np.add.reduceat(x, g.ends[:-1])  # noqa: E731  each document has two places at least
        columns = {
            "doc_id": pa.array(g.ids, pa.int64()), "held_out": g.held, "n_tokens": pa.array(np.diff(g.ends) - 1, pa.int64()), "n_known": pa.array(sums((known[0][words] > 0) & (words > 0)), pa.int64()),
            "train_tokens": pa.array([n_tokens] * len(g.ids), pa.int64()), "base_score": sums(base[words]), "score": sums(scores),
        }
        return pa.table(columns)

    return B.met(packed, counts, use, RESULT)
