"""SentencePiece encoding over a relational lattice, and decoding.

Texts are cut into words (a space and what follows it, and again between letters or digits and those
marks that no piece has beside one), and each distinct word is encoded once. Its substrings up to the longest piece are exploded and equi-joined with the piece table;
the pieces found are the edges of the word's lattice, grouped by word and folded with ``aggregate``.

The models at hand are byte-pair models: their pieces' scores are merge priorities, and the sum of
scores that Viterbi maximises gives other pieces than the library does. So the fold goes through the
edges by priority, not by position: its state is the set of boundaries, a bit each, and an edge is
taken if it spans just two symbols, whose boundary it removes. That is the library's result wherever a
merge never opens a better one. Where an edge could still be taken at the end, the word is encoded
again by explicit merging, as are words with over ``MASK`` characters or several spaces. For unigram models, whose
scores are log-probabilities, ``segmented`` folds the same lattice by Viterbi.

What moves: every block of documents asks for each of its distinct words once, the answers come back
packed, and the documents travel as word numbers.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.blocks import deflate, deflate_sorted, inflate, inflate_sorted
from mapweave.llm.session import documents, prepare, release, shuffle_partitions, stable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a word that fit a mask; bytes of text a block has; pieces that are broadcast at most.
MASK, BLOCK_BYTES, BROADCAST_PIECES = 62, 12 << 20, 1_000_000
#: Bits of a key that number a block's words, and of those above that number a partition's blocks.
WORD_BITS, PLACE_BITS = 22, 18
#: In an edge's id: the character itself, which no piece covers.
UNKNOWN = 1 << 23
SPACE = "▁"
#: Partitions of words for one of documents: a word's edges take many times its own space.
WORD_PARTITIONS = 8
#: Answers packed together, words asked for in one batch, and pieces cut into words at once, at most.
PACKED, WORDS_AT_ONCE, PIECES_AT_ONCE = 200_000, 50_000, 50_000
RESULT = "doc_id long, ids array<int>, text_sha256 string"


class Model:
    """The pieces of a byte-pair SentencePiece model with byte fallback, without normalisation."""

    def __init__(self, path: str = MODEL) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or normal.precompiled_charsmap or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only byte-pair models that keep texts as they are, with a space in front")
        sp = SentencePieceProcessor(model_file=path)
        everything = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in everything if sp.is_byte(i)}
        plain = [i for i in everything if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = sorted({-sp.get_score(i) for i in plain})
        rank = {s: k for k, s in enumerate(scores)}
        self.pieces = {sp.id_to_piece(i): (rank[-sp.get_score(i)], i) for i in plain}
        self.longest = max(map(len, self.pieces))
        if len(self.bytes) < 256 or any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces) or len(everything) >= UNKNOWN:
            raise ValueError("pieces must not cross words, and every byte must have a piece")
        near: dict[str, set[str]] = {}
        for p in self.pieces:
            for a, b in zip(p, p[1:], strict=False):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and not any(x.isalnum() and x.isascii() for x in near.get(c, ()))]
        odd = "".join(sorted({x for c in marks for x in near.get(c, ()) if x.isalnum()}))  # beside a mark in some piece
        s, a = re.escape("".join(marks)), rf"[^\W_{odd}]"
        #: Cuts between letters or digits and marks, where no piece has such a pair; otherwise only at spaces.
        self.words = re.compile(rf" *{a}+(?=[ \n{s}]|$)| *[{s}]+(?=[ \n]|{a}|$)| *[^ \n]+| +|\n" if marks else r" *[^ \n]+| +|\n")
        #: What stands between two spaces is one word unless it has one of these.
        self.cuts = "[\n" + "".join(f"\\{c}" for c in marks) + "]"
        raw = {i: p.replace(SPACE, " ").encode() for p, (_, i) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [raw.get(i, b"") for i in everything]

    def merged(self, word: str) -> list[int]:
        """Ids of a word by explicit merging, the best pair first and of equals the leftmost."""
        text = word.replace(" ", SPACE)
        at, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < len(text) and (hit := self.pieces.get(at[left] + at[right])):
                heapq.heappush(heap, (hit[0], left, at[left] + at[right]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, left, piece = heapq.heappop(heap)
            right = after[left]
            if not at[left] or right >= len(text) or at[left] + at[right] != piece:
                continue
            at[left], at[right], after[left] = piece, "", after[right]
            if after[left] < len(text):
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [i for s in at if s for i in self.ids(s)]

    def ids(self, symbol: str) -> list[int]:
        hit = self.pieces.get(symbol)
        return [hit[1]] if hit else [self.bytes[b] for b in symbol.encode()]


def _spaced(text: str) -> bool:
    return "  " in text or text[0] in (" ", SPACE) or SPACE in text


def _blocks(batches):
    """(place, ids, texts) of at most so many bytes, or of one longer text.

    A place counts on from the partition's; it leaves room for the numbers of the block's words below it.
    """
    made, ids, texts, size = TaskContext.get().partitionId() << PLACE_BITS, [], [], 0
    for batch in batches:
        for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids.append(i)
            texts.append(t.decode("utf-8", "replace") if t else None)
            size += len(t or b"")
            if size >= BLOCK_BYTES:
                yield made << WORD_BITS, ids, texts
                made, ids, texts, size = made + 1, [], [], 0
    if ids:
        yield made << WORD_BITS, ids, texts


class _Block:
    """The distinct words of a block, numbered in their order, and its documents as such numbers."""

    def __init__(self, place: int, ids: list, texts: list[str | None], find, cuts: str) -> None:
        plain = [t if t and not _spaced(t) else None for t in texts]
        self.odd = [k for k, t in enumerate(texts) if t and plain[k] is None]
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        self.counts = pc.list_value_length(split).fill_null(0).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(split))
        del plain, split
        self.indices, pieces = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
        whole = ~pc.match_substring_regex(pieces, cuts).to_numpy(zero_copy_only=False)
        words, sizes = [pc.binary_join_element_wise(" ", pieces.filter(pa.array(whole)), "")], []
        parted, self.n_pieces = np.flatnonzero(~whole), len(pieces)
        for at in range(0, len(parted), PIECES_AT_ONCE):
            self._cut((" " + p for p in pieces.take(pa.array(parted[at : at + PIECES_AT_ONCE])).to_pylist()), find, sizes, words)
        self._cut((" " + texts[k].replace(SPACE, " ") for k in self.odd), find, sizes, words)
        #: Where the words of a piece, or of a text that goes alone, begin among all, and how many they are.
        rest = np.concatenate([parted, self.n_pieces + np.arange(len(self.odd))])
        self.sizes, self.begin = np.ones(self.n_pieces + len(self.odd), np.int64), np.empty(self.n_pieces + len(self.odd), np.int64)
        self.begin[: self.n_pieces][whole] = np.arange(int(whole.sum()))
        self.sizes[rest] = np.concatenate(sizes)
        self.begin[rest] = int(whole.sum()) + np.cumsum(self.sizes[rest]) - self.sizes[rest]
        words = pc.dictionary_encode(pa.chunked_array(words, pa.string())).combine_chunks()
        order = pc.sort_indices(words.dictionary)  # neighbours share their beginnings, which compress
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        self.at, self.words = rank[words.indices.to_numpy()], words.dictionary.take(order)
        own_way = pc.or_(pc.or_(pc.equal(self.words, "\n"), pc.starts_with(self.words, "  ")), pc.greater(pc.utf8_length(self.words), MASK))
        own_way = own_way.to_numpy(zero_copy_only=False).copy()
        own_way[1 << WORD_BITS :] = True  # more words than a block can number are in no text under 8 MB
        #: Numbers of the words that are asked for, and of those that go their own way.
        self.asked, self.others = np.flatnonzero(~own_way), np.flatnonzero(own_way)
        self.place, self.ids, self.digests = place, ids, b"".join(hashlib.sha256((t or "").encode()).digest() for t in texts)

    @staticmethod
    def _cut(texts, find, sizes: list, words: list) -> None:
        found = [find(t) for t in texts]
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        words.append(pa.array(chain.from_iterable(found), pa.string()))

    def packed(self) -> bytes:
        """The documents as numbers of words, the most frequent ones small, and what each number stands for."""
        alone = np.zeros(len(self.counts), np.int64)
        alone[self.odd] = 1
        starts = np.concatenate([[0], np.cumsum(self.counts + alone)])
        of, here = np.empty(int(starts[-1]), np.int32), np.ones(int(starts[-1]), bool)  # per text its pieces, or itself
        here[starts[self.odd]] = False
        of[here], of[~here] = self.indices, self.n_pieces + np.arange(len(self.odd))
        flat = []
        for low in range(0, len(of), PIECES_AT_ONCE):
            some = of[low : low + PIECES_AT_ONCE]
            sizes = self.sizes[some]
            after = np.cumsum(sizes)
            flat.append(self.at[np.repeat(self.begin[some] - (after - sizes), sizes) + np.arange(int(after[-1]))])
        lengths = np.diff(np.concatenate([[0], np.cumsum(self.sizes[of])])[starts])
        flat = np.concatenate([np.empty(0, np.int32), *flat])
        del of, here, starts
        order = np.argsort(-np.bincount(flat, minlength=len(self.words)), kind="stable").astype(np.uint32)
        rank = np.empty(len(self.words), np.uint32)
        rank[order] = np.arange(len(self.words), dtype=np.uint32)
        others = {int(k): self.words[k].as_py() for k in self.others}
        return pickle.dumps((self.ids, self.digests, deflate(lengths), deflate(rank[flat], 3), deflate(order), others))


def _pack_answers(batches):
    """Rows (key, ids, word) of one partition as few packed rows per block."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["key"].to_numpy()
        lists = table["ids"].chunk(0) if table["ids"].num_chunks else table["ids"].combine_chunks()
        starts, values = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
        again = {int(key[i]): table["word"][i].as_py() for i in np.flatnonzero(table["word"].is_valid().to_numpy()).tolist()}
        order = np.argsort(key)
        block = key[order] >> WORD_BITS
        edges = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows, place = order[a:b], int(block[a]) << WORD_BITS
            sizes = starts[rows + 1] - starts[rows]
            after = np.cumsum(sizes)
            ids = values[np.repeat(starts[rows] - (after - sizes), sizes) + np.arange(int(sizes.sum()))]
            mine = {k - place: w for k, w in again.items() if k >> WORD_BITS << WORD_BITS == place}
            packed = pickle.dumps((deflate_sorted((key[rows] - place).astype(np.uint32)), deflate(sizes.astype(np.uint32)), deflate(ids.astype(np.uint32)), mine))
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([packed], pa.binary())], names=["block", "answers"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield from flush()
            held = []
    if held:
        yield from flush()
        held = []
    release()


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """Rows (word, ids, again) from distinct words of at most ``MASK`` characters in a column ``word``.

    ``ids`` are in order, characters without a piece as ``UNKNOWN`` plus code point; ``again`` says that
    an edge could still have been taken.
    """
    spark = words.sparkSession
    rows = [(p.replace(SPACE, " "), rank, i) for p, (rank, i) in model.pieces.items()]
    # As a table of Arrow's: from a list Spark would start further Python workers, which stay beside the others.
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)]
    pieces = spark.createDataFrame(pa.table(columns, names=["piece", "rank", "id"]))
    if len(rows) <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    parts = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    parts = parts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("word") - F.col("s")))).alias("l"))
    parts = parts.select("word", "s", "l", F.substr(F.col("word"), F.col("s") + 1, F.col("l")).alias("piece"))
    edges = parts.join(pieces, "piece", "left").where(F.col("id").isNotNull() | (F.col("l") == 1))
    left = lambda x, n: F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))
    place = left(F.col("s").cast("long"), 30).bitwiseOR(left(F.col("l").cast("long"), 24)).bitwiseOR(F.coalesce(F.col("id"), F.lit(UNKNOWN) + F.ascii("piece")).cast("long"))
    edge = left(F.coalesce("rank", F.lit(0)).cast("long"), 36).bitwiseOR(place)
    one = F.lit(1).cast("long")
    inner, ends = left(left(one, F.col("l") - 1) - 1, F.col("s") + 1), left(one.bitwiseOR(left(one, F.col("l"))), F.col("s"))
    # The masks of an edge are made with it, where expressions are compiled; within the fold they are not.
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(edge.alias("edge"), inner.alias("inner"), ends.alias("ends")))).alias("edges"))

    within = lambda m, a: F.bit_count(m.bitwiseAND(a["inner"]))
    open_ = lambda m, a: m.bitwiseAND(a["ends"]) == a["ends"]
    # A single character has no inner boundary, so the fold passes it by.
    folded = F.aggregate("edges", left(one, F.length("word") + 1) - 1, lambda m, a: F.when((within(m, a) == 1) & open_(m, a), m.bitwiseAND(F.bitwise_not(a["inner"]))).otherwise(m))
    done, mask = grouped.select("word", "edges", folded.alias("mask")), F.col("mask")
    taken = done.select("word", mask, F.filter("edges", lambda a: (within(mask, a) <= 1) & open_(mask, a)).alias("taken"))
    order = F.sort_array(F.transform("taken", lambda a: a["edge"].bitwiseAND((1 << 36) - 1)))
    # Pieces that cover the word once, and no more, are one fewer than its boundaries.
    return taken.select("word", F.transform(order, lambda e: e.bitwiseAND((1 << 24) - 1).cast("int")).alias("ids"), (F.size("taken") + 1 != F.bit_count("mask")).alias("again"))


def segmented(words: DataFrame, pieces: DataFrame, unknown: float, longest: int) -> DataFrame:
    """Rows (word, pieces, score): the segmentation of each word with the greatest sum of scores, for unigram models.

    ``words`` has distinct words in a column ``word``, ``pieces`` rows (piece, score); characters without a piece are
    pieces of their own with the score ``unknown``. The edges of the lattice are folded by their ends: the state is,
    for each position, the best score there and the edge that led to it. Of equal sums the one whose last piece
    is longer stays, and so on towards the front. Null and empty words have no pieces and score 0; repeated words
    count as one; an empty table gives an empty result; other columns of either table are dropped.
    """
    words = words.select(F.coalesce("word", F.lit("")).alias("word")).distinct()
    parts = words.select("word", F.explode(F.sequence(F.lit(0), F.greatest(F.length("word") - 1, F.lit(0)))).alias("s"))
    parts = parts.where(F.length("word") > 0).select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s")))).alias("l"))
    parts = parts.select("word", "s", "l", F.substr(F.col("word"), F.col("s") + 1, F.col("l")).alias("piece"))
    known = pieces.select("piece", F.col("score").cast("double").alias("score")).where(F.col("piece").isNotNull()).groupBy("piece").agg(F.max("score").alias("score"))
    edges = parts.join(known, "piece", "left").where(F.col("score").isNotNull() | (F.col("l") == 1)).withColumn("score", F.coalesce("score", F.lit(unknown)))
    edge = F.struct((F.col("s") + F.col("l")).alias("e"), "s", "score")  # by end; of one end from the longest piece on
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    place = "struct<score:double,s:int>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"))).cast(f"array<{place}>")

    def step(best, e):
        sum_ = F.get(best, e.s).score + e.score
        better = F.struct(sum_.alias("score"), e.s.cast("int").alias("s")).cast(place)
        last = F.size(best) - 1
        replaced = F.when(sum_ > F.get(best, last).score, F.concat(F.slice(best, 1, last), F.array(better))).otherwise(best)
        return F.when(e.e > last, F.concat(best, F.array(better))).otherwise(replaced)  # every end has an edge: one of a single character

    folded = grouped.select("word", F.aggregate("edges", start, step).alias("best"))
    none = F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("cuts"))
    # Back from the end along the edges kept: as many steps as there are characters at most.
    back = lambda a, i: F.when(a["at"] > 0, F.struct(F.get(F.col("best"), a["at"]).s.alias("at"), F.concat(F.array(F.get(F.col("best"), a["at"]).s), a.cuts).alias("cuts"))).otherwise(a)
    cuts = folded.select("word", F.get(F.col("best"), F.length("word")).score.alias("score"), F.aggregate(F.sequence(F.lit(1), F.length("word")), none, back, lambda a: a.cuts).alias("cuts"))
    ends = F.concat(F.slice("cuts", 2, F.size("cuts")), F.array(F.length("word")))
    made = cuts.select("word", F.transform("cuts", lambda c, i: F.substr(F.col("word"), c + 1, F.get(ends, i) - c)).alias("pieces"), "score")
    return words.join(made, "word", "left").select("word", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"), F.coalesce("score", F.lit(0.0)).alias("score"))


def encoded(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, the ids of its pieces, and the SHA-256 of its text.

    Null and empty texts have no pieces; blank ones have those of their characters. Rows are encoded each, also with
    equal ids or texts and null ids; an empty table gives an empty result; other columns, whatever their names, are
    dropped. Very long texts are encoded whole. The model's own sign for a space, in a text, is encoded as one, as the
    library does, so only there decoding gives another text. Blocks hold a fixed number of bytes, or one longer text.
    """
    return _encoded(docs, model or Model(), _as_ids, RESULT)


def _encoded(docs: DataFrame, model: Model, finish: Callable, schema: str) -> DataFrame:
    """``finish(doc_ids, bounds, pieces, digests)`` of all documents, a thousand at a time, as rows of the schema."""
    spark = docs.sparkSession
    prepare(spark)
    docs, n = stable(documents(docs)), WORD_PARTITIONS * shuffle_partitions(spark)

    find, cuts = model.words.findall, model.cuts

    def ask(batches):
        for place, ids, texts in _blocks(batches):
            block = _Block(place, ids, texts, find, cuts)
            for at in range(0, len(block.asked), WORDS_AT_ONCE):
                some = block.asked[at : at + WORDS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([block.words.take(pa.array(some)), pa.array(some + place, pa.int64())], names=["word", "key"])
            del block
            release()

    def pack(batches):
        for place, ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([_Block(place, ids, texts, find, cuts).packed()], pa.binary())], names=["block", "docs"])
            release()

    asked = docs.mapInArrow(ask, "word string, key long").where("word is not null and key is not null").repartition(n, "word")
    # Both uses read the same columns of the same exchange, which therefore runs once.
    known = asked.groupBy("word").agg(F.min("key").alias("key")).where("key is not null").select("word")
    answers = asked.join(lattice(known, model).hint("shuffle_hash"), "word").select("key", "ids", F.when(F.col("again"), F.col("word")).alias("word"))
    answers = answers.mapInArrow(_pack_answers, "block long, answers binary")
    blocks = docs.mapInArrow(pack, "block long, docs binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        made = put_together(left, right)
        release()  # what the block needed, also of a task's last one
        return made

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("two passes over the documents saw different rows")
        ids, digests, lengths, flat, order, others = pickle.loads(left["docs"][0].as_py())
        order = inflate(order, np.uint32)
        answered = [pickle.loads(x) for x in right["answers"].to_pylist()]
        number = np.concatenate([np.empty(0, np.uint32), *(inflate_sorted(x[0], np.uint32) for x in answered)]).astype(np.int64)
        sizes = np.concatenate([np.empty(0, np.uint32), *(inflate(x[1], np.uint32) for x in answered)]).astype(np.int64)
        values = np.concatenate([np.empty(0, np.uint32), *(inflate(x[2], np.uint32) for x in answered)]).astype(np.int32)
        if len(number) + len(others) != len(order):
            raise RuntimeError("two passes over the documents saw different rows")
        starts, redo = np.concatenate([[0], np.cumsum(sizes)]), {}
        for row in np.unique(np.searchsorted(starts, np.flatnonzero(values >= UNKNOWN), "right") - 1).tolist():
            redo[int(number[row])] = [i for v in values[starts[row] : starts[row + 1]].tolist() for i in ([v] if v < UNKNOWN else [model.bytes[b] for b in chr(v - UNKNOWN).encode()])]
        for x in answered:
            redo |= {k: model.merged(w) for k, w in x[3].items()}
        redo |= {k: model.merged(w) if w != "\n" else [model.bytes[10]] for k, w in others.items()}
        begin, size = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        begin[number], size[number] = starts[:-1], sizes
        more = np.array([i for x in redo.values() for i in x], np.int32)
        where = np.cumsum([0, *(len(x) for x in redo.values())])
        for k, word in enumerate(redo):
            begin[word], size[word] = len(values) + where[k], len(redo[word])
        values = np.concatenate([values, more])
        sequence, counts = order[inflate(flat, np.uint32)], inflate(lengths, np.int64)
        return pa.concat_tables(_assembled(ids, digests, counts, sequence, begin, size, values, finish)).combine_chunks()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, schema)


def _assembled(ids, digests, counts, sequence, begin, size, values, finish):
    """The documents of a block with the ids of their pieces, a thousand at a time."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(ids), 1000):
        b = min(a + 1000, len(ids))
        some = sequence[ends[a] : ends[b]].astype(np.int64)
        sizes = size[some]
        after = np.cumsum(sizes)
        pieces = values[np.repeat(begin[some] - (after - sizes), sizes) + np.arange(int(sizes.sum()))]
        bounds = np.concatenate([[0], after])[ends[a : b + 1] - ends[a]]
        yield finish(ids[a:b], bounds, pieces, [digests[32 * i : 32 * i + 32].hex() for i in range(a, b)])


def _as_ids(ids, bounds, pieces, digests) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pieces, pa.int32()))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": lists, "text_sha256": pa.array(digests, pa.string())})


def _lists(column: pa.Array) -> list[list[int]]:
    """Rows of an array of ids; nulls as empty lists."""
    starts, values = np.asarray(column.offsets), np.asarray(column.values)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b].tolist() if v else [] for a, b, v in zip(starts[:-1].tolist(), starts[1:].tolist(), valid.tolist(), strict=True)]


def decoded_text(ids: list[int], raw: list[bytes]) -> str:
    """The text of pieces, without the space that encoding puts in front."""
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decoded(encodings: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the text.

    Null and empty ids give the empty text; null doc_ids and repeated rows are decoded each; an empty table gives an
    empty result; other columns, whatever their names, are dropped. Bytes that are no UTF-8 become the replacement sign.
    """
    raw = (model or Model()).raw

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([decoded_text(x, raw) for x in _lists(batch["ids"])], pa.string())], names=["doc_id", "text"])

    return encodings.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, n_pieces, SHA-256 of the ids as 32-bit little-endian numbers, and whether decoding gives the text again.

    The cases are those of ``encoded``; null and empty texts have 0 pieces and decode to the empty text.
    """
    model = model or Model()
    raw = pa.array(model.raw, pa.binary())

    def digest(ids, bounds, pieces, digests) -> pa.Table:
        back = raw.take(pa.array(pieces))
        starts, data = np.asarray(back.buffers()[1]).view(np.int32), back.buffers()[2] or b""
        data, at = memoryview(data), starts[: len(pieces) + 1][bounds].tolist()
        texts = [data[a + (a < b and data[a] == 32) : b] for a, b in zip(at[:-1], at[1:], strict=True)]
        numbers = pieces.astype("<i4")
        hashes = [hashlib.sha256(numbers[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        same = [hashlib.sha256(t).hexdigest() == d for t, d in zip(texts, digests, strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_pieces": pa.array(np.diff(bounds), pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "round_trip": pa.array(same, pa.bool_())})

    return _encoded(docs, model, digest, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")
