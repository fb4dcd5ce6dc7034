"""Finding personal data: patterns for the plain forms, a character-level BiLSTM-CRF for the others.

The network is trained in numpy from labelled spans. ``examples`` writes such spans with a seeded
generator (plain and loose forms, among numbers, codes and words that are none of them); callers can
pass their own. A stretch of text around the characters that a span needs is cut into overlapping windows,
counted from the stretch's own beginning; the emissions of the windows are blended where they
overlap, the weight of each falling towards its edges, and one Viterbi pass runs over the whole stretch.
So no span is cut by a window's edge, and where a text begins makes no difference. A span that meets the end
of its stretch is decoded again with more text around it. Spans of all stretches are reconciled over the whole
text: of those that overlap the choice with the greatest total score stays (weighted interval scheduling).

Each of the four kinds has a digit or an ``@``; a decoded span without either is dropped, so text far from
such characters is not decoded. Forms without them (``name at host dot com``, numbers in words) are not sought.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapweave.llm.bilstm import PAD, BiLstmCrf
from mapweave.llm.session import documents, prepare, release

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, HIDDEN, EPOCHS, EXAMPLES = 96, 48, 24, 16, 3000
#: Characters of text around a digit or ``@`` that are decoded, also where a span meets the end of the first; and the
#: longest part of a stretch that one Viterbi pass takes, ``FAR`` more on both sides: a span is of the part it starts in.
NEAR, FAR, PART = 40, 256, 2048
#: Least total by which a span's labels beat "none", and windows decoded at once.
LEAST_SCORE, WINDOWS_AT_ONCE = 4.0, 2048
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[+(]?[0-9](?:.*[0-9])?", re.DOTALL)
_CANDIDATE = re.compile(r"[0-9@]")
_PLAIN = "@.-+()[]_%:/, \n"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches in linear time: from each ``@`` back over the local part, then over the domain."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = at = domain.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain forms, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def symbol_table() -> np.ndarray:
    """Symbol of each ASCII code point: 1 digit, 2 capital, 3 other, 4 not ASCII, letters and marks from 5."""
    table = np.full(129, 3, np.int64)
    table[48:58], table[65:91], table[128] = 1, 2, 4
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _PLAIN):
        table[ord(c)] = 5 + i
    return table


SYMBOLS = 5 + 26 + len(_PLAIN)


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def examples(n: int = EXAMPLES, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of a window's length or less with labelled (kind, start, end) spans, which can reach over the edges."""
    r = random.Random(seed)
    pick = r.choice
    syllables = "the an re tion ing ed er on es de la que os ar en un ch der ge ie sch ung le ou ai é ü ó ñ".split()
    word = lambda: "".join(pick(syllables) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(pick("0123456789") for _ in range(k))
    plain_word = lambda least=2: "".join(pick("abcdefghijklmnopqrstuvwxyz") if r.random() < 0.4 else pick(syllables[:22]) for _ in range(r.randint(least, 5)))

    def label():
        return plain_word(1) + pick(["", "", "", "-" + plain_word(1), num(1), "-" + pick(["and", "of", "the"]) + "-" + plain_word(1)])

    def email():
        name = plain_word(1) + pick(["", "", num(r.randint(1, 4)), pick("._-") + plain_word(1), pick("._-") + num(2), pick("._-") + plain_word(1) + num(2)])
        host = ".".join(pick(["mail", "mx" + num(1), label(), label()]) for _ in range(r.randint(1, 3))) + "." + pick(["com", "org", "net", "de", "fr", "es", "io", "co.uk", plain_word(1)[:3] + "x"])
        return pick([name, name, name.capitalize()]) + pick(["@", " @ ", " @ ", "@ ", " @"]) + host

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        gap = pick(["", " ", "-", ".", " "])
        return gap.join(num(4) for _ in range(4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {num(2)} {num(6)}", f"{a}.{b}.{c}", f"+{num(1)}-{a}-{b}-{c}"])

    def none():
        return pick([
            lambda: num(r.randint(1, 6)), lambda: "$" + num(2) + "." + num(2), lambda: f"{pick(['19', '20'])}{num(2)}-{num(2)}-{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}",
            lambda: "".join(pick("0123456789abcdef") for _ in range(r.randint(12, 40))), lambda: "AKIA" + "".join(pick("ABCDEFGHIJ0123456789") for _ in range(16)), lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(24))}"',
            lambda: f"{num(1)}.{num(2)}", lambda: num(2) + "%", lambda: f"{num(2)}:{num(2)}", lambda: "@" + plain_word(), lambda: "src" + num(2), lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"({num(4)})", lambda: f"{num(3)}-{num(3)}", lambda: "a@b",
        ])()

    makers, out = (email, ip, card, phone), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WIDTH:
            what = r.random()
            if what < 0.16:
                k = r.randrange(4)
                piece = makers[k]()
                spans.append((k, len(text), len(text) + len(piece)))
            else:
                piece = none() if what < 0.3 else word().capitalize() if what < 0.4 else word()
            text += piece + pick([" ", " ", " ", " ", " ", ", ", ", ", ". ", ". ", "? ", ": ", ") ", " (", "\n", "*** ", "### ", " | "])
        width = pick([WIDTH, WIDTH, r.randint(12, WIDTH)])
        cut = r.randint(0, max(0, len(text) - width))
        out.append((text[cut : cut + width], [(k, s - cut, e - cut) for k, s, e in spans if s - cut < width and e - cut > 0]))
    return out


def labelled(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of windows: 0 none, 1 + 2k first and 2 + 2k further characters of kind k.

    A span that began before the window has no first character in it.
    """
    x, y, table = np.zeros((len(rows), WIDTH), np.int64), np.zeros((len(rows), WIDTH), np.int64), symbol_table()
    for row, (text, spans) in enumerate(rows):
        x[row, : len(text)] = symbols(text, table)[:WIDTH]
        for k, s, e in spans:
            y[row, max(0, s) : min(e, len(text))] = 2 + 2 * k
            if s >= 0:
                y[row, s] = 1 + 2 * k
    return x, y


@functools.lru_cache(maxsize=4)
def trained(n: int = EXAMPLES, epochs: int = EPOCHS, hidden: int = HIDDEN) -> BiLstmCrf:
    """The network of the generated examples; the same on every call and machine up to rounding."""
    model = BiLstmCrf(SYMBOLS, 1 + 2 * len(KINDS), hidden)
    model.fit(*labelled(examples(n)), epochs)
    return model


def _plausible(kind: int, text: str) -> bool:
    d = len(_digits(text))
    return ("@" in text and "." in text, text.count(".") == 3 and 4 <= d <= 12, 13 <= d <= 19 and luhn(_digits(text)), 7 <= d <= 15)[kind]


def tidied(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The bounds that a found span has by its characters: whole names and hosts, first to last digit; or nothing."""
    if kind:
        m = _NUMBERS.search(text, start, end)
        return m and (m.start(), m.end())
    at = text.find("@", start, end)
    host = at + 1
    while 0 < host < len(text) and text[host] == " ":
        host += 1
    domain = _DOMAIN.match(text, host) if at >= 0 else None
    stop = at
    while stop > 0 and text[stop - 1] == " ":
        stop -= 1
    begin = stop
    while begin > 0 and _LOCAL.match(text[begin - 1]):
        begin -= 1
    return (begin, domain.end()) if domain and begin < stop else None


def reconciled(spans: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """Of (start, end, kind) spans with scores, those without overlaps that have the greatest total."""
    order = sorted(spans, key=lambda x: (x[1], x[0], x[2]))
    ends, best, kept = [x[1] for x in order], [0.0], []
    for i, x in enumerate(order):
        before = bisect.bisect_right(ends, x[0], 0, i)
        take = best[before] + spans[x]
        kept.append(before if take > best[i] else -1)
        best.append(max(take, best[i]))
    out, i = [], len(order)
    while i:
        if kept[i - 1] >= 0:
            out.append(order[i - 1])
            i = kept[i - 1]
        else:
            i -= 1
    return out[::-1]


def stretches(marks: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(start, end, core start, core end) of the text around marks; long stretches in parts that overlap."""
    if not len(marks):
        return []
    breaks = np.flatnonzero(np.diff(marks) > 2 * NEAR)
    out = []
    for a, b in zip([0, *(breaks + 1).tolist()], [*breaks.tolist(), len(marks) - 1], strict=True):
        start, end = max(0, int(marks[a]) - NEAR), min(length, int(marks[b]) + 1 + NEAR)
        for at in range(start, end, PART):
            core = min(end, at + PART)
            out.append((max(start, at - FAR), min(end, core + FAR), at, core))
    return out


_SLOPE = {n: np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(np.float32) for n in range(1, WIDTH + 1)}


def blended(model: BiLstmCrf, stretch: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions (characters, labels) of each stretch of symbols, from windows that overlap by half."""
    starts = [(k, at) for k, codes in enumerate(stretch) for at in range(0, max(1, len(codes) - WIDTH + STRIDE), STRIDE)]
    out = [np.zeros((len(codes), model.n_labels), np.float32) for codes in stretch]
    weights = [np.zeros(len(codes), np.float32) for codes in stretch]
    for low in range(0, len(starts), WINDOWS_AT_ONCE):
        some = starts[low : low + WINDOWS_AT_ONCE]
        x = np.full((len(some), WIDTH), PAD, np.int64)
        for row, (k, at) in enumerate(some):
            codes = stretch[k][at : at + WIDTH]
            x[row, : len(codes)] = codes
        e = model.emissions(x)[0]
        for row, (k, at) in enumerate(some):
            n = min(WIDTH, len(stretch[k]) - at)
            out[k][at : at + n] += _SLOPE[n][:, None] * e[:n, row]
            weights[k][at : at + n] += _SLOPE[n]
    return [e / w[:, None] for e, w in zip(out, weights, strict=True)]


def decoded(model: BiLstmCrf, emissions: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, score) of the spans in each stretch, by Viterbi over its whole length."""
    out: list[list] = [[] for _ in emissions]
    order = sorted(range(len(emissions)), key=lambda k: len(emissions[k]))
    while order:
        some, size = [], 0
        while order and (not some or size + len(emissions[order[-1]]) <= WINDOWS_AT_ONCE * WIDTH and len(emissions[order[-1]]) * 2 >= len(emissions[some[0]])):
            some.append(order.pop())
            size += len(emissions[some[-1]])
        e = np.full((len(emissions[some[0]]), len(some), model.n_labels), -1e4, np.float32)
        e[:, :, 0] = 0
        for row, k in enumerate(some):
            e[: len(emissions[k]), row] = emissions[k]
        labels = model.viterbi(e)
        for row in np.flatnonzero(labels.any(1)).tolist():
            k, mine, j = some[row], labels[row].tolist(), 0
            lead = emissions[k][np.arange(len(emissions[k])), labels[row, : len(emissions[k])]] - emissions[k][:, 0]
            while j < len(emissions[k]):
                if mine[j] == 0:
                    j += 1
                    continue
                kind, begin = (mine[j] - 1) // 2, j
                j += 1
                while j < len(emissions[k]) and mine[j] == 2 + 2 * kind:
                    j += 1
                out[k].append((kind, begin, j, float(lead[begin:j].sum())))
    return out


def model_spans(model: BiLstmCrf, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) spans of each text by the network alone."""
    table, found = symbol_table(), [{} for _ in texts]
    codes = [symbols(t, table) if _CANDIDATE.search(t) else None for t in texts]
    jobs = [(of, *x) for of, c in enumerate(codes) if c is not None for x in stretches(np.flatnonzero((c == 1) | (c == table[ord("@")])), len(c))]
    wider = []

    def decode(some, last: bool) -> None:
        spans = decoded(model, blended(model, [codes[of][a:b] for of, a, b, _, _ in some]))
        for (of, start, end, core, core_end), mine in zip(some, spans, strict=True):
            text = texts[of]
            if not last and any((b == 0 and start > 0) or (e == end - start and end < len(text)) for _, b, e, _ in mine):
                wider.append((of, max(0, start - FAR), min(len(text), end + FAR), core, core_end))
                continue
            for kind, b, e, score in mine:
                # What was only added around a stretch belongs to another stretch, or to none.
                inside = core <= start + b < core_end or last and start + b < core_end and start + e > core
                if inside and score >= LEAST_SCORE and (place := tidied(kind, text, start + b, start + e)) and _plausible(kind, text[place[0] : place[1]]):
                    key = (*place, kind)
                    found[of][key] = max(score, found[of].get(key, score))

    for todo, last in ((jobs, False), (wider, True)):
        held, size = [], 0
        for job in todo:
            held.append(job)
            size += job[2] - job[1]
            if size >= WINDOWS_AT_ONCE * STRIDE:
                decode(held, last)
                held, size = [], 0
        if held:
            decode(held, last)
    return [[(k, s, e) for s, e, k in reconciled(x)] for x in found]


def all_spans(model: BiLstmCrf, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans of each text, and the spans that the network adds apart from them."""
    out = []
    for text, more in zip(texts, model_spans(model, texts), strict=True):
        base = base_spans(text) if _CANDIDATE.search(text) else []
        taken = sorted((s, e) for _, s, e in base)
        out.append((base, [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]))
    return out


def found(docs: DataFrame, examples_used: int = EXAMPLES) -> DataFrame:
    """Per document: matches of each plain form, a hash of their spans, and all spans.

    Null, empty and blank texts have none; each row is judged by itself, repeated rows and null ids too; an empty table
    gives an empty result; other columns, whatever their names, are dropped. Very long texts are read whole; offsets
    count code points. Of spans that the network scores alike the one that ends first stays.
    """
    prepare(docs.sparkSession)
    model = trained(examples_used)

    def run(batches):
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch["text"].to_pylist()]
            spans = all_spans(model, texts)
            joined = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(x))
            columns = [batch["doc_id"], *(pa.array([sum(x[0] == k for x in base) for base, _ in spans], pa.int64()) for k in range(4))]
            columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in spans], pa.string()))
            columns.append(pa.array([joined(base + more) for base, more in spans], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            release()

    return documents(docs).mapInArrow(run, RESULT)
