"""Finding secrets in texts by one combined automaton over their bytes.

All rules are compiled, reversed, into a single minimal automaton. One pass over the bytes of a text,
from the end, marks where matches of any rule begin; from the leftmost mark of a rule its own forward
automaton runs to the longest end, and the search goes on behind it. That gives the leftmost-longest,
non-overlapping matches of every rule, in time linear in the text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from mapweave.llm.automata import begins, compiled, linked, longest, parsed, reversed_node
from mapweave.llm.session import documents, prepare, release


@dataclass(frozen=True)
class Rule:
    """A pattern and the least length of its match, or of what follows ``head`` in it; ``tail`` may follow the match."""

    kind: str
    pattern: str
    least: int
    head: str | None = None
    base: bool = False
    tail: str = ""


_PEM = r"[A-Z0-9 ]*PRIVATE KEY-----"
#: A key's headers and body up to the END line; five dashes end it, so a second key is another match. Where
#: that line is missing, as in a cut text, the lines of base64 that follow are taken.
_PEM_TAIL = r"""(?:-{0,4}[A-Za-z0-9+/=:,.;_@#>*()"'\\\x20\t\r\n])*-----END """ + _PEM + r"|(?:(?:[\x20\t\r\n]|\\[rn])*[A-Za-z0-9+/=]{40,})+"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The base rules, then rules for tokens with a public prefix. Where a rule is one run of a
#: class, its least length can stand in the pattern: a run that is too short has no part that is long enough.
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", 12, _ASSIGN, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, None, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, None, True),
    Rule("private_key", "-----BEGIN " + _PEM, 0, tail=_PEM_TAIL),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
)
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    """Compiles on the driver; ``ready`` links the arrays on a worker."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        nodes = [parsed(r.pattern) for r in rules]
        self.back = compiled([reversed_node(x) for x in nodes], anywhere=True)
        self.forward = [compiled([parsed(f"{r.pattern}(?:{r.tail})?")], anywhere=False) if r.tail else compiled([x], anywhere=False) for r, x in zip(rules, nodes, strict=True)]
        self.heads = [r.head and compiled([parsed(r.head)], anywhere=False) for r in rules]

    def ready(self) -> Scanner:
        self.root, self.ends = linked(self.back), [linked(x) for x in self.forward]
        self.values = [h and linked(h) for h in self.heads]
        return self

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule; found by a base rule, or not within such a span."""
        found, free = [], [0] * len(self.rules)
        for start, bits in reversed(begins(self.root, data)):
            for k in range(len(self.rules)):
                if bits >> k & 1 and start >= free[k]:
                    free[k] = end = longest(self.ends[k], data, start)
                    value = longest(self.values[k], data, start) if self.values[k] else start
                    if end - value >= self.rules[k].least:
                        found.append((start, k, end))
        base = [x for x in found if self.rules[x[1]].base]
        return sorted(base + [x for x in found if not self.rules[x[1]].base and not any(s <= x[0] and x[2] <= e for s, _, e in base)])


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with code point offsets; each stretch of the text is decoded once."""
    marks, at, n = {}, 0, 0
    for x in sorted({y for s, _, e in spans for y in (s, e)}):
        n += len(data[at:x].decode("utf-8", "replace"))
        marks[x], at = n, x
    return [(marks[s], k, marks[e]) for s, k, e in spans]


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: matches of each base rule, a hash of the base spans, and all spans.

    Null, empty and blank texts have none; very long ones are read whole. Each row is judged by itself, so repeated
    rows repeat their result, null ids too; an empty table gives an empty result; other columns, whatever their names,
    are dropped. Matches of different rules that begin together are given in the rules' order. Offsets count code points.
    """
    prepare(docs.sparkSession)
    scanner = Scanner(rules)
    base = [k for k, r in enumerate(rules) if r.base]
    schema = ", ".join(["doc_id long", *(f"n_{rules[k].kind} long" for k in base), "base_sha256 string", "spans string"])

    def run(batches):
        scan = scanner.ready()
        for batch in batches:
            all_spans = []
            for text in batch["text"]:
                data = text.as_py() or b""
                all_spans.append(in_code_points(data, scan.spans(data)))
            out = {"doc_id": batch["doc_id"]}
            for k in base:
                out[f"n_{rules[k].kind}"] = pa.array([sum(x[1] == k for x in spans) for spans in all_spans], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(_joined([x for x in spans if x[1] in base], rules).encode()).hexdigest() for spans in all_spans], pa.string())
            out["spans"] = pa.array([_joined(spans, rules) for spans in all_spans], pa.string())
            yield pa.RecordBatch.from_pydict(out)
        release()

    return documents(docs).mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[{kind}]") -> DataFrame:
    """The documents with every secret replaced by ``mask``; all columns, whatever their names, and rows stay.

    Null, empty and blank texts stay as they are, very long ones are masked whole, repeated rows each; an empty table
    gives an empty result. Spans of two rules that overlap are replaced together, named after the first; of two that begin
    together the first rule's. A whole-number column ``n_chars``, where there is one, counts the code points of the new text.
    """
    prepare(docs.sparkSession)
    scanner, schema, names = Scanner(rules), docs.schema, docs.columns

    def run(batches):
        scan = scanner.ready()
        for batch in batches:
            texts, changed = [], []
            for text in batch[names.index(text_col)]:
                old = text.as_py()
                data = (old or "").encode()
                out, at = [], 0
                for s, k, e in scan.spans(data):
                    if s >= at:
                        out += [data[at:s], mask.format(kind=rules[k].kind).encode()]
                    at = max(at, e)
                changed.append(bool(out))
                texts.append(b"".join([*out, data[at:]]).decode("utf-8", "replace") if out else old)
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(texts, pa.string())
            if "n_chars" in names and pa.types.is_integer(columns[names.index("n_chars")].type):
                k = names.index("n_chars")
                kept = columns[k].to_pylist()
                columns[k] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, kept, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return docs.mapInArrow(run, schema)
