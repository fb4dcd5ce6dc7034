"""Regular expressions over bytes as minimal deterministic automata in transition arrays.

Supported: literals, escapes, classes, ``.``-free groups, alternation, ``? * + {m} {m,} {m,n}`` and
``(?i:...)`` for letters in either case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123))


class _Parser:
    """Nodes: ("set", frozenset), ("cat", [..]), ("or", [..]), ("repeat", node, least, most or None)."""

    def __init__(self, source: str) -> None:
        self.s, self.i, self.fold = source, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def next(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.next()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.next()
            if c == "{":
                body = self.s[self.i : self.s.index("}", self.i)]
                self.i += len(body) + 1
                least, comma, most = body.partition(",")
                node = ("repeat", node, int(least), int(most) if most else None if comma else int(least))
            else:
                node = ("repeat", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.next()
        if c == "(":
            fold = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            if self.next() != ")":
                raise ValueError(f"unbalanced group in {self.s}")
            self.fold = fold
            return node
        if c == "[":
            return self.set(self.members())
        return self.set({self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.next()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> set[int]:
        out: set[int] = set()
        while (c := self.next()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.next()
                c = self.next()
                high = self.escaped() if c == "\\" else ord(c)
            out.update(range(low, high + 1))
        return out

    def set(self, members: set[int]):
        if self.fold:
            members = members | {m ^ 32 for m in members if m in LETTERS}
        return ("set", frozenset(members))


def parsed(source: str):
    p = _Parser(source)
    node = p.alternatives()
    if p.i != len(source):
        raise ValueError(f"unbalanced group in {source}")
    return node


def reversed_node(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [reversed_node(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [reversed_node(x) for x in node[1]])
    if kind == "repeat":
        return ("repeat", reversed_node(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """The state in which what begins in ``start`` has matched ``node``."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
        elif kind == "cat":
            end = start
            for x in node[1]:
                end = self.add(x, end)
        elif kind == "or":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
        else:
            _, inner, least, most = node
            end = start
            for _ in range(least):
                end = self.add(inner, end)
            if most is None:
                loop = self.state()
                self.empty[end].append(loop)
                self.empty[self.add(inner, loop)].append(loop)
                end = loop
            else:
                stops = [end]
                for _ in range(most - least):
                    stops.append(end := self.add(inner, end))
                out = self.state()
                for x in stops:
                    self.empty[x].append(out)
                end = out
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """``step[state, byte]`` is the next state; state 0 is the start; ``accepts[state]`` has a bit per rule."""

    step: np.ndarray
    accepts: np.ndarray


def compiled(nodes: list, anywhere: bool) -> Automaton:
    """One minimal automaton of all rules by subset construction; ``anywhere`` lets matches begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for rule, node in enumerate(nodes):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(node, first)] = rule
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    sign = [tuple(b in s for s in sets) for b in range(256)]
    classes = {x: i for i, x in enumerate(dict.fromkeys(sign))}
    kind = np.array([classes[x] for x in sign])
    sample = [sign.index(x) for x in classes]
    root = nfa.closure([start])
    numbers, order, table = {root: 0}, [root], []
    for states in order:
        row = []
        for b in sample:
            to = {t for x in states for s, t in nfa.moves[x] if b in s}
            after = nfa.closure(to | ({start} if anywhere else set()))
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            row.append(numbers[after])
        table.append(row)
    table, accepts = np.array(table), np.array([sum(1 << ends[x] for x in states if x in ends) for states in order], np.int64)
    part = np.unique(accepts, return_inverse=True)[1]
    while True:  # states that no input tells apart fall together
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    rename = np.full(part.max() + 1, -1)
    for i in range(len(part)):
        if rename[part[i]] < 0:
            rename[part[i]] = rename.max() + 1
    part = rename[part]
    firsts = [int(np.argmax(part == i)) for i in range(part.max() + 1)]
    return Automaton(part[table[firsts]][:, kind].astype(np.int32), accepts[firsts])


def linked(a: Automaton) -> list:
    """The automaton's start as a list of 257: the lists of the next states by byte, then what it accepts (None: dead)."""
    rows: list[list] = [[] for _ in a.accepts]
    for row, to, accepts in zip(rows, a.step.tolist(), a.accepts.tolist(), strict=True):
        row.extend([rows[t] for t in to])
        row.append(accepts)
    for row in rows:
        if not row[256] and all(x is row for x in row[:256]):
            row[256] = None
    return rows[0]


def begins(root: list, data: bytes) -> list[tuple[int, int]]:
    """Where matches begin, from the last to the first, with a bit per rule; ``root`` reads backwards."""
    row, i, out = root, len(data), []
    for b in reversed(data):
        i -= 1
        row = row[b]
        if row[256]:
            out.append((i, row[256]))
    return out


def longest(root: list, data: bytes, start: int) -> int:
    """End of the longest match that begins at ``start``, or -1; ``root`` reads forwards and is anchored."""
    row, end = root, start if root[256] else -1
    for i in range(start, len(data)):
        row = row[data[i]]
        if row[256]:
            end = i + 1
        elif row[256] is None:  # no way back to a match
            break
    return end
