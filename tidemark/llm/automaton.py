"""Regular expressions to one minimal transition table, and scans of bytes with it.

The accepted syntax is that of byte-wise regular expressions without look-around,
anchors, references and lazy repetition: literals, escapes, classes, groups,
alternation and the repetitions ``? * + {m} {m,} {m,n}``; ``(?i:...)`` for ASCII letters
in either case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textarrays import unique


class _Parser:
    """Adds the fragments of one expression to shared lists of edges: (from, 256-bit set of bytes, to), set None for an empty step."""

    def __init__(self, pattern: str, edges: list[tuple[int, int | None, int]], fresh):
        self.p, self.i, self.edges, self.fresh, self.fold = pattern, 0, edges, fresh, False

    def parse(self) -> tuple[int, int]:
        out = self.alternation()
        if self.i != len(self.p):
            raise ValueError(f"{self.p!r}: not understood from {self.i}")
        return out

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternation(self) -> tuple[int, int]:
        a, b = self.fresh(), self.fresh()
        while True:
            s, e = self.sequence()
            self.edges += [(a, None, s), (e, None, b)]
            if self.peek() != "|":
                return a, b
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        a = b = self.fresh()
        while self.peek() not in ("", "|", ")"):
            s, e = self.repeated()
            self.edges.append((b, None, s))
            b = e
        return a, b

    def repeated(self) -> tuple[int, int]:
        at, fold = self.i, self.fold
        s, e = self.atom()
        end, op = self.i, self.peek()
        if op not in ("?", "*", "+", "{") or op == "":
            return s, e
        if op == "{":
            close = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : close].partition(",")
            low, high = int(low), (int(high) if high else None if "," in self.p[self.i : close] else int(low))
            after = close + 1
        else:
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[op]
            after = self.i + 1

        def again() -> tuple[int, int]:
            self.i, self.fold = at, fold
            out = self.atom()
            assert self.i == end
            return out

        a = b = self.fresh()
        for _ in range(low):
            x, y = again()
            self.edges.append((b, None, x))
            b = y
        if high is None:
            x, y = again()
            c = self.fresh()
            self.edges += [(b, None, x), (y, None, x), (b, None, c), (y, None, c)]
            b = c
        else:
            last = self.fresh()
            for _ in range(high - low):
                x, y = again()
                self.edges += [(b, None, last), (b, None, x)]
                b = y
            self.edges.append((b, None, last))
            b = last
        self.i = after
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.i += 1
            outer = self.fold
            if self.p.startswith("?", self.i):
                flags, _, _ = self.p[self.i + 1 :].partition(":")
                if flags not in ("", "i"):
                    raise ValueError(f"{self.p!r}: (?{flags} is not supported")
                self.fold, self.i = self.fold or flags == "i", self.i + 2 + len(flags)
            out = self.alternation()
            if self.peek() != ")":
                raise ValueError(f"{self.p!r}: a ) is missing")
            self.i, self.fold = self.i + 1, outer
            return out
        if c in "^$" or c in "?*+{":
            raise ValueError(f"{self.p!r}: {c} is not supported here")
        a, b = self.fresh(), self.fresh()
        self.edges.append((a, self.folded(self.one()), b))
        return a, b

    def folded(self, mask: int) -> int:
        if self.fold:
            for x in range(26):
                if mask >> (65 + x) & 1 or mask >> (97 + x) & 1:
                    mask |= 1 << (65 + x) | 1 << (97 + x)
        return mask

    def one(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == ".":
            return ((1 << 256) - 1) ^ (1 << 10)
        if c == "\\":
            return self.escape()
        if c != "[":
            return 1 << ord(c)
        negated = self.peek() == "^"
        self.i += negated
        mask, begin = 0, self.i
        while self.peek() != "]" or self.i == begin:
            first = self.member()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                last = self.member()
                for x in range(first.bit_length() - 1, last.bit_length()):
                    mask |= 1 << x
            else:
                mask |= first
        self.i += 1
        return ((1 << 256) - 1) ^ mask if negated else mask

    def member(self) -> int:
        c = self.p[self.i]
        self.i += 1
        return self.escape() if c == "\\" else 1 << ord(c)

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return 1 << int(self.p[self.i - 2 : self.i], 16)
        sets = {"d": "0123456789", "w": "0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "s": " \t\n\r\f\v", "n": "\n", "t": "\t", "r": "\r"}
        return sum(1 << ord(x) for x in sets.get(c, c))


@dataclass(frozen=True)
class Automaton:
    """table[state, class] is the next state; 0 is the start, in which no match is under way.

    accepts[state] has bit r if a match of rule r may end here. classes[byte] is the
    byte's class; class 0 leads from everywhere to the start.
    """

    table: np.ndarray
    accepts: np.ndarray
    classes: np.ndarray


def compile_rules(patterns: list[str], max_states: int = 60_000) -> Automaton:
    """Subset construction over all rules at once, searching from every byte, then minimisation."""
    edges: list[tuple[int, int | None, int]] = []
    count = 0

    def fresh() -> int:
        nonlocal count
        count += 1
        return count - 1

    start = fresh()
    finals = {}
    for r, p in enumerate(patterns):
        s, e = _Parser(p, edges, fresh).parse()
        edges.append((start, None, s))
        finals[e] = r
    # bytes that no edge tells apart share a class
    masks = sorted({m for _, m, _ in edges if m is not None})
    kinds: dict[tuple, int] = {(False,) * len(masks): 0}
    classes = np.array([kinds.setdefault(tuple(bool(m >> b & 1) for m in masks), len(kinds)) for b in range(256)], np.uint8)
    member = {k: i for i, k in enumerate(masks)}
    empty, step = [[] for _ in range(count)], [[] for _ in range(count)]
    for a, m, b in edges:
        (empty[a].append(b) if m is None else step[a].append((m, b)))
    closure = [0] * count
    for n in range(count):
        seen, todo = {n}, [n]
        while todo:
            for b in empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        closure[n] = sum(1 << x for x in seen)
    moves: list[list[tuple[int, int]]] = [[] for _ in range(len(kinds))]  # by class: (state bit, closure of the target)
    for kind, k in kinds.items():
        for a in range(count):
            for m, b in step[a]:
                if kind[member[m]]:
                    moves[k].append((1 << a, closure[b]))
    begin = closure[start]
    numbers, order, rows = {begin: 0}, [begin], []
    while len(rows) < len(order):
        now, row = order[len(rows)], []
        for k in range(len(kinds)):
            to = begin
            for bit, target in moves[k]:
                if now & bit:
                    to |= target
            if to not in numbers:
                if len(order) >= max_states:
                    raise ValueError(f"the rules need more than {max_states} states")
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(1 << r for e, r in finals.items() if s >> e & 1) for s in order], np.int64)
    # Moore: states are one as long as neither acceptance nor any successor's group differs
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    swap = np.arange(group.max() + 1)
    swap[group[0]], swap[0] = 0, group[0]  # the start is state 0
    group = swap[group]
    _, one = np.unique(group, return_index=True)
    return Automaton(group[table[one]].astype(np.int32), accepts[one], classes)


def run(machine: Automaton, data: np.ndarray, edges: np.ndarray, width: int = 512, few: int = 24) -> np.ndarray:
    """The state behind every byte; at each of ``edges`` (first bytes of documents) the start is entered anew.

    Bytes of class 0 lead to the start from every state, so the text may be cut behind
    them: pieces of about ``width`` bytes run side by side, byte by byte.
    """
    n = len(data)
    states = np.zeros(n, np.int32)
    if not n:
        return states
    kind = machine.classes[data]
    resets = np.flatnonzero(kind == 0) + 1
    goals = np.searchsorted(resets, np.arange(width, n, width))
    cuts = unique(np.concatenate([[0], resets[goals[goals < len(resets)]], edges, [n]]))
    cuts = cuts[cuts <= n]
    starts, lengths = cuts[:-1], np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    flat, wide = machine.table.ravel(), machine.table.shape[1]
    lanes = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if len(lengths) else []
    state = np.zeros(len(starts), np.int32)
    for t, live in enumerate(lanes):
        if live <= few:  # some long pieces without a reset: one after the other
            table = machine.table.tolist()
            for i in range(live):
                a, b, now = int(starts[i]) + t, int(starts[i] + lengths[i]), int(state[i])
                rest = []
                for k in kind[a:b].tobytes():
                    now = table[now][k]
                    rest.append(now)
                states[a:b] = rest
            break
        at = starts[:live] + t
        state = flat.take(state[:live] * wide + kind.take(at))
        states[at] = state
    return states
