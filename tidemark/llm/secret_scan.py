"""Secret scans: all rules in one automaton, run once over the bytes of each text.

Each rule is parsed into a Thompson automaton. Their union, free to start anywhere, is made deterministic by subset
construction, minimised by refinement of partitions, and laid out as one transition array over byte classes. The scan
reports where matches of a rule end; a small automaton of the reversed rule, also deterministic, then runs back from
that end to the leftmost start. Both read bytes; spans are turned into code points afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, fresh, plain

#: Fixed values of the three base kinds, in their order: pattern, letters in either case or not, what a match must satisfy.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 20
HEX, HEX_LEAST = r"[0-9a-f]", 24
BASE = ("assign", "access", "hex")
#: Further kinds. Their spans are added; those of the base kinds stay.
MORE = {
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
}
REDACTED = "[redacted]"


@dataclass(frozen=True)
class Rule:
    """``least``: least length of a match; ``value``: of what an assignment gives. A shorter match is dropped, but what it covers stays taken."""

    kind: str
    pattern: str
    any_case: bool = False
    least: int = 0
    value: int = 0


# A run of hex digits that is too short takes nothing from another match, so its length may stand in the pattern, where it
# keeps every word with an "a" from being reported. Other lengths stay out: counters of overlapping starts multiply states.
RULES = (
    Rule("assign", ASSIGN, any_case=True, value=6),
    Rule("access", ACCESS, least=ACCESS_LEAST),
    Rule("hex", f"{HEX}{{{HEX_LEAST},}}"),
    *(Rule(kind, pattern, least=least) for kind, (pattern, least) in MORE.items()),
)


# Syntax trees are nested tuples: ("set", frozenset of bytes), ("cat", parts), ("alt", parts), ("star", part).
class _Parser:
    """The part of regular expressions that rules use: literals, \\xHH, classes, groups, |, ?, *, + and {m,}."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def chars(self, of: set[int]) -> tuple:
        if self.any_case:
            of = of | {ord(f(chr(c))) for c in of if c < 128 for f in (str.lower, str.upper)}
        return ("set", frozenset(of))

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", tuple(parts))

    def atom(self) -> tuple:
        if self.peek() == "(":
            self.take()
            inner = self.alternatives()
            self.take()
            return inner
        if self.peek() != "[":
            return self.chars({self.char()})
        self.take()
        of: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                of |= set(range(low, self.char() + 1))
            else:
                of.add(low)
        self.take()
        return self.chars(of)

    def repeated(self, atom: tuple) -> tuple:
        c = self.peek()
        if c == "?":
            self.take()
            return ("alt", (atom, ("cat", ())))
        if c == "*":
            self.take()
            return ("star", atom)
        if c == "+":
            self.take()
            return ("cat", (atom, ("star", atom)))
        if c == "{":
            m = re.compile(r"\{(\d+)(,?)\}").match(self.p, self.i)
            self.i = m.end()
            return ("cat", (atom,) * int(m[1]) + (("star", atom),) * bool(m[2]))
        return atom


def _reversed(tree: tuple) -> tuple:
    kind, x = tree
    if kind == "set":
        return tree
    if kind == "star":
        return (kind, _reversed(x))
    parts = tuple(map(_reversed, x))
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    """Thompson's construction: free moves, and moves on a set of bytes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Moves for ``tree`` from ``start``; returns where they end."""
        kind, x = tree
        if kind == "cat":
            for part in x:
                start = self.add(part, start)
            return start
        if kind == "set":
            # a state of its own, as a state has one move at most
            mid, end = self.state(), self.state()
            self.free[start].append(mid)
            self.on[mid] = (x, end)
            return end
        end = self.state()
        if kind == "star":
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(x, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for part in x:
            self.free[self.add(part, self._branch(start))].append(end)
        return end

    def _branch(self, start: int) -> int:
        s = self.state()
        self.free[start].append(s)
        return s

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass
class Dfa:
    """``step[state * classes + class]`` is the next state times ``classes``; states from ``first`` (times classes) accept."""

    classes: int
    class_of: bytes
    step: list[int]
    first: int
    start: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def _deterministic(nfa: _Nfa, start: frozenset, ends: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation. ``ends``: accepting state to rule number."""
    sets = {on[0] for on in nfa.on if on}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    class_of = bytes(kinds[s] for s in signature)
    example = [class_of.index(bytes([c])) for c in range(len(kinds))]
    table: dict[frozenset, int] = {start: 0}
    order, rows = [start], []
    for subset in order:  # grows while it is walked
        row = []
        for b in example:
            moved = {nfa.on[s][1] for s in subset if nfa.on[s] and b in nfa.on[s][0]}
            to = nfa.closure(moved) | start if anywhere else nfa.closure(moved)
            if to not in table:
                table[to] = len(order)
                order.append(to)
            row.append(table[to])
        rows.append(row)
    marks = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in order]
    # states are equal if they accept the same rules and move to equal states: refined until nothing changes
    names = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    block = [names[m] for m in marks]
    while True:
        looks = [(block[s], *(block[t] for t in rows[s])) for s in range(len(rows))]
        names = {x: i for i, x in enumerate(dict.fromkeys(looks))}
        finer = [names[x] for x in looks]
        if len(names) == len(set(block)):
            break
        block = finer
    one = {}
    for s, b in enumerate(block):
        one.setdefault(b, s)
    placed = sorted(one, key=lambda b: (bool(marks[one[b]]), b))  # accepting states last
    number = {b: i for i, b in enumerate(placed)}
    k = len(kinds)
    step = [number[block[t]] * k for b in placed for t in rows[one[b]]]
    accepts = {number[b] * k: marks[one[b]] for b in placed if marks[one[b]]}
    dead = next((number[b] * k for b in placed if not marks[one[b]] and all(block[t] == b for t in rows[one[b]]) and block[0] != b), -1)
    return Dfa(k, class_of, step, min(accepts), number[block[0]] * k, accepts, dead)


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [_Parser(r.pattern, r.any_case).alternatives() for r in rules]
        nfa = _Nfa()
        start, ends = nfa.state(), {}
        for i, tree in enumerate(trees):
            ends[nfa.add(tree, nfa._branch(start))] = i
        self.forward = _deterministic(nfa, nfa.closure([start]), ends, anywhere=True)
        self.backward = [self._back(tree) for tree in trees]

    @staticmethod
    def _back(tree: tuple) -> Dfa:
        nfa = _Nfa()
        start = nfa.state()
        end = nfa.add(_reversed(tree), start)
        return _deterministic(nfa, nfa.closure([start]), {end: 0}, anywhere=False)

    def _ends(self, text: bytes) -> dict[int, list[int]]:
        """For each rule the places at which a longest match ends: the last of a run of accepting places."""
        d = self.forward
        step, first, s = d.step, d.first, d.start
        runs: list[list[int]] = []  # first and last place and state, while neither changes but by one
        last = -1
        i = 0
        for c in text.translate(d.class_of):
            s = step[s + c]
            i += 1
            if s >= first:
                if s == last:
                    runs[-1][1] = i
                else:
                    runs.append([i, i, s])
                last = s
            else:
                last = -1
        out: dict[int, list[int]] = {}
        for at, until, state in runs:
            for r in d.accepts[state]:
                ends = out.setdefault(r, [])
                if ends and ends[-1] == at - 1:
                    ends[-1] = until
                else:
                    ends.append(until)
        return out

    def _start(self, r: int, text: bytes, end: int, done: int) -> int | None:
        """The leftmost start, not before ``done``, of a match of rule ``r`` that ends at ``end``."""
        d, found = self.backward[r], None
        s, i = d.start, end
        while i > done and s != d.dead:
            i -= 1
            s = d.step[s + d.class_of[text[i]]]
            if s >= d.first:
                found = i
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """Start, rule number and end of all matches, in bytes: leftmost, not overlapping within a rule."""
        out = []
        for r, ends in self._ends(text).items():
            done = 0
            for end in ends:
                start = self._start(r, text, end, done)
                if start is None:
                    continue
                done = end
                rule = self.rules[r]
                if end - start >= rule.least and (not rule.value or self._value(text, start, end) >= rule.value):
                    out.append((start, r, end))
        return sorted(out)

    @staticmethod
    def _value(text: bytes, start: int, end: int) -> int:
        """Length of the value of an assignment: what follows the first separator, with spaces and a quote taken off."""
        i = start
        while text[i] not in b":=":
            i += 1
        i += 1
        while text[i] == 0x20:
            i += 1
        return end - i - (text[i] in b"\"'")


@cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once, on the driver; tasks get the arrays (some 300,000 numbers)."""
    return Scanner(rules)


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points; ``spans`` are sorted by start."""
    if not spans or text.isascii():
        return spans
    at, seen, place = 0, 0, {}
    for x in sorted({x for s, _, e in spans for x in (s, e)}):
        seen += len(text[at:x].decode("utf-8", "replace"))
        at, place[x] = x, seen
    return [(place[s], r, place[e]) for s, r, e in spans]


def find(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Kinds, starts and ends (code points, end exclusive) of all spans by start, then in the order of ``rules``. Null: none."""

    scanner = compiled(rules)

    @F.pandas_udf("kinds array<string>, starts array<int>, ends array<int>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kinds = [r.kind for r in rules]
        for texts in parts:
            rows = [code_points(t, scanner.spans(t)) if t else [] for t in texts]
            yield pd.DataFrame({"kinds": [[kinds[r] for _, r, _ in x] for x in rows], "starts": [[s for s, _, _ in x] for x in rows], "ends": [[e for _, _, e in x] for x in rows]})

    return of.asNondeterministic()(body(text))  # so that filters never run it twice


def redacted(text: Column | str, rules: tuple[Rule, ...] = RULES, mark: str = REDACTED) -> Column:
    """The text with every span (overlapping ones united) replaced by ``mark``; null stays null."""

    scanner, new = compiled(rules), mark.encode()

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                bits, at = [], 0
                for start, _, end in scanner.spans(t):
                    if start >= at:
                        bits += [t[at:start], new]
                    at = max(at, end)
                out.append(b"".join([*bits, t[at:]]).decode("utf-8", "replace"))
            yield pd.Series(out, dtype=object)

    return of.asNondeterministic()(body(text))


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; all rows and columns stay."""
    c = F.col(f"`{text}`")
    return docs.select(*(redacted(c, rules).alias(n) if n == text else F.col(f"`{n}`") for n in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and spans by document; all spans as ``kind:start:end``, and the hash of those of the base kinds."""
    (s,) = fresh(docs, "_spans")
    found = docs.select(*plain(docs, "doc_id"), find("text").alias(s))
    kind = F.col(f"{s}.kinds")
    listed = F.zip_with(kind, F.zip_with(F.col(f"{s}.starts"), F.col(f"{s}.ends"), lambda a, b: F.concat_ws(":", a, b)), lambda k, x: F.concat_ws(":", k, x))
    base = F.filter(listed, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).isin(*BASE))
    count = lambda k: F.size(F.filter(kind, lambda x: x == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(listed, ",").alias("spans"))
