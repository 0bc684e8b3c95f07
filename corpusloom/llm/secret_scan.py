"""Secret scans with one deterministic automaton for all rules.

The rules' expressions are compiled together: subset construction over the
bytes' equivalence classes, then minimisation, into one flat transition list.
A text's UTF-8 bytes pass through it once. Where a rule's accepting states are
left, a match has ended; the rule's reversed automaton walks back over these
bytes only and finds the leftmost start. Spans of one rule never overlap, and a
match that its rule's check refuses still uses up its bytes.

Rules end in a run of characters or a fixed text, so that the longest match and
the leftmost greedy one of Python's `re` are the same; the tests compare both.

Defined results: a null or empty text has no spans. Offsets count code points,
ends are exclusive. Repeated rows and ids get a row each. Columns other than
`doc_id` and `text` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as R
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """`check` is an expression that a span must match in full to be kept."""

    kind: str
    pattern: str
    check: str | None = None


# The three base rules in their order.
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGNED = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE_RULES = (
    Rule("assign", _ASSIGNED + "+", _ASSIGNED + "{6,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Public token formats beyond the base.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Thompson's construction over Python's own parse of an expression."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves that read nothing
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, items, at: int, fold: bool, back: bool) -> int:
        """Appends the items behind state `at`, last one first if `back`."""
        for op, arg in reversed(items) if back else items:
            if op in (R.LITERAL, R.NOT_LITERAL, R.IN):
                to = self.state()
                self.moves[at].append((_bytes(op, arg, fold), to))
                at = to
            elif op is R.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, (fold or bool(on & re.I)) and not off & re.I, back)
            elif op is R.BRANCH:
                to = self.state()
                for way in arg[1]:
                    self.free[self.add(way, at, fold, back)].append(to)
                at = to
            elif op is R.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, fold, back)
                if most is R.MAXREPEAT:
                    loop, to = self.state(), self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold, back)].append(loop)
                    self.free[loop].append(to)
                    at = to
                else:
                    to = self.state()
                    for _ in range(most - least):
                        self.free[at].append(to)
                        at = self.add(inner, at, fold, back)
                    self.free[at].append(to)
                    at = to
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    chars: set[int] = set()
    negated = op is R.NOT_LITERAL
    for kind, value in arg if op is R.IN else [(R.LITERAL, arg)]:
        if kind is R.NEGATE:
            negated = True
        elif kind is R.RANGE:
            chars.update(range(value[0], value[1] + 1))
        elif kind is R.LITERAL:
            chars.add(value)
        else:
            raise ValueError(f"not supported in a class: {kind}")
    if chars and max(chars) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        chars |= {ord(c) for x in chars for c in (chr(x).lower(), chr(x).upper())}
    return frozenset(range(256)) - chars if negated else frozenset(chars)


@dataclass(frozen=True)
class Automaton:
    """States are multiples of `width`; those from `hot` on accept. A state's
    row of `step` starts at its number; `mask` has a bit for each rule."""

    classes: bytes
    width: int
    step: list[int]
    start: int
    hot: int
    mask: dict[int, int]
    dead: int


def compile_rules(patterns: list[str], anywhere: bool, back: bool = False) -> Automaton:
    """One automaton for all patterns. `anywhere` lets matches begin at every
    byte; `back` reads from the end."""
    nfa = _Nfa()
    begin = nfa.state()
    ends = {}
    for bit, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.free[begin].append(first)
        ends[nfa.add(_parser.parse(pattern), first, False, back)] = 1 << bit

    # Bytes that no rule tells apart share a class.
    sets = {chars for moves in nfa.moves for chars, _ in moves}
    kinds: dict[tuple, int] = {}
    classes = bytes(
        kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)
    )
    sample = [classes.index(k) for k in range(len(kinds))]

    root = nfa.closure([begin])
    found, rows = {root: 0}, []
    todo = [root]
    for states in todo:
        row = []
        for b in sample:
            to = {t for s in states for chars, t in nfa.moves[s] if b in chars}
            reached = nfa.closure(to | {begin} if anywhere else to)
            if reached not in found:
                found[reached] = len(found)
                todo.append(reached)
            row.append(found[reached])
        rows.append(row)
    masks = [sum(bit for end, bit in ends.items() if end in states) for states in todo]

    # Minimisation: split blocks until all of a block's states move alike.
    block = {m: i for i, m in enumerate(sorted(set(masks)))}
    part = [block[m] for m in masks]
    while True:
        known: dict[tuple, int] = {}
        finer = [
            known.setdefault((part[i], *(part[t] for t in row)), len(known))
            for i, row in enumerate(rows)
        ]
        if len(known) == len(set(part)):
            break
        part = finer
    of_part = {p: i for i, p in enumerate(part)}
    order = sorted(of_part, key=lambda p: (masks[of_part[p]] != 0, p))
    width = len(sample)
    number = {p: k * width for k, p in enumerate(order)}
    step = [number[part[t]] for p in order for t in rows[of_part[p]]]
    mask = {number[p]: masks[of_part[p]] for p in order}
    hot = min((n for n, m in mask.items() if m), default=len(step))
    dead = next(
        (n for n, m in mask.items() if not m and set(step[n : n + width]) == {n}), -1
    )
    return Automaton(classes, width, step, number[part[0]], hot, mask, dead)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.forward = compile_rules([r.pattern for r in rules], anywhere=True)
        self.backward = [compile_rules([r.pattern], anywhere=False, back=True) for r in rules]
        self.checks = [r.check and re.compile(r.check.encode()) for r in rules]

    def _ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(rule, exclusive end) wherever a rule's longest match ends."""
        a = self.forward
        step, hot, mask, state, on = a.step, a.hot, a.mask, a.start, 0
        for i, c in enumerate(data.translate(a.classes)):
            state = step[state + c]
            if state >= hot or on:
                now = mask[state]
                if gone := on & ~now:
                    yield from ((k, i) for k in range(len(self.rules)) if gone >> k & 1)
                on = now
        yield from ((k, len(data)) for k in range(len(self.rules)) if on >> k & 1)

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start of a match that ends at `end`, or -1."""
        a = self.backward[rule]
        state, best = a.start, -1
        for i in range(end - 1, least - 1, -1):
            state = a.step[state + a.classes[data[i]]]
            if state == a.dead:
                break
            if state >= a.hot:
                best = i
        return best

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end) in code points, by start, then rule."""
        data = text.encode("utf-8")
        used = [0] * len(self.rules)
        found = []
        for rule, end in self._ends(data):
            start = self._start(rule, data, end, used[rule])
            if start < 0:
                continue
            used[rule] = end
            check = self.checks[rule]
            if check is None or check.fullmatch(data, start, end):
                found.append((start, rule, end))
        if len(data) != len(text):
            at = {}
            last = points = 0
            for pos in sorted({p for s, _, e in found for p in (s, e)}):
                points += len(data[last:pos].decode("utf-8"))
                at[pos], last = points, pos
            found = [(at[s], rule, at[e]) for s, rule, e in found]
        return [(rule, s, e) for s, rule, e in sorted(found)]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`doc_id, spans`: an array of `kind, start, end` for each document."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [
                    {"kind": kinds[k], "start": s, "end": e}
                    for k, s, e in scanner.spans(t.as_py() or "")
                ]
                for t in batch.column("text")
            ]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(scan, out)
