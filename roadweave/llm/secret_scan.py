"""Secret scanning with one deterministic automaton for all rules.

Rules are written as regular expressions over bytes (literals, classes, groups, alternatives,
``? * +`` and ``{n,}``), parsed here to Thompson automata, joined, made deterministic by subset
construction, minimised by partition refinement and laid out as one flat transition array. The
search automaton reads every byte of a text once, whatever the number of rules; accepting states
carry the set of rules whose shortest match ends there (a rule's trailing loop is left to its own
automaton, or the joined one would keep every mix of loops apart). Spans follow from the same arrays: when a rule first accepts,
its leftmost start is found with the rule's own anchored automaton from the last place at which no
rule was under way, and that automaton then runs on to the longest end. Such steps only happen at
hits, so the pass stays one step for each byte.

The rules of the base kinds follow the contract: leftmost, longest, non-overlapping within a kind;
matches that are too short are found and then dropped, as they use up their text. Only ``hex``
carries its least length in the expression, which finds the same spans: its characters run on
greedily, so a shorter match never hides a longer one.

Cases: null and empty texts have no span (digest of the empty string); long texts cost one step a
byte; repeated rows are reported each; an empty table gives an empty result; other columns are
ignored. Offsets are code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_VALUE = "[A-Za-z0-9+/_.=\\-]"
_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Kind, expression and least length of a match, in the order in which kinds are listed. The first
#: three are the base kinds.
RULES: tuple[tuple[str, str, int], ...] = (
    ("assign", _KEYS + "[\"']? *[:=] *[\"']?" + _VALUE + "+", 0),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]{24,}", 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", "eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", 40),
    ("forge_token", "gh[a-z]_[A-Za-z0-9]+", 36),
    ("chat_token", "xox[a-z]-[A-Za-z0-9\\-]+", 16),
)
BASE_KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6
_VALUE_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


# --- expressions to automata -------------------------------------------------------------------
@dataclass
class Nfa:
    """Thompson automaton: ``steps[s]`` is (bytes, target) or None, ``empty[s]`` the free moves."""

    steps: list[tuple[frozenset[int], int] | None] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.steps.append(None)
        self.empty.append([])
        return len(self.steps) - 1


class _Parser:
    def __init__(self, text: str, nfa: Nfa) -> None:
        self.text, self.at, self.nfa = text, 0, nfa

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return ("alt", branches) if len(branches) > 1 else branches[0]

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self) -> tuple:
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                low = ""
                while self.peek() != ",":
                    low += self.take()
                if self.take() + self.take() != ",}":
                    raise ValueError(f"only {{n,}} is supported: {self.text}")
                node = ("seq", [node] * int(low) + [("star", node)])
            else:
                node = {"?": ("opt", node), "*": ("star", node), "+": ("seq", [node, ("star", node)])}[c]
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group: {self.text}")
            return node
        if c == "[":
            got: set[int] = set()
            while self.peek() != "]":
                low = self.take()
                low = self.take() if low == "\\" else low
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    got.update(range(ord(low), ord(self.take()) + 1))
                else:
                    got.add(ord(low))
            self.take()
            return ("bytes", frozenset(got))
        return ("bytes", frozenset({ord(self.take() if c == "\\" else c)}))

    def build(self, node: tuple) -> tuple[int, int]:
        kind, n = node[0], self.nfa
        a, b = n.state(), n.state()
        if kind == "bytes":
            n.steps[a] = (node[1], b)
        elif kind == "seq":
            last = a
            for x in node[1]:
                s, e = self.build(x)
                n.empty[last].append(s)
                last = e
            n.empty[last].append(b)
        elif kind == "alt":
            for x in node[1]:
                s, e = self.build(x)
                n.empty[a].append(s)
                n.empty[e].append(b)
        else:
            s, e = self.build(node[1])
            n.empty[a] += [s, b]
            n.empty[e] += [b, s] if kind == "star" else [b]
        return a, b


def _without_tail(node: tuple) -> tuple:
    """Cuts what may repeat or be left out at the end, down to the shortest matches."""
    if node[0] != "seq":
        return node
    parts = list(node[1])
    while parts and parts[-1][0] in ("star", "opt"):
        parts.pop()
    return ("seq", [*parts[:-1], _without_tail(parts[-1])] if parts else [])


def _closure(nfa: Nfa, states: set[int]) -> frozenset[int]:
    todo, got = list(states), set(states)
    while todo:
        for t in nfa.empty[todo.pop()]:
            if t not in got:
                got.add(t)
                todo.append(t)
    return frozenset(got)


@dataclass
class Dfa:
    """``rows[state][c]`` is the state after a byte of class ``classes[byte]``; ``accepts[state]``
    has the rules ending there."""

    rows: list[list[int]]
    accepts: list[frozenset[int]]
    start: int
    classes: list[int]

    def table(self, order: list[int] | None = None) -> list[int]:
        """Flat transitions ``[place * 256 + byte]``, times 256, with states placed in an order."""
        order = order or list(range(len(self.rows)))
        place = {s: i * 256 for i, s in enumerate(order)}
        return [place[self.rows[s][c]] for s in order for c in self.classes]


def determinise(nfa: Nfa, start: int, finals: dict[int, int], search: bool) -> Dfa:
    """Subset construction; with ``search`` a match may begin at every byte. State 0 is dead."""
    sets = list({step[0] for step in nfa.steps if step})
    names: dict[tuple, int] = {}
    classes = [names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)]
    some = [classes.index(c) for c in range(len(names))]
    first = _closure(nfa, {start})
    ids: dict[frozenset[int], int] = {frozenset(): 0, first: 1}
    order, rows, k = [frozenset(), first], [], 0
    while k < len(order):
        steps = [nfa.steps[s] for s in order[k] if nfa.steps[s]]
        row = []
        for byte in some:
            to = _closure(nfa, {t for on, t in steps if byte in on} | ({start} if search else set()))
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
        k += 1
    return Dfa(rows, [frozenset(finals[s] for s in subset if s in finals) for subset in order], 1, classes)


def minimise(d: Dfa) -> Dfa:
    """Refines the partition by accepted rules until no block's states differ in where they go."""
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in d.accepts]
    while True:
        count, names = len(names), {}
        block = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(d.rows)]
        if len(names) == count:
            break
    some = {b: s for s, b in reversed(list(enumerate(block)))}
    return Dfa([[block[t] for t in d.rows[some[b]]] for b in range(count)], [d.accepts[some[b]] for b in range(count)], block[d.start], d.classes)


class Scanner:
    """The joined search automaton, and an anchored automaton for each rule."""

    def __init__(self, rules: tuple[tuple[str, str, int], ...] = RULES) -> None:
        self.rules = rules
        joined, finals = Nfa(), {}
        start = joined.state()
        self.anchored: list[tuple[list[int], list[bool], int, int]] = []
        for r, (_, text, _) in enumerate(rules):
            s, e = self._read(text, joined, shortest=True)
            joined.empty[start].append(s)
            finals[e] = r
            own = Nfa()
            s, e = self._read(text, own)
            d = minimise(determinise(own, s, {e: 0}, search=False))
            dead = next((s for s, row in enumerate(d.rows) if not d.accepts[s] and set(row) == {s}), -1)
            self.anchored.append((d.table(), [bool(a) for a in d.accepts], d.start * 256, dead * 256))
        d = minimise(determinise(joined, start, finals, search=True))
        # the start is placed first and states that accept last, so that one comparison finds them
        order = sorted(range(len(d.rows)), key=lambda s: (bool(d.accepts[s]), s != d.start))
        self.first_accept = sum(not a for a in d.accepts) * 256
        self.table = d.table(order)
        self.accepts = [sorted(d.accepts[s]) for s in order]

    @staticmethod
    def _read(text: str, nfa: Nfa, shortest: bool = False) -> tuple[int, int]:
        p = _Parser(text, nfa)
        node = p.alternatives()
        ends = p.build(_without_tail(node) if shortest else node)
        if p.at != len(text):
            raise ValueError(f"cannot read all of {text}")
        return ends

    def _longest(self, rule: int, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        table, accepts, s, dead = self.anchored[rule]
        end = -1
        for i in range(at, len(data)):
            s = table[s + data[i]]
            if s == dead:
                break
            if accepts[s >> 8]:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes: leftmost, longest, non-overlapping for each rule."""
        table, limit, state = self.table, self.first_accept, 0
        hits = [i for i, b in enumerate(data) if (state := table[state + b]) >= limit]
        if not hits:
            return []
        return self._resolve(data, hits)

    def _resolve(self, data: bytes, hits: list[int]) -> list[tuple[int, int, int]]:
        # hits lists where some rule accepts; which ones, and since when anything was under way,
        # is read again from the arrays over just the stretches that hold hits
        out, done = [], [0] * len(self.rules)
        table, at, state, idle = self.table, 0, 0, 0
        last = hits[-1]
        limit = self.first_accept
        while at <= last:
            state = table[state + data[at]]
            at += 1
            if state == 0:
                idle = at
            elif state >= limit:
                for rule in self.accepts[state >> 8]:
                    if at <= done[rule]:
                        continue
                    for begin in range(max(idle, done[rule]), at):
                        end = self._longest(rule, data, begin)
                        if end >= 0:
                            out.append((rule, begin, end))
                            done[rule] = end
                            break
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(rules: tuple[tuple[str, str, int], ...] = RULES) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find_secrets(text: str | None, rules: tuple[tuple[str, str, int], ...] = RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then as kinds are listed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    s = scanner(rules)
    found = []
    for rule, a, b in s.spans(data):
        if rules[rule][0] == "assign":
            v = b
            while v > a and data[v - 1] in _VALUE_BYTES:
                v -= 1
            sign = next(i for i in range(a, b) if data[i] in b":=")
            if b - max(v, sign + 1) < LEAST_VALUE:
                continue
        if b - a >= rules[rule][2]:
            found.append((a, rule, b))
    if not found:
        return []
    found.sort()
    if len(data) == len(text):
        return [(a, b, rules[r][0]) for a, r, b in found]
    marks = sorted({x for a, _, b in found for x in (a, b)})
    chars, n, before = {}, 0, 0
    for m in marks:
        n += len(data[before:m].decode("utf-8", "surrogatepass"))
        chars[m], before = n, m
    return [(chars[a], chars[b], rules[r][0]) for a, r, b in found]


def scan_secrets(docs: DataFrame, rules: tuple[tuple[str, str, int], ...] = RULES, base: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """doc_id, number of base spans by kind, digest of the base spans, all spans."""

    def rows(b: dict) -> dict:
        out: dict[str, list] = {f"n_{k}": [] for k in base} | {"base_sha256": [], "spans": []}
        for text in b["text"].to_pylist():
            got = find_secrets(text, rules)
            own = [x for x in got if x[2] in base]
            for k in base:
                out[f"n_{k}"].append(sum(x[2] == k for x in own))
            line: Callable = lambda xs: ",".join(f"{k}:{a}:{e}" for a, e, k in xs)
            out["base_sha256"].append(hashlib.sha256(line(own).encode()).hexdigest())
            out["spans"].append(line(got))
        return {"doc_id": b["doc_id"]} | {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()}

    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"]
    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], schema, rows, names)
