"""Secret scanning by one combined deterministic automaton.

Rule patterns are parsed into one non-deterministic automaton over bytes, made deterministic by subset construction
(unanchored, all rules at once) and minimised by partition refinement; what is left is one transition array, walked once
per byte. A state tells which rules end a match there. Where a rule's run of ends begins, the rule's own reversed automaton
walks back to the leftmost start not before the rule's last match, so that each rule's matches are leftmost, longest and
non-overlapping. Rules may then drop a match by its length.

Defined cases: null or empty text has no spans; very long texts take memory in proportion to their matches; repeated rows
are scanned one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# ---------------------------------------------------------------- patterns to syntax trees

#: Trees: ("set", frozenset of bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)
_ALL = frozenset(range(256))


class _Parser:
    """Literals, [classes], (groups), (?i:groups in either case), |, ?, *, +, {m}, {m,}, {m,n}, \\xHH and escaped signs."""

    def __init__(self, pattern: str):
        self.p, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def alternatives(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.take()
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence(self):
        out = []
        while self.peek() and self.peek() not in "|)":
            out.append(self.repeated(self.atom()))
        return ("cat", out)

    def repeated(self, tree):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                body = self.p[self.at : self.p.index("}", self.at)]
                self.at += len(body) + 1
                least, comma, most = body.partition(",")
                tree = ("rep", tree, int(least), int(most) if most else None if comma else int(least))
            else:
                tree = ("rep", tree, int(sign == "+"), 1 if sign == "?" else None)
        return tree

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.p[self.at - 2 : self.at], 16)
        return ord(c)

    def folded(self, values: set[int]):
        if self.fold:
            values |= {ord(chr(v).swapcase()) for v in values if v < 128 and chr(v).isalpha()}
        return ("set", frozenset(values))

    def atom(self):
        if self.peek() == "(":
            self.take()
            before = self.fold
            if self.p.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            tree = self.alternatives()
            self.take()
            self.fold = before
            return tree
        if self.peek() == "[":
            self.take()
            flip = self.peek() == "^" and bool(self.take())
            values: set[int] = set()
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.p[self.at + 1] != "]":
                    self.take()
                    high = self.byte()
                values |= set(range(low, high + 1))
            self.take()
            return ("set", _ALL - values) if flip else self.folded(values)
        return self.folded({self.byte()})


def parse(pattern: str):
    return _Parser(pattern).alternatives()


def _reverse(tree):
    if tree[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [_reverse(x) for x in tree[1]])
    return ("rep", _reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


# ---------------------------------------------------------------- automata


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Builds tree from start; returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """next[state, byte]; accepts[state]: bit k set if rule k ends there; state 0 starts. Without unanchored, dead marks the sink."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_automaton(trees: list, unanchored: bool) -> Automaton:
    nfa = _Nfa()
    start = nfa.state()
    ends = []
    for t in trees:
        begin = nfa.state()
        nfa.free[start].append(begin)
        ends.append(nfa.add(t, begin))
    # Bytes that no set tells apart are one letter of the alphabet.
    sets = list({s for edges in nfa.on for s, _ in edges})
    letter_of: dict[tuple, int] = {}
    letter = np.array([letter_of.setdefault(tuple(b in s for s in sets), len(letter_of)) for b in range(256)])
    sample = [int(np.flatnonzero(letter == k)[0]) for k in range(len(letter_of))]
    first = nfa.closure([start])
    reach = [[nfa.closure([t for values, t in edges if byte in values]) for byte in sample] for edges in nfa.on]
    always = first if unanchored else frozenset()
    number, todo, table = {first: 0}, [first], []
    while todo:  # in order of numbering
        now, row = [reach[s] for s in todo.pop(0) if nfa.on[s]], []
        for k in range(len(sample)):
            then = always.union(*[to[k] for to in now])
            if then not in number:
                number[then] = len(number)
                todo.append(then)
            row.append(number[then])
        table.append(row)
    move = np.array(table)
    accepts = np.array([sum(1 << k for k, e in enumerate(ends) if e in s) for s in number])
    # Minimisation: refine the classes by what they accept until successors agree.
    cls = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([cls, cls[move]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == cls.max():
            break
        cls = new
    keep = np.unique(cls, return_index=True)[1]
    order = np.argsort(keep != 0, kind="stable")  # the class of state 0 first
    if cls[0] != cls[keep[order[0]]]:
        order = np.concatenate([[cls[0]], np.delete(np.arange(len(keep)), cls[0])])
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    small = rank[cls[move[keep[order]]]]
    dead = number.get(frozenset())
    return Automaton(small[:, letter].astype(np.int32), accepts[keep[order]], -1 if dead is None else int(rank[cls[dead]]))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    #: A bytes pattern whose group 1 the length is taken of; without it, of the whole match.
    of: bytes = b""

    def keeps(self, match: bytes) -> bool:
        if not self.least:
            return True
        return len(re.fullmatch(self.of, match)[1] if self.of else match) >= self.least


#: The three kinds of the contract. hex counts in the automaton: shorter runs are everywhere in plain text.
BASE = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6, rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: What the method adds: published token formats and keys in PEM. Formats with a tail of their own each would multiply the
#: states of the combined automaton (any tail may run while any other does), so they share one. A key is its header with the
#: lines right after it, which may be cut off, and its footer.
MORE = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("vendor", "(github_pat_|glpat-|xox[abeoprs]-|AIza|[rs]k_(live|test)_|npm_)[A-Za-z0-9_-]+", 24),
    Rule("pem", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\\x0a\\x0d]*"),
    Rule("pem_end", "-----END ([A-Z]+ )?PRIVATE KEY-----"),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        trees = [parse(r.pattern) for r in rules]
        self.rules = rules
        self.forward = compile_automaton(trees, True)
        self.backward = [compile_automaton([_reverse(t)], False) for t in trees]
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def rows(self) -> list:
        """The transition array as rows that hold the next row itself; at 256, what the state accepts."""
        if self._rows is None:
            rows = [r.tolist() for r in self.forward.next]
            for row, accepts in zip(rows, self.forward.accepts.tolist(), strict=True):
                row[:] = [rows[t] for t in row]
                row.append(accepts)
            self._rows = rows
        return self._rows

    def ends(self, text: bytes) -> list[tuple[int, int]]:
        """(byte, rules that end a match there): one pass."""
        row = self.rows()[0]
        out = []
        for at, byte in enumerate(text):
            row = row[byte]
            if row[256]:
                out.append((at, row[256]))
        return out

    def start(self, rule: int, text: bytes, end: int, floor: int) -> int:
        """Leftmost start, from floor on, of a match of rule whose last byte is end; -1 if there is none."""
        automaton, state, found = self.backward[rule], 0, -1
        step, accepts, dead = automaton.next, automaton.accepts, automaton.dead
        for at in range(end, floor - 1, -1):
            state = step[state, text[at]]
            if state == dead:
                break
            if accepts[state]:
                found = at
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        ends = self.ends(text)
        out = []
        for k, rule in enumerate(self.rules if ends else ()):
            own = [at for at, mask in ends if mask >> k & 1]
            floor, i = 0, 0
            while i < len(own):
                last = i
                while last + 1 < len(own) and own[last + 1] == own[last] + 1:
                    last += 1
                for at in own[i : last + 1]:  # the first of the run, unless an earlier match of the rule covers its start
                    begin = self.start(k, text, at, floor)
                    if begin >= 0:
                        floor = own[last] + 1
                        if rule.keeps(text[begin:floor]):
                            out.append((begin, k, floor))
                        break
                i = last + 1
        return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(scanner: Callable[[], Scanner], batches: Iterator[pa.RecordBatch]):
    """For each batch: it, and for each row the text and its spans in bytes."""
    scan = scanner().spans
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        texts = (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        yield batch, ((t, scan(t)) for t in texts)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: kind, start and end (code points, end exclusive), by start, then rule."""
    held = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def scan(batches):
        for batch, rows in _found(lambda: held.value, batches):
            out = []
            for text, spans in rows:
                if spans:
                    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    out.append([{"kind": rules[k].kind, "start": int(point[a]), "end": int(point[b])} for a, k, b in spans])
                else:
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPANS_ARROW)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text replaced by mark (spans that overlap or touch by one); null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    sign, names = mark.encode(), docs.columns

    def clean(batches):
        for batch, rows in _found(lambda: held.value, batches):
            out = []
            for text, spans in rows:
                parts, at = [], 0
                for a, _, b in spans:
                    if b > at:
                        parts += [text[at:a], sign] if a > at or not parts else []
                        at = b
                out.append(b"".join([*parts, text[at:]]))
            new = pa.array(out, pa.binary()).cast(pa.string())
            valid = batch.column("text").is_valid()
            new = pa.compute.if_else(valid, new, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(i) for i, n in enumerate(names)], names)

    return docs.mapInArrow(clean, docs.schema)
