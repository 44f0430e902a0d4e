"""Secret scanning with combined deterministic automata.

Every rule's regex is parsed into a Thompson NFA over bytes. Three automata are made of all rules together by subset
construction over byte classes, each minimised by partition refinement into one transition array:

1. The filter reads each text forward once, free to begin anywhere, and stays where it accepts: most texts end here.
2. The reversed rules, free to begin anywhere, read the other texts backward once; where a rule is accepted, a match of it begins.
3. The rules, anchored, are read from those places on; the last accepted place is the match's end. It is the leftmost longest
   match, and the next one begins behind it, so that a rule reads each byte of its matches once.

Cost is linear in the text, whatever it holds, as long as a rule reads only boundedly many bytes beyond its last accepted one,
which is so for all rules here. Only the arrays are broadcast: their size depends on the rules, not on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import accumulate
from operator import getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, give_back, span_digest, values

WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def value_of(span: bytes) -> bytes:
    """The value of an assignment: what follows the first : or =, blanks and a quote."""
    at = min(i for i in (span.find(b":"), span.find(b"=")) if i >= 0)
    rest = span[at + 1 :].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


def any_span(span: bytes) -> bool:
    return True


def at_least(n: int, span: bytes) -> bool:
    return len(span) >= n


def long_value(n: int, span: bytes) -> bool:
    return len(value_of(span)) >= n


@dataclass(frozen=True)
class Rule:
    """pattern: the regex. trigger: one that is contained in every span that holds; whole: one with the same spans that hold, where
    its matches are fewer. Both are the pattern by default. keep: whether a span holds."""

    kind: str
    pattern: str
    keep: Callable[[bytes], bool] = any_span
    ignore_case: bool = False
    trigger: str | None = None
    whole: str | None = None


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", partial(long_value, 6), True, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""),
    Rule("access", r"AKIA[A-Z0-9]+", partial(at_least, 20), trigger=r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", partial(at_least, 24), trigger=r"[0-9a-f]{24,}", whole=r"[0-9a-f]{24,}"),
)
#: The public prefixes of well-known credentials.
MORE_RULES = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", partial(at_least, 24), trigger=r"gh[opsur]_[A-Za-z0-9]"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", partial(at_least, 20), trigger=r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("map", r"AIza[A-Za-z0-9_-]+", partial(at_least, 35), trigger=r"AIza[A-Za-z0-9_-]"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", partial(at_least, 40), trigger=r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """eps[s]: states reached without a byte; arcs[s]: (byte set, state)."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def parse(self, pattern: str, start: int, fold: bool, backward: bool = False) -> int:
        """Adds the pattern after start, its parts in the opposite order if backward; gives its end. Literals, escapes, classes,
        groups, |, ?, *, +, {m}, {m,}, {m,n}."""
        self._p, self._i, self._fold, self._backward = pattern, 0, fold, backward
        tree = self._either()
        if self._i != len(pattern):
            raise ValueError(f"{pattern!r}: what stands at {self._i} isn't understood")
        return self._build(tree, start)

    def _peek(self) -> str:
        return self._p[self._i : self._i + 1]

    def _take(self) -> str:
        self._i += 1
        return self._p[self._i - 1]

    def _either(self):
        options = [self._row()]
        while self._peek() == "|":
            self._take()
            options.append(self._row())
        return options[0] if len(options) == 1 else ("or", options)

    def _row(self):
        parts = []
        while self._peek() and self._peek() not in "|)":
            atom = self._atom()
            while self._peek() and self._peek() in "?*+{":
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign := self._take(), (0, 0))
                if sign == "{":
                    end = self._p.index("}", self._i)
                    a, comma, b = self._p[self._i : end].partition(",")
                    low, high, self._i = int(a), (int(b) if b else None) if comma else int(a), end + 1
                atom = ("repeat", atom, low, high)
            parts.append(atom)
        return ("row", parts)

    def _byte(self) -> int:
        c = self._take()
        if c == "\\":
            c = self._take()
            if c == "x":
                self._i += 2
                return int(self._p[self._i - 2 : self._i], 16)
        return ord(c)

    def _atom(self):
        c = self._peek()
        if c == "(":
            self._take()
            if self._p.startswith("?:", self._i):
                self._i += 2
            inside = self._either()
            if self._peek() != ")":
                raise ValueError(f"{self._p!r}: a group isn't closed")
            self._take()
            return inside
        if c == ".":
            self._take()
            return ("bytes", frozenset(range(256)))
        if c != "[":
            return ("bytes", self._folded({self._byte()}))
        self._take()
        negate = self._peek() == "^"
        self._i += negate
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self._p[self._i + 1 : self._i + 2] != "]":
                self._take()
                high = self._byte()
            found |= set(range(low, high + 1))
        self._take()
        found = set(self._folded(found))
        return ("bytes", frozenset(set(range(256)) - found if negate else found))

    def _folded(self, found: set[int]) -> frozenset[int]:
        if self._fold:
            found = found | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)

    def _build(self, tree, at: int) -> int:
        kind = tree[0]
        if kind == "bytes":
            self.arcs[at].append((tree[1], to := self.state()))
            return to
        if kind == "row":
            for part in reversed(tree[1]) if self._backward else tree[1]:
                at = self._build(part, at)
            return at
        if kind == "or":
            end = self.state()
            for option in tree[1]:
                self.eps[at].append(begin := self.state())
                self.eps[self._build(option, begin)].append(end)
            return end
        _, atom, low, high = tree
        for _ in range(low):
            at = self._build(atom, at)
        if high is None:
            self.eps[at].append(loop := self.state())
            self.eps[self._build(atom, loop)].append(loop)
            return loop
        end = self.state()
        self.eps[at].append(end)
        for _ in range(high - low):
            at = self._build(atom, at)
            self.eps[at].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """classes: byte to byte class; step[state, class]: next state; accept[state]: bit set of rules. State 0 begins."""

    classes: np.ndarray
    step: np.ndarray
    accept: np.ndarray


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool, backward: bool = False) -> Automaton:
    """One minimal DFA for all patterns (regex, ignore case), for reading them backward if so; if not anchored, a match may begin at any byte."""
    nfa = _Nfa()
    begin = nfa.state()
    ends = {}
    for k, (pattern, fold) in enumerate(patterns):
        nfa.eps[begin].append(own := nfa.state())
        ends[nfa.parse(pattern, own, fold, backward)] = 1 << k
    sets = sorted({s for arcs in nfa.arcs for s, _ in arcs}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)])
    _, classes = np.unique(member, axis=0, return_inverse=True)
    classes = classes.reshape(-1)
    n_classes = int(classes.max()) + 1
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(n_classes)]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = closure({begin})
    number, todo, step = {first: 0}, [first], []
    for now in todo:
        row = []
        for b in example:
            to = {t for s in now for bytes_, t in nfa.arcs[s] if b in bytes_}
            nxt = closure(to | ({begin} if not anchored else set()))
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        step.append(row)
    accept = np.array([sum(bit for s, bit in ends.items() if s in states) for states in todo], np.int64)
    return _minimal(Automaton(classes.astype(np.uint8), np.array(step, np.int32), accept))


def _minimal(a: Automaton) -> Automaton:
    """Refines the partition by accepted rules until each block's states step into the same blocks."""
    _, block = np.unique(a.accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[a.step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = {}
    for b in block:  # state 0 keeps its number
        order.setdefault(int(b), len(order))
    block = np.array([order[int(b)] for b in block])
    pick = [int(np.flatnonzero(block == k)[0]) for k in range(len(order))]
    return Automaton(a.classes, block[a.step[pick]].astype(np.int32), a.accept[pick])


class Scanner:
    """The three combined automata of the rules, as arrays; runs inside tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.filter = compile_rules([(r.trigger or r.pattern, r.ignore_case) for r in rules], anchored=False)
        whole = [(r.whole or r.pattern, r.ignore_case) for r in rules]
        self.begins = compile_rules(whole, anchored=False, backward=True)
        self.ends = compile_rules(whole, anchored=True)

    def ready(self) -> "Scanner":
        """Turns the arrays into linked rows, so that a step is one lookup. Once in a process."""
        if hasattr(self, "_begin"):
            return self
        a = self.filter
        rows: list[list] = [[] for _ in range(len(a.accept))]
        for row, to, hit in zip(rows, a.step.tolist(), a.accept.tolist(), strict=True):
            row.extend([row] * len(to) if hit else [rows[t] for t in to])  # an accepting row leads to itself
        self._begin, self._hit = rows[0], {id(r) for r, hit in zip(rows, a.accept.tolist(), strict=True) if hit}
        self._rows, self._classes = rows, a.classes.tobytes()
        self._back, self._back_classes, self._back_accept = self.begins.step.tolist(), self.begins.classes.tobytes(), self.begins.accept
        alive = self.ends.accept.copy()  # the rules that a state can still accept
        while (more := alive | np.bitwise_or.reduce(alive[self.ends.step], axis=1)).tolist() != alive.tolist():
            alive = more
        self._ahead, self._ahead_classes = self.ends.step.tolist(), self.ends.classes.tobytes()
        self._accept, self._alive = self.ends.accept.tolist(), alive.tolist()
        return self

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) in bytes, by start and rule."""
        if id(reduce(getitem, data.translate(self._classes), self._begin)) not in self._hit:
            return []
        back = self._back
        states = np.fromiter(accumulate(data.translate(self._back_classes)[::-1], lambda s, c: back[s][c], initial=0), np.int32, len(data) + 1)
        said = self._back_accept[states[::-1]]  # at each place, the rules that have a match which begins there
        coded, step, out = data.translate(self._ahead_classes), self._ahead, []
        for k, rule in enumerate(self.rules):
            bit, at = 1 << k, 0
            for begin in np.flatnonzero(said & bit).tolist():
                if begin < at:
                    continue
                s = 0
                for i in range(begin, len(data)):
                    s = step[s][coded[i]]
                    if self._accept[s] & bit:
                        at = i + 1
                    elif not self._alive[s] & bit:
                        break
                if rule.keep(data[begin:at]):
                    out.append((begin, at, k))
        return sorted(out, key=lambda x: (x[0], x[2]))


SPAN = "struct<kind:string,start:long,end:long>"


def scan_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the array column `out` of spans (kind, start, end in code points, end exclusive), by start, then rule.

    Null and empty texts have no spans; very long ones are read whole; repeated rows, row order and other columns stay, also one
    of this name (the new one is then named fresh(df, out)); an empty table stays empty. One narrow pass without a shuffle.
    """
    out = fresh(df, out)
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Scanner(rules))

    @F.arrow_udf(f"array<{SPAN}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = held.value.ready()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in batches:
            found = []
            for text in texts:
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans = scanner.spans(data)
                if spans and not data.isascii():
                    before = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])  # code points that begin before each byte
                    spans = [(int(before[a]), int(before[b]), k) for a, b, k in spans]
                found.append([{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans])
            yield pa.array(found, kind)
        give_back()

    return df.withColumn(out, scan(F.col(text_col)))


def redact_secrets(df: DataFrame, text_col: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """Replaces the spans' characters by the mark, overlapping spans by one; texts without spans stay as they are."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(values(texts), values(found), strict=True):
            if text is not None and spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return df.withColumn(text_col, F.when(F.size(spans) > 0, redact(F.col(text_col), F.col(spans))).otherwise(F.col(text_col)))


def secret_digest(documents: DataFrame) -> DataFrame:
    out = fresh(documents, "secrets")
    return span_digest(scan_secrets(documents.select("doc_id", "text"), out=out), out, [r.kind for r in BASE_RULES])
