"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model is compiled into two transducers.

* The normaliser: a trie of the model's rewriting rules (its character map, as far as it has one), whose final states write what
  a match becomes; characters on no path are copied. It is subsequential: the leftmost longest match decides, so each input has
  one output. Blanks become meta symbols on the way, and the dummy prefix goes in front.
* The pieces: arcs that read a piece's characters and write its number, and fallback arcs that read one character that no piece
  is and write its bytes' pieces (or the unknown piece).

The second is composed with each normalised input lazily: a state is a place in the input and the last piece written. The
encoding is the tropical shortest path. In a unigram model an arc weighs its piece's negative score, and a fallback arc ten more
than the worst one. In a byte-pair model an arc weighs 0 if merging the text of the last two pieces alone gives these two pieces
again, and infinity if not: exactly one path is then of finite weight, and it is the byte-pair encoding. Either way one state
for each place is enough. Runs of meta symbols in byte-pair models are the one exception: all their merges may tie, which pairs
can't tell; their path is found by merging from the left.

If no piece holds the meta symbol behind another character (as in all common models), every path passes the places before a run
of meta symbols: inputs are cut there, and the path of each distinct part is kept, in tables of bounded size.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, give_back, values

META = "▁"
ROWS = 64  # texts whose pieces are held at once
UNKNOWN_PENALTY = 10.0
_WIDE, _LOW, _START = 22, (1 << 22) - 1, -(1 << 21)  # two arcs as one number: pieces from 0, complements of characters below
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a message: numbers, 4-byte floats, bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 5:
            value, at = float(np.frombuffer(data, "<f4", 1, at)[0]), at + 4
        elif key & 7 == 1:
            value, at = data[at : at + 8], at + 8
        else:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Normaliser:
    """The rewriting rules as a trie in arrays: arcs[state << 21 | character] is the next state, writes[state] its output, if final."""

    def __init__(self, rules: dict[str, str], kept: list[str]) -> None:
        """kept: strings that are copied as they are; they go before rules."""
        self.arcs: dict[int, int] = {}
        self.writes: list[str | None] = [None]
        for read, write in [*rules.items(), *((x, x) for x in kept)]:
            state = 0
            for c in read:
                key = state << 21 | ord(c)
                if key not in self.arcs:
                    self.arcs[key] = len(self.writes)
                    self.writes.append(None)
                state = self.arcs[key]
            self.writes[state] = write
        every = [*rules, *kept]
        one, more, second = ("".join(sorted({x for x in found})) for found in ((r for r in every if len(r) == 1), (r[0] for r in every if len(r) > 1), (r[1] for r in every if len(r) > 1)))
        options = [f"[{re.escape(one)}]"] * bool(one) + [f"[{re.escape(more)}](?=[{re.escape(second)}])"] * bool(more)
        self._where = "|".join(options)
        self.kept = sorted(kept, key=len, reverse=True)

    def __call__(self, text: str) -> str:
        """What the text becomes. Only places where a rule may begin are looked at; all else is copied in blocks."""
        if not self._where:
            return text
        out, at, find = [], 0, re.compile(self._where).search
        while m := find(text, at):
            begin, state, end, write = m.start(), 0, m.start() + 1, text[m.start()]
            for i in range(begin, len(text)):
                state = self.arcs.get(state << 21 | ord(text[i]), -1)
                if state < 0:
                    break
                if self.writes[state] is not None:
                    end, write = i + 1, self.writes[state]
            out += [text[at:begin], write]
            at = end
        return "".join([*out, text[at:]])


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a model's character map: a double array (its units: label, offset, leaf), then the outputs, each ended by a zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    offset = lambda u: int(u >> 10) << ((int(u) & 1 << 9) >> 6)
    labels = np.arange(1, 256, dtype=np.int64)
    rules, todo = {}, [(offset(units[0]), b"")]
    while todo:
        base, read = todo.pop()
        at = base ^ labels
        at = at[at < len(units)]
        for place in at[(units[at] & 0x800000FF) == (at ^ base)].tolist():
            unit, key = units[place], read + bytes([place ^ base])
            below = place ^ offset(unit)
            if unit >> 8 & 1:
                begin = int(units[below]) & 0x7FFFFFFF
                rules[key.decode("utf8", "replace")] = texts[begin : texts.index(b"\0", begin)].decode("utf8", "replace")
            todo.append((below, key))
    return rules


class Transducer:
    """The compiled model. ready() must be called in the process that uses it."""

    def __init__(self, path: str) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.byte_pair, self.prefix, charsmap, self.shrink, escape = False, True, b"", True, True
        with open(path, "rb") as f:
            for key, value in _fields(f.read()):
                if key == 1:
                    own = dict(_fields(value))
                    self.pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
                elif key == 2:
                    own = dict(_fields(value))
                    self.byte_pair, suffix = own.get(3, 1) == 2, bool(own.get(24, 0))
                    if own.get(3, 1) not in (1, 2) or suffix:
                        raise ValueError("only unigram and byte-pair models with blanks as prefixes are supported")
                elif key == 3:
                    own = dict(_fields(value))
                    charsmap, self.prefix, self.shrink, escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if not escape:
            raise ValueError("models with unescaped blanks aren't supported")
        self.normaliser = Normaliser(character_map(charsmap), [p for p, _, kind in self.pieces if kind == USER])

    def ready(self, cache: int = 150_000) -> "Transducer":
        """Builds what isn't broadcast; once in a process, as its tasks share the broadcast object and so the paths found."""
        if hasattr(self, "_parts"):
            return self
        self._id = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self._score = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self._byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self._unknown = next((i for i, (*_, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self._out = [b"" if kind in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(META, " ").encode() for p, _, kind in self.pieces]
        scores = list(self._score.values()) or [0.0]
        bonus = lambda p, s, kind: len(p.encode()) * max(scores) - 0.1 if kind == USER else s
        self._weight = [-bonus(*x) for x in self.pieces]
        self._fallback = UNKNOWN_PENALTY - min(scores)
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pairs: dict[int, float] = {}
        self._cache = cache
        self._arcs = ahocorasick.Automaton()  # the pieces' trie with failure links: gives the arcs that end at each place
        for p, i in self._id.items():
            self._arcs.add_word(p, (i, len(p)))
        self._reach, self._longest = self._arcs.longest_prefix, max(map(len, self._id), default=1)
        self._arcs.make_automaton()
        self._text = [p for p, *_ in self.pieces]
        self._chars = {p for p in self._id if len(p) == 1}
        self._joins = {p[i : i + 2] for p in self._id for i in range(len(p) - 1)}
        frozen = "|".join(map(re.escape, self.normaliser.kept)) if self.byte_pair else ""
        spans = any(META in p.lstrip(META) for p in self._id)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self._id and not any(c in p for p in self._joins))
        words = r"[\s\S]+" if spans else rf"{META}*[^{META}{alone}]+|{META}+|[{alone}]" if alone else rf"{META}*[^{META}]+|{META}+"
        self._cut = re.compile(words).findall
        self._frozen = re.compile(f"({frozen})").split if frozen else None
        return self

    def normal(self, text: str) -> str:
        """The normaliser's output."""
        text = self.normaliser(text)
        if self.shrink:
            text = re.sub(" +", " ", text).strip(" ")
        return META * (self.prefix and text != "") + text.replace(" ", META)

    def encode(self, text: str) -> bytes:
        """Piece ids as 4-byte integers."""
        parts, out = self._parts, []
        normal = self.normal(text)
        for k, block in enumerate(self._frozen(normal) if self._frozen else [normal]):
            if k % 2:  # what the user has defined is never merged
                out.append(array("i", [self._id[block]]).tobytes())
                continue
            for part in self._cut(block):
                ids = parts.get(part)
                out.append(self._whole(part) if ids is None else ids)
        ids = b"".join(out)
        if not self._byte and ids:  # unknown characters side by side are one unknown piece
            own = np.frombuffer(ids, np.int32)
            ids = own[np.concatenate([[True], (own[1:] != self._unknown) | (own[:-1] != self._unknown)])].tobytes()
        return ids

    def _whole(self, part: str) -> bytes:
        """A part's ids. No arc reads two characters that stand side by side in no piece, so it is cut there as well."""
        if (ids := self._older.get(part)) is not None:
            self._keep(part, ids)
            return ids
        cuts = [0, *(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self._joins), len(part)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            own = part[a:b]
            if (ids := self._parts.get(own)) is None:
                ids = array("i", self._path(own)).tobytes()
                if len(cuts) > 2:
                    self._keep(own, ids)
            out.append(ids)
        self._keep(part, ids := b"".join(out))
        return ids

    def _keep(self, part: str, ids: bytes) -> None:
        """Two generations bound the memory; what is dropped is found again."""
        if len(self._parts) >= self._cache:
            self._older, self._parts = self._parts, {}
        if len(part) < 100:
            self._parts[part] = ids

    def decode(self, ids) -> str:
        """The text that ids stand for, without the dummy prefix; bytes that aren't UTF-8 become U+FFFD."""
        out = self._out
        text = b"".join([out[i] for i in ids]).decode("utf8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def _path(self, s: str) -> list[int]:
        """The ids on the shortest path of a part."""
        blanks = len(s) - len(s.lstrip(META)) if self.byte_pair else 0
        if blanks < 2:
            return self._written(self._shortest(s))
        if blanks < len(s):  # pieces of meta symbols alone merge last and tie: from the left
            rest = self._shortest(s[blanks - 1 :])
            if rest[0] == self._id.get(META):
                return self._run(blanks) + self._written(rest[1:])
            return self._run(blanks - 1) + self._written(rest)
        return self._run(blanks)

    def _run(self, n: int) -> list[int]:
        """Meta symbols alone: all their merges tie, so the leftmost pair that makes a piece merges."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and META * (sizes[-2] + sizes[-1]) in self._id:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return self._written([self._id.get(META * k, ~ord(META)) for k in sizes])

    def _merged(self, s: str) -> list[str]:
        """What merging the best pair, from the left, again and again makes of a short text."""
        parts, score = list(s), self._score
        while len(parts) > 1:
            best, k = -math.inf, -1
            for i in range(len(parts) - 1):
                if (x := score.get(parts[i] + parts[i + 1])) is not None and x > best:
                    best, k = x, i
            if k < 0:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _pair_weight(self, before: int, arc: int) -> float:
        """0 if a byte-pair model writes this arc's piece behind that one, else infinity."""
        if len(self._pairs) >= 2 * self._cache:
            self._pairs.clear()
        texts = [self._text[x] if x >= 0 else chr(~x) for x in (before, arc) if x != _START]
        found = self._pairs[before << _WIDE ^ arc & _LOW] = 0.0 if self._merged("".join(texts)) == texts else math.inf
        return found

    def _finite(self, s: str) -> list[int] | None:
        """The arcs on the one path of finite weight through a byte-pair model's composition: depth first, the longest arc first.

        A place has one finite way in, so one from which no arc leads on isn't entered again.
        """
        ids, pairs, reach, most, n = self._id, self._pairs, self._reach, self._longest, len(s)
        out, before, left, at, last = [], [], set(), 0, _START
        k = reach(s[:most]) or 1
        while at < n:
            while k:
                arc = ids.get(s[at : at + k])
                if arc is None and k == 1:
                    arc = ~ord(s[at])
                if arc is not None and at + k not in left:
                    weight = pairs.get(last << _WIDE ^ arc & _LOW)
                    if (self._pair_weight(last, arc) if weight is None else weight) == 0:
                        break
                k -= 1
            if k:
                out.append(arc)
                before.append(at)
                at, last = at + k, arc
                k = reach(s[at : at + most]) or 1
            elif out:
                left.add(at)
                out.pop()
                k, at = at - before[-1] - 1, before.pop()
                last = out[-1] if out else _START
            else:
                return None
        return out

    def _shortest(self, s: str) -> list[int]:
        """The arcs on the tropical shortest path through the composition with s, for both kinds of models. A fallback arc is the
        complement of its character. Arcs are relaxed by their ends, longest first; ties keep the earlier one."""
        if self.byte_pair and (found := self._finite(s)) is not None:
            return found
        arcs = self._arcs.iter(s)
        if not self._chars.issuperset(s):
            own = [(i, (~ord(c), 1)) for i, c in enumerate(s) if c not in self._chars]
            arcs = sorted([*arcs, *own], key=lambda x: x[0])
        cost, last = [0.0] + [math.inf] * len(s), [_START] * (len(s) + 1)
        pairs, weight, byte_pair = self._pairs, self._weight, self.byte_pair
        for end, (arc, n) in arcs:
            begin, end = end + 1 - n, end + 1
            so_far = cost[begin]
            if so_far == math.inf or byte_pair and cost[end] == 0:
                continue
            if byte_pair:
                own = pairs.get(last[begin] << _WIDE ^ arc & _LOW)
                total = so_far + (self._pair_weight(last[begin], arc) if own is None else own)
            else:
                total = so_far + (weight[arc] if arc >= 0 else self._fallback)
            if total < cost[end]:
                cost[end], last[end] = total, arc
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= len(self._text[last[at]]) if last[at] >= 0 else 1
        return out[::-1]

    def _written(self, arcs: list[int]) -> list[int]:
        """What the arcs write: pieces, and for a fallback arc its character's bytes, or the unknown piece."""
        if all(x >= 0 for x in arcs):
            return arcs
        return [i for x in arcs for i in ([x] if x >= 0 else [self._byte[b] for b in chr(~x).encode()] if self._byte else [self._unknown])]


def encode_pieces(df: DataFrame, model: str, text_col: str = "text", ids: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """df with the array column `ids`, and with what decoding those ids gives if `decoded` names a column.

    Null counts as empty, and an empty text has no pieces; whole texts of any length are encoded; repeated rows get equal pieces;
    ties of paths go to the longer last piece; other columns stay, also of these names (the new ones are then named by
    fresh()); an empty table stays empty. One narrow pass; the compiled model is broadcast (its size is the vocabulary's).
    """
    ids, decoded = fresh(df, ids), decoded and fresh(df, decoded)
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Transducer(model))

    @F.arrow_udf("struct<ids:array<int>,text:string>" if decoded else "struct<ids:array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = held.value.ready()
        for texts in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            own = [fst.encode(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in own]).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(own), np.int32)))]
            if decoded:
                columns.append(pa.array([fst.decode(np.frombuffer(x, np.int32).tolist()) for x in own], pa.string()))
            yield pa.StructArray.from_arrays(columns, ["ids", "text"][: len(columns)])
        give_back()

    got = fresh(df, "encoded")
    out = df.withColumn(got, encode(F.col(text_col))).withColumn(ids, F.col(got)["ids"])
    return (out.withColumn(decoded, F.col(got)["text"]) if decoded else out).drop(got)


def decode_pieces(df: DataFrame, model: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; null ids give null. Other columns stay, as in encode_pieces()."""
    out = fresh(df, out)
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Transducer(model))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = held.value.ready()
        for rows in batches:
            yield pa.array([None if x is None else fst.decode(x) for x in values(rows)], pa.string())

    return df.withColumn(out, decode(F.col(ids)))


def piece_digest(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, the ids, their count, the decoded text's digest and whether it equals the text."""
    own = encode_pieces(documents.select("doc_id", "text"), model, decoded="decoded")
    return own.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "piece_ids")
