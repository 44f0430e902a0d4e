"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. A text becomes a weighted set: its shingles of five words, each with its count times a damped inverse document frequency.
   Document frequencies are counted over all documents in DF_BUCKETS hashed counters (a table of fixed size, which is
   broadcast). The inverse frequency is scaled to [1, 1 + IDF_SPREAD]: unbounded, it would weigh the few words that differ
   within a large group of near copies many times higher than all that they share, and tear the group apart.
2. Texts with the same words are one vertex. Each vertex gets SAMPLES consistent weighted samples; two vertices agree in a
   sample with a probability that is their weighted Jaccard similarity. BANDS bands of SAMPLES / BANDS samples are the bucket keys.
3. The least member of each bucket leads it and is compared with all others, first by their samples, then exactly; the links
   found make classes. In a bucket that still holds several classes, all members outside its largest class are queries and are
   compared with all members of other classes, in blocks of bounded size within tasks: first by samples, and those that agree
   with any, exactly. So every pair of a bucket that isn't in one class by then has been compared, but no pair is a row except
   those with a leader.
4. Verified links are joined into connected components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bounded_batches, counted, forget, fresh, give_back, hinted, small, spread_join, values, written

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, BANDS = 126, 21
BLOCK, BLOCK_WORDS = 256, 1 << 20
DF_BUCKETS, IDF_SPREAD = 1 << 18, 0.15
_TABLE, _STEP, _LEVELS = 1 << 12, 0.02, 1024
_B = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64, for i < n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_B, np.uint64(pow(int(_B), -1, 1 << 64)))):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base)]))
    return _POWERS[0], _POWERS[1]


_READ, _AT_ONCE = 1 << 16, 1 << 13  # bytes of a text and shingles that are hashed at once
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in their order: runs of letters, digits and characters beyond ASCII, in lower case.

    Long texts are read in blocks that end between words, which bounds the memory.
    """
    raw = np.frombuffer(text.lower().encode("utf8", "replace"), np.uint8) if text else np.empty(0, np.uint8)
    inside = np.concatenate([[False], _LETTER[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        begin = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, begin + _READ, "right")))
        own = raw[begin : ends[to - 1]]
        up, down = _powers(len(own) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], dtype=np.uint64)])
        s, e = starts[k:to] - begin, ends[k:to] - begin
        out[k:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        k = to
    return _mixed(out)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the shingles, sorted, and their counts. Fewer than five words make one shingle, none make none."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = min(SHINGLE, len(words))
    own = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        own = own * _B + words[i : len(words) - n + 1 + i]
    return np.unique(_mixed(own + np.uint64(n)), return_counts=True)


def identity(words: np.ndarray) -> bytes:
    """16 bytes that stand for the words in their order."""
    return blake2b(words.tobytes(), digest_size=16).digest()


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(hashes & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]


@lru_cache(maxsize=1)  # cleared at the end of each task
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each quantised log weight and entry of the drawn variables: log a and t of the sampling scheme; and a multiplier
    for each sample. r and c are Gamma(2, 1), beta is uniform; a shingle's entry in a sample is picked by its hash."""
    rng = np.random.default_rng(20_240_229)
    r, c, beta = rng.gamma(2, 1, _TABLE), rng.gamma(2, 1, _TABLE), rng.uniform(0, 1, _TABLE)
    log_a, t = np.empty((_LEVELS, _TABLE), np.float32), np.empty((_LEVELS, _TABLE), np.int32)
    for level in range(_LEVELS):  # row by row, so that no large array is made on the way
        t[level] = own = np.floor(level * _STEP / r + beta)
        log_a[level] = np.log(c) - r * (own - beta + 1)
    return log_a.reshape(-1), t.reshape(-1), rng.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """SAMPLES hashes, each of a sampled (shingle, t)."""
    log_a, t, odd = _draws()
    level = np.minimum(np.rint(np.log(w) / _STEP), _LEVELS - 1).astype(np.int64) * _TABLE
    out = np.empty(SAMPLES, np.uint64)
    for lo in range(0, SAMPLES, 16):
        columns = odd[None, lo : lo + 16]
        least, shingle, step = np.full(columns.size, np.inf, np.float32), np.zeros(columns.size, np.uint64), np.zeros(columns.size, np.int32)
        for i in range(0, len(hashes), _AT_ONCE):  # bounds memory for very long texts
            part = hashes[i : i + _AT_ONCE]
            at = ((part[:, None] * columns) >> np.uint64(52)).astype(np.int64) + level[i : i + _AT_ONCE, None]
            pick = log_a[at].argmin(axis=0)  # ties: the smallest hash, as they are sorted
            own = at[pick, np.arange(columns.size)]
            less = log_a[own] < least
            least, shingle, step = np.where(less, log_a[own], least), np.where(less, part[pick], shingle), np.where(less, t[own], step)
        out[lo : lo + 16] = _mixed(shingle * _B + step.astype(np.int64).astype(np.uint64) + np.arange(lo, lo + columns.size, dtype=np.uint64))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two (sorted hashes, weights); 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low, high = np.minimum(a[1][i], b[1][j]).sum(), np.maximum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low - high + high
    return float(low / total) if total else 0.0


def _counted(held: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate([np.empty(0, np.uint64), *held]) & np.uint64(DF_BUCKETS - 1)
    return np.bincount(every.astype(np.int64), minlength=DF_BUCKETS)


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The inverse document frequency of each hashed counter, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, held, size = np.zeros(DF_BUCKETS, np.int64), 0, [], 0
        for batch in batches:
            n += len(batch)
            for t in values(batch.column(0)):
                held.append(shingles(word_hashes(t))[0])
                size += len(held[-1])
                if size > 1 << 20:
                    total += _counted(held)
                    held, size = [], 0
        total += _counted(held)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bucket", "n"])
        give_back()

    sums = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # DF_BUCKETS + 1 rows at most
    found = dict(zip(sums["bucket"], sums["n"], strict=True))
    n = max(1, found.pop(-1, 0))
    df = np.ones(DF_BUCKETS)
    df[list(found)] = list(found.values())
    return 1 + IDF_SPREAD * np.clip(np.log(n / df) / np.log(n + 1), 0, 1)


def signatures(docs: DataFrame, idf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, text_key (a hash of the text), vertex (16 bytes), words (their number), samples (SAMPLES bytes), bands (BANDS long keys; none for texts without words)."""

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            vertices, sizes, samples, bands = [], [], [], []
            for t in values(texts):
                words = word_hashes(t)
                h, n = shingles(words)
                vertices.append(identity(words))
                sizes.append(len(words))
                if not len(h):
                    samples.append(b"")
                    bands.append([])
                    continue
                own = signature(h, weights(h, n, idf.value))
                samples.append((own >> np.uint64(56)).astype(np.uint8).tobytes())
                keys = np.zeros(BANDS, np.uint64)
                for column in own.reshape(BANDS, -1).T:
                    keys = _mixed(keys * _B + column)
                bands.append((keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(vertices, pa.binary()), pa.array(sizes, pa.int64()), pa.array(samples, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["vertex", "words", "samples", "bands"])
        _draws.cache_clear()
        give_back()

    signed = F.arrow_udf(sign, "struct<vertex:binary,words:long,samples:binary,bands:array<long>>")(F.col(text))
    return docs.select(key, F.xxhash64(text).alias("text_key"), signed.alias("s")).select(key, "text_key", "s.*")


def _agree(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs whose samples don't rule out the similarity: at least SIMILARITY less four standard deviations agree."""
    least = SAMPLES * SIMILARITY - 4 * (SAMPLES * SIMILARITY * (1 - SIMILARITY)) ** 0.5

    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SAMPLES) for c in (a, b))
            yield pa.array((x == y).sum(axis=1) >= least)

    sides = [vertices.select(F.col("vertex").alias(k), F.col("samples").alias(f"s_{k}")) for k in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(F.arrow_udf(near, "boolean")("s_a", "s_b")).select("a", "b")


def _texts(needs: DataFrame, docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """needs (with vertex) and the vertices' texts. A vertex's text is found by its keeper's id and a hash of the text, so rows
    that only share an id, or have none, don't meet; rows that repeat both are one by then."""
    needs, n = counted(needs)
    wanted = written(needs.select("vertex").distinct().join(vertices.select("vertex", "kept"), "vertex").select("vertex", F.col("kept.text_key").alias("_key"), F.col("kept.doc_id").alias("_doc")))
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("_own"))
    held = held.join(small(wanted), (F.col("_own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    return held.groupBy("vertex").agg(F.any_value("text").alias("text")).join(hinted(needs, n, 96), "vertex")


def _verified(pairs: DataFrame, n_pairs: int, docs: DataFrame, idf, vertices: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. A leader a meets its partners in streams sorted by (a, salt): no group
    is held in memory, and a leader of many partners is dealt to many tasks."""
    fans = pairs.groupBy("a").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("salts"))
    fans = written(fans)
    salted = pairs.join(hinted(fans, n_pairs), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    needs = salted.select(F.col("b").alias("vertex"), "a", "salt", F.lit(1).alias("part"))
    needs = needs.unionByName(fans.select(F.col("a").alias("vertex"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part")))
    rows = _texts(needs, docs, vertices).select("a", "salt", "part", "vertex", F.col("vertex").alias("root"), "text")
    return _compared(rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "part"), idf)


def _verified_blocks(met: DataFrame, n_met: int, docs: DataFrame, idf, vertices: DataFrame) -> DataFrame:
    """Links (a, b) between a group's queries and partners of other classes; met is what _across() gives. A group's queries are
    dealt into blocks of bounded rows and words; its partners stream past each block, in parts of bounded rows."""
    queries = met.where("part = 0").join(vertices.select("vertex", "words"), "vertex")
    sizes = queries.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("words") / BLOCK_WORDS, F.lit(1.0))).cast("int").alias("parts"))
    spread = met.where("part = 1").groupBy("group").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("salts"))
    sizes = hinted(written(sizes.join(spread, "group")), n_met)
    h = F.xxhash64("vertex")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    each = met.join(sizes, "group")
    own = each.where("part = 0").select("group", F.pmod(h, "parts").cast("int").alias("q"), every(F.col("salts")).alias("salt"), "part", "vertex", "root")
    partners = each.where("part = 1").select("group", every(F.col("parts")).alias("q"), F.pmod(h, "salts").cast("int").alias("salt"), "part", "vertex", "root")
    needs = own.unionByName(partners).withColumn("a", F.concat("group", F.col("q").cast("string").cast("binary")))
    rows = _texts(needs.select("a", "salt", "part", "vertex", "root"), docs, vertices).select("a", "salt", "part", "vertex", "root", "text")
    return _compared(rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "part"), idf)


def _compared(dealt: DataFrame, idf) -> DataFrame:
    """Links (a, b) of streams sorted by (a, salt, part): the rows of part 0 are held and compared with each row of part 1 of
    another class. One link to each class is enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, vectors, index, known = None, [], [], None, set()
        for batch in batches:
            left, right = [], []
            for a, salt, part, vertex, root, text in zip(*map(values, batch.columns), strict=True):
                words = word_hashes(text)
                if identity(words) != vertex:  # another row with the same id
                    continue
                h, n = shingles(words)
                own = (h, weights(h, n, idf.value))
                if at != (a, salt):
                    at, names, vectors, index, known = (a, salt), [], [], None, set()
                if part == 0:
                    names.append((vertex, root))
                    vectors.append(own)
                    continue
                if index is None and names:
                    index = SetIndex(vectors)
                for k in index.similar(own) if index else ():
                    name, of = names[k]
                    if of != root and (name, root) not in known:
                        known.add((name, root))
                        left.append(name)
                        right.append(vertex)
            yield pa.record_batch([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
        names, vectors, index = [], [], None
        give_back()

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


class SetIndex:
    """Weighted sets by shingle, so that another set is compared with all of them at once, exactly."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        hashes = np.concatenate([h for h, _ in sets])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.weights = np.concatenate([w for _, w in sets])[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])[order]
        self.totals = np.array([w.sum() for _, w in sets])

    def similar(self, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The numbers of the sets that are similar enough to own."""
        begin, end = np.searchsorted(self.hashes, own[0], "left"), np.searchsorted(self.hashes, own[0], "right")
        n = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], np.minimum(self.weights[at], np.repeat(own[1], n)), minlength=len(self.totals))
        total = self.totals + own[1].sum() - shared
        return np.flatnonzero(shared >= SIMILARITY * total - 1e-9 * (total > 0)) if total.any() else np.empty(0, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """edges a, b: vertex, root (the least vertex of its component), for every vertex that isn't its own root."""
    edges, n = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, old = None, edges
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(hinted(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(hinted(least, n), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        seen = Observation()
        edges = written(star.where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")))
        forget(old)
        now, old = (seen.get.get("n") or 0, seen.get.get("h") or 0), edges
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        mark, n = now, now[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size (its rows).

    docs: doc_id, text; other columns, whatever their names, aren't looked at. One row for each row of docs. A null text counts as
    empty; texts with the same words are one class, so are texts without words; repeated rows and repeated ids are in the classes
    of their texts. Very long texts are hashed in blocks, whole. A null doc_id is never a class_id unless all of the class are
    null. An empty table gives an empty one. Ties of buckets and classes go to the least vertex.
    """
    return _classes(docs).select("doc_id", "class_id", "class_size")


def _classes(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the vertex of each row and the root of its class."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    idf = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))
    signed, n_signed = counted(signatures(docs, idf))
    kept = F.min(F.struct("doc_id", "text_key")).alias("kept")
    vertices, n_vertices = counted(signed.groupBy("vertex").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper"), kept, F.first("words").alias("words"), F.first("samples").alias("samples"), F.first("bands").alias("bands")))
    members = vertices.select("vertex", F.explode("bands").alias("bucket"))
    buckets = written(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("vertex").alias("leader")).where("n > 1"))
    members, n_members = counted(spread_join(members, buckets, "bucket", "n", n_vertices).select("bucket", "vertex", "leader"))
    pairs, n_pairs = counted(members.where("vertex <> leader").select(F.col("leader").alias("a"), F.col("vertex").alias("b")).distinct())
    near, n_near = counted(_agree(hinted(pairs, n_pairs), vertices))
    links = written(_verified(near, n_near, docs, idf, vertices))
    roots, n_roots = counted(components(links))
    forget(buckets, pairs, near, links)
    more, n_more = counted(_across(members.select("bucket", "vertex"), roots, n_roots, vertices))
    forget(members)
    if n_more:
        found, n_found = counted(_verified_blocks(more, n_more, docs, idf, vertices))
        if n_found:
            roots, n_roots = _merged_roots(found, roots, n_roots)
        forget(more, found)
    placed = written(vertices.select("vertex", "copies", "keeper").join(hinted(roots, n_roots), "vertex", "left").withColumn("root", F.coalesce("root", "vertex")))
    classes = written(placed.groupBy("root").agg(F.count("*").alias("members"), F.min("keeper").alias("class_id"), F.sum("copies").alias("class_size")))
    placed = spread_join(placed, classes, "root", "members", n_vertices)
    placed = written(placed.select("vertex", "copies", "root", "class_id", "class_size"))
    forget(vertices, roots, classes)
    return spread_join(signed.select("doc_id", "vertex"), placed, "vertex", "copies", n_signed).select("doc_id", "vertex", "root", "class_id", "class_size")


def _across(members: DataFrame, roots: DataFrame, n_roots: int, vertices: DataFrame) -> DataFrame:
    """group, vertex, root, part: the vertices of a bucket whose samples agree well enough with those of a vertex of another class
    there; as queries (part 0) or partners (1). group is the largest class of the bucket.

    A bucket's members outside its largest class are its queries. Queries and members are dealt into blocks of about BLOCK; each
    pair of blocks meets in one task, which holds the queries' samples and lets the members stream by.
    """
    placed = members.join(hinted(roots, n_roots), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = mixed.select("bucket", F.col("top.root").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("query_parts"))
    mixed, n_mixed = counted(mixed)
    held = placed.join(hinted(mixed, n_mixed), "bucket")
    held = held.join(vertices.select("vertex", "samples"), "vertex").withColumn("h", F.xxhash64("vertex"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    member = held.select("bucket", every(F.col("query_parts")).alias("q"), F.pmod("h", "parts").cast("int").alias("m"), F.lit(1).alias("side"), "vertex", "root", "samples", "largest")
    query = held.where("root <> largest").select("bucket", F.pmod("h", "query_parts").cast("int").alias("q"), every(F.col("parts")).alias("m"), F.lit(0).alias("side"), "vertex", "root", "samples", "largest")
    dealt = member.unionByName(query).repartition(F.col("bucket"), F.col("q"), F.col("m")).sortWithinPartitions("bucket", "q", "m", "side")
    least = SAMPLES * SIMILARITY - 4 * (SAMPLES * SIMILARITY * (1 - SIMILARITY)) ** 0.5

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, kept, hit = None, [], [], np.zeros(0, bool)
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            side, vertex, root, largest = batch.column(3).to_numpy(), *(batch.column(i).to_pylist() for i in (4, 5, 7))
            own = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, SAMPLES)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (side[1:] != side[:-1]), [True]])) if len(side) else []
            out = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if at != (key := tuple(keys[i])):
                    out += [(*q, 0) for q, met in zip(queries, hit, strict=False) if met]
                    at, queries, kept, hit = key, [], [], np.zeros(0, bool)
                if side[i] == 0:
                    queries += zip(largest[i:j], vertex[i:j], root[i:j], strict=True)
                    kept.append(own[i:j])
                    continue
                samples = np.concatenate(kept) if kept else np.empty((0, SAMPLES), np.uint8)
                roots = np.array([q[2] for q in queries], object)
                hit = hit if len(hit) == len(queries) else np.zeros(len(queries), bool)
                for k in range(i, j):
                    near = ((samples == own[k]).sum(axis=1) >= least) & (roots != root[k])
                    if near.any():
                        hit |= near
                        out.append((largest[k], vertex[k], root[k], 1))
            yield _quartets(out)
        yield _quartets([(*q, 0) for q, met in zip(queries, hit, strict=False) if met])
        queries, kept = [], []
        give_back()

    return dealt.mapInArrow(match, "group binary, vertex binary, root binary, part int").distinct()


def _quartets(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, pa.int32() if k == 3 else pa.binary()) for k, c in enumerate(columns)], ["group", "vertex", "root", "part"])


def _merged_roots(found: DataFrame, roots: DataFrame, n_roots: int) -> tuple[DataFrame, int]:
    """The roots after more links: the links' roots are joined into components, and the old roots follow theirs."""
    edges = found
    for k in ("a", "b"):
        own = hinted(roots.select(F.col("vertex").alias(k), F.col("root").alias(f"root_{k}")), n_roots)
        edges = edges.join(own, k, "left").withColumn(f"root_{k}", F.coalesce(f"root_{k}", k))
    merged, n = counted(components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
    further = hinted(merged.select(F.col("vertex").alias("root"), F.col("root").alias("top")), n)
    return counted(roots.join(further, "root", "left").select("vertex", F.coalesce("top", "root").alias("root")).unionByName(merged))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (rows without one go if the class has others).

    Rows that repeat an id are told apart by their texts; of several rows of one id and class, any one stays.
    """
    found = written(_classes(docs))
    twice, gone = fresh(docs, "_twice"), fresh(docs, "_gone")
    often = hinted(*counted(found.groupBy(F.col("doc_id").alias(twice)).count().where("count > 1").select(twice)))
    goes = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).join(often, F.col("doc_id").eqNullSafe(F.col(twice)), "left_anti")
    goes = hinted(*counted(goes.select(F.col("doc_id").alias(gone))))
    once = docs.join(often, docs["doc_id"].eqNullSafe(F.col(twice)), "left_anti")
    once = once.join(goes, once["doc_id"].eqNullSafe(F.col(gone)), "left_anti")

    def vertex(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([identity(word_hashes(t)) for t in values(texts)], pa.binary())

    own, root, key = fresh(docs, "_vertex"), fresh(docs, "_root"), fresh(docs, "_id")
    many = docs.join(often, docs["doc_id"].eqNullSafe(F.col(twice)), "left_semi").withColumn(own, F.arrow_udf(vertex, "binary")(F.col("text")))
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(key), F.col("vertex").alias(f"{own}_"), F.col("root").alias(root)).distinct()
    many = many.join(stays, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(f"{own}_"))).dropDuplicates(["doc_id", root])
    return once.unionByName(many.select(*docs.columns))
