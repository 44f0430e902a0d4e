"""Benchmark decontamination with a distributed positional inverted index.

1. Count, over all documents, how often each term of the benchmark occurs (partial counts in every task).
2. In every window of an item, pick the rarest terms; they are the anchors.
3. Store the anchors' postings (term, document, position) of all documents as a table: the index.
4. Intersect the offset-adjusted lists: a posting at p of an anchor at q of an item says that the item may begin at p - q.
   A window can occur there only if all its anchors say so.
5. Compare the documents' words with the items' words at these places only; that is exact, as every occurrence of a window
   holds its anchors.

6. Proximity matches come from the same index, as an item's two rarest terms are always anchors: places where both stand as far
   apart as in the item, give or take SLOP words.

A document is known by a hash of its id and text, so null and repeated ids don't meet; what two documents of one hash share are
places to look at, never hits. What is broadcast is checked by its bytes: terms, items and candidate places; beyond the bound
the same joins shuffle. No step makes pairs of documents, or of documents and items that share no anchor.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, fresh, give_back, size_of, small, values, whole, written

WINDOW, ANCHORS, SLOP = 10, 2, 5
HELD_BYTES = 64 << 20  # of terms or items that Python workers hold
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII; A-Z count as a-z. In UTF-8 that is a matter of bytes."""
    return _WORDS(text.encode().lower()) if text else []


_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words of each text, counted in the column's bytes at once; null has none."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    inside = _LETTER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(inside)]
    first[begins] = inside[begins]
    sums = np.concatenate([[0], np.cumsum(first)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _word_column(df: DataFrame, text: str, out: str) -> DataFrame:
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[w.decode("utf8", "replace") for w in words_of(t)] for t in values(texts)], pa.list_(pa.string()))

    return df.withColumn(out, F.arrow_udf(split, "array<string>")(F.col(text)))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in the column text of all docs (0 where it doesn't)."""
    spark = docs.sparkSession
    if (held := _collected(terms)) is None:
        found = _word_column(docs.select("text"), "text", "w").select(F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    else:
        wanted = spark.sparkContext.broadcast(frozenset(held))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                own: Counter = Counter()
                for text in values(batch.column(0)):
                    own.update(words_of(text))
                for w in own.keys() & wanted.value:
                    total[w] += own[w]
            yield pa.record_batch([pa.array([w.decode("utf8", "replace") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
            give_back()

        found = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def _collected(terms: DataFrame) -> list[bytes] | None:
    """The terms for a broadcast, if they take at most HELD_BYTES; else None."""
    return [r[0].encode() for r in terms.collect()] if size_of(terms) <= HELD_BYTES else None


def postings(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index: key, term, position (from 0) of every occurrence; only of the given terms, if any are given."""
    if terms is None or (held := _collected(terms)) is None:
        out = _word_column(docs.select(key, text), text, "w").select(key, F.posexplode("w").alias("position", "term")).select(key, "term", "position")
        return out if terms is None else out.join(terms, "term", "left_semi").select(key, "term", "position")
    wanted = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(held)})
    kind = docs.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, names = wanted.value.get, [w.decode("utf8", "replace") for w in wanted.value]
        for batch in batches:
            rows, ids, places = [], [], []
            for r, text in enumerate(values(batch.column(1))):
                found = [(i, t) for i, w in enumerate(words_of(text)) if (t := get(w)) is not None]
                if found:
                    rows += [r] * len(found)
                    places += [i for i, _ in found]
                    ids += [t for _, t in found]
                if len(rows) > 200_000:
                    yield _posting_batch(batch, rows, ids, places, names)
                    rows, ids, places = [], [], []
            yield _posting_batch(batch, rows, ids, places, names)
        give_back()

    return docs.select(key, text).mapInArrow(find, f"`{key}` {kind}, term string, position int")


def _posting_batch(batch: pa.RecordBatch, rows: list[int], ids: list[int], places: list[int], names: list[str]) -> pa.RecordBatch:
    terms = pa.DictionaryArray.from_arrays(pa.array(ids, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
    return pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), terms, pa.array(places, pa.int32())], [batch.schema.names[0], "term", "position"])


_ANCHORS = "struct<windows:array<array<struct<place:int,term:string>>>,rarest:array<struct<place:int,term:string>>>"


def _anchored(items: DataFrame, counts: DataFrame, window: int, anchors: int) -> DataFrame:
    """item_key; windows: for each window the places of its rarest terms (ties: by term, then place); rarest: the whole item's two."""

    def pick(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = pa.struct([("place", pa.int32()), ("term", pa.string())])
        for rows in batches:
            out = []
            for places in values(rows):
                order = sorted((p["n"], p["term"], p["position"]) for p in places)
                rank = [0] * len(places)
                for k, (_, _, at) in enumerate(order):
                    rank[at] = k
                n = min(window, len(places))
                own = {tuple(sorted(sorted(range(s, s + n), key=rank.__getitem__)[:anchors])) for s in range(len(places) - n + 1)}
                named = lambda w: [{"place": p, "term": places[p]["term"]} for p in w]
                out.append({"windows": [named(w) for w in sorted(own)], "rarest": named(sorted(at for _, _, at in order[:2]))})
            yield pa.array(out, pa.struct([("windows", pa.list_(pa.list_(place))), ("rarest", pa.list_(place))]))

    placed = items.select("item_key", F.posexplode("words").alias("position", "term")).join(counts, "term")
    by_item = placed.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("position", "term", "n"))).alias("places"))
    return by_item.select("item_key", F.arrow_udf(pick, _ANCHORS)("places").alias("a")).select("item_key", "a.*")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, words of the items that have any; equal rows are one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), whole("text").alias("text")).distinct()
    return written(_word_column(items, "text", "words").where(F.size("words") > 0).select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "words"))


def _index(docs: DataFrame, items: DataFrame, window: int, anchors: int) -> tuple[DataFrame, DataFrame]:
    """The stored postings doc_key, term, position of the anchors' terms, and the items' anchors."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    anchored = written(_anchored(items, term_counts(docs, terms), window, anchors))
    every = F.array_union(F.flatten("windows"), "rarest")
    each = anchored.select(F.explode(every).alias("a")).select(F.col("a.term").alias("term")).distinct()
    return written(postings(docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "text"), each, "doc_key")), anchored


def _candidate_places(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """doc_key, item_key, begin: where an item may lie in a document such that a whole window could occur. begin may be negative."""
    each = anchored.select("item_key", F.explode(F.array_distinct(F.flatten("windows"))).alias("a")).select("item_key", F.col("a.place").alias("place"), F.col("a.term").alias("term"))
    said = index.join(small(each), "term").select("doc_key", "item_key", (F.col("position") - F.col("place")).alias("begin"), "place")
    met = said.groupBy("doc_key", "item_key", "begin").agg(F.collect_set("place").alias("places"))
    whole_windows = F.exists("windows", lambda w: F.forall(w, lambda a: F.array_contains("places", a["place"])))
    return met.join(small(anchored.select("item_key", "windows")), "item_key").where(whole_windows).select("doc_key", "item_key", "begin")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window of an item), items (sorted distinct ids, as strings), and
    n_near if slop is given: how many places there are where an item's two rarest terms are as far apart as in the item, give or
    take slop (items of one word: where it stands).

    docs: doc_id, text, and whatever else stands there (columns of the new names stay; the new ones then get an underscore in
    front, as fresh() says); benchmark: item_id, text. A null or empty text has no words; a null doc_id is a value like others; rows that repeat an id are each judged by their own
    text, and repeated rows alike; an empty benchmark or table gives no hits. Texts of any length are read whole. Terms of equal
    rarity go by their bytes, then place. A null item_id isn't among the items, but its words count.
    """
    bounded_batches(docs.sparkSession)
    items = _items(benchmark)
    index, anchored = _index(docs.select("doc_id", "text"), items, window, ANCHORS)
    places = _candidate_places(index, anchored)
    held = None
    if size_of(items) <= HELD_BYTES:
        held = docs.sparkSession.sparkContext.broadcast({r["item_key"]: (r["item_id"], [w.encode() for w in r["words"]]) for r in items.collect()})
        by_doc = places.groupBy("doc_key").agg(F.collect_list(F.struct("item_key", "begin")).alias("places"))
    else:
        by_doc = places.join(items, "item_key").groupBy("doc_key").agg(F.collect_list(F.struct("item_id", "begin", "words")).alias("places"))
    own, places_col, out, near = (fresh(docs, x) for x in ("_doc_key", "_places", "_hits", "_near"))
    if slop is not None:
        close = _proximate(index, anchored, slop).groupBy("doc_key").agg(F.count("*").alias("near"))
        by_doc = by_doc.join(close, "doc_key", "full")
    found = written(by_doc.select(F.col("doc_key").alias(own), F.col("places").alias(places_col), *([F.col("near").alias(near)] if slop is not None else [])))
    forget(index, anchored)

    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = held.value if held else None
        for texts, rows in batches:
            n_words, hits, met = word_counts(texts), np.zeros(len(texts), np.int64), [[]] * len(texts)
            for k in np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False)):
                own_places = [(*known[p["item_key"]], p["begin"]) if known else (p["item_id"], [w.encode() for w in p["words"]], p["begin"]) for p in rows[k].as_py()]
                hits[k], met[k] = _judged(texts[k].as_py(), own_places, window)
            yield pa.StructArray.from_arrays([pa.array(n_words), pa.array(hits), pa.array(met, pa.list_(pa.string()))], ["n_words", "n_hit", "items"])
        give_back()

    joined = docs.withColumn(f"{own}_", F.xxhash64("doc_id", "text")).join(small(found), F.col(f"{own}_") == F.col(own), "left")
    judged = F.arrow_udf(judge, "struct<n_words:long,n_hit:long,items:array<string>>")(F.col("text"), F.col(places_col))
    result = [F.col(out)["n_words"].alias(fresh(docs, "n_words")), F.col(out)["n_hit"].alias(fresh(docs, "n_hit")), F.array_sort(F.col(out)["items"]).alias(fresh(docs, "items"))]
    if slop is not None:
        result.append(F.coalesce(F.col(near), F.lit(0)).alias(fresh(docs, "n_near")))
    return joined.withColumn(out, judged).select(*docs.columns, *result)


def _judged(text: str | None, places: list[tuple[str | None, list[bytes], int]], window: int) -> tuple[int, list[str]]:
    """The number of hit words, and the items that hit any; places: (item_id, words, begin)."""
    words = words_of(text)
    hit: set[int] = set()
    items = set()
    for name, item, begin in places:
        need, run = min(window, len(item)), 0
        for i, w in enumerate(item):
            run = run + 1 if 0 <= begin + i < len(words) and words[begin + i] == w else 0
            if run >= need:
                hit.update(range(begin + i + 1 - run if run == need else begin + i, begin + i + 1))
                items.add(name)
    return len(hit), [x for x in items if x is not None]


def _proximate(index: DataFrame, anchored: DataFrame, slop: int) -> DataFrame:
    """doc_key, item_key, position, distinct. Lists are joined by document, item and blocks of positions, not pair by pair."""
    one, two = anchored.where(F.size("rarest") == 1), anchored.where(F.size("rarest") == 2)
    alone = index.join(small(one.select("item_key", F.col("rarest")[0]["term"].alias("term"))), "term").select("doc_key", "item_key", "position")

    def side(k: int) -> DataFrame:
        own = small(two.select("item_key", F.col("rarest")[k]["term"].alias("term"), F.col("rarest")[k]["place"].alias("place")))
        return index.join(own, "term").select("doc_key", "item_key", F.col("position").alias(f"p{k}"), (F.col("position") - F.col("place")).alias(f"b{k}"))

    block = lambda c: F.floor(c / F.lit(slop + 1))
    left = side(0).withColumn("block", F.explode(F.array(*(block(F.col("b0")) + d for d in (-1, 0, 1)))))
    right = side(1).withColumn("block", block(F.col("b1")))
    near = left.join(right, ["doc_key", "item_key", "block"]).where(F.abs(F.col("b0") - F.col("b1")) <= slop)
    return alone.unionByName(near.select("doc_key", "item_key", F.least("p0", "p1").alias("position"))).distinct()


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, position: items whose two rarest terms stand in a document as far apart as in the item, give or take slop.

    Items of one word match where it stands. docs: doc_id, text. Rows that repeat an id and a text are one.
    """
    bounded_batches(docs.sparkSession)
    items = _items(benchmark)
    index, anchored = _index(docs.select("doc_id", "text"), items, WINDOW, ANCHORS)
    ids = docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id")
    found = written(_proximate(index, anchored, slop))
    found = found.join(small(items.select("item_key", "item_id")), "item_key")
    return ids.join(small(found), "doc_key").select("doc_id", "item_id", "position").distinct()


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    own = contamination(documents.select("doc_id", "text"), benchmark, slop=SLOP)
    return own.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")
