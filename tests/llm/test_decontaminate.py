import random
import re
import time
from collections import defaultdict

import pyarrow as pa

from ledgerstone.llm import decontaminate as d


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    wins = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[s : s + n])].add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for k, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := wins.get(tuple(w[s : s + n])):
                    met |= found
                    hit |= set(range(s, s + n))
        out.append((k, len(w), len(hit), ",".join(sorted(met))))
    return sorted(out, key=str)


def got(docs, items):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in d.contamination(docs, items).collect()), key=str)


def test_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(docs.select("doc_id", "text"), items) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_hard_texts(spark):
    rng = random.Random(2)
    pool = ["a", "b", "The", "the", "É", "é", "x1", "日本"]
    text = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(i, text(rng.randint(0, 14))) for i in range(12)] + [(50, None), (51, "..."), (52, "a a a a a a a a a a a a"), (53, "the"), (3, text(11))]
    docs = [(i, ", ".join((text(rng.randint(0, 40)), rng.choice(items)[1] or "", text(5)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, items[3][1]), (7, "a " * 30), (7, "the"), (7, "the"), (200, "b " * 4000)]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    a, b = make(docs, "doc_id long, text string"), make(items, "item_id long, text string")
    assert got(a, b) == brute(docs, items)
    assert got(a, b.limit(0)) == brute(docs, []) and d.contamination(a.limit(0), b).count() == 0
    clash = a.selectExpr("*", "1 as _places", "2 as _hits", "3 as _doc_key", "4 as doc_key", "5 as item_key")
    assert d.contamination(clash, b, slop=1).count() == len(docs)
    out = d.contamination(a.selectExpr("*", "-1 as N_hit"), b)
    assert out.columns[-3:] == ["n_words", "_n_hit", "items"] and out.where("N_hit <> -1").count() == 0


def test_shuffled_paths_give_the_same(spark, data, monkeypatch):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet").limit(60) for t in ("documents", "benchmark"))
    want = got(docs.select("doc_id", "text"), items)
    monkeypatch.setattr(d, "HELD_BYTES", 0)
    monkeypatch.setattr(d, "small", lambda df: df.hint("merge"))
    assert got(docs.select("doc_id", "text"), items) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "q rare w w w unique z"), (2, "rare x unique"), (3, "unique rare"), (4, "solo")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare w w unique"), (2, "solo")], "item_id long, text string")
    near = {(r["doc_id"], r["item_id"]) for r in d.proximity(docs, items, 1).collect()}
    assert near == {(1, "1"), (2, "1"), (4, "2")}


def test_words_are_counted_in_the_column(spark):
    texts = ["a b", None, "", "É x-1", "..", "日本 語", "end"]
    for at in range(len(texts)):
        column = pa.array(["zz yy", *texts], pa.string()).slice(1 + at)
        assert d.word_counts(column).tolist() == [len(words(t)) for t in texts[at:]]


def test_many_rows_without_ids(spark):
    """10,000 rows without an id, a third of them one text: each is judged by its own text, and none meets the others."""
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(None, "a one two three four five six seven eight nine ten b")] * 3_000 + [(None, f"w{i} one two three") for i in range(7_000)]
    begin = time.monotonic()
    out = d.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).groupBy("n_hit").count().collect()
    assert {r["n_hit"]: r["count"] for r in out} == {10: 3_000, 0: 7_000} and time.monotonic() - begin < 60
