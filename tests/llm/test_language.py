import numpy as np
from pyspark.sql import functions as F

from ledgerstone.llm import language


def test_held_out_accuracy(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    train, rest = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    model = language.fit(train)
    found = language.identify(rest, declared=None, host=None, model=model).collect()
    assert sum(r["lang_found"] == r["lang"] for r in found) >= 0.98 * len(found)


def test_evidence_is_fused(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang")
    model = language.fit(df)
    rows = [(i, "on", "fr", "site.fr") for i in range(30)] + [(99, "on", "en", "site.com")]
    rows += [(100 + i, r["text"], r["lang"], "site.fr" if r["lang"] == "fr" else "site.com") for i, r in enumerate(df.limit(120).collect())]
    found = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model=model).collect()}
    assert found[0]["lang_found"] == "fr" and found[99]["lang_found"] == "en"


def test_edges(spark, data):
    model = language.fit(spark.read.parquet(f"{data}/documents.parquet"))
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "12 34 ...", "fr", "s"), (4, "日本語の文章です。漢字かな交じり", "en", "s"), (5, "the and of that with " * 20_000, "EN-us", "s"), (5, "the and of that with", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as _lang_host", "2 as _lang_score")
    found = {r["doc_id"]: r for r in language.identify(df, model=model).collect()}
    assert [found[k]["lang_known"] for k in (1, 2, 3, 4, 5)] == [False, False, False, False, True]
    assert language.identify(df.limit(0), model=model).count() == 0
    assert language.identify(df.limit(0)).count() == 0


def test_pages(spark, data):
    rows = language.page_languages(spark.read.parquet(f"{data}/pages.parquet")).collect()
    assert rows and sum(r["lang_found"] == r["lang_declared"] for r in rows) >= 0.95 * len(rows)


def test_rare_languages_and_copies_in_large_tables(spark):
    many = spark.range(5_000).select(F.concat(F.lit("the cat of that house "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([("hyvää huomenta kaikille", "fi"), ("kiitos paljon avusta", "fi"), ("123", "xx"), (None, "xx")], "text string, lang string")
    copies = spark.range(3_000).select(F.lit("un seul texte de la langue").alias("text"), F.lit("fr").alias("lang"))
    other = spark.range(30).select(F.concat(F.lit("la maison et le jardin "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("fr").alias("lang"))
    df = many.unionByName(rare).unionByName(copies).unionByName(other)
    model, once = language.fit(df, rows=100), language.fit(df.distinct(), rows=100)
    assert model.languages == once.languages == ["en", "fi", "fr", language.UNKNOWN]
    assert np.array_equal(model.log_p, once.log_p)
    assert language.quota([2, 30, 5_000], 100) == 68 and language.quota([2, 30], 100) == 30 and language.quota([], 100) == 0
    found = {r["text"]: r["lang_found"] for r in language.identify(rare.unionByName(other), declared=None, host=None, model=model).collect()}
    assert found["kiitos paljon avusta"] == "fi" and {v for k, v in found.items() if k and k.startswith("la ")} == {"fr"}


def brute_fusion(rows, model, found):
    """The posteriors by hand: rows (text, declared, host); found: the language that the text alone gives each."""
    languages, pseudo, towards = model.languages, 1.0, 20.0
    suffix = lambda h: h.rsplit(".", 1)[1] if "." in h else ""

    def likelihood(of):
        kinds = {of(r) for r in rows}
        total = {x: sum(f == x for f in found) + pseudo * (len(kinds) + 1) for x in languages}
        return {(k, x): np.log((sum(of(r) == k and f == x for r, f in zip(rows, found)) + pseudo) / total[x]) for k in kinds for x in languages}

    top = {x: sum(f == x for f in found) + 1.0 for x in languages}
    top = {x: v / sum(top.values()) for x, v in top.items()}

    def smoothed(own, parent):
        return {x: (sum(f == x for f in own) + towards * parent[x]) / (len(own) + towards) for x in languages}

    says, ends = likelihood(lambda r: r[1]), likelihood(lambda r: suffix(r[2]))
    by_suffix = {s: smoothed([f for r, f in zip(rows, found) if suffix(r[2]) == s], top) for s in {suffix(r[2]) for r in rows}}
    by_host = {h: smoothed([f for r, f in zip(rows, found) if r[2] == h], by_suffix[suffix(h)]) for h in {r[2] for r in rows}}
    out = []
    for text, declared, host in rows:
        logs, sizes = model.score([text], 1)
        post = [logs[0][k] + says[declared, x] + ends[suffix(host), x] + np.log(by_host[host][x]) for k, x in enumerate(languages)]
        out.append(languages[int(np.argmax(post))] if sizes[0] else language.UNKNOWN)
    return out


def test_posteriors_equal_brute_force_and_evidence_matters(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang")
    model = language.fit(df)
    full = [(r["text"][:300], r["lang"], f"h{k % 3}.{'fr' if r['lang'] == 'fr' else 'de' if r['lang'] == 'de' else 'com'}") for k, r in enumerate(df.limit(150).collect())]
    short = [(r[0].split()[0][:3], r[1], r[2]) for r in full if r[0].strip()]
    rows = full + short
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify(table, model=model).collect()}
    by_text = [got[k]["lang_text"] for k in range(len(rows))]
    assert [got[k]["lang_found"] for k in range(len(rows))] == brute_fusion(rows, model, by_text)
    right = lambda col: sum(got[k][col] == rows[k][1] for k in range(len(full), len(rows)))
    assert right("lang_found") > right("lang_text")  # ablation: without markup, suffix and host, short texts are read worse
    for part in ({"declared": None}, {"host": None}):
        less = {r["doc_id"]: r["lang_confidence"] for r in language.identify(table, model=model, **part).collect()}
        assert any(less[k] != got[k]["lang_confidence"] for k in less)
