"""The pipeline against a brute-force version of its stages on a small fixture."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerstone.llm.queries import QUERIES

SECRET = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """The documents, more with secrets and without letters, and the benchmark."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = docs.where("doc_id in (1, 2)").withColumn("text", F.concat(F.lit("token = 'abcdef123456' "), F.reverse("text"))).withColumn("doc_id", F.col("doc_id") + 10_000)
    odd = docs.where("doc_id = 1").withColumn("text", F.lit("1234 5678")).withColumn("doc_id", F.lit(20_000).cast("long"))
    docs.unionByName(more).unionByName(odd).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def result(spark, folder):
    return {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}


def test_stages_take_effect(spark, folder, result):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_near_duplicates"](spark, folder).collect()}
    hit = {r["doc_id"]: r["contaminated"] for r in QUERIES["op4_decontamination"](spark, folder).collect()}
    known = {r["doc_id"]: r["lang_known"] for r in QUERIES["op10_language"](spark, folder).collect()}
    spans = {r["doc_id"]: r["spans"] for r in QUERIES["op7_secrets"](spark, folder).collect()}
    want = {k for k in text if known[k] and classes[k] == k and not hit[k]}
    assert set(result) == want
    for k in want:
        assert (result[k]["text"] == text[k]) == (spans[k] == "")
        assert not any(len(m[2]) >= 6 for m in SECRET.finditer(result[k]["text"]))
        assert result[k]["n_chars"] == len(result[k]["text"]) and result[k]["round_trip"]
    assert {10_001, 10_002} <= want and 20_000 not in want and len(want) < len(text) - 1


def test_stages_keep_the_columns_and_survive_edges(spark, data):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "The cat and the dog of that house", "en", "s", 33), (3, "The cat and the dog of that house", "en", "s", 33), (None, "the and of", "en", "s", 10)]
    for df in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, data).persist()
            assert df.columns == [c.split()[0] for c in kind.split(", ")], name
        assert "piece_ids" in corpus_pipeline.STAGES[-1][1](spark, df, data).columns
        assert df.where(F.col("text") == "").count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_queries_return_one_row_for_each(spark, data, name):
    out = QUERIES[name](spark, data)
    table = "pages" if name in ("op8_wrappers", "page_languages") else "conversations" if name in ("op3_chat_trees", "reply_branches") else "documents"
    rows = spark.read.parquet(f"{data}/{table}.parquet")
    if name == "reply_branches":
        assert out.count() > rows.select("conv_id").distinct().count()
        return
    n = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert out.count() == n
