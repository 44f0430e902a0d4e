"""Columns of a caller's that have a result's name keep their values; the result's column gets an underscore in front."""

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerstone.llm import language, near_dedup, pii, sharding, wrappers


def test_results_get_free_names(spark, data):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 7)], "doc_id long, text string, lang string, source string, shard int")
    assert sharding.shard(df, ["doc_id"], F.lit(1)).columns[-5:] == ["shard", "_shard", "shard_depth", "shard_page", "shard_oversized"]
    found = language.identify(df.withColumnRenamed("shard", "lang_found"))
    assert found.columns[-5:] == ["lang_found", "_lang_found", "lang_text", "lang_confidence", "lang_known"] and found.first()["lang_found"] == 7
    assert pii.find_pii(df.withColumnRenamed("shard", "PII")).columns[-2:] == ["PII", "_pii"]
    pages = spark.createDataFrame([(1, "http://h/", "<p>x</p>", 7)], "page_id long, url string, html string, main_text int")
    out = wrappers.extract(pages).first()
    assert (out["main_text"], out["_main_text"]) == (7, "x")
    assert near_dedup.keep_one(df.withColumnRenamed("shard", "class_id")).first()["class_id"] == 7


def test_stages_keep_columns_of_clashing_names(spark, data):
    kind = "doc_id long, text string, lang string, source string, n_chars long, lang_known boolean, n_hit long, secrets string, class_id long, piece_ids string, n_pieces int"
    df = spark.createDataFrame([(k, f"the cat and the dog of that house number {k} is on the mat with all", "en", "s", 40, False, 5, "x", 9, "y", 3) for k in range(3)], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, data).persist()
        assert df.columns == [c.split()[0] for c in kind.split(", ")] and df.count() == 3, name
    out = corpus_pipeline.STAGES[-1][1](spark, df, data)
    assert out.columns[-3:] == ["_n_pieces", "round_trip", "_piece_ids"] and out.where("piece_ids = 'y'").count() == 3
