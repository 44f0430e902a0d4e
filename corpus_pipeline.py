"""The corpus pipeline: documents through five stages, each an operator of ledgerstone.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

For every stage: a null text counts as empty; texts are read whole; repeated rows are judged alike, of which near duplicates keep
one; an empty table gives an empty one; extra columns stay, whatever their names, as what an operator adds gets a free name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm.common import forget, fresh, model_path, scratch, table, written
from ledgerstone.llm.decontaminate import contamination
from ledgerstone.llm.language import identify
from ledgerstone.llm.near_dedup import keep_one
from ledgerstone.llm.pieces import encode_pieces
from ledgerstone.llm.queries import PIECE_MODEL
from ledgerstone.llm.secrets import redact_secrets, scan_secrets


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go; so do those without letters."""
    return identify(docs).where(F.col(fresh(docs, "lang_known"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least doc_id stays."""
    return keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where(F.col(fresh(docs, "n_hit")) == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; n_chars follows. All documents stay."""
    spans = fresh(docs, "secrets")
    out = redact_secrets(scan_secrets(docs, out=spans), spans=spans)
    return out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, the number of pieces, and whether decoding gives the text again."""
    ids, decoded = fresh(docs, "piece_ids"), fresh(docs, "decoded")
    out = encode_pieces(docs, model_path(PIECE_MODEL), ids=ids, decoded=decoded)
    return out.select(*docs.columns, F.size(ids).cast("long").alias(fresh(docs, "n_pieces")), (F.col(decoded) == F.coalesce("text", F.lit(""))).alias(fresh(docs, "round_trip")), ids)


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("pieces", encoded),
]

#: Shortest paths and weighted samples aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as made:
            out = written(stage(spark, docs, sf_dir))
        forget(*(t for t in made if t is not out))
        docs = out
    return docs
