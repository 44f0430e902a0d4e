"""The corpus operators' queries over the whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_digest, reply_branches
from .common import model_path, table
from .decontaminate import contamination_digest
from .language import language_digest, page_languages
from .matroska import media_digest
from .near_dedup import near_duplicates
from .pieces import piece_digest
from .pii import pii_digest
from .secrets import secret_digest
from .sharding import shard_digest
from .wrappers import page_digest

#: A parameter: the public vocabulary that op5 encodes with.
PIECE_MODEL = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": lambda spark, d: shard_digest(table(spark, d, "documents")),
    "op2_matroska": lambda spark, d: media_digest(table(spark, d, "documents")),
    "op3_chat_trees": lambda spark, d: chat_digest(table(spark, d, "conversations")),
    "op4_decontamination": lambda spark, d: contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_sentencepiece": lambda spark, d: piece_digest(table(spark, d, "documents"), model_path(PIECE_MODEL)),
    "op6_pii": lambda spark, d: pii_digest(table(spark, d, "documents")),
    "op7_secrets": lambda spark, d: secret_digest(table(spark, d, "documents")),
    "op8_wrappers": lambda spark, d: page_digest(table(spark, d, "pages")),
    "op9_near_duplicates": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op10_language": lambda spark, d: language_digest(table(spark, d, "documents")),
    "reply_branches": lambda spark, d: reply_branches(table(spark, d, "conversations")),
    "page_languages": lambda spark, d: page_languages(table(spark, d, "pages")),
}
