"""Tables of the driver's data as entry relations, so that the operators can be run on them and compared with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(df: DataFrame, archive: Column, index: Column, path: Column, size: Column, packed: Column, modified: Column, kind: Column, encrypted: Column | None = None) -> DataFrame:
    return df.select(
        archive.alias("archive_path"), index.cast("long").alias("index"), path.alias("path"), components(path).alias("components"), path.alias("display_path"), size.cast("long").alias("size"),
        packed.cast("long").alias("compressed_size"), modified.cast("long").alias("modified_unix_seconds"), kind.alias("kind"), (F.lit(False) if encrypted is None else encrypted).alias("encrypted"),
    )



def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without their scheme; those that end in / are folders."""
    df = _table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return _entries(df, F.concat(F.lit("pages-"), (F.col("page_id") % 4).cast("string")), F.col("page_id"), path, F.octet_length("html"), F.lit(None), F.lit(None), F.when(path.endswith("/"), "Directory").otherwise("File"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """priority/status/order-KEY.EXT, and every 97th order a folder of its own."""
    df = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, ("zip", "tar.gz", "7z.001", "txt", "exe"))), (key % 5).cast("int") + 1)
    folder = key % 97 == 0
    path = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.when(folder, F.concat(F.lit("Batch-"), (key % 7).cast("string"))).otherwise(F.concat(F.lit("order-"), key.cast("string"), F.lit("."), ext)))
    size = F.when(key % 11 != 0, F.floor("o_totalprice"))
    modified = F.when(key % 13 != 0, seconds("o_orderdate"))
    return _entries(df, F.concat(F.lit("orders-"), (key % 8).cast("string")), key, path, size, F.floor(size / 2), modified, F.when(folder, "Directory").otherwise("File"), key % 17 == 0)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    path = F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".bin"))
    return _entries(df, F.concat(F.lit("lines-"), (F.col("l_orderkey") % 64).cast("string")), F.col("l_orderkey") * 10 + F.col("l_linenumber"), path, F.col("l_quantity"), F.floor(F.col("l_quantity") / 2), seconds("l_shipdate"), F.lit("File"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _entries(df, F.concat(F.lit("docs-"), F.col("source")), F.col("doc_id"), path, F.octet_length("text"), F.lit(None), F.lit(None), F.lit("File"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in mixed case, with duplicates but for case."""
    df = _table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return _entries(df, F.concat(F.lit("parts-"), (key % 4).cast("string")), key, F.concat(F.col("p_brand"), F.lit("/"), name), F.col("p_size"), F.lit(None), F.lit(None), F.lit("File"))


def volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as split archives: folder, name, size; turn t is part t + 1; every third one has a gap before turn 5."""
    df = _table(spark, sf_dir, "conversations")
    n = F.col("turn") + 1 + F.when((F.col("turn") >= 5) & (F.col("conv_id") % 3 == 0), 1).otherwise(0)
    return df.select((F.col("conv_id") % 10).cast("string").alias("folder"), F.concat(F.lit("chat-"), F.col("conv_id").cast("string"), F.lit(".zip."), F.lpad(n.cast("string"), 3, "0")).alias("name"), F.char_length("text").cast("long").alias("size"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """operation (user), worker (event type), seq, ms, bytes, file."""
    df = _table(spark, sf_dir, "events")
    return df.select(F.col("user_id").alias("operation"), F.col("event_type").alias("worker"), F.col("event_id").alias("seq"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ms"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), F.concat(F.lit("file-"), (F.col("event_id") % 50).cast("string")).alias("file"))
