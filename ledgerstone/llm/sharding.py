"""Sharding by extendible hashing, with DataFrame functions only.

A shard is a prefix of the bits of a row's key hash. The directory has depth 0 at first; a bucket over the byte limit splits
on the next bit, others stay, until every bucket fits. Bytes only shrink when a bucket splits, so the bucket of a row is the
shortest prefix of its hash whose bytes fit. They are found in two passes over narrow rows (hash and bytes): sums of fine
buckets and of all their prefixes; then the same below those fine buckets that are still too large, if there are any.

Rows of one hash can't be split by it. Their bucket, at BITS bits, is continued on overflow pages of as many rows as surely
fit. A row that is larger than the limit has its page to itself and is marked.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, fresh, hinted, whole, written

BITS = 60
#: A parameter: bytes of text in a shard at most. FINER: bits beyond the expected depth in the first pass.
BYTE_LIMIT, FINER = 1 << 20, 2


def key_hash(*keys: str | Column) -> Column:
    """The first BITS bits of the keys' SHA-256, as a long. Null keys count as the empty text."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, BITS // 4), 16, 10).cast("long")


def prefix(hashed: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", hashed, F.lit(BITS) - depth)


def _shortest(fine: DataFrame, at: int, low: int, limit: int) -> DataFrame:
    """fine: bucket (prefix of `at` bits), bytes. bucket, depth: the least depth in low..at whose prefix fits; null if none does."""
    climbed = fine.select("bucket", "bytes", F.explode(F.sequence(F.lit(low), F.lit(at))).alias("depth"))
    climbed = climbed.withColumn("above", F.call_function("shiftright", F.col("bucket"), F.lit(at) - F.col("depth")))
    fits = climbed.groupBy("depth", "above").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit).select("depth", "above")
    return climbed.join(fits, ["depth", "above"]).groupBy("bucket").agg(F.min("depth").alias("depth"))


def shard(df: DataFrame, keys: list[str], size: Column, limit: int = BYTE_LIMIT) -> DataFrame:
    """df with shard (its bits as text, '' for the whole table), shard_depth, shard_page (0 but for rows of one hash that
    don't fit together) and shard_oversized (the row alone is over the limit).

    keys: the columns that are hashed; rows of equal keys are kept together as far as the limit allows. size: a row's bytes,
    null counts as 0. Null and empty keys are one key; repeated rows and ties of hashes share a shard; other columns stay, also of
    these names (the new ones are then named by fresh()). Every page of a shard fits the limit unless it is one oversized row. An empty table stays empty.
    """
    names = {k: fresh(df, f"_shard_{k}") for k in ("hash", "bytes", "fine", "bucket", "depth", "deep", "pages", "page")}
    rows = df.withColumn(names["hash"], key_hash(*keys)).withColumn(names["bytes"], F.coalesce(size.cast("long"), F.lit(0)))
    narrow = rows.select(F.col(names["hash"]).alias("h"), F.col(names["bytes"]).alias("b"))
    total = narrow.agg(F.sum("b")).first()[0] or 0
    at = min(BITS, max(0, ceil(log2(max(1, total / limit)))) + FINER)
    fine = written(narrow.groupBy(prefix(F.col("h"), at).alias("bucket")).agg(F.sum("b").alias("bytes")))
    first, n_first = counted(_shortest(fine, at, 0, limit))
    large = fine.join(first, "bucket", "left_anti")
    out = rows.withColumn(names["fine"], prefix(F.col(names["hash"]), at))
    out = out.join(hinted(first.toDF(names["bucket"], names["depth"]), n_first), F.col(names["fine"]) == F.col(names["bucket"]), "left").drop(names["bucket"])
    if at < BITS and not large.isEmpty():
        held = narrow.withColumn("bucket", prefix(F.col("h"), at)).join(large.select("bucket"), "bucket", "left_semi")
        each = written(held.groupBy(F.col("h").alias("bucket")).agg(F.sum("b").alias("bytes"), F.max("b").alias("most")))
        second = _shortest(each, BITS, at + 1, limit)
        deep, n_deep = counted(each.join(second, "bucket", "left").select(F.col("bucket").alias(names["bucket"]), F.coalesce("depth", F.lit(BITS)).alias(names["deep"]), F.when(F.col("depth").isNull(), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))).alias(names["pages"])))
        out = out.join(hinted(deep, n_deep), F.col(names["hash"]) == F.col(names["bucket"]), "left").drop(names["bucket"])
        out = out.withColumn(names["depth"], F.coalesce(names["depth"], names["deep"])).drop(names["deep"])
        full = F.col(names["pages"]).isNotNull()
        if deep.where(full).isEmpty():
            out = out.withColumn(names["page"], F.lit(0).cast("long"))
        else:
            out = out.where(~full).withColumn(names["page"], F.lit(0).cast("long")).unionByName(_paged(out.where(full), names["hash"], names["pages"], names["page"]))
        out = out.drop(names["pages"])
    else:
        out = out.withColumn(names["page"], F.lit(0).cast("long"))
    depth = F.coalesce(F.col(names["depth"]), F.lit(BITS))
    bits = F.lpad(F.conv(F.col(names["hash"]).cast("string"), 10, 2), BITS, "0")
    return out.select(*df.columns, F.substr(bits, F.lit(1), depth).alias(fresh(df, "shard")), depth.cast("int").alias(fresh(df, "shard_depth")), F.col(names["page"]).alias(fresh(df, "shard_page")), (F.col(names["bytes"]) > limit).alias(fresh(df, "shard_oversized")))


def _paged(df: DataFrame, key: str, per_page: str, page: str) -> DataFrame:
    """The column `page` for rows of one hash: their running number over its rows a page. Rows are numbered within each task, and
    tasks by their sums, so that a hot key is never in one task."""
    mark, part, local, before = (fresh(df, x) for x in ("_mark", "_part", "_local", "_before"))
    numbered = written(df.withColumn(mark, F.monotonically_increasing_id()).withColumn(part, F.shiftright(F.col(mark), 33)))
    own = Window.partitionBy(key, part).orderBy(mark)  # the rows of one input split
    tasks = numbered.groupBy(key, part).agg(F.count("*").alias(before))
    tasks = tasks.withColumn(before, F.sum(before).over(Window.partitionBy(key).orderBy(part)) - F.col(before))
    out = numbered.withColumn(local, F.row_number().over(own) - 1).join(tasks, [key, part])
    return out.withColumn(page, F.floor((F.col(before) + F.col(local)) / F.col(per_page))).drop(mark, part, local, before)


def directory(sharded: DataFrame) -> DataFrame:
    """The directory of 2**global depth entries: slot (its bits as text), shard, n_rows (of all the shard's pages).

    Rows of one hash that outgrow a shard drive the depth to BITS; such a directory can't be listed: ValueError. The shards
    themselves are then the directory, as prefixes.
    """
    shards = written(sharded.groupBy("shard", "shard_depth").agg(F.count("*").alias("n_rows")))
    top = shards.agg(F.coalesce(F.max("shard_depth"), F.lit(0))).first()[0]
    if top > 30:
        raise ValueError("the directory is too deep to be listed")
    each = shards.withColumn("global_depth", F.lit(top))
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("global_depth") - F.col("shard_depth")) - 1
    ends = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("end")
    bits = F.lpad(F.conv(F.col("end").cast("string"), 10, 2), BITS, "0")
    return each.select("shard", "n_rows", "global_depth", "shard_depth", ends).select(F.concat("shard", F.substr(bits, F.lit(BITS + 1) - (F.col("global_depth") - F.col("shard_depth")), F.col("global_depth") - F.col("shard_depth"))).alias("slot"), "shard", "n_rows")


def shard_digest(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"))
    return shard(rows, ["doc_id"], F.col("n_bytes"))
