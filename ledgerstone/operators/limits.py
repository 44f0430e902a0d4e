"""Totals, limits, duplicates and conflicts of listings and extraction plans."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.paths import components, fold, unsafe_reason

U64_MAX = Decimal((1 << 64) - 1)


def totals(entries: DataFrame) -> DataFrame:
    """Of each archive: entries, files, bytes (saturating), UTF-16 path bytes, the largest entry, and whether a listing's limits hold (inclusive)."""
    size = F.col("size").cast("decimal(20,0)")
    out = entries.groupBy("archive_path").agg(
        F.count("*").alias("n_entries"), F.count_if(F.col("kind") == "File").alias("n_files"), F.least(F.coalesce(F.sum(size), F.lit(0)), F.lit(U64_MAX)).cast("decimal(20,0)").alias("total_size"),
        F.sum(F.octet_length(F.encode("display_path", "UTF-16LE"))).alias("path_bytes"), F.max("size").alias("largest"),
    )
    broken = F.when(F.col("n_entries") > schema.MAX_ENTRIES, "entries").when(F.col("path_bytes") > schema.MAX_PATH_BYTES, "path bytes").when(F.col("total_size") > schema.MAX_LISTED_BYTES, "bytes")
    return out.withColumn("limit_broken", broken)


def running(entries: DataFrame, max_entries: int = schema.MAX_ENTRIES, max_bytes: int = schema.MAX_EXTRACT_BYTES, max_file: int = schema.MAX_FILE_BYTES) -> DataFrame:
    """entries with entries_so_far, bytes_so_far and limit_broken (null, or the first limit that the row breaks; values at a limit hold)."""
    so_far = Window.partitionBy("archive_path").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    out = entries.withColumn("entries_so_far", F.count("*").over(so_far)).withColumn("bytes_so_far", F.sum(F.coalesce("size", F.lit(0))).over(so_far))
    return out.withColumn("limit_broken", F.when(F.col("entries_so_far") > max_entries, "entries").when(F.col("size") > max_file, "file").when(F.col("bytes_so_far") > max_bytes, "bytes"))


def first_violations(entries: DataFrame, **limits: int) -> DataFrame:
    """archive_path, index, limit_broken of the first row of each archive that breaks a limit."""
    return running(entries, **limits).where("limit_broken is not null").groupBy("archive_path").agg(F.min("index").alias("index"), F.min_by("limit_broken", "index").alias("limit_broken"))


def duplicate_names(entries: DataFrame) -> DataFrame:
    """archive_path, name (Unicode lower case), n of names that stand more than once."""
    return entries.groupBy("archive_path", F.lower("path").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def _conflict_paths(entries: DataFrame) -> DataFrame:
    return entries.select("archive_path", "index", fold(F.array_join(components(F.col("path")), "/")).alias("low"), (F.col("kind") == "Directory").alias("is_dir"))


def adjacent_conflicts(entries: DataFrame) -> DataFrame:
    """archive_path, conflict: whether two neighbours in byte order are equal, or a file is an ancestor of the next.

    A path that sorts between a file and what lies below it hides the conflict; conflicts() doesn't miss these.
    """
    order = Window.partitionBy("archive_path").orderBy("low", F.desc("is_dir"), "index")
    rows = _conflict_paths(entries).withColumn("next", F.lead("low").over(order))
    hit = (F.col("low") == F.col("next")) | (~F.col("is_dir") & F.col("next").startswith(F.concat("low", F.lit("/"))))
    return rows.groupBy("archive_path").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("conflict"))


def conflicts(entries: DataFrame) -> DataFrame:
    """archive_path, path, n: equal paths, and files that are ancestors of n other entries. Ancestors meet by equality."""
    rows = _conflict_paths(entries)
    parts = F.split("low", "/")
    above = rows.select("archive_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("low"), F.col("low").alias("of"))
    met = above.groupBy("archive_path", "low").agg(F.count_if(F.col("of") != F.col("low")).alias("below"), F.count_if(F.col("of") == F.col("low")).alias("same"))
    files = rows.groupBy("archive_path", "low").agg(F.bool_or(~F.col("is_dir")).alias("file"))
    found = met.join(files, ["archive_path", "low"])
    return found.select("archive_path", F.col("low").alias("path"), (F.col("same") - 1 + F.when(F.col("file"), F.col("below")).otherwise(0)).alias("n")).where("n > 0")


def encrypted(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """Entries count as encrypted if their archive says so as a whole (archives: archive_path, archive_encrypted)."""
    return entries.join(archives.select("archive_path", "archive_encrypted"), "archive_path", "left").withColumn("encrypted", F.col("encrypted") | F.coalesce("archive_encrypted", F.lit(False))).drop("archive_encrypted")


def zipped_names(entries: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    """entries with names of another scan (archive_path, index, name) by place; archives whose counts differ keep theirs or, if
    strict (as for LZH, where the other scan alone has the paths), make the query fail."""
    left, right = (d.groupBy("archive_path").agg(F.count("*").alias(n)) for d, n in ((entries, "a"), (names, "b")))
    both = left.join(right, "archive_path", "left").fillna(0, ["b"])
    if strict:
        both = both.withColumn("a", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.format_string("%s: %d entries and %d names", "archive_path", "a", "b"))))
    same = both.where("a = b").select("archive_path")
    new = names.join(same, "archive_path", "left_semi").select("archive_path", "index", F.col("name").alias("new_name"))
    out = entries.join(new, ["archive_path", "index"], "left")
    return out.withColumn("path", F.coalesce("new_name", "path")).withColumn("display_path", F.coalesce("new_name", "display_path")).withColumn("components", components(F.col("path"))).select(*entries.columns)


def extraction_plan(entries: DataFrame, existing: DataFrame, policy: str = "Ask") -> DataFrame:
    """Each entry's action: create folder, write, overwrite, skip, ask, error. existing: archive_path, path, is_dir of the destination.

    An unsafe path is an error for its whole archive, selected or not. policy: OverwriteAll, SkipAll or Ask.
    """
    if policy not in ("OverwriteAll", "SkipAll", "Ask"):
        raise ValueError(f"no such policy: {policy}")
    rows = entries.withColumn("unsafe", unsafe_reason(F.col("path"))).withColumn("low", fold(F.array_join("components", "/")))
    bad = rows.groupBy("archive_path").agg(F.bool_or(F.col("unsafe").isNotNull()).alias("archive_unsafe"))
    there = existing.select("archive_path", fold(F.array_join(components(F.col("path")), "/")).alias("low"), F.col("is_dir").alias("there_dir")).dropDuplicates(["archive_path", "low"])
    rows = rows.join(bad, "archive_path").join(there, ["archive_path", "low"], "left")
    clash = {"OverwriteAll": "overwrite", "SkipAll": "skip", "Ask": "ask"}[policy]
    is_dir = F.col("kind") == "Directory"
    action = (
        F.when(F.col("archive_unsafe"), "error").when(~F.col("kind").isin("File", "Directory"), "error").when(is_dir & F.col("there_dir"), "keep folder").when(is_dir & F.col("there_dir").isNull(), "create folder")
        .when(F.col("there_dir").isNull(), "write").when(F.col("there_dir"), "error").otherwise(clash)
    )
    return rows.select("archive_path", "index", "path", "unsafe", action.alias("action"))


def merged_summaries(parts: DataFrame) -> DataFrame:
    """Workers' summaries (archive_path, worker, entries, bytes, skipped, warning) as one of each archive; the first worker's warning stands."""
    return parts.groupBy("archive_path").agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), F.sum("skipped").alias("skipped"), F.min_by("warning", F.when(F.col("warning").isNotNull(), F.col("worker"))).alias("warning"))


def compared_files(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """name, state (same, changed, missing, extra) of files by their digests (name, digest)."""
    both = declared.select("name", F.col("digest").alias("a")).join(actual.select("name", F.col("digest").alias("b")), "name", "full")
    return both.select("name", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))
