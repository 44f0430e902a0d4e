"""Split archives: their parts, byte ranges and free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import suffixed, volume_base, volume_index

MAX_PARTS = 65_535
#: A name that more rows want is hot; its rows are dealt over so many parts.
HOT_ROWS, SALTS = 100_000, 64


def contiguous(files: DataFrame) -> DataFrame:
    """folder, base, index, name, size of the parts from 1 up to the first gap. files: folder, name, size."""
    parts = files.select("folder", F.regexp_replace("name", r"\.[0-9]+$", "").alias("base"), volume_index(F.col("name")).alias("index"), "name", "size").where(F.col("index").isNotNull() & (F.col("index") <= MAX_PARTS))
    ranked = parts.withColumn("at", F.row_number().over(Window.partitionBy("folder", "base").orderBy("index")))
    return ranked.where("index = at").drop("at")


def offsets(parts: DataFrame) -> DataFrame:
    """parts with begin and end, their byte range in the joined file."""
    before = Window.partitionBy("folder", "base").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("end", F.col("begin") + F.col("size"))


def joined_length(parts: DataFrame) -> DataFrame:
    return parts.groupBy("folder", "base").agg(F.sum("size").alias("length"), F.count("*").alias("n_parts"))


def locate(positions: DataFrame, parts: DataFrame) -> DataFrame:
    """folder, base, position, index, offset: the part that holds each byte. Positions and parts are merged in one order, not paired."""
    ranges = offsets(parts).where("size > 0").select("folder", "base", F.col("begin").alias("at"), F.struct("index", "begin", "end").alias("part"), F.lit(None).cast("long").alias("position"), F.lit(0).alias("which"))
    asked = positions.select("folder", "base", F.col("position").alias("at"), F.lit(None).cast(ranges.schema["part"].dataType).alias("part"), "position", F.lit(1).alias("which"))
    order = Window.partitionBy("folder", "base").orderBy("at", "which").rowsBetween(Window.unboundedPreceding, 0)
    held = ranges.unionByName(asked).withColumn("part", F.last("part", ignorenulls=True).over(order)).where("which = 1")
    return held.where("position < part.end").select("folder", "base", "position", F.col("part.index").alias("index"), (F.col("position") - F.col("part.begin")).alias("offset"))


def split_at(positions: DataFrame, volume_size: int) -> DataFrame:
    """Part (from 1) and offset of each position when a file is written in parts of one size."""
    return positions.withColumn("part", F.floor(F.col("position") / volume_size) + 1).withColumn("offset", F.col("position") % volume_size)


def with_base(names: DataFrame) -> DataFrame:
    return names.withColumn("volume_base", volume_base(F.col("name"))).withColumn("volume_index", volume_index(F.col("name")))


def _numbered(low: Column, pattern: str) -> Column:
    """The name that a numbered copy stands for, and its number, if it has this form."""
    part = lambda k: F.regexp_extract(low, pattern, k)
    return F.struct(F.concat(part(1), part(3)).alias("base"), part(2).try_cast("int").alias("k"))


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (folder, name, and any more) with free_name: the name, or the first of name_2, name_3, ... that isn't there (whatever the case).

    An existing name counts as itself, number 1, and as a copy of the name whose number it bears; the first gap in a name's
    numbers is the answer. Each side is shuffled once. Names that very many rows want are few, so they are broadcast, and
    their rows are dealt over SALTS parts by their other columns.
    """
    low = existing.select("folder", F.lower("name").alias("low"))
    own = F.struct(F.col("low").alias("base"), F.lit(1).alias("k"))
    copies = (_numbered(F.col("low"), pattern) for pattern in (r"(?s)^(.+)_([1-9][0-9]{0,8})(\.[^.]*)\z", r"(?s)^(.+)_([1-9][0-9]{0,8})()\z"))
    each = low.select("folder", "low", F.inline(F.when(F.contains("low", F.lit("_")), F.array(own, *copies)).otherwise(F.array(own))))
    each = each.where(((F.col("k") == 1) & (F.col("base") == F.col("low"))) | ((F.col("k") >= 2) & (suffixed(F.col("base"), F.col("k")) == F.col("low"))))
    ranked = each.select("folder", F.col("base").alias("low"), "k", F.dense_rank().over(Window.partitionBy("folder", "base").orderBy("k")).alias("at"))
    run = ranked.where("k = at").groupBy("folder", "low").agg(F.max("k").alias("last"))
    asked = wanted.withColumn("low", F.lower("name"))
    hot = F.broadcast(asked.groupBy("folder", "low").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS).select("folder", "low", F.lit(True).alias("hot")))
    dealt = asked.join(hot, ["folder", "low"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*wanted.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    found = run.join(hot, ["folder", "low"], "left").select("folder", "low", "last", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    free = F.when(F.col("last").isNotNull(), suffixed(F.col("name"), F.col("last") + 1)).otherwise(F.col("name"))
    return dealt.join(found, ["folder", "low", "salt"], "left").select(*wanted.columns, free.alias("free_name"))


def common_prefix(a: Column, b: Column) -> Column:
    """What two arrays of components begin with, joined."""
    n = F.least(F.size(a), F.size(b))
    same = F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k), k).otherwise(0)))).otherwise(0)
    return F.when(a == b, F.array_join(a, "/")).otherwise(F.array_join(F.slice(a, F.lit(1), same), "/"))


def common_parent(paths: DataFrame) -> DataFrame:
    """selection, common: the longest common ancestor of the paths' parents. paths: selection, components (of the parent).

    The common prefix of the least and the greatest path in component order is that of all: sums, not lists, are shuffled.
    """
    ends = paths.groupBy("selection").agg(F.min("components").alias("a"), F.max("components").alias("b"))
    return ends.select("selection", common_prefix(F.col("a"), F.col("b")).alias("common"))


def loose_matches(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (folder, name) with found: the existing name, or the only one of the folder that matches with ? as any character; else null.

    Names meet by folder and length, so that few pairs are tried.
    """
    from ..functions.paths import loosely_matches

    there = existing.select("folder", F.col("name").alias("real"), F.char_length(F.lower("name")).alias("n")).distinct()
    asked = wanted.select("folder", "name", F.char_length(F.lower("name")).alias("n")).distinct()
    met = asked.join(there, ["folder", "n"]).where(loosely_matches(F.col("name"), F.col("real")))
    by = met.groupBy("folder", "name").agg(F.bool_or(F.col("real") == F.col("name")).alias("exact"), F.count("*").alias("k"), F.min("real").alias("real"))
    found = by.select("folder", "name", F.when(F.col("exact"), F.col("name")).when((F.col("k") == 1) & F.col("name").contains("?"), F.col("real")).alias("found"))
    return wanted.join(found, ["folder", "name"], "left")
