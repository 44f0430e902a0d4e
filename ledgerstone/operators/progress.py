"""Progress over batches: merges, throttling, and the place of a byte within a list of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monotone(events: DataFrame) -> DataFrame:
    """events (operation, seq, bytes) with bytes_so_far, the running maximum."""
    return events.withColumn("bytes_so_far", F.max("bytes").over(Window.partitionBy("operation").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def parallel_merge(events: DataFrame) -> DataFrame:
    """Of each operation: the sum of its workers' latest counters and the last event's file. events: operation, worker, seq, bytes, file."""
    by_worker = events.groupBy("operation", "worker").agg(F.max("bytes").alias("bytes"), F.max("seq").alias("seq"), F.max_by("file", "seq").alias("file"))
    return by_worker.groupBy("operation").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("workers"), F.max_by("file", "seq").alias("file"))


def locate_bytes(done: DataFrame, files: DataFrame) -> DataFrame:
    """operation, done, file_index, file_bytes: which file byte number `done` lies in.

    A file's last byte is its own, empty files hold none, and beyond the end it is all of the last file. files: operation,
    index, size. Both sides are merged in one order, not paired.
    """
    upto = Window.partitionBy("operation").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    ends = files.where("size > 0").withColumn("end", F.sum("size").over(upto))
    last = ends.groupBy("operation").agg(F.max("end").alias("all_bytes"), F.max_by(F.struct("index", "size", "end"), "index").alias("last"))
    marks = ends.select("operation", F.col("end").alias("at"), F.struct("index", "size", "end").alias("file"), F.lit(None).cast("long").alias("done"), F.lit(1).alias("which"))
    asked = done.select("operation", F.col("done").alias("at"), F.lit(None).cast(marks.schema["file"].dataType).alias("file"), "done", F.lit(0).alias("which"))
    after = Window.partitionBy("operation").orderBy("at", "which").rowsBetween(0, Window.unboundedFollowing)
    held = marks.unionByName(asked).withColumn("file", F.first("file", ignorenulls=True).over(after)).where("which = 0").join(last, "operation")
    file = F.coalesce("file", "last")
    return held.select("operation", "done", file["index"].alias("file_index"), F.least(file["size"], F.col("done") - (file["end"] - file["size"])).alias("file_bytes"))


def completed_files(done: DataFrame, files: DataFrame) -> DataFrame:
    """operation, done, n_completed: files whose bytes are all done; an empty one once its place is reached, and none after the first unfinished.

    files: operation, index, size, is_file. done: operation, done.
    """
    upto = Window.partitionBy("operation").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    ends = files.where("is_file").withColumn("end", F.sum("size").over(upto)).withColumn("low", F.when(F.col("size") == 0, F.greatest("end", F.lit(1))).otherwise(F.col("end")))
    marks = ends.select("operation", F.col("low").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("done"), F.lit(0).alias("which"))
    asked = done.distinct().select("operation", F.col("done").alias("at"), F.lit(0).alias("one"), "done", F.lit(1).alias("which"))
    so_far = Window.partitionBy("operation").orderBy("at", "which").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("n_completed", F.sum("one").over(so_far)).where("which = 1").select("operation", "done", "n_completed")
