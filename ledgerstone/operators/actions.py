"""Rules of the actions on archives: direct children, drops, destinations, labels, batch results and progress texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions import paths as P
from ..sources.archives import KNOWN, READABLE
from ..sources.sink import LEVELS

#: The code pages offered for names, by their index.
CODEPAGE_OPTIONS = (0, 65001, 949, 932, 936, 950, 1361, 50220, 54936, 1200, 1201)


def direct_children(entries: DataFrame, directory: str = "") -> DataFrame:
    """archive_path, path, index, size, kind of a directory's children by exact path, and of_size, the sum over all below it.

    Of the rows of one child, a folder without a size gives way to later rows; any other row stands.
    """
    parts = [p for p in directory.replace("\\", "/").split("/") if p not in ("", ".")]
    n = len(parts)
    below = entries.where((F.size("components") > n) & (F.slice("components", 1, n) == F.array(*map(F.lit, parts)).cast("array<string>")))
    own = F.size("components") == n + 1
    rows = below.select("archive_path", F.array_join(F.slice("components", 1, n + 1), "/").alias("path"), "index", F.when(own, F.col("size")).alias("size"), F.when(own, F.col("kind")).otherwise("Directory").alias("kind"), F.coalesce("size", F.lit(0)).alias("all"))
    weak = F.col("size").isNull() & (F.col("kind") == "Directory")
    row = F.struct("index", "size", "kind")
    by = rows.groupBy("archive_path", "path").agg(F.min_by(row, F.when(~weak, F.col("index"))).alias("first"), F.max_by(row, "index").alias("last"), F.sum("all").alias("of_size"))
    held = F.coalesce("first", "last")
    return by.select("archive_path", "path", held["index"].alias("index"), held["size"].alias("size"), held["kind"].alias("kind"), "of_size")


def drop_routes(items: DataFrame) -> DataFrame:
    """drop_id, route: create for several items or a folder, list for one archive, else create. items: drop_id, name, is_dir."""
    by = items.groupBy("drop_id").agg(F.count("*").alias("n"), F.bool_or("is_dir").alias("any_dir"), F.first("name").alias("name"))
    return by.select("drop_id", F.when((F.col("n") == 1) & ~F.col("any_dir") & P.is_archive_drop(F.col("name")), "list").otherwise("create").alias("route"))


def destination(path: Column, mode: Column) -> Column:
    """Where an archive is extracted to: 0 asks (null), 1 its folder, else a folder of its name beside it."""
    folder = P.parent(path)
    return F.when(mode == 0, None).when(mode == 1, folder).otherwise(F.concat(folder, F.lit("/"), P.directory_name(P.file_name(path))))


def create_targets(sources: DataFrame, kind: str = "Zip") -> DataFrame:
    """selection, target: a lone folder's name, a lone file's stem, or several items' common folder's name, with the extension.

    sources: selection, path, is_dir.
    """
    from .volumes import common_prefix

    rows = sources.withColumn("parent", P.components(P.parent(F.col("path"))))
    by = rows.groupBy("selection").agg(F.count("*").alias("n"), F.first("path").alias("path"), F.bool_or("is_dir").alias("is_dir"), F.min("parent").alias("a"), F.max("parent").alias("b"))
    both = by.select("selection", "n", "path", "is_dir", common_prefix(F.col("a"), F.col("b")).alias("common"))
    name = P.file_name(F.col("path"))
    stem = F.when(F.col("n") > 1, P.file_name(F.col("common"))).when(F.col("is_dir"), name).otherwise(P.stem(name))
    stem = F.when(stem == "", "archive").otherwise(stem)
    return both.select("selection", F.concat(F.when(F.col("common") == "", "").otherwise(F.concat("common", F.lit("/"))), stem, F.lit(f".{P.EXTENSIONS[kind]}")).alias("target"))


def compression_destinations(sources: DataFrame, existing: DataFrame, kind: str = "Zip") -> DataFrame:
    """selection, target, destination: create_targets(), and the first name of the target's that is still free in its folder.

    existing: folder, name.
    """
    from .volumes import free_names

    split = create_targets(sources, kind).withColumn("folder", P.parent(F.col("target"))).withColumn("name", P.file_name(F.col("target")))
    return free_names(split, existing).select("selection", "target", F.when(F.col("folder") == "", F.col("free_name")).otherwise(F.concat("folder", F.lit("/"), "free_name")).alias("destination"))


def progress_title(operation: Column, path: Column) -> Column:
    name = P.file_name(path)
    return F.concat(operation, F.lit(" - "), F.when(name == "", path).otherwise(name))


def opening_snapshots(files: DataFrame) -> DataFrame:
    """path, phase, file, bytes, total_bytes: the first report of each archive that is opened. files: path, size."""
    return files.select("path", F.lit("Opening").alias("phase"), P.file_name(F.col("path")).alias("file"), F.lit(0).cast("long").alias("bytes"), F.col("size").alias("total_bytes"))


def offered_formats(known: DataFrame) -> DataFrame:
    """Those of capabilities() that the dialog for new archives offers: ZIP and 7z where they can be written."""
    return known.where(F.upper("format").isin("ZIP", "7Z") & F.col("can_write"))


def menu_actions(items: DataFrame) -> DataFrame:
    """selection, actions: what a selection offers. items: selection, name, is_dir."""
    by = items.groupBy("selection").agg(F.count("*").alias("n"), F.every(P.is_archive(F.col("name")) & ~F.col("is_dir")).alias("archives"), F.every("is_dir").alias("folders"))
    create = F.when((F.col("n") > 1) & F.col("folders"), F.array(*map(F.lit, ("zip", "7z", "zip each", "7z each")))).otherwise(F.array(F.lit("zip"), F.lit("7z")))
    one = F.array(F.lit("extract"))
    return by.select("selection", F.when(F.col("archives") & (F.col("n") == 1), one).when(F.col("archives"), F.concat(one, create)).otherwise(create).alias("actions"))


def batch_results(items: DataFrame) -> DataFrame:
    """batch, processed, failed, elevation (failures that more rights may help), messages in order. items: batch, seq, name, error."""
    line = F.when(F.col("error").isNotNull(), F.struct("seq", F.concat("name", F.lit(": "), "error").alias("text")))
    by = items.groupBy("batch").agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count("error").alias("failed"), F.count_if(F.col("error").isNotNull() & fmt.needs_elevation(F.col("error"))).alias("elevation"), F.sort_array(F.collect_list(line)).alias("lines"))
    return by.select("batch", "processed", "failed", "elevation", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("messages"))


def progress_texts(rows: DataFrame) -> DataFrame:
    """rows of snapshots with percent, file_percent, detail, elapsed_text. Unknown totals show a dash."""
    known = F.col("total_bytes").isNotNull() | F.col("total_entries").isNotNull()
    share = F.when(known, fmt.fraction(F.col("phase"), F.col("bytes"), F.col("total_bytes"), F.col("entries"), F.col("total_entries")))
    files = F.when(F.col("total_entries").isNotNull(), F.concat(F.lit("Files "), F.least("entries", "total_entries").cast("string"), F.lit(" / "), F.col("total_entries").cast("string"))).otherwise(F.concat(F.lit("Files "), F.col("entries").cast("string")))
    return (
        rows.withColumn("percent", fmt.percent(share)).withColumn("file_percent", fmt.percent(fmt.file_fraction(F.col("file_bytes"), F.col("file_total"))))
        .withColumn("detail", F.concat(files, F.lit("  •  "), fmt.compact_bytes(F.col("bytes")), F.lit(" processed"))).withColumn("elapsed_text", F.concat(F.lit("Elapsed "), fmt.format_duration(F.col("elapsed"))))
    )


def callback_progress(events: DataFrame) -> DataFrame:
    """events (operation, seq, reported, base, total) with all_bytes, which never falls, and file_bytes."""
    own = events.withColumn("p", fmt.operation_bytes(F.col("reported"), F.col("base"), F.col("total")))
    so_far = Window.partitionBy("operation").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("all_bytes", F.max("p.all_bytes").over(so_far)).withColumn("file_bytes", F.col("p.file_bytes")).drop("p")


def codepage_option(index: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, CODEPAGE_OPTIONS)), F.greatest(index, F.lit(0)) + 1), F.lit(0))


def lha_codepage(name: Column, codepage: Column) -> Column:
    return F.when(name.rlike(r"(?i)^.+\.(lha|lzh)$") & (codepage == 0), 932).otherwise(codepage)


def capabilities(spark: SparkSession) -> DataFrame:
    """format, can_list, can_write, max_level of all containers that are known."""
    rows = [(f, True, False, None) for f in READABLE] + [(v, v in ("ZIP", "ZIP volume"), False, None) for v in KNOWN.values()] + [(P.LABELS[k], True, True, n) for k, n in LEVELS.items()]
    best: dict[str, tuple] = {}
    for name, *row in rows:
        best[name.upper()] = max(best.get(name.upper(), (False, False, -1)), (row[0], row[1], -1 if row[2] is None else row[2]))
    return spark.createDataFrame([(k, a, b, None if n < 0 else n) for k, (a, b, n) in sorted(best.items())], "format string, can_list boolean, can_write boolean, max_level int")
