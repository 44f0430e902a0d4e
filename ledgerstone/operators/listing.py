"""Browsing and selecting: subtrees, folder views with inferred folders, sorts and selections, over many archives at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import format_size, format_timestamp
from ..functions.paths import components, fold, is_executable

#: Sort columns of a view; ARCHIVE_ORDER keeps the archive's own order.
NAME, SIZE, PACKED, MODIFIED, PATH, ARCHIVE_ORDER = "name", "size", "packed", "modified", "path", "archive"
SELECTIONS_BROADCAST = 1_000_000


def _parts(path: str | Sequence[str]) -> list[str]:
    return [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")] if isinstance(path, str) else list(path)


def _prefix(parts: list[str]) -> Column:
    return F.array(*map(F.lit, parts)).cast("array<string>")


def restrict(entries: DataFrame, directory: str) -> DataFrame:
    """Entries at or below a directory, with their index counted anew within each archive; no directory keeps all as they are."""
    parts = _parts(directory)
    if not parts:
        return entries
    kept = entries.where(F.slice("components", 1, len(parts)) == _prefix(parts))
    return kept.withColumn("index", (F.row_number().over(Window.partitionBy("archive_path").orderBy("index")) - 1).cast("long"))


def selected(entries: DataFrame, selection: DataFrame | None) -> DataFrame:
    """Entries at or below any selected path (archive_path, path); None selects all.

    Each entry's ancestors are matched by equality: no pair of an entry and a selection is tried that doesn't match.
    """
    if selection is None:
        return entries
    wanted = selection.select("archive_path", F.array_join(components(F.col("path")), "/").alias("_at")).distinct()
    n = F.size("components")
    above = F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice("components", F.lit(1), k), "/"))
    own = entries.select("archive_path", "index", F.explode(above).alias("_at"))
    if wanted.limit(SELECTIONS_BROADCAST + 1).count() <= SELECTIONS_BROADCAST:
        wanted = F.broadcast(wanted)
    hits = own.join(wanted, ["archive_path", "_at"], "left_semi").select("archive_path", "index").distinct()
    return entries.join(hits, ["archive_path", "index"], "left_semi")


def hints(entries: DataFrame, selection: DataFrame | None) -> DataFrame:
    """archive_path, n_entries, n_bytes of what is selected."""
    return selected(entries, selection).groupBy("archive_path").agg(F.count("*").alias("n_entries"), F.sum(F.coalesce("size", F.lit(0))).alias("n_bytes"))


def folder_view(entries: DataFrame, directory: str = "") -> DataFrame:
    """Direct children of a directory: archive_path, source_index, name, relative_path, is_folder, first_index.

    Folders are inferred from what lies below them and are one whatever the case of A-Z: the first name stands. A folder's source
    is its own entry: the first row, if that is one, else the first later one of exactly this name. Files are never merged.
    """
    parts = _parts(directory)
    depth = len(parts)
    rows = entries.where((F.size("components") > depth) & (F.slice("components", 1, depth) == _prefix(parts)))
    rows = rows.select("archive_path", "index", F.element_at("components", depth + 1).alias("name"), (F.size("components") > depth + 1).alias("below"), "kind")
    rows = rows.withColumn("is_folder", F.col("below") | (F.col("kind") == "Directory"))
    files = rows.where(~F.col("is_folder")).select("archive_path", F.col("index").alias("source_index"), "name", "is_folder", F.col("index").alias("first_index"))
    # by exact name first, then over names: both sums are partial before they shuffle
    exact = rows.where("is_folder").groupBy("archive_path", "name").agg(F.min("index").alias("first"), F.min_by("below", "index").alias("inferred"), F.min(F.when(~F.col("below"), F.col("index"))).alias("own"))
    folders = exact.groupBy("archive_path", fold(F.col("name")).alias("key")).agg(F.min_by(F.struct("name", "first", "inferred", "own"), "first").alias("f"))
    source = F.when(~F.col("f.inferred"), F.col("f.first")).otherwise(F.col("f.own"))
    folders = folders.select("archive_path", source.alias("source_index"), F.col("f.name").alias("name"), F.lit(True).alias("is_folder"), F.col("f.first").alias("first_index"))
    base = "".join(f"{p}/" for p in parts)
    return folders.unionByName(files).withColumn("relative_path", F.concat(F.lit(base), F.col("name")))


def sorted_view(view: DataFrame, entries: DataFrame, column: str = NAME, ascending: bool = True) -> DataFrame:
    """The view with rn, each archive's order from 1: folders first both ways, then by column and name; null sizes and times least."""
    own = entries.select("archive_path", F.col("index").alias("source_index"), "size", "compressed_size", "modified_unix_seconds", "display_path")
    rows = view.join(own, ["archive_path", "source_index"], "left")
    keys = {SIZE: F.col("size"), PACKED: F.col("compressed_size"), MODIFIED: F.col("modified_unix_seconds"), PATH: fold(F.coalesce("display_path", "relative_path"))}
    key = keys.get(column, fold(F.col("name")))
    if column == ARCHIVE_ORDER:
        order = [F.desc("is_folder"), F.asc("first_index")]
    else:
        way = (lambda c: c.asc_nulls_first()) if ascending else (lambda c: c.desc_nulls_last())
        order = [F.desc("is_folder"), way(key), way(F.col("name")), F.asc("first_index")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("archive_path").orderBy(*order)).cast("long"))


def presented(sorted_rows: DataFrame, selection: DataFrame | None = None, utc: bool = False) -> DataFrame:
    """What a table shows of each row; folders without an entry of their own show blanks and their path."""
    out = sorted_rows.select(
        "archive_path", "rn", "is_folder", is_executable(F.col("name")).alias("is_executable"), "name", format_size(F.col("size")).alias("size_text"), format_size(F.col("compressed_size")).alias("packed_text"),
        format_timestamp(F.col("modified_unix_seconds"), utc).alias("modified_text"), F.coalesce("display_path", "relative_path").alias("path_text"), "relative_path",
    )
    if selection is None:
        return out.withColumn("is_selected", F.lit(False))
    marks = selection.select("archive_path", F.col("path").alias("relative_path"), F.lit(True).alias("is_selected")).distinct()
    return out.join(marks, ["archive_path", "relative_path"], "left").withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))


def activated(view: DataFrame) -> DataFrame:
    """The folder that a row opens; null for files."""
    return view.withColumn("opens", F.when(F.col("is_folder"), F.col("relative_path")))


def next_sort(column: str, ascending: bool, clicked: str) -> tuple[str, bool]:
    return (column, not ascending) if clicked == column else (clicked, True)


def range_selection(sorted_rows: DataFrame, anchor: int, target: int) -> DataFrame:
    """The rows between two places, both included, of each archive's view."""
    return sorted_rows.where(F.col("rn").between(min(anchor, target), max(anchor, target))).select("archive_path", F.col("relative_path").alias("path"))


def toggled(selection: DataFrame, rows: DataFrame) -> DataFrame:
    """The symmetric difference of a selection and other paths."""
    both = selection.select("archive_path", "path").distinct().unionAll(rows.select("archive_path", "path").distinct())
    return both.groupBy("archive_path", "path").count().where("count = 1").select("archive_path", "path")


def context_selection(selection: DataFrame, row: DataFrame) -> DataFrame:
    """The selection if it holds the row, else the row alone; by archive."""
    held = selection.join(row, ["archive_path", "path"], "left_semi").select("archive_path").distinct()
    return selection.join(held, "archive_path", "left_semi").unionByName(row.select("archive_path", "path").join(held, "archive_path", "left_anti"))


def all_visible(selection: DataFrame, view: DataFrame) -> DataFrame:
    return selection.select("archive_path", "path").unionAll(view.select("archive_path", "relative_path")).distinct()


def selection_state(view: DataFrame, selection: DataFrame) -> DataFrame:
    """archive_path, n_selected, state: 0 none, 1 some, 2 all of the view's rows."""
    marks = selection.select("archive_path", F.col("path").alias("relative_path"), F.lit(1).alias("on")).distinct()
    by = view.join(marks, ["archive_path", "relative_path"], "left").groupBy("archive_path").agg(F.count("on").alias("n_selected"), F.count("*").alias("n"))
    return by.select("archive_path", "n_selected", F.when(F.col("n_selected") == 0, 0).when(F.col("n_selected") == F.col("n"), 2).otherwise(1).alias("state"))


def root_names(entries: DataFrame) -> DataFrame:
    """archive_path, n_roots: distinct first components, whatever the case of A-Z."""
    return entries.groupBy("archive_path").agg(F.countDistinct(fold(F.get("components", F.lit(0)))).alias("n_roots"))
