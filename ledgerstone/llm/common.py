"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..workers import BATCH_BYTES, bounded_batches, give_back, values  # noqa: F401

#: Bytes of a side that may be broadcast; above it the join shuffles. A row counts with WIDTH bytes beside its texts and arrays.
BROADCAST_BYTES, WIDTH = 16 << 20, 48
#: A key is hot if it has more than HOT_ROWS rows and more than one HOT_SHARE-th of all; so there are fewer than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 500, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session that names none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage, outlives lost executors and has true sizes."""
    path = f"{shared_dir(df.sparkSession)}/ledgerstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that written() makes within, so that all but the result can be deleted once the result is written."""
    made: list[DataFrame] = []
    mark = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(mark)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made, and that nothing reads any more."""
    for df in tables:
        with suppress(AttributeError):  # it wasn't made by written()
            sc, path = df.sparkSession.sparkContext, df._written_at
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """written(), and the number of rows, which is counted while writing."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get.get("n") or 0


def hinted(df: DataFrame, n: int, width: int = WIDTH) -> DataFrame:
    """A table of n rows of at most `width` bytes, to be broadcast if it is within BROADCAST_BYTES, else to be shuffled and merged."""
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df.hint("merge")


def size_of(df: DataFrame) -> int:
    """The bytes that df takes in memory, about: WIDTH for a row, and all its texts and arrays. df should be cheap to read."""
    parts = [F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    return df.agg(F.coalesce(F.sum(sum(parts, F.lit(WIDTH))), F.lit(0))).first()[0]


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if its bytes are within BROADCAST_BYTES, else to be shuffled and merged. df should be cheap to read.

    Spark's own choice goes by the size of files, which says little about rows in memory.
    """
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df.hint("merge")


def spread_join(many: DataFrame, one: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """many (n rows) joined with one (narrow, unique by key, written), whose column `size` counts the rows of many with its key.

    Rows of hot keys meet a broadcast of those keys, which are fewer than HOT_SHARE; all others shuffle. So no task gets a hot key.
    """
    hot = F.col(size) > max(HOT_ROWS, n // HOT_SHARE)
    few = one.where(hot).drop(size)
    rest = many.join(F.broadcast(few.select(key)), key, "left_anti").join(one.where(~hot).drop(size), key)
    return many.join(F.broadcast(few), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str | Column) -> Column:
    """A text column where null counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever its case: the name with as many underscores in front as it takes.

    Operators name their results so: a column of the caller's that has the name already stays as it is.
    """
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def model_path(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def span_digest(df: DataFrame, spans: str, kinds: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the count of each kind, base_sha256 over those kinds, all spans as one string."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    held = F.filter(spans, lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select("doc_id", *map(count, kinds), F.sha2(F.array_join(F.transform(held, name), ","), 256).alias("base_sha256"), F.array_join(F.transform(spans, name), ",").alias("spans"), *more)
