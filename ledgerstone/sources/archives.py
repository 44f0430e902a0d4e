"""Archives as relations: `archives` and `entries` over any path that Spark can read, and integrity tests.

Files come in through Spark's binaryFile reader, so any store will do; listing, name decoding and testing are Arrow functions
over single files. Read natively: ZIP (and split ZIP, joined first), TAR, TAR in xz, bz2 and zstd, and single files in gzip,
bz2, xz and zstd; .tar.gz and .tgz list as the one TAR they hold. Others are known by their signature and give an
UnsupportedFormat error row.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import encoding
from ..functions.paths import components, container_of, filter_of, payload_name, volume_base, volume_index
from ..workers import bounded_batches, give_back
from .zip_names import ENCRYPTED_FLAG, UTF8_FLAG, ZipRecord, records

READABLE = ("zip", "tar", "tar.bz2", "tar.xz", "tar.zst", "gzip", "bzip2", "xz", "zstd")
KNOWN = {"SevenZip": "7z", "SevenZipVolume": "7z volume", "Zip": "ZIP", "ZipVolume": "ZIP volume", "Rar4": "RAR", "Rar5": "RAR5", "Lzh": "LZH", "Iso": "ISO"}
BLOCK = 1 << 20
LISTED = 2_000  # entries that are Python objects at once, but for one long archive
ENTRY_ITEM = "struct<index:long,path:string,size:long,compressed_size:long,modified_unix_seconds:long,kind:string,encrypted:boolean>"
LISTING = f"struct<format_name:string,filter_name:string,warning:string,error_class:string,error_detail:string,entries:array<{ENTRY_ITEM}>>"
_ITEM = pa.struct([("index", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("modified_unix_seconds", pa.int64()), ("kind", pa.string()), ("encrypted", pa.bool_())])
_LISTING = pa.struct([(n, pa.string()) for n in ("format_name", "filter_name", "warning", "error_class", "error_detail")] + [("entries", pa.list_(_ITEM))])


class Unsupported(Exception):
    """A container that is known but not read here."""


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """archive_path, length, modified_unix_seconds, content, name, container, filter, payload of every file at a path or glob."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return raw.select(
        F.col("path").alias("archive_path"), "length", F.unix_timestamp("modificationTime").alias("modified_unix_seconds"), "content", name.alias("name"),
        container_of(name, F.col("content")).alias("container"), filter_of(F.col("content")).alias("filter"), payload_name(name).alias("payload"),
    )


def joined_volumes(found: DataFrame) -> DataFrame:
    """Split archives as one file each: the parts from 1 up to the first gap; all other files as they are. A joined file must fit a binary value."""
    from pyspark.sql import Window

    parts = found.where(F.col("container").isin("ZipVolume", "SevenZipVolume")).withColumn("base", volume_base(F.col("name"))).withColumn("index", volume_index(F.col("name"))).withColumn("folder", F.regexp_replace("archive_path", r"[^/]*$", ""))
    run = parts.withColumn("at", F.row_number().over(Window.partitionBy("folder", "base").orderBy("index"))).where("index = at")
    whole = run.groupBy("folder", "base").agg(F.sort_array(F.collect_list(F.struct("index", "content"))).alias("p"), F.sum("length").alias("length"), F.max("modified_unix_seconds").alias("modified_unix_seconds"), F.first("container").alias("container"))
    whole = whole.select(
        F.concat("folder", "base").alias("archive_path"), "length", "modified_unix_seconds", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["content"])).alias("content"), F.col("base").alias("name"), "container",
        F.lit(None).cast("string").alias("filter"), F.lit(None).cast("string").alias("payload"),
    )
    return found.where(F.col("container").isNull() | ~F.col("container").isin("ZipVolume", "SevenZipVolume")).unionByName(whole)


def vote(found: list[ZipRecord]) -> int:
    """The code page of most legacy name bytes; ties: the larger page; 0 if there are none."""
    weights: Counter[int] = Counter()
    for r in found:
        if not r.flags & UTF8_FLAG and r.unicode_name is None and (name := encoding.detect(r.raw_name)) not in ("Utf8", "Utf16Le", "Utf16Be"):
            weights[encoding.CODEPAGES[name]] += max(1, sum(b >= 128 for b in r.raw_name))
    return max(weights, key=lambda p: (weights[p], p), default=0)


def zip_entries(data: bytes, codepage: int) -> list[dict]:
    found = records(io.BytesIO(data))
    page = codepage or vote(found)
    out = []
    for i, r in enumerate(found):
        name = r.unicode_name or (r.raw_name.decode("utf8", "replace") if r.flags & UTF8_FLAG else encoding.decode(r.raw_name, page))
        out.append({"index": i, "path": name.rstrip("/") or name, "size": r.size, "compressed_size": r.packed, "modified_unix_seconds": r.modified, "kind": "Directory" if name.endswith("/") else "File", "encrypted": bool(r.flags & ENCRYPTED_FLAG)})
    return out


def opened(data: bytes, packed: str | None) -> BinaryIO:
    raw = io.BytesIO(data)
    if packed == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw))
    return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}.get(packed, lambda f: f)(raw)


def is_tar(head: bytes) -> bool:
    return len(head) >= 512 and (head[257:262] == b"ustar" or head.strip(b"\0") != b"" and _sum_fits(head))


def _sum_fits(head: bytes) -> bool:
    stated = re.fullmatch(rb"[ 0]*([0-7]+)[ \0]*", head[148:156])
    return bool(stated) and int(stated[1], 8) == sum(head[:148]) + 8 * 32 + sum(head[156:512])


def tar_name(m: tarfile.TarInfo, codepage: int) -> str:
    """A member's name, wherever it is listed, judged or written."""
    return encoding.decode(m.name.encode("utf8", "surrogateescape"), codepage)


def tar_entries(f: BinaryIO, codepage: int) -> tuple[list[dict], str | None]:
    """The members up to the first damage, and a warning if there is one behind at least one member."""
    out: list[dict] = []
    try:
        with tarfile.open(fileobj=f, mode="r|", errors="surrogateescape") as tar:
            for m in tar:
                kind = "File" if m.isreg() else "Directory" if m.isdir() else "Symlink" if m.issym() else "Hardlink" if m.islnk() else "Other"
                out.append({"index": len(out), "path": tar_name(m, codepage), "size": m.size if kind == "File" else 0, "compressed_size": None, "modified_unix_seconds": int(m.mtime), "kind": kind, "encrypted": False})
    except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError) as e:
        if not out:
            raise
        return out, f"partial archive: {e}"
    return out, None


def listing(data: bytes, name: str, container: str | None, packed: str | None, payload: str | None, modified: int, codepage: int) -> dict:
    """What one file lists; errors are part of the answer."""
    out = {"format_name": KNOWN.get(container, ""), "filter_name": packed, "warning": None, "error_class": None, "error_detail": None, "entries": []}
    try:
        if container in ("Zip", "ZipVolume"):
            out["entries"] = zip_entries(data, codepage)
        elif container:
            raise Unsupported(KNOWN[container])
        elif packed in ("lz4", "lzip", "compress"):
            raise Unsupported(packed)
        else:
            wrapped = re.search(r"(?i)(\.tar\.gz|\.tgz)$", name)
            with opened(data, packed) as f:
                head = b"" if wrapped else f.read(512)
            if not wrapped and is_tar(head):
                out["format_name"] = "TAR"
                with opened(data, packed) as f:
                    out["entries"], out["warning"] = tar_entries(f, codepage)
            elif packed:
                out["format_name"] = "raw"
                out["entries"] = [{"index": 0, "path": payload or "data", "size": len(data), "compressed_size": len(data), "modified_unix_seconds": modified, "kind": "File", "encrypted": False}]
            else:
                raise Unsupported("no known signature")
    except Unsupported as e:
        out |= {"error_class": "UnsupportedFormat", "error_detail": str(e)}
    except (ValueError, OSError, EOFError, tarfile.TarError, zlib.error, lzma.LZMAError) as e:
        out |= {"error_class": "Corrupt", "error_detail": str(e)}
    return out


def listed(found: DataFrame, codepage: int = 0) -> DataFrame:
    """files() with the struct column `listing`. Workers hold a few archives at once, however many a partition has."""
    bounded_batches(found.sparkSession)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, n = [], 0
            for k in range(len(batch[0])):
                rows.append(listing(*(c[k].as_py() for c in batch), codepage))
                n += 1 + len(rows[-1]["entries"])
                if n >= LISTED:
                    yield pa.array(rows, _LISTING)
                    rows, n = [], 0
            if rows:
                yield pa.array(rows, _LISTING)
        give_back()

    return found.withColumn("listing", F.arrow_udf(run, LISTING)("content", "name", "container", "filter", "payload", "modified_unix_seconds"))


def archives(found: DataFrame, codepage: int = 0) -> DataFrame:
    """One row an archive, with its counts and its error, if any."""
    sizes = F.transform("listing.entries", lambda e: F.coalesce(e["size"], F.lit(0)))
    return listed(found, codepage).select(
        "archive_path", "listing.format_name", "listing.filter_name", "listing.warning", "listing.error_class", "listing.error_detail", F.size("listing.entries").cast("long").alias("entry_count"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total_uncompressed_size"),
    )


def entries(found: DataFrame, codepage: int = 0) -> DataFrame:
    """One row an entry, as schema.ENTRY says. Files that can't be listed have none; see archives() for why."""
    each = listed(found, codepage).select("archive_path", F.inline("listing.entries"))
    return each.select("archive_path", "index", "path", components(F.col("path")).alias("components"), F.col("path").alias("display_path"), "size", "compressed_size", "modified_unix_seconds", "kind", "encrypted").select(*schema.ENTRY.names)


def members(data: bytes, container: str | None, packed: str | None, name: str, codepage: int = 0) -> Iterator[tuple[int, str, str, int | None, Iterator[bytes]]]:
    """index, path, kind, modified, and the content in blocks, of every member in order."""
    blocks = lambda f: iter(lambda: f.read(BLOCK), b"")
    if container in ("Zip", "ZipVolume"):
        names = zip_entries(data, codepage)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for entry, info in zip(names, z.infolist(), strict=True):
                if entry["encrypted"]:
                    raise PermissionError("password required")
                if entry["kind"] == "Directory":
                    yield entry["index"], entry["path"], "Directory", entry["modified_unix_seconds"], iter(())
                else:
                    with z.open(info) as f:
                        yield entry["index"], entry["path"], "File", entry["modified_unix_seconds"], blocks(f)
    elif packed and re.search(r"(?i)(\.tar\.gz|\.tgz)$", name) or packed and not is_tar(opened(data, packed).read(512)):
        with opened(data, packed) as f:
            yield 0, "", "File", None, blocks(f)
    else:
        with opened(data, packed) as raw, tarfile.open(fileobj=raw, mode="r|", errors="surrogateescape") as tar:
            for i, m in enumerate(tar):
                kind = "File" if m.isreg() else "Directory" if m.isdir() else "Other"
                yield i, tar_name(m, codepage), kind, int(m.mtime), blocks(tar.extractfile(m)) if kind == "File" else iter(())


def tested(found: DataFrame) -> DataFrame:
    """archive_path, entries, bytes, error_class, error_detail: everything is decoded and counted, in blocks."""
    bounded_batches(found.sparkSession)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for data, container, packed, name in ([c[k].as_py() for c in batch] for k in range(len(batch[0]))):  # one file at a time
                n = size = 0
                error = detail = None
                try:
                    if container and container not in ("Zip", "ZipVolume"):
                        raise Unsupported(KNOWN[container])
                    for *_, content in members(data, container, packed, name):
                        size += sum(map(len, content))
                        n += 1
                except Unsupported as e:
                    error, detail = "UnsupportedFormat", str(e)
                except PermissionError as e:
                    error, detail = "PasswordRequired", str(e)
                except (ValueError, OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, NotImplementedError) as e:
                    error, detail = "Corrupt", str(e)
                rows.append({"entries": n, "bytes": size, "error_class": error, "error_detail": detail})
            yield pa.array(rows, pa.struct([("entries", pa.int64()), ("bytes", pa.int64()), ("error_class", pa.string()), ("error_detail", pa.string())]))

    out = F.arrow_udf(run, "struct<entries:long,bytes:long,error_class:string,error_detail:string>")("content", "container", "filter", "name")
    return found.select("archive_path", out.alias("t")).select("archive_path", "t.*")
