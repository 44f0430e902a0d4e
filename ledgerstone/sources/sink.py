"""Writing archives and extracting them, one task an archive, with atomic commits.

Targets are folders that all executors share as a file system. Output is written to a temporary name beside its target and
renamed, so a task that is lost and run again leaves one whole file.
"""

from __future__ import annotations

import io
import os
import tarfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.paths import unsafe_reason
from ..workers import bounded_batches, give_back, values
from .archives import members

LEVELS = {"Zip": 9, "Tar": 9, "TarGzip": 9, "TarXz": 9, "TarZstd": 22}
WRITABLE = tuple(LEVELS)
EARLIEST = 315_532_800  # 1980, the first time that ZIP can state


class Volumes(io.RawIOBase):
    """A writable file in parts of one size: base.001, base.002 and so on. Seeks within what is written."""

    def __init__(self, base: str, size: int) -> None:
        self.base, self.size, self.at, self.length, self.parts = base, size, 0, 0, []

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence]
        return self.at

    def _part(self, k: int) -> BinaryIO:
        while len(self.parts) <= k:
            self.parts.append(open(f"{self.base}.{len(self.parts) + 1:03d}", "w+b"))  # noqa: SIM115
        return self.parts[k]

    def write(self, data) -> int:
        data = memoryview(data).cast("B")
        done = 0
        while done < len(data):
            k, offset = divmod(self.at, self.size)
            part, n = self._part(k), min(self.size - offset, len(data) - done)
            part.seek(offset)
            part.write(data[done : done + n])
            done += n
            self.at += n
            self.length = max(self.length, self.at)
        return done

    def close(self) -> None:
        for p in self.parts:
            p.close()
        super().close()


def check_options(kind: str, level: int, volume_size: int | None = None, password: str | None = None) -> None:
    if kind not in WRITABLE:
        raise ValueError(f"can't write {kind}; writable: {', '.join(WRITABLE)}")
    if not 0 <= level <= LEVELS[kind]:
        raise ValueError(f"compression level {level} is outside 0..={LEVELS[kind]}")
    if volume_size is not None and (kind != "Zip" or volume_size <= 0):
        raise ValueError("only ZIP is written in volumes, of a positive size")
    if password is not None:
        raise ValueError("encryption isn't supported")


def build(out: BinaryIO, rows: Iterator[tuple[str, str, bytes, int | None]], kind: str, level: int) -> tuple[int, int]:
    """Writes rows of (name, kind, content, modified) to out; number of entries and bytes."""
    n = size = 0
    if kind == "Zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED, compresslevel=level or None) as z:
            for name, entry, content, modified in rows:
                if entry == "Directory":
                    continue
                info = zipfile.ZipInfo(name, time.gmtime(max(EARLIEST, modified or EARLIEST))[:6])
                info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED
                z.writestr(info, content, compresslevel=level or None)
                n, size = n + 1, size + len(content)
        return n, size
    if kind == "TarZstd":
        import zstandard

        stream = zstandard.ZstdCompressor(level=level or 3).stream_writer(out, closefd=False)
        tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT)  # noqa: SIM115
    else:
        stream, mode = None, {"Tar": "w|", "TarGzip": "w:gz", "TarXz": "w:xz"}[kind]
        more = {"TarGzip": {"compresslevel": level}, "TarXz": {"preset": level}}.get(kind, {})
        tar = tarfile.open(fileobj=out, mode=mode, format=tarfile.PAX_FORMAT, **more)  # noqa: SIM115
    with tar:
        for name, entry, content, modified in rows:
            info = tarfile.TarInfo(name)
            info.mtime = modified or 0
            if entry == "Directory":
                info.type, info.mode = tarfile.DIRTYPE, 0o755
                tar.addfile(info)
            else:
                info.size, info.mode = len(content), 0o644
                tar.addfile(info, io.BytesIO(content))
                size += len(content)
            n += 1
    if stream:
        stream.close()
    return n, size


def write_archives(rows: DataFrame, folder: str, kind: str = "Zip", level: int = 6, volume_size: int | None = None) -> DataFrame:
    """Writes one archive for each value of `archive` and returns archive, entries, bytes; an action runs it.

    rows: archive (a file name), name, kind, content, modified_unix_seconds. Thumbs.db files are left out; members are in
    the byte order of their names. Rows stream through the task that writes their archive.
    """
    check_options(kind, level, volume_size)
    bounded_batches(rows.sparkSession)
    kept = rows.where(F.lower(F.regexp_extract("name", r"([^/]*)$", 1)) != "thumbs.db").select("archive", "name", "kind", "content", "modified_unix_seconds")
    dealt = kept.repartition("archive").sortWithinPartitions("archive", "name")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*map(values, b.columns), strict=True))
        first = next(stream, None)
        while first is not None:
            archive, later = first[0], []

            def own() -> Iterator[tuple]:
                for row in chain([first], stream):  # noqa: B023
                    if row[0] != archive:  # noqa: B023
                        later.append(row)  # noqa: B023
                        return
                    yield row[1:]

            target = os.path.join(folder, archive)
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            try:
                if volume_size:
                    out = Volumes(temporary, volume_size)
                    with out:
                        n, size = build(out, own(), kind, level)
                    for k in range(1, len(out.parts) + 1):
                        os.replace(f"{temporary}.{k:03d}", f"{target}.{k:03d}")
                    k = len(out.parts) + 1
                    while os.path.exists(stale := f"{target}.{k:03d}"):
                        os.remove(stale)
                        k += 1
                else:
                    with open(temporary, "wb") as f:
                        n, size = build(f, own(), kind, level)
                    os.replace(temporary, target)
            except BaseException:
                for f in os.listdir(folder):
                    if f.startswith(os.path.basename(temporary)):
                        os.remove(os.path.join(folder, f))
                raise
            yield pa.record_batch([pa.array([archive]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "entries", "bytes"])
            first = later[0] if later else None
        give_back()

    return dealt.mapInArrow(write, "archive string, entries long, bytes long")


def extract(found: DataFrame, plan: DataFrame, folder: str, codepage: int = 0, max_entries: int = schema.MAX_ENTRIES, max_bytes: int = schema.MAX_EXTRACT_BYTES, max_file: int = schema.MAX_FILE_BYTES) -> DataFrame:
    """Extracts by a plan (limits.extraction_plan) below folder/archive name; archive_path, entries, bytes, skipped, error_detail; an action runs it.

    found: files(). Only create folder, write and overwrite are carried out. A target outside the folder, also by way of a
    link, is an error. Names are decoded as the listing does with this code page. Limits count what is really decoded, whatever
    the archive declares: an archive stops at the first block beyond one (values at a limit hold); what is half-written goes.
    """
    bounded_batches(found.sparkSession)
    bad = plan.groupBy("archive_path").agg(F.bool_or(F.col("action") == "error").alias("bad"), F.map_from_entries(F.collect_list(F.struct("index", "action"))).alias("actions"))
    rows = found.join(bad, "archive_path").select("archive_path", "name", "container", "filter", "payload", "content", "bad", "actions")

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([("entries", pa.int64()), ("bytes", pa.int64()), ("skipped", pa.int64()), ("error_detail", pa.string())])
        for batch in batches:
            out = []
            for name, container, packed, payload, data, bad, actions in ([c[k].as_py() for c in batch] for k in range(len(batch[0]))):  # one archive at a time
                out.append({"entries": 0, "bytes": 0, "skipped": 0, "error_detail": "unsafe entry path or kind"} if bad else _extracted(os.path.join(folder, name), data, container, packed, payload, name, dict(actions), codepage, (max_entries, max_bytes, max_file)))
            yield pa.array(out, kind)

    result = F.arrow_udf(run, "struct<entries:long,bytes:long,skipped:long,error_detail:string>")("name", "container", "filter", "payload", "content", "bad", "actions")
    return rows.select("archive_path", result.alias("r")).select("archive_path", "r.*")


def _extracted(root: str, data: bytes, container, packed, payload, name: str, actions: dict[int, str], codepage: int, limits: tuple[int, int, int]) -> dict:
    max_entries, max_bytes, max_file = limits
    out = {"entries": 0, "bytes": 0, "skipped": 0, "error_detail": None}
    os.makedirs(root, exist_ok=True)
    try:
        for index, path, kind, modified, content in members(data, container, packed, name, codepage):
            if out["entries"] + out["skipped"] >= max_entries:
                raise ValueError(f"more than {max_entries} entries")
            action = actions.get(index, "skip")
            target = os.path.join(root, (path or payload or "data").replace("\\", "/"))
            if os.path.commonpath([os.path.realpath(root), os.path.realpath(target)]) != os.path.realpath(root):
                raise PermissionError(f"{path} leaves the folder")
            if kind == "Directory" or action == "create folder":
                os.makedirs(target, exist_ok=True)
            elif action in ("write", "overwrite"):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temporary = f"{target}.{uuid.uuid4().hex}.tmp"
                own = 0
                try:
                    with open(temporary, "wb") as f:
                        for block in content:
                            if own + len(block) > max_file or out["bytes"] + own + len(block) > max_bytes:
                                raise ValueError(f"{path}: more bytes than the limit")
                            own += f.write(block)
                    os.replace(temporary, target)
                finally:
                    if os.path.exists(temporary):
                        os.remove(temporary)
                out["bytes"] += own
                if modified is not None:
                    os.utime(target, (modified, modified))
                out["entries"] += 1
            else:
                out["skipped"] += 1
    except (OSError, ValueError, EOFError, tarfile.TarError, zipfile.BadZipFile) as e:
        out["error_detail"] = str(e)
    return out


def missing(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Safe paths that were expected but not produced."""
    return expected.where(unsafe_reason(F.col("path")).isNull()).join(produced, ["archive_path", "path"], "left_anti")
