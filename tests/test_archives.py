"""Archives written and read again, and streams of progress."""

import gzip
import io
import os
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerstone.functions.paths import components
from ledgerstone.operators import limits
from ledgerstone.sources import archives, sink
from ledgerstone.streaming import progress

CONTENT = {"hello.txt": b"hello from the round trip", "nested/bytes.bin": bytes(range(256)), "nested/Thumbs.db": b"x"}


def tree(spark, name):
    rows = [(name, k, "File", v, 1_700_000_000) for k, v in CONTENT.items()] + [(name, "nested", "Directory", b"", 1_700_000_000)]
    return spark.createDataFrame(rows, "archive string, name string, kind string, content binary, modified_unix_seconds long")


@pytest.mark.parametrize(("kind", "ext"), [("Zip", "zip"), ("Tar", "tar"), ("TarXz", "tar.xz"), ("TarZstd", "tar.zst"), ("TarGzip", "tar.gz")])
def test_round_trip(spark, tmp_path, kind, ext):
    name = f"out.{ext}"
    done = sink.write_archives(tree(spark, name), str(tmp_path), kind).collect()
    assert [(r["archive"], r["bytes"]) for r in done] == [(name, 281)]
    assert os.listdir(tmp_path) == [name]
    found = archives.files(spark, str(tmp_path))
    rows = {r["path"]: r for r in archives.entries(found).collect()}
    assert archives.archives(found).first()["error_class"] is None
    if kind == "TarGzip":
        assert list(rows) == ["out.tar"] and archives.archives(found).first()["format_name"] == "raw"
        return
    assert set(rows) - {"nested"} == {"hello.txt", "nested/bytes.bin"}
    assert rows["hello.txt"]["size"] == 25 and rows["hello.txt"]["modified_unix_seconds"] == 1_700_000_000
    assert archives.tested(found).first()["bytes"] == 281
    to = tmp_path / "x"
    to.mkdir()
    plan = limits.extraction_plan(archives.entries(found), spark.createDataFrame([], "archive_path string, path string, is_dir boolean"), "OverwriteAll")
    result = sink.extract(found.where(F.col("name") == name), plan, str(to)).first()
    assert (result["entries"], result["bytes"], result["error_detail"]) == (2, 281, None)
    assert (to / name / "nested" / "bytes.bin").read_bytes() == CONTENT["nested/bytes.bin"]


def test_volumes(spark, tmp_path):
    noise = os.urandom(32_768)
    rows = spark.createDataFrame([("v.zip", "n.bin", "File", noise, 1_700_000_000)], "archive string, name string, kind string, content binary, modified_unix_seconds long")
    sink.write_archives(rows, str(tmp_path), "Zip", 6, 1024).collect()
    assert (tmp_path / "v.zip.001").stat().st_size == 1024 and (tmp_path / "v.zip.002").exists()
    whole = archives.joined_volumes(archives.files(spark, str(tmp_path)))
    assert [r["size"] for r in archives.entries(whole).collect()] == [32_768]
    assert archives.tested(whole).first()["bytes"] == 32_768


def test_legacy_names_errors_and_raw_streams(spark, tmp_path):
    raw = bytes.fromhex("C7D1B1DB") + b".txt"
    head = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0, 0, 0, 0x21, zlib.crc32(b"a"), 1, 1, len(raw), 0) + raw + b"a"
    record = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 20, 20, 0, 0, 0, 0x21, zlib.crc32(b"a"), 1, 1, len(raw), 0, 0, 0, 0, 0, 0) + raw
    (tmp_path / "legacy.zip").write_bytes(head + record + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(record), len(head), 0))
    (tmp_path / "volume.nii.gz").write_bytes(gzip.compress(b"hello world"))
    (tmp_path / "x.7z").write_bytes(bytes.fromhex("377ABCAF271C0004"))
    (tmp_path / "cut.zip").write_bytes(b"PK\x03\x04 cut")
    found = archives.files(spark, str(tmp_path))
    rows = {os.path.basename(r["archive_path"]): r for r in archives.entries(found).collect()}
    assert rows["legacy.zip"]["path"] == "한글.txt" and rows["volume.nii.gz"]["path"] == "volume.nii"
    errors = {os.path.basename(r["archive_path"]): r["error_class"] for r in archives.archives(found).collect()}
    assert errors == {"legacy.zip": None, "volume.nii.gz": None, "x.7z": "UnsupportedFormat", "cut.zip": "Corrupt"}


def test_unsafe_members_stop_the_extraction(spark, tmp_path):
    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        info = tarfile.TarInfo("../escape.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    found = archives.files(spark, str(tmp_path))
    plan = limits.extraction_plan(archives.entries(found), spark.createDataFrame([], "archive_path string, path string, is_dir boolean"))
    (tmp_path / "out").mkdir()
    result = sink.extract(found, plan, str(tmp_path / "out")).first()
    assert result["entries"] == 0 and result["error_detail"]
    assert not (tmp_path / "escape.txt").exists()


def test_many_members_and_options(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(512):
            z.writestr(f"d/{i:03d}.bin", bytes([i % 256]) * 4096)
    found = archives.files(spark, str(tmp_path))
    assert archives.archives(found).first()["total_uncompressed_size"] == 512 * 4096
    for bad in ({"kind": "Rar", "level": 1}, {"kind": "Zip", "level": 10}, {"kind": "Tar", "level": 1, "volume_size": 5}, {"kind": "Zip", "level": 1, "password": "x"}):
        with pytest.raises(ValueError):
            sink.check_options(**bad)


def test_conflict_plan(spark):
    rows = spark.createDataFrame([("a", 0, "x", "File"), ("a", 1, "d", "Directory"), ("a", 2, "y", "File")], "archive_path string, index long, path string, kind string").withColumn("components", components(F.col("path")))
    there = spark.createDataFrame([("a", "X", False), ("a", "d", True)], "archive_path string, path string, is_dir boolean")
    for policy, clash in (("Ask", "ask"), ("SkipAll", "skip"), ("OverwriteAll", "overwrite")):
        assert [r["action"] for r in limits.extraction_plan(rows, there, policy).orderBy("index").collect()] == [clash, "keep folder", "write"]


def test_throttle_and_merge_streams(spark, tmp_path):
    rows = [(1, i, ms, ms * 10, False, f"w{i % 2}", f"f{i}") for i, ms in enumerate((0, 40, 99, 120, 219, 220))]
    events = spark.createDataFrame(rows, "operation long, seq long, ms long, bytes long, force boolean, worker string, file string")
    want = [0, 120, 220]
    assert [r["ms"] for r in progress.throttled(events).orderBy("ms").collect()] == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make, mode in (("throttle", progress.throttled_stream, "append"), ("merge", progress.merged_stream, "update")):
        make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["ms"] for r in spark.table("throttle").collect()) == want
    assert spark.table("merge").first()["bytes"] == max(0, 990, 2190) + max(400, 1200, 2200)


def test_extraction_stops_at_limits_of_what_is_decoded(spark, tmp_path):
    """A ZIP that packs much into little: the bytes that come out count, not those that are declared."""
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(4):
            z.writestr(f"{k}.bin", bytes(3 << 20))
    found = archives.files(spark, str(tmp_path / "bomb.zip"))
    plan = archives.entries(found).select("archive_path", "index", F.lit("write").alias("action"))

    def run(to, **limits):
        r = sink.extract(found, plan, str(tmp_path / to), **limits).first()
        return r["entries"], r["bytes"], r["error_detail"] is None, sorted(os.listdir(tmp_path / to / "bomb.zip"))

    assert run("all", max_bytes=12 << 20, max_entries=4, max_file=3 << 20) == (4, 12 << 20, True, ["0.bin", "1.bin", "2.bin", "3.bin"])
    assert run("bytes", max_bytes=(7 << 20)) == (2, 6 << 20, False, ["0.bin", "1.bin"])
    assert run("file", max_file=(3 << 20) - 1) == (0, 0, False, [])
    assert run("entries", max_entries=3) == (3, 9 << 20, False, ["0.bin", "1.bin", "2.bin"])


def test_one_name_in_listing_and_extraction_and_code_pages(spark, tmp_path):
    raw = "한글파일.txt".encode("cp949")
    with tarfile.open(tmp_path / "old.tar", "w", encoding="utf-8", errors="surrogateescape", format=tarfile.GNU_FORMAT) as t:
        info = tarfile.TarInfo(raw.decode("utf-8", "surrogateescape"))
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    found = archives.files(spark, str(tmp_path / "old.tar"))
    for page, name in ((949, "한글파일.txt"), (0, "한글파일.txt"), (437, raw.decode("cp437"))):
        listed = archives.entries(found, page).first()["path"]
        assert listed == name
        plan = archives.entries(found, page).select("archive_path", "index", F.lit("write").alias("action"))
        sink.extract(found, plan, str(tmp_path / str(page)), codepage=page).collect()
        assert [f for _, _, fs in os.walk(tmp_path / str(page)) for f in fs] == [name]


def test_names_by_place_are_strict_if_asked(spark):
    from ledgerstone.operators import limits

    e = spark.createDataFrame([("a", 0, "x", ["x"], "x"), ("a", 1, "y", ["y"], "y")], "archive_path string, index long, path string, components array<string>, display_path string")
    names = spark.createDataFrame([("a", 0, "n")], "archive_path string, index long, name string")
    assert {r["path"] for r in limits.zipped_names(e, names).collect()} == {"x", "y"}
    with pytest.raises(Exception, match="2 entries and 1 names"):
        limits.zipped_names(e, names, strict=True).collect()


def test_workers_hold_a_few_archives_at_once(spark, tmp_path, monkeypatch):
    """Batches are bounded by bytes for the writer and the readers, and listings go out in pieces, also of one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.createDataFrame([(f"{a}.zip", f"{m}.txt", "File", b"x" * m, 1_700_000_000) for a in range(7) for m in range(5)], "archive string, name string, kind string, content binary, modified_unix_seconds long")
    monkeypatch.setattr(archives, "LISTED", 12)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 1 << 30)
        sink.write_archives(rows, str(tmp_path)).collect()
        assert int(spark.conf.get(key)) <= 2 << 20
        for make in (archives.listed, archives.tested):
            spark.conf.set(key, 1 << 30)
            make(archives.files(spark, str(tmp_path)))
            assert int(spark.conf.get(key)) <= 2 << 20
        found = archives.entries(archives.files(spark, str(tmp_path)).coalesce(1))
        assert sorted((os.path.basename(r["archive_path"]), r["path"], r["size"]) for r in found.collect()) == [(f"{a}.zip", f"{m}.txt", m) for a in range(7) for m in range(5)]
    finally:
        spark.conf.set(key, before)
