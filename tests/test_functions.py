"""Facts about single functions, as tables."""

import pytest
from pyspark.sql import functions as F

from ledgerstone.functions import encoding
from ledgerstone.functions import formats as fmt
from ledgerstone.functions import paths as P
from ledgerstone.operators import limits, listing, progress, volumes


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def entries(spark, rows, archive="a"):
    df = spark.createDataFrame([(archive, i, *r) for i, r in enumerate(rows)], "archive_path string, index long, path string, size long, modified_unix_seconds long, kind string")
    return df.select("archive_path", "index", "path", P.components(F.col("path")).alias("components"), F.col("path").alias("display_path"), "size", F.floor(F.col("size") / 2).alias("compressed_size"), "modified_unix_seconds", "kind", F.lit(False).alias("encrypted"))


def test_safe_paths(spark):
    safe = ["folder/file.txt", "a/./b", "x"]
    unsafe = ["../escape.txt", "C:\\Windows\\escape.txt", "\\\\server\\share\\escape.txt", "CON", "aux.txt", "dir/NUL.bin", "name. ", "a:b", "star*", "COM¹", "com².txt", "dir/COM³.bin", "LPT¹", "lpt².txt", "dir/LPT³.bin", "", "/abs", "."]
    assert values(spark, safe, P.unsafe_reason) == [None] * len(safe)
    assert all(values(spark, unsafe, P.unsafe_reason))


def test_names(spark):
    assert values(spark, ["tool.EXE", "a b.cmd", "x.bat", "y.Ps1", "exe", "tool.exe.txt", "tool.exes"], P.is_executable) == [True] * 4 + [False] * 3
    names = ["q.ZIP", "two words.7z", "n.tar.xz", "disk.ISO", "q.zip.017", "q.7Z.999", "q.zip~", "q.tar.002", "zip", ".7z"]
    assert values(spark, names, P.is_archive) == [True] * 6 + [False] * 3 + [True]
    assert values(spark, names, P.is_archive_drop)[-1] is False
    assert values(spark, ["k.rar.042", "k.rar.42", "k.rar.000", "k.7777777777", "m.n.20000"], P.volume_index) == [42, None, None, None, 20000]
    assert values(spark, ["data.tar.zst", "data.zip.003", "data.tgz", ".tar.gz", "data", ".7z"], P.directory_name) == ["data", "data", "data", "extracted", "data", ".7z"]
    assert values(spark, ["log.tar.gz", "log.tgz", "scan.csv.gz", ".gz", "log", ".tgz"], P.payload_name) == ["log.tar", "log.tar", "scan.csv", None, None, None]
    assert values(spark, ["m" * 45, "n" * 30, "n" * 31], P.menu_name) == ["m" * 29 + "…", "n" * 30, "n" * 29 + "…"]
    assert values(spark, ["w" * 33 + ".7z"], lambda c: P.menu_name(c, P.compression_suffix(c))) == ["w" * 26 + "….7z"]
    assert values(spark, ['say "hi"', "dir\\", " "], P.quoted_argument) == ['"say \\"hi\\""', '"dir\\\\"', '" "']
    assert values(spark, [7, 70, 7000], lambda c: P.volume_name(F.lit("part"), c), "int") == ["part.007", "part.070", "part.7000"]
    assert values(spark, ["Docs\\Sub\\x", "docs/subway", "DOCS/SUB", "docs"], lambda c: P.is_within(c, F.lit("docs/./sub"))) == [True, False, True, False]


def test_sizes_and_times(spark):
    assert values(spark, [None, 0, 1023, 1024, 1280, 102400, 1 << 30, 5 << 50], fmt.format_size, "long") == ["", "0 B", "1023 B", "1.0 KB", "1.2 KB", "100 KB", "1.0 GB", "5120 TB"]
    assert values(spark, [None, 59.9, 3661.0, 360000.0], fmt.format_duration, "double") == ["—", "00:00:59", "01:01:01", "100:00:00"]
    assert values(spark, [None, 0, -1, 86400], lambda c: fmt.format_timestamp(c, utc=True), "long") == values(spark, [None, 0, -1, 86400], fmt.format_timestamp, "long") == ["", "1970-01-01 00:00", "1969-12-31 23:59", "1970-01-02 00:00"]
    seconds = [-2208988800, 0, 1700000000]
    assert values(spark, seconds, lambda c: fmt.from_filetime(fmt.to_filetime(c)), "long") == seconds
    assert values(spark, [0, 9, 10, -3], fmt.volume_size, "int") == [None, 99_213_744_538, None, None]
    assert values(spark, [1, 65536, 2 << 20], fmt.stream_buffer, "int") == [4096, 65536, 1 << 20]


def test_messages(spark):
    assert values(spark, ["the PASSPHRASE is wrong: incorrect passphrase", "member 3: passphrase required", "encrypted, but of an unknown version", "bad block", None], fmt.is_password_error) == [True, True, False, False, False]
    assert values(spark, ["cannot write: error 13", "E 0x80070005", "disk full"], fmt.needs_elevation) == [True, True, False]


@pytest.mark.parametrize(("reported", "base", "total", "want"), [(950, 900, 100, (950, 50)), (50, 900, 100, (950, 50)), (1400, 900, 100, (1000, 100))])
def test_callback_progress(spark, reported, base, total, want):
    assert tuple(spark.range(1).select(fmt.operation_bytes(F.lit(reported), F.lit(base), F.lit(total)).alias("x")).select("x.*").first()) == want


def test_encodings():
    vectors = {"EFBBBF61": "Utf8", "FFFE4800": "Utf16Le", "FEFF0048": "Utf16Be", "845B845C": "Johab", "81308130": "Gb18030", b"<meta charset=big5>".hex() + "81408140": "Big5"}
    assert {h: encoding.detect(bytes.fromhex(h)) for h in vectors} == vectors
    texts = {"1B2442242224241B2842": "あい", "BEC8B3E7C7CFBCBCBFE4": "안녕하세요", "82B182F182C982BF82CD": "こんにちは", "D6D0CEC4": "中文", "B36F": "這", "68656C6C6F2E747874": "hello.txt"}
    assert {h: encoding.decode(bytes.fromhex(h)) for h in texts} == texts


def test_encoding_columns(spark):
    assert values(spark, [bytes.fromhex("D6D0CEC4"), None], encoding.detect_encoding, "binary") == ["Gbk", None]
    assert values(spark, ["a%20b+c", "%E4%B8%AD", "%zz", "%ff"], encoding.percent_decoded) == ["a b+c", "中", None, None]
    assert values(spark, ['\n  "C:\\a b"\nx', "file:///C:/x%20y", "file://host/x", " \n"], encoding.dropped_path) == ["C:\\a b", "C:\\x y", None, None]


def test_restrict_and_views(spark):
    e = entries(spark, [("root.txt", 1, None, "File"), ("dir/a.txt", 2, None, "File"), ("dir/sub/b.txt", 4, None, "File"), ("other.txt", 8, None, "File"), ("dir2/c", 1, None, "File")])
    assert [(r["index"], r["path"]) for r in listing.restrict(e, "dir").orderBy("index").collect()] == [(0, "dir/a.txt"), (1, "dir/sub/b.txt")]
    e = entries(spark, [("zeta.txt", 1, None, "File"), ("folder/second.txt", 2, None, "File"), ("Alpha.txt", 3, None, "File"), ("folder/first.txt", 4, None, "File"), ("beta.txt", 5, None, "File")])
    view = listing.sorted_view(listing.folder_view(e), e)
    assert [r["name"] for r in view.orderBy("rn").collect()] == ["folder", "Alpha.txt", "beta.txt", "zeta.txt"]
    assert [r["name"] for r in listing.sorted_view(listing.folder_view(e), e, listing.NAME, False).orderBy("rn").collect()] == ["folder", "zeta.txt", "beta.txt", "Alpha.txt"]


def test_folder_rows(spark):
    inferred = entries(spark, [("folder/child.bin", 8192, 86400, "File")])
    row = listing.presented(listing.sorted_view(listing.folder_view(inferred), inferred), utc=True).first()
    assert (row["size_text"], row["packed_text"], row["modified_text"], row["path_text"]) == ("", "", "", "folder")
    own = entries(spark, [("folder/child.bin", 8192, 86400, "File"), ("folder", 0, 0, "Directory")])
    row = listing.presented(listing.sorted_view(listing.folder_view(own), own), utc=True).first()
    assert (row["size_text"], row["modified_text"]) == ("0 B", "1970-01-01 00:00")
    case = entries(spark, [("Foo/a", 1, 0, "File"), ("foo", 0, 0, "Directory"), ("Foo", 0, 0, "Directory")])
    assert [(r["name"], r["source_index"]) for r in listing.folder_view(case).collect()] == [("Foo", 2)]


def test_limits_are_inclusive(spark):
    e = entries(spark, [("a", 2, None, "File"), ("b", 3, None, "File"), ("c", 0, None, "File")])
    assert [r["limit_broken"] for r in limits.running(e, 2, 5, 3).orderBy("index").collect()] == [None, None, "entries"]
    assert limits.first_violations(e, max_entries=3, max_bytes=4, max_file=9).first()["index"] == 1
    assert limits.first_violations(e.limit(0)).count() == 0


def test_conflicts(spark):
    e = entries(spark, [("a", 1, None, "File"), ("a!", 1, None, "File"), ("A/b", 1, None, "File"), ("x/y", 1, None, "File"), ("X/Y", 1, None, "File")])
    assert {(r["path"], r["n"]) for r in limits.conflicts(e).collect()} == {("a", 1), ("x/y", 1)}
    hidden = entries(spark, [("a", 1, None, "File"), ("a!", 1, None, "File"), ("a/b", 1, None, "File")])
    assert limits.adjacent_conflicts(hidden).first()["conflict"] is False
    assert limits.conflicts(hidden).count() == 1


def test_progress_places(spark):
    files = spark.createDataFrame([(1, i, s, True) for i, s in enumerate([25, 25, 0, 25, 25])], "operation long, index long, size long, is_file boolean")
    done = spark.createDataFrame([(1, x) for x in (1, 25, 26, 75, 76, 100)], "operation long, done long")
    assert {r["done"]: (r["file_index"], r["file_bytes"]) for r in progress.locate_bytes(done, files).collect()} == {1: (0, 1), 25: (0, 25), 26: (1, 1), 75: (3, 25), 76: (4, 1), 100: (4, 25)}
    files = spark.createDataFrame([(1, 0, 25, True), (1, 1, 0, False), (1, 2, 0, True), (1, 3, 25, True)], "operation long, index long, size long, is_file boolean")
    done = spark.createDataFrame([(1, x) for x in (0, 24, 25, 26, 50)], "operation long, done long")
    assert {r["done"]: r["n_completed"] for r in progress.completed_files(done, files).collect()} == {0: 0, 24: 0, 25: 2, 26: 2, 50: 3}


def test_free_and_loose_names(spark):
    there = spark.createDataFrame([("f", n) for n in ("a.zip", "A_2.zip", "a_4.zip", "b", "café.txt", "cafe.txt")], "folder string, name string")
    wanted = spark.createDataFrame([("f", n) for n in ("a.zip", "b", "c")], "folder string, name string")
    assert {r["name"]: r["free_name"] for r in volumes.free_names(wanted, there).collect()} == {"a.zip": "a_3.zip", "b": "b_2", "c": "c"}
    wanted = spark.createDataFrame([("f", n) for n in ("caf?.txt", "?.zip", "b", "d")], "folder string, name string")
    assert {r["name"]: r["found"] for r in volumes.loose_matches(wanted, there).collect()} == {"caf?.txt": None, "?.zip": "a.zip", "b": "b", "d": None}


def test_free_names_in_one_pass_with_hot_names_and_numbers_in_extensions(spark, monkeypatch):
    monkeypatch.setattr(volumes, "HOT_ROWS", 3)
    names = ("a.zip", "A_2.zip", "a_4.zip", "b", "x.tar_5", "x_2.tar_5", "..", ".._2", "_2.zip", ".zip")
    there = spark.createDataFrame([("f", n) for n in names + names], "folder string, name string")
    want = {"a.zip": "a_3.zip", "A.zip": "A_3.zip", "b": "b_2", "c": "c", "x.tar_5": "x_3.tar_5", "..": ".._3", ".zip": ".zip_2"}
    wanted = spark.createDataFrame([(k, "f", n) for n in want for k in range(10 if n in ("a.zip", "c") else 2)] + [(0, None, "b")], "id long, folder string, name string")
    rows = volumes.free_names(wanted, there).collect()
    assert sorted((r["id"], r["name"], r["free_name"]) for r in rows if r["folder"]) == sorted((k, n, f) for n, f in want.items() for k in range(10 if n in ("a.zip", "c") else 2))
    assert [r["free_name"] for r in rows if r["folder"] is None] == ["b"]


def test_destinations_group_their_sources_a_few_times_only(spark, data):
    from ledgerstone.plans import catalog

    plan = catalog.QUERIES["compression_destination"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 4  # existing names, hot names for both sides, the rows
