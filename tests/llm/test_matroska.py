import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerstone.llm import matroska as m


@pytest.mark.parametrize("n", [192, 384, 1536, 1728, 20_000 * 192 // 192])
def test_round_trip_and_cues(n):
    payload = os.urandom(n - n % 192 or 192)
    data = m.mux(payload)
    media = m.demux(data)
    assert b"".join(data[p.start : p.end] for p in media.packets) == payload
    assert [at for *_, at in media.cues] == media.clusters
    assert [p.timestamp_ns for p in media.packets] == [24_000_000 * i for i in range(len(media.packets))]


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACE, m.FIXED])
def test_lacing(kind):
    frames = [os.urandom(n) for n in ((300, 300, 300) if kind == m.FIXED else (255, 1, 700, 0, 40_000, 12))]
    cluster = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 5), m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(3, -2, frames, kind)), m.number(m.REFERENCE, 1)), m.element(m.SIMPLE_BLOCK, m.block(3, 7, [b"x"], m.NO_LACE)))
    unknown = m.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster
    media = m.demux(m.element(m.EBML) + unknown)
    assert sorted(unknown and (m.element(m.EBML) + unknown)[p.start : p.end] for p in media.packets) == sorted([*frames, b"x"])
    assert {(p.track, p.timestamp_ns, p.key) for p in media.packets} == {(3, 3_000_000, False), (3, 12_000_000, True)}


def test_damaged_files_are_errors():
    data = m.mux(b"a" * 1920)
    for cut in (5, 60, len(data) - 30):
        with pytest.raises((ValueError, IndexError)):
            m.demux(data[:cut])


def test_digest(spark, docs):
    rows = [(1, None), (2, ""), (3, "é" * 1000), (4, "x" * 192), (5, "x" * 192), (6, "long " * 60_000)]
    got = {r["doc_id"]: r for r in m.media_digest(docs(rows)).collect()}
    for k, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert got[k]["n_bytes"] == len(raw) and got[k]["payload_bytes"] == len(payload)
        assert got[k]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[k]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert got[k]["media_sha256"] == hashlib.sha256(m.mux(payload)).hexdigest()
    assert got[4][1:] == got[5][1:]
    assert m.media_digest(docs([])).count() == 0


def test_packet_table(spark):
    files = spark.createDataFrame([(1, m.mux(b"a" * 1920)), (2, b"junk"), (3, None)], "id long, media binary")
    rows = m.packet_table(files, "media", "id").collect()
    assert len(rows) == 10 and {r["id"] for r in rows} == {1}


def test_cues_tracks_and_errors(spark):
    good = m.mux(b"x" * 192 * 200)
    rows = [(1, good), (2, good[:-5]), (3, None), (4, b"")]
    df = spark.createDataFrame(rows, "id int, media binary").withColumn("media_parsed", F.lit("mine"))
    out = {r["id"]: r for r in m.parsed(df, "media").collect()}
    assert out[1]["media_parsed"] == "mine" and out[1]["_media_parsed"]["error"] is None and out[2]["_media_parsed"]["error"]
    assert [len(out[k]["_media_parsed"]["packets"]) for k in (1, 2, 3, 4)] == [200, 0, 0, 0]
    cues = m.cue_table(df, "media", "id").collect()
    assert cues and all(good[c["cluster_at"] : c["cluster_at"] + 4] == m.CLUSTER.to_bytes(4, "big") for c in cues)
    assert [(t["id"], t["track"], t["codec"]) for t in m.track_table(df, "media", "id").collect()] == [(1, 1, "A_PCM/INT/LIT")]
