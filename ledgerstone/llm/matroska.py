"""Media columns: Matroska files in a binary column, read as packet tables.

`mux` stores a payload as 8-bit mono PCM in a Matroska file; `packets` parses any Matroska or WebM bytes: elements of
variable length (also of unknown size), clusters, simple blocks and block groups, the four kinds of lacing, and cues. Both
are small helpers that run inside tasks on one file at a time; Spark deals the rows, explodes the packets and aggregates.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, values, whole

# Element IDs of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK, INFO, CUES, CUE_POINT, CUE_POSITIONS, AUDIO}

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, SAMPLE_RATE = 192, 8, 8, 8000
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """n as an element size of the least width, or the width asked for."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's bytes after its flags."""
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == EBML_LACE:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, at: int, frames: list[bytes], kind: int) -> bytes:
    return vint(track) + struct.pack(">hB", at, 0x80 | kind << 1) + lace(frames, kind)


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file of one PCM track: frames of so many samples, laced into blocks, with one cue for each cluster."""
    per_ms = SAMPLE_RATE // 1000
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) / per_ms)), element(MUXING_APP, b"ledgerstone"), element(WRITING_APP, b"ledgerstone"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)), number(CHANNELS, 1), number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), element(CODEC_ID, b"A_PCM/INT/LIT"), number(DEFAULT_DURATION, frame * 1_000_000_000 // SAMPLE_RATE), audio))
    parts, cues, at, each = [info, tracks], [], len(info) + len(tracks), FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for i in range(0, len(frames), each):
        begin, blocks = i * frame // per_ms, []
        for j in range(i, min(i + each, len(frames)), FRAMES_A_BLOCK):
            own = frames[j : min(j + FRAMES_A_BLOCK, i + each)]
            kind = NO_LACE if len(own) == 1 else FIXED if len({*map(len, own)}) == 1 else EBML_LACE
            blocks.append(element(SIMPLE_BLOCK, block(1, j * frame // per_ms - begin, own, kind)))
        parts.append(element(CLUSTER, number(TIMESTAMP, begin), *blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, begin), element(CUE_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    head = element(EBML, number(0x4286, 1), number(0x42F7, 1), number(0x42F2, 4), number(0x42F3, 8), element(0x4282, b"matroska"), number(0x4287, 4), number(0x4285, 2))
    return head + element(SEGMENT, *parts, element(CUES, *cues))


class Packet(NamedTuple):
    """cluster and block: running numbers; lace: number within the block; start, end: byte range in the file."""

    track: int
    timestamp_ns: int
    cluster: int
    block: int
    lace: int
    key: bool
    start: int
    end: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, position of the cluster in the file
    tracks: dict[int, dict[int, bytes]]
    clusters: list[int]  # positions in the file


def _ident(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element ID at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    """The size (None: unknown) and where its bytes end."""
    if at >= len(data) or not data[at] or at + (width := 9 - data[at].bit_length()) > len(data):
        raise ValueError(f"no element size at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return None if n == (1 << 7 * width) - 1 else n, at + width


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """The byte ranges of a block's frames."""
    if kind == NO_LACE:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError(f"the block that ends at byte {end} has frames of unequal size")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == XIPH:
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    else:
        for k in range(n - 1):
            value, to = _size(data, at)
            if value is None:
                value = (1 << 7 * (to - at)) - 1
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (to - at) - 1) - 1))
            at = to
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    if at > end or min(sizes, default=0) < 0:
        raise ValueError(f"the frames pass the end of their block at byte {end}")
    return [*out, (at, end)]


def demux(data: bytes) -> Media:
    """All packets of the first segment. ValueError where the bytes aren't well-formed; a file cut within an element counts as such."""
    packets, cues, tracks, clusters = [], [], {}, []
    scale, segment, cluster_time, n_blocks, own, cue = 1_000_000, 0, 0, 0, None, {}
    group: list | None = None

    def add(start: int, end: int, key: bool | None) -> None:
        nonlocal n_blocks
        track, at = _size(data, start)
        relative, flags = struct.unpack_from(">hB", data, at)
        step = int.from_bytes((tracks.get(track) or {}).get(DEFAULT_DURATION, b""), "big")
        for k, (a, b) in enumerate(_frames(data, at + 3, end, flags >> 1 & 3)):
            packets.append(Packet(track, (cluster_time + relative) * scale + k * step, len(clusters) - 1, n_blocks, k, bool(flags & 0x80) if key is None else key, a, b))
        n_blocks += 1

    at, stops = 0, [(len(data), 0)]  # (where a master ends, its ID)
    while at < len(data):
        while at >= stops[-1][0] and len(stops) > 1:
            if stops.pop()[1] == BLOCK_GROUP and group:
                add(*group)
                group = None
        ident, to = _ident(data, at)
        n, to = _size(data, to)
        if n is None and ident not in (SEGMENT, CLUSTER):
            raise ValueError(f"an element of unknown size at byte {at}")
        if ident in (CLUSTER, CUES) and stops[-1][1] == CLUSTER:  # after a cluster of unknown size
            stops.pop()
        end = stops[-1][0] if n is None else to + n
        if end > stops[-1][0]:
            raise ValueError(f"the element at byte {at} passes the end of what holds it")
        value = data[to:end] if ident not in MASTERS and ident not in (SIMPLE_BLOCK, BLOCK) else b""
        if ident == SEGMENT:
            segment = to
        elif ident == CLUSTER:
            clusters.append(at)
        elif ident == TRACK:
            own = {}
        elif ident == TRACK_NUMBER:
            tracks[int.from_bytes(value, "big")] = own
        elif ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(value, "big")
        elif ident == TIMESTAMP:
            cluster_time = int.from_bytes(value, "big")
        elif ident == SIMPLE_BLOCK:
            add(to, end, None)
        elif ident == BLOCK:
            group = [to, end, True]
        elif ident == REFERENCE and group:
            group[2] = False
        elif ident == CUE_POINT:
            cue = {}
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[ident] = int.from_bytes(value, "big")
            if ident == CUE_CLUSTER:
                cues.append((cue.get(CUE_TIME, 0) * scale, cue.get(CUE_TRACK, 0), segment + cue[CUE_CLUSTER]))
        if own is not None and ident not in MASTERS and stops[-1][1] in (TRACK, AUDIO):
            own[ident] = value
        if ident in MASTERS:
            stops.append((end, ident))
            at = to
        else:
            at = end
    if group:
        add(*group)
    return Media(packets, cues, tracks, clusters)


PACKET = "struct<track:int,timestamp_ns:long,cluster:int,block:int,lace:int,key:boolean,start:long,end:long>"
_PACKET = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("cluster", pa.int32()), ("block", pa.int32()), ("lace", pa.int32()), ("key", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])


PARSED = f"struct<packets:array<{PACKET}>,cues:array<struct<timestamp_ns:long,track:int,cluster_at:long>>,tracks:array<struct<track:int,codec:string,elements:map<int,binary>>>,error:string>"
_CUES = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int32()), ("cluster_at", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("track", pa.int32()), ("codec", pa.string()), ("elements", pa.map_(pa.int32(), pa.binary()))]))


def parsed(df: DataFrame, media_col: str, out: str = "media_parsed") -> DataFrame:
    """df with the struct `out`: packets, cues, tracks, and error (null but for malformed files, which have nothing else).

    Null and empty files have empty arrays and no error; repeated rows are parsed alike; files of any length are read whole, one
    at a time; other columns stay, also of this name (the new one is then named fresh(df, out)); an empty table stays empty.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf(PARSED)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            rows = []
            for data in values(files, 16):
                try:
                    m = demux(data) if data else Media([], [], {}, [])
                    tracks = [{"track": k, "codec": (v.get(CODEC_ID) or b"").decode("utf8", "replace"), "elements": list(v.items())} for k, v in m.tracks.items()]
                    rows.append(([p._asdict() for p in m.packets], [{"timestamp_ns": a, "track": b, "cluster_at": c} for a, b, c in m.cues], tracks, None))
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append(([], [], [], str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.list_(_PACKET), _CUES, _TRACKS, pa.string()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["packets", "cues", "tracks", "error"])

    return df.withColumn(fresh(df, out), parse(F.col(media_col)))


def cue_table(df: DataFrame, media_col: str, *keep: str) -> DataFrame:
    """One row for each cue of each file: the kept columns, timestamp_ns, track, cluster_at (the cluster's byte)."""
    return parsed(df.select(*keep, media_col), media_col, "_parsed").select(*keep, F.inline("_parsed.cues"))


def track_table(df: DataFrame, media_col: str, *keep: str) -> DataFrame:
    """One row for each track of each file: the kept columns, track, codec, elements (the track's other elements by ID)."""
    return parsed(df.select(*keep, media_col), media_col, "_parsed").select(*keep, F.inline("_parsed.tracks"))


def packet_table(df: DataFrame, media_col: str, *keep: str) -> DataFrame:
    """One row for each packet of each file: the kept columns, then the fields of Packet. Null files have none, nor have malformed
    ones, whose error parsed() tells."""
    return parsed(df.select(*keep, media_col), media_col, "_parsed").select(*keep, F.inline("_parsed.packets"))


def _store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's UTF-8 bytes with blanks up to a positive multiple of a frame, as a Matroska file; null counts as empty."""
    for texts in batches:
        payloads = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts)
        yield pa.array([mux(p + b" " * (-len(p) % FRAME if p else FRAME)) for p in payloads], pa.binary())


BACK = "struct<payload:binary,packets:int,clusters:int,cues:int,last_ms:long,feature:string>"


def _read_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stored payload, collected from the packets' byte ranges, and features of its samples."""
    fields = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    for files in batches:
        rows = []
        for f in files:
            data = f.as_buffer().to_pybytes()
            media = demux(data)
            payload = b"".join([data[p.start : p.end] for p in media.packets])
            x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
            crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
            feature = f"samples={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={crossings};peak={abs(x).max()};packets={len(media.packets)}"
            rows.append((payload, len(media.packets), len(media.clusters), len(media.cues), media.packets[-1].timestamp_ns // 1_000_000, feature))
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], ["payload", "packets", "clusters", "cues", "last_ms", "feature"])


def media_digest(documents: DataFrame) -> DataFrame:
    """doc_id and digests of the stored form and of what is read back from it; one narrow pass, equal texts get equal values.

    A null text counts as empty, and its payload is one frame of blanks; very long texts take many clusters; repeated rows and ids
    each have their row; an empty table gives an empty one; columns but doc_id and text aren't looked at.
    """
    # coalesce() between the two keeps Spark from fusing them, which would store each text twice
    stored = documents.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), F.arrow_udf(_store, "binary")(F.col("text")).alias("media"))
    back = stored.withColumn("back", F.arrow_udf(_read_back, BACK)(F.coalesce("media", F.lit(b""))))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("back.payload").cast("long").alias("payload_bytes"), F.sha2("back.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("back.payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "back.feature", F.col("back.packets").alias("n_packets"), F.col("back.clusters").alias("n_clusters"), F.col("back.cues").alias("n_cues"), F.col("back.last_ms").alias("last_packet_ms"),
    )
