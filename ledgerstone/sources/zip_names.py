"""The central directory of a ZIP file, read from its tail: raw names, sizes, times and flags."""

from __future__ import annotations

import calendar
import io
import struct
import zlib
from typing import BinaryIO, NamedTuple

END, END64, LOCATOR, RECORD = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
END_SIZE, COMMENT_MAX = 22, 65_535
UTF8_FLAG, ENCRYPTED_FLAG, UNICODE_PATH, ZIP64 = 0x0800, 1, 0x7075, 1


class ZipRecord(NamedTuple):
    raw_name: bytes
    flags: int
    unicode_name: str | None
    size: int
    packed: int
    modified: int | None
    header: int


def _directory(f: BinaryIO, length: int) -> tuple[int, int, int]:
    """Number of records, and offset and size of the directory."""
    tail_at = max(0, length - END_SIZE - COMMENT_MAX)
    f.seek(tail_at)
    tail = f.read(length - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + END_SIZE or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (size, offset):
        back = at - 20
        if back < 0 or tail[back : back + 4] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", tail, back + 8)[0])
        end = f.read(56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 record")
        count, size, offset = struct.unpack_from("<QQQ", end, 32)
    if offset + size > length:
        raise ValueError("the central directory passes the end of the file")
    return count, offset, size


def _extra(data: bytes, raw: bytes) -> tuple[str | None, bytes]:
    """The Unicode path, if its checksum fits the raw name; and the ZIP64 field."""
    name, wide, at = None, b"", 0
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        if kind == UNICODE_PATH and len(body) > 5 and body[0] == 1 and struct.unpack_from("<I", body, 1)[0] == zlib.crc32(raw):
            name = body[5:].decode("utf8", "replace")
        elif kind == ZIP64:
            wide = body
        at += 4 + n
    return name, wide


def records(f: BinaryIO) -> list[ZipRecord]:
    length = f.seek(0, io.SEEK_END)
    count, offset, size = _directory(f, length)
    f.seek(offset)
    data, at, out = f.read(size), 0, []
    for _ in range(count):
        if data[at : at + 4] != RECORD or at + 46 > len(data):
            raise ValueError("a record of the central directory is damaged")
        flags, _, time, date, _, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<HHHHIIIHHH", data, at + 8)
        header = struct.unpack_from("<I", data, at + 42)[0]
        raw = data[at + 46 : at + 46 + n_name]
        name, wide = _extra(data[at + 46 + n_name : at + 46 + n_name + n_extra], raw)
        longs = list(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
        if full == 0xFFFFFFFF and longs:
            full = longs.pop(0)
        if packed == 0xFFFFFFFF and longs:
            packed = longs.pop(0)
        if header == 0xFFFFFFFF and longs:
            header = longs.pop(0)
        parts = ((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
        modified = calendar.timegm((*parts, 0, 0, 0)) if 1 <= parts[1] <= 12 and 1 <= parts[2] <= 31 else None
        out.append(ZipRecord(raw, flags, name, full, packed, modified, header))
        at += 46 + n_name + n_extra + n_comment
    return out
