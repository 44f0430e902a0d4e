"""Legacy name encodings: detection and decoding of raw bytes, as Arrow functions.

Every detector reads bytes with one rule table: (lead bytes, trail bytes, points). The first rule that fits takes its bytes;
where none fits, one byte is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code pages, codecs, labels in markup and the byte ranges of the encodings.
CODEPAGES = {"Utf8": 65001, "Utf16Le": 1200, "Utf16Be": 1201, "Sjis": 932, "Iso2022Jp": 50220, "EucKr": 949, "Johab": 1361, "Gbk": 936, "Gb18030": 54936, "Big5": 950}
CODECS = {65001: "utf-8", 1200: "utf-16-le", 1201: "utf-16-be", 932: "cp932", 50220: "iso2022_jp", 949: "cp949", 1361: "johab", 936: "gbk", 54936: "gb18030", 950: "cp950"}
LABELS = {
    "shift_jis": "Sjis", "sjis": "Sjis", "x-sjis": "Sjis", "iso-2022-jp": "Iso2022Jp", "jis": "Iso2022Jp", "cp50220": "Iso2022Jp", "cp50221": "Iso2022Jp", "euc-kr": "EucKr", "cp949": "EucKr",
    "gbk": "Gbk", "gb2312": "Gbk", "cp936": "Gbk", "gb18030": "Gb18030", "cp54936": "Gb18030", "big5": "Big5", "cp950": "Big5", "big5-hkscs": "Big5", "utf-8": "Utf8", "utf8": "Utf8",
}
JOHAB_ONLY = r"[\x5b-\x60\x7b-\x7e]"
#: encoding: (regex of the bytes that a rule takes, points), in order.
RULES = {
    "Sjis": ((rb"[\xa1-\xdf](?=[\x00-\x7f])", 1), (rb"[\xa1-\xdf]", 0), (rb"[\x82\x83][\x40-\x7e\x80-\xfc]", 5), (rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]", 1)),
    "EucKr": ((rb"[\xb0-\xc8][\xa1-\xfe]", 5), (rb"[\xc9-\xfd][\xa1-\xfe]", -10)),
    "Johab": ((rb"[\x84-\xd3][\x5b-\x60\x7b-\x7e]", 3), (rb"[\x84-\xd3][\x41-\x7e\x81-\xfe]", 1)),
    "Gbk": ((rb"[\xc9-\xf7][\xa1-\xfe]", 5), (rb"[\xa1-\xc8][\xa1-\xfe]", 2), (rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]", 1)),
    "Gb18030": ((rb"[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]", 8), (rb"[\xb0-\xf7][\xa1-\xfe]", 2), (rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]", 1)),
    "Big5": ((rb"[\xa4-\xc6][\x40-\x7e]", 5), (rb"[\xa4-\xc6][\xa1-\xfe]", 2), (rb"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]", 1)),
}
_SCAN = {name: re.compile(b"|".join(b"(" + p + b")" for p, _ in rules), re.S) for name, rules in RULES.items()}
_JIS = re.compile(rb"\x1b(?:\$[@B]|\([BJI])")
_LENIENT_UTF8 = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*+\Z")
_CHARSET = re.compile(r"charset[=\"']?([a-z0-9_-]+)")
BOMS = ((b"\xef\xbb\xbf", "Utf8"), (b"\xff\xfe", "Utf16Le"), (b"\xfe\xff", "Utf16Be"))
HTML_HEAD, PROFILE_SAMPLE, LONG_TEXT = 2048, 128 * 1024, 16 * 1024


def score(data: bytes, encoding: str) -> int:
    points = [p for _, p in RULES[encoding]]
    return sum(points[m.lastindex - 1] for m in _SCAN[encoding].finditer(data))


def johab_marks(data: bytes) -> int:
    """Pairs whose second byte only Johab has."""
    return sum(m.lastindex == 1 for m in _SCAN["Johab"].finditer(data))


def _profile(data: bytes, codepage: int) -> tuple[int, int, int]:
    """Hangul, Chinese and bad characters of a decoded sample."""
    units = data[:PROFILE_SAMPLE].decode(CODECS[codepage], "replace")
    hangul = len(re.findall("[가-힣ᄀ-ᇿ㄰-㆏]", units))
    return hangul, len(re.findall("[一-鿿㐀-䶿]", units)), len(re.findall("[�?]", units))


def _korean(profile: tuple[int, int, int], least: int) -> bool:
    hangul, chinese, bad = profile
    return hangul >= least and chinese * 3 <= hangul and bad <= max(2, hangul // 6)


def _johab_wins(data: bytes, own: int, best: int, brief: bool) -> bool:
    """Whether Johab goes before a Chinese encoding of more points: by what the text is then or, where that shows no letters at
    all, by pairs that only Johab has, if it has three quarters of the points."""
    if any(profile := _profile(data, 1361)):
        return _korean(profile, 4 if brief else 16)
    marks = 1 if brief else 8 if len(data) >= LONG_TEXT else 2
    return johab_marks(data) >= marks and own * 4 >= best * 3


def detect(data: bytes) -> str:
    for sign, name in BOMS:
        if data.startswith(sign):
            return name
    if _JIS.search(data):
        return "Iso2022Jp"
    if _LENIENT_UTF8.match(data):
        return "Utf8"
    m = _CHARSET.search("".join(c.lower() if c.isascii() else c for c in data[:HTML_HEAD].decode("utf-8", "replace")))
    if m and m[1] in LABELS:
        return LABELS[m[1]]
    points = {name: score(data, name) for name in RULES}
    best, brief = max(points.values()), len(data) < 1024
    if best <= 0:
        return "Johab" if points["Johab"] > 0 or johab_marks(data) >= 2 else "EucKr"
    for name in ("EucKr", "Sjis"):
        if points[name] == best:
            return name
    if best in (points["Gbk"], points["Gb18030"], points["Big5"]):
        if points["Johab"] > 0 and _johab_wins(data, points["Johab"], best, brief):
            return "Johab"
        if points["EucKr"] > 0 and _korean(_profile(data, 949), 8 if brief else 32):
            return "EucKr"
    if points["Gb18030"] == best > points["Gbk"]:
        return "Gb18030"
    return next(name for name in ("Gbk", "Big5", "Johab") if points[name] == best)


def decode(data: bytes, codepage: int = 0) -> str:
    """Text of a raw name; code page 0 detects. Bytes that don't decode become U+FFFD."""
    if codepage == 0:
        if not _JIS.search(data):
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError:
                pass
        codepage = CODEPAGES[detect(data)]
    if codepage in (1200, 1201):
        data = data[: len(data) // 2 * 2]
        return data.decode(CODECS[codepage], "replace").removeprefix("﻿")
    try:
        return data.decode(CODECS.get(codepage, f"cp{codepage}"), "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def detect_encoding(raw: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in batches:
            yield pa.array([None if x is None else detect(x) for x in names.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(raw)


def decode_name(raw: Column, codepage: Column | int = 0) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, pages in batches:
            yield pa.array([None if x is None else decode(x, p or 0) for x, p in zip(names.to_pylist(), pages.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(raw, F.lit(codepage) if isinstance(codepage, int) else codepage)


def codepage_of(encoding: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CODEPAGES.items() for x in kv)), encoding)


def percent_decoded(text: Column) -> Column:
    """%XX as bytes; null where an escape or the UTF-8 is bad; + stays."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                if t is None or re.search("%(?![0-9A-Fa-f]{2})", t):
                    out.append(None)
                    continue
                raw = re.sub(rb"%(..)", lambda m: bytes([int(m[1], 16)]), t.encode())
                try:
                    out.append(raw.decode())
                except UnicodeDecodeError:
                    out.append(None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def dropped_path(text: Column) -> Column:
    """The path in a dropped text: its first line that isn't blank, as a file address or a quoted path."""
    first = F.regexp_extract(text, r"(?m)^[ \t]*(\S.*?)[ \t\r]*$", 1)
    address = F.replace(percent_decoded(F.regexp_replace(first, "^file:///", "")), F.lit("/"), F.lit("\\"))
    return F.when(first.startswith("file:///"), address).when(first.startswith("file://") | (first == ""), None).otherwise(F.regexp_replace(first, '^"+|"+$', ""))
