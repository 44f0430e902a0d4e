"""Scalar functions on paths and names, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The suffixes by which an archive is known, and the names that devices have.
ARCHIVE_SUFFIXES = ("zip", "zipx", "7z", "rar", "tar", "gz", "bz2", "xz", "zst", "cab", "lha", "lzh", "tgz", "tbz2", "txz", "iso", "img")
RESERVED = r"^(CON|PRN|AUX|NUL|(COM|LPT)[1-9¹²³])$"
MENU_CHARS = 30
#: Extensions of the formats that can be written.
EXTENSIONS = {"Zip": "zip", "7z": "7z", "Tar": "tar", "TarGzip": "tar.gz", "TarXz": "tar.xz", "TarZstd": "tar.zst"}
LABELS = {"Zip": "ZIP", "7z": "7z", "Tar": "TAR", "TarGzip": "TAR.GZ", "TarXz": "TAR.XZ", "TarZstd": "TAR.ZST"}


def fold(c: Column) -> Column:
    """A-Z as a-z, all else as it is; lower() would fold other letters too."""
    return F.translate(c, UPPER, LOWER)


def components(path: Column) -> Column:
    """The parts of a path between / or \\, without empty ones and dots."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))


def normalized(path: Column) -> Column:
    return F.array_join(components(path), "/")


def starts_with(parts: Column, prefix: Column) -> Column:
    """Whether an array of components begins with another; by component, so that dir isn't a prefix of dir2."""
    return F.slice(parts, F.lit(1), F.greatest(F.size(prefix), F.lit(0))) == prefix


def is_within(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies below it: by component, and A-Z count as a-z."""
    return starts_with(F.transform(components(path), fold), F.transform(components(folder), fold))


def built_path(display: Column) -> Column:
    """Parts at / and \\, without empty ones (dots stay); null where none is left."""
    parts = F.filter(F.split(display, r"[/\\]"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*+)[/\\]*+$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]*+[^/\\]*+[/\\]*+$", "")


def stem(name: Column) -> Column:
    """A name without its last extension; a leading dot doesn't begin one."""
    return F.when(name.rlike(r"^.+\.[^.]*$") & (name != ".."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(name: Column) -> Column:
    """What stands behind the last dot, unless the dot leads the name; null if there is none."""
    return F.when(name.rlike(r"^.+\.[^.]*$") & (name != ".."), F.regexp_extract(name, r"\.([^.]*)$", 1))


def is_executable(name: Column) -> Column:
    return name.rlike(r"(?i)\.(exe|ps1|bat|cmd)$")


def is_volume(name: Column) -> Column:
    """A numbered part of a split archive: .zip or .7z, then three digits or more."""
    return name.rlike(r"(?i)\.(zip|7z)\.[0-9]{3,}$")


def is_archive(name: Column) -> Column:
    return name.rlike(rf"(?i)\.({'|'.join(ARCHIVE_SUFFIXES)})$") | is_volume(name)


def is_archive_drop(name: Column) -> Column:
    """As is_archive, but by the true extension, so that a file called .zip has none."""
    return name.rlike(rf"(?i)^.+\.({'|'.join(ARCHIVE_SUFFIXES)})$") | is_volume(name)


def volume_base(name: Column) -> Column:
    return F.when(is_volume(name), F.regexp_replace(name, r"\.[0-9]+$", ""))


def volume_index(name: Column) -> Column:
    """The number of a split part (any base): at least three digits, 1 to 2**32 - 1; else null."""
    n = F.regexp_extract(name, r"\.([0-9]{3,})$", 1).try_cast("decimal(20,0)")
    return F.when((n > 0) & (n < 4294967296), n.cast("long"))


def volume_name(base: Column, index: Column) -> Column:
    digits = index.cast("string")
    return F.concat(base, F.lit("."), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def container_of(name: Column, head: Column) -> Column:
    """The container format by name where names decide, else by the first 8 bytes (binary); null if neither tells."""
    text = F.hex(F.substring(head, 1, 8))
    return (
        F.when(name.rlike(r"(?i)\.7z\.[0-9]{3,}$") & volume_index(name).isNotNull(), "SevenZipVolume").when(name.rlike(r"(?i)\.zip\.[0-9]{3,}$") & volume_index(name).isNotNull(), "ZipVolume")
        .when(name.rlike(r"(?i)^.+\.(iso|img)$"), "Iso").when(name.rlike(r"(?i)^.+\.(lha|lzh)$"), "Lzh")
        .when(text.startswith("377ABCAF271C"), "SevenZip").when(text.rlike("^504B(03|05|07)(04|06|08)"), "Zip")
        .when(text.startswith("526172211A0700"), "Rar4").when(text == "526172211A070100", "Rar5").when(text.rlike("^....2D6C68(3[0-7]|64)2D"), "Lzh")
    )


def filter_of(head: Column) -> Column:
    """The stream compression by the first bytes; null if there is none."""
    text = F.hex(F.substring(head, 1, 8))
    signs = {"1F8B": "gzip", "425A68": "bzip2", "FD377A585A00": "xz", "28B52FFD": "zstd", "04224D18": "lz4", "4C5A4950": "lzip", "1F9D": "compress"}
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for sign, name in signs.items():
        out = out.when(text.startswith(sign), name)
    return out


def is_wrapped_tar(name: Column) -> Column:
    return name.rlike(r"(?i)(\.tar\.gz|\.tgz)$")


def payload_name(name: Column) -> Column:
    """The name of the one file within a compressed stream; null if the name doesn't tell."""
    short = F.regexp_replace(name, r"(?i)\.(tgz|tbz2|txz)$", "")
    return F.when(name.rlike(r"(?i)\.(tgz|tbz2|txz)$"), F.when(short != "", F.concat(short, F.lit(".tar")))).when(name.rlike(r"(?i)^.+\.(gz|bz2|xz|zst|lz4|lz|z)$"), stem(name))


def directory_name(name: Column) -> Column:
    """The folder that an archive is extracted to."""
    base = F.coalesce(volume_base(name), name)
    tar = r"(?i)\.tar\.(zst|xz|gz|bz2)$"
    out = F.when(base.rlike(tar), F.regexp_replace(base, tar, "")).otherwise(stem(base))
    return F.when(F.coalesce(out, F.lit("")) == "", "extracted").otherwise(out)


def archive_name(first_source: Column, kind: str = "Zip") -> Column:
    own = stem(file_name(first_source))
    return F.concat(F.when(F.coalesce(own, F.lit("")) == "", "archive").otherwise(own), F.lit(f".{EXTENSIONS[kind]}"))


def suffixed(name: Column, index: Column) -> Column:
    """name_2.ext for index 2."""
    ext = extension(name)
    return F.concat(stem(name), F.lit("_"), index.cast("string"), F.coalesce(F.concat(F.lit("."), ext), F.lit("")))


def compression_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?i)(\.zip|\.7z)$", 1)


def menu_name(name: Column, suffix: Column | None = None) -> Column:
    """At most MENU_CHARS characters: the head, an ellipsis and the suffix that stays visible."""
    suffix = F.lit("") if suffix is None else suffix
    return F.when(F.char_length(name) <= MENU_CHARS, name).otherwise(F.concat(F.substr(name, F.lit(1), F.lit(MENU_CHARS - 1) - F.char_length(suffix)), F.lit("…"), suffix))


def loosely_matches(pattern: Column, candidate: Column) -> Column:
    """? stands for any one character; both in Unicode lower case."""
    safe = F.regexp_replace(F.lower(pattern), r"([\\%_])", r"\\$1")
    return F.like(F.lower(candidate), F.replace(safe, F.lit("?"), F.lit("_")))


def invalid_component(c: Column) -> Column:
    """Whether a component isn't a valid file name: bad characters, a blank or dot at its end, or a device's name."""
    head = F.upper(F.regexp_extract(F.regexp_replace(c, "[ .]+$", ""), r"^([^.]*)", 1))
    return (c == "") | c.rlike(r"[ .]$") | c.rlike(r'[\x00-\x1f<>:"|?*]') | head.rlike(RESERVED)


def unsafe_reason(path: Column) -> Column:
    """Why an entry's path may not be written below a folder: empty, absolute, drive, parent or component; null if it may.

    Both separators count, as on Windows, wherever this runs.
    """
    parts = components(path)
    own = F.filter(F.split(path, r"[/\\]"), lambda p: (p != "") & (p != "."))
    return (
        F.when(path == "", "empty").when(path.rlike(r"^[/\\]"), "absolute").when(path.rlike(r"^[A-Za-z]:"), "drive")
        .when(F.exists(own, lambda p: p == ".."), "parent").when(F.size(parts) == 0, "empty").when(F.exists(own, invalid_component), "component")
    )


def quoted_argument(c: Column) -> Column:
    """A command-line argument quoted for Windows: backslashes double before a quote and at the end."""
    inside = F.regexp_replace(F.regexp_replace(c, r'(\\*)"', r'$1$1\\"'), r"(\\+)$", r"$1$1")
    return F.concat(F.lit('"'), inside, F.lit('"'))
