"""Scalar functions on sizes, times and progress, as expressions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
FILETIME_EPOCH = 116_444_736_000_000_000  # 1970 in units of 100 ns since 1601
MB, GB = 1 << 20, 1 << 30
# The volume sizes offered, by their index, the thread settings, and markers in error messages.
VOLUME_SIZES = (None, 10 * MB, 50 * MB, 100 * MB, 300 * MB, 650 * MB, GB, 4 * GB, 23 * GB, 99_213_744_538)
THREADS = ("Auto", "4", "6", "8", "10", "16", "All")
PASSWORD_MARKERS = (
    "passphrase required", "passphrase is required", "password required", "password is required", "no passphrase", "no password", "incorrect passphrase", "incorrect password",
    "wrong passphrase", "wrong password", "invalid passphrase", "invalid password", "bad passphrase", "bad password",
)
ELEVATION_MARKERS = ("access is denied", "access denied", "permission denied", "eacces", "eperm", "operation not permitted", "0x80070005", "error 5", "error 13", "errno 13")
ELEVATION_CODES = (5, 1314)
CORRUPTION_MARKERS = ("bad lzh data", "data error", "truncated", "unexpected end", "invalid header", "checksum")
CORRUPTION_OPERATIONS = ("reading archive header", "reading archive entry data", "closing archive")


def _decimals(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def _scaled(size: Column, whole_from: float | None) -> Column:
    """size in the largest unit that keeps it at 1 or more; whole numbers from whole_from on, else one decimal, ties to even."""
    power = reduce(lambda acc, k: acc + F.when(size >= float(1 << 10 * k), 1).otherwise(0), range(1, len(UNITS)), F.lit(0))
    x = size.cast("double") / F.pow(F.lit(1024.0), power)
    # format_number groups thousands with commas and rounds half-even
    tenths = F.replace(_decimals(x, "0.0"), F.lit(","), F.lit(""))
    number = tenths if whole_from is None else F.when(x >= whole_from, F.replace(_decimals(x, "0"), F.lit(","), F.lit(""))).otherwise(tenths)
    return F.when(power == 0, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power + 1)))


def format_size(size: Column) -> Column:
    return F.when(size.isNull(), "").otherwise(_scaled(size, 100.0))


def compact_bytes(size: Column) -> Column:
    return _scaled(size, None)


def format_timestamp(seconds: Column, utc: bool = False) -> Column:
    """To the minute, in the session's time zone or UTC; empty for null."""
    if utc:
        at = F.call_function("dateadd", F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
        minutes = F.floor(F.pmod(seconds, F.lit(86400)) / 60).cast("int")
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" "), two(F.floor(minutes / 60)), F.lit(":"), two(minutes % 60)), F.lit(""))
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"), F.lit(""))


def format_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    hours, minutes = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long")
    return F.when(seconds.isNull(), "—").otherwise(F.concat_ws(":", two(hours), two(minutes), two(whole % 60)))


def to_filetime(seconds: Column) -> Column:
    return seconds * 10_000_000 + FILETIME_EPOCH


def from_filetime(filetime: Column) -> Column:
    return F.floor((filetime - FILETIME_EPOCH).cast("decimal(20,0)") / 10_000_000).cast("long")


def volume_size(index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("long") for x in VOLUME_SIZES)), F.when(index >= len(VOLUME_SIZES), 0).otherwise(F.greatest(index, F.lit(0))) + 1)


def thread_setting(index: Column) -> Column:
    """The name of a thread setting by its index; one below 0 counts as 0, one beyond the end is the first."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, THREADS)), F.greatest(index, F.lit(0)) + 1), F.lit(THREADS[0]))


def boundaries_hold(*at: Column) -> Column:
    """Whether column boundaries, as shares of the width, rise strictly between 0 and 1. Null and NaN don't."""
    pairs = zip((F.lit(0.0), *at), (*at, F.lit(1.0)), strict=True)
    return F.coalesce(reduce(lambda x, y: x & y, (a < b for a, b in pairs)), F.lit(False))


def stream_buffer(size: Column) -> Column:
    return F.least(F.greatest(size, F.lit(4096)), F.lit(MB))


def _says(message: Column, markers: tuple[str, ...]) -> Column:
    low = F.translate(message, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in markers)), F.lit(False))


def is_password_error(message: Column) -> Column:
    return _says(message, PASSWORD_MARKERS)


def needs_elevation(message: Column, code: Column | None = None) -> Column:
    told = _says(message, ELEVATION_MARKERS)
    return told if code is None else told | F.coalesce(code.isin(*ELEVATION_CODES), F.lit(False))


def is_recoverable(operation: Column, message: Column) -> Column:
    return operation.isin(*CORRUPTION_OPERATIONS) & _says(message, CORRUPTION_MARKERS)


def fraction(phase: Column, done: Column, total: Column, entries: Column, all_entries: Column) -> Column:
    """Share of an operation that is done, by bytes if their total is known, else by entries; 1 when finished."""
    share = lambda a, b: F.least(F.greatest(a.cast("double") / b, F.lit(0.0)), F.lit(1.0))
    return F.when(phase == "Finished", 1.0).when(total > 0, share(done, total)).when(all_entries > 0, share(entries, all_entries)).otherwise(0.0).cast("float")


def file_fraction(done: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).when(total > 0, F.least(F.greatest(done.cast("double") / total, F.lit(0.0)), F.lit(1.0))).cast("float")


def remaining(elapsed: Column, share: Column, phase: Column) -> Column:
    """Estimated seconds that are left; null if there is no estimate."""
    done = (phase == "Finished") | (share >= 1)
    left = elapsed / F.when(share > 0, share.cast("double")) - elapsed
    return F.when(done, 0.0).when(left >= 0, left)


def operation_bytes(reported: Column, base: Column, total: Column) -> Column:
    """Operation-wide bytes from a counter that may or may not restart with each file, as (all, current)."""
    own = F.when(reported >= base, reported - base).otherwise(reported)
    own = F.when(total.isNull(), own).otherwise(F.least(own, total))
    return F.struct((base + own).alias("all_bytes"), own.alias("file_bytes"))


def rescaled(done: Column, handler_total: Column, source_total: Column) -> Column:
    """A handler's progress on the scale of the sources, exact."""
    d = lambda c: c.cast("decimal(20,0)")
    product = d(F.least(done, handler_total)) * d(source_total)
    return F.when(handler_total > 0, ((product - product % d(handler_total)) / d(handler_total)).cast("long"))  # a plain quotient is rounded


def percent(share: Column) -> Column:
    return F.when(share.isNull() | (share < 0), "—%").otherwise(F.concat(_decimals(share.cast("double") * 100, "0"), F.lit("%")))
