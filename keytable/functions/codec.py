"""Composite string keys: encoding, padding, Base64, transforms, decoding.

Everything here builds Columns; nothing runs. Null parts become empty text and keep
their separators, which is why parts are coalesced before they are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "__"

ColumnFunction = Callable[[Column], Column]


@dataclass(frozen=True)
class Padding:
    """A part padded to ``length`` with the first character of the separator."""

    length: int
    side: str = "left"


def pad(part: Column, padding: Padding, separator: str = SEPARATOR) -> Column:
    """Padded text; longer values stay whole (``lpad`` alone would cut them)."""
    fill = F.lpad if padding.side == "left" else F.rpad
    return F.when(F.length(part) >= padding.length, part).otherwise(fill(part, padding.length, separator[0]))


def unpad(part: Column, padding: Padding, separator: str = SEPARATOR) -> Column:
    """A padded part without its fill characters."""
    fill = separator[0]
    return F.ltrim(part, F.lit(fill)) if padding.side == "left" else F.rtrim(part, F.lit(fill))


def base64_text(part: Column) -> Column:
    """Base64 of the UTF-8 bytes on one line."""
    return F.regexp_replace(F.base64(F.encode(part, "UTF-8")), "[\\r\\n]", "")


def unbase64_text(part: Column) -> Column:
    return F.decode(F.unbase64(part), "UTF-8")


def as_text(part: Column, kind: T.DataType | None = None) -> Column:
    """A value as key text: booleans and numbers as they print, timestamps as ISO in
    microseconds, binary as upper-case hex."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(part, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.hex(part)
    return part.cast("string")


def encode_part(part: Column, kind: T.DataType | None = None, *, transform: ColumnFunction | None = None, padding: Padding | None = None, encoder: ColumnFunction | None = None, separator: str = SEPARATOR) -> Column:
    """One key part: transform, text, then padding or else encoder; null is empty."""
    text = as_text(transform(part) if transform else part, None if transform else kind)
    text = F.coalesce(text, F.lit(""))
    if padding:
        return pad(text, padding, separator)
    return F.coalesce(encoder(text), F.lit("")) if encoder else text


def join_parts(parts: Sequence[Column], separator: str = SEPARATOR) -> Column:
    """Encoded parts as one key."""
    return F.concat_ws(separator, *parts) if parts else F.lit("")


def split_parts(key: Column, n: int, separator: str = SEPARATOR) -> list[Column]:
    """The parts of a key; the last one keeps any further separators."""
    if n == 1:
        return [key]
    pieces = F.split(key, "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in separator), n)
    return [F.get(pieces, F.lit(i)) for i in range(n)]


def parse_part(text: Column, kind: T.DataType) -> Column:
    """A decoded part in its type: text, whole numbers or identifiers; empty is null."""
    if not isinstance(kind, (T.StringType, T.IntegerType, T.LongType, T.ShortType)):
        raise TypeError(f"keys of type {kind.simpleString()} can't be decoded")
    return F.nullif(text, F.lit("")).cast(kind)


def reverse_minute(ts: Column) -> Column:
    """Ticks of 100 ns from the minute of a timestamp to the last representable instant,
    with a leading 0: later minutes sort first."""
    last = 3155378975999999999  # 9999-12-31T23:59:59.9999999 in ticks from year 1
    epoch = 621355968000000000  # 1970-01-01 in ticks from year 1
    minute = 600000000
    left = F.lit(last - epoch) - F.unix_micros(ts.cast("timestamp")) * 10
    return F.concat(F.lit("0"), (left - F.pmod(left, F.lit(minute))).cast("string"))


def successor(prefix: str) -> str:
    """The prefix with its last character moved on by one: the end of a prefix range in
    a rendered filter. (Plans use ``startswith``, which needs no such end.)"""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else ""
