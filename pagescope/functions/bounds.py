"""Whether bounds of a column leave room for values of a range, by physical and logical type; on the JVM.

Each order that the format defines has a key: an expression over a bound's bytes that compares as the values do, and a
Python function that gives the same key of a value. Bounds without a known order, of odd lengths or of NaN, and ranges
whose values don't fit the column's type, exclude nothing."""

from __future__ import annotations

import datetime
import decimal
import math
import struct
import uuid
from collections.abc import Callable
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logical import deprecated, max_bytes, min_bytes

_EPOCH = datetime.datetime(1970, 1, 1)
_PER_SECOND = {"MILLIS": 1_000, "MICROS": 1_000_000, "NANOS": 1_000_000_000}
#: Bytes that a big-endian number is widened to before it is compared.
_WIDE = 32
_INT_RANGE = 1 << 63


class _Unfit(Exception):
    """The value is of another kind than the column."""


def _whole(value: Fraction, up: bool) -> int:
    return math.ceil(value) if up else math.floor(value)


def _number(value: Any) -> Fraction:
    if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal)):
        raise _Unfit
    if isinstance(value, (float, decimal.Decimal)) and not math.isfinite(value):
        raise _Unfit
    return Fraction(value)


def _seconds(value: datetime.datetime) -> Fraction:
    if value.tzinfo is not None:
        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    gap = value - _EPOCH
    return Fraction(gap.days * 86_400 + gap.seconds) + Fraction(gap.microseconds, 1_000_000)


def _int_key(value: Any, up: bool) -> int:
    return _whole(_number(value), up)


def _date_key(value: Any, up: bool) -> int:
    if isinstance(value, datetime.datetime):
        return _whole(_seconds(value) / 86_400, up)
    if isinstance(value, datetime.date):
        return (value - _EPOCH.date()).days
    return _int_key(value, up)


def _stamp_key(unit: str) -> Callable[[Any, bool], int]:
    def key(value: Any, up: bool) -> int:
        if isinstance(value, datetime.datetime):
            return _whole(_seconds(value) * _PER_SECOND[unit], up)
        if isinstance(value, datetime.date):
            return (value - _EPOCH.date()).days * 86_400 * _PER_SECOND[unit]
        return _int_key(value, up)

    return key


def _time_key(unit: str) -> Callable[[Any, bool], int]:
    def key(value: Any, up: bool) -> int:
        if isinstance(value, datetime.time):
            seconds = value.hour * 3600 + value.minute * 60 + value.second
            return _whole((Fraction(seconds) + Fraction(value.microsecond, 1_000_000)) * _PER_SECOND[unit], up)
        return _int_key(value, up)

    return key


def _unscaled(scale: int) -> Callable[[Any, bool], int]:
    return lambda value, up: _whole(_number(value) * 10**scale, up)


def _clamped(key: Callable[[Any, bool], int]) -> Callable[[Any, bool], int]:
    """Keys of longs: what lies beyond them is taken to their ends, where it keeps its order to every bound."""
    return lambda value, up: max(-_INT_RANGE, min(_INT_RANGE - 1, key(value, up)))


def _float_key(size: int) -> Callable[[Any, bool], int]:
    """Place of a number in the order of floats: its bits, those of negative ones turned. Zeros of either sign are as
    low, or as high, as zeros can be, as bounds may have either sign, too."""

    def key(value: Any, up: bool) -> int:
        if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal)) or math.isnan(value):
            raise _Unfit
        top, form, same = {2: (1 << 15, "<e", "<H"), 4: (1 << 31, "<f", "<I"), 8: (1 << 63, "<d", "<Q")}[size]
        try:
            (near,) = struct.unpack(form, struct.pack(form, float(value)))
        except (OverflowError, struct.error):
            near = math.inf if value > 0 else -math.inf
        if near == 0:
            near = -0.0 if up else 0.0
        (bits,) = struct.unpack(same, struct.pack(form, near))
        place = bits if bits < top else top - 1 - bits
        if math.isinf(near):
            return place
        return place + (up and near < value) - (not up and near > value)

    return key


def _bytes_key(value: Any, up: bool) -> bytes:  # noqa: ARG001
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, uuid.UUID):
        return value.bytes
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    raise _Unfit


def _wide_key(scale: int) -> Callable[[Any, bool], str]:
    def key(value: Any, up: bool) -> str:
        number = _unscaled(scale)(value, up)
        most = 1 << (8 * _WIDE - 1)
        number = max(-most, min(most - 1, number))
        return ("1" if number >= 0 else "0") + f"{number % (2 * most):0{2 * _WIDE}X}"

    return key


def _bool_key(value: Any, up: bool) -> int:  # noqa: ARG001
    if not isinstance(value, bool):
        raise _Unfit
    return int(value)


def _turned(raw: Column, size: int) -> Column:
    """The first `size` bytes, last one first."""
    return F.concat(*[F.substring(raw, i, 1) for i in range(size, 0, -1)])


def _signed(raw: Column, size: int) -> Column:
    """Little-endian bytes as a number; null for another number of bytes."""
    whole = F.conv(F.hex(_turned(raw, size)), 16, -10).cast("long")
    top = 1 << (8 * size - 1)
    return F.when(F.octet_length(raw) == size, whole if size == 8 else F.when(whole >= top, whole - 2 * top).otherwise(whole))


def _unsigned(raw: Column, size: int) -> Column:
    return F.when(F.octet_length(raw) == size, F.conv(F.hex(_turned(raw, size)), 16, 10).cast("decimal(20,0)"))


def _float(raw: Column, size: int) -> Column:
    """As _float_key; null for NaN, whose place is undefined."""
    top = 1 << (8 * size - 1)
    infinite = {2: 0x7C00, 4: 0x7F800000, 8: 0x7FF0000000000000}[size]
    bits = _signed(raw, size)
    if size == 8:
        least = F.lit(-top)
        place = F.when(bits >= 0, bits).otherwise(F.lit(-1) - (bits - least))
    else:
        place = F.when(bits >= 0, bits).otherwise(-1 - (bits + top))
    return F.when((place <= infinite) & (place >= -infinite - 1), place)


def _wide(raw: Column) -> Column:
    text, size = F.hex(raw), 2 * _WIDE
    negative = F.substring(text, 1, 1) >= "8"
    widened = F.when(negative, F.concat(F.lit("0"), F.lpad(text, size, "F"))).otherwise(F.concat(F.lit("1"), F.lpad(text, size, "0")))
    return F.when((F.octet_length(raw) > 0) & (F.octet_length(raw) <= _WIDE), widened)


def _signed_key(logical: dict[str, Any] | None) -> Callable[[Any, bool], int] | None:
    name = logical["name"] if logical else None
    if name in (None, "INTEGER"):
        return _clamped(_int_key)
    if name == "DATE":
        return _clamped(_date_key)
    if name in ("TIMESTAMP", "TIME"):
        return _clamped((_stamp_key if name == "TIMESTAMP" else _time_key)(logical["unit"]))
    return _clamped(_unscaled(logical["scale"] or 0)) if name == "DECIMAL" else None


def _unsigned_key(value: Any, up: bool) -> decimal.Decimal:
    return decimal.Decimal(max(-1, min(1 << 64, _int_key(value, up))))


def order_of(kind: str, logical: dict[str, Any] | None) -> tuple[Callable[[Column], Column], Callable[[Any, bool], Any]] | None:
    """The key of a bound's bytes and the key of a value: the least one from it on (True), or the last one up to it. None
    where the format defines no order (INT96, INTERVAL, geometries), or this module doesn't know it."""
    name = logical["name"] if logical else None
    if kind == "BOOLEAN":
        return lambda raw: _signed(raw, 1), _bool_key
    if kind in ("INT32", "INT64"):
        size = 4 if kind == "INT32" else 8
        if name == "INTEGER" and logical["is_signed"] is False:
            return lambda raw: _unsigned(raw, size), _unsigned_key
        of = _signed_key(logical)
        return of and (lambda raw: _signed(raw, size), of)
    if kind in ("FLOAT", "DOUBLE") and name is None or name == "FLOAT16" and kind == "FIXED_LEN_BYTE_ARRAY":
        size = {"FLOAT": 4, "DOUBLE": 8}.get(kind, 2)
        return lambda raw: _float(raw, size), _float_key(size)
    if name == "DECIMAL" and kind in ("FIXED_LEN_BYTE_ARRAY", "BYTE_ARRAY"):
        return _wide, _wide_key(logical["scale"] or 0)
    if kind == "BYTE_ARRAY" and name in (None, "STRING", "ENUM", "JSON", "BSON") or kind == "FIXED_LEN_BYTE_ARRAY" and name in (None, "UUID"):
        return lambda raw: raw, _bytes_key
    return None


def _outside(low_bytes: Column, high_bytes: Column, kind: str, logical: dict[str, Any] | None, low: Any, high: Any) -> Column:
    order = order_of(kind, logical)
    if order is None:
        return F.lit(False)
    key, of = order
    is_float = kind in ("FLOAT", "DOUBLE") or bool(logical) and logical["name"] == "FLOAT16"
    found = F.lit(False)
    for limit, raw, up in ((low, high_bytes, True), (high, low_bytes, False)):
        if limit is None or is_float and high is None:
            continue
        try:
            wanted = of(limit, up)
        except _Unfit:
            continue
        told = F.lit(wanted).cast("decimal(20,0)") if isinstance(wanted, decimal.Decimal) else F.lit(wanted)
        found |= F.coalesce(key(raw) < told if up else key(raw) > told, F.lit(False))
    return found


Kind = tuple[str, dict[str, Any] | None]


def kinds_of(rows: DataFrame) -> list[Kind]:
    """Physical and logical types among rows of chunks: a few, whatever the number of files."""
    found = rows.select("type", "logical_type").distinct().collect()
    return [(r["type"], r["logical_type"] and r["logical_type"].asDict()) for r in found]


def is_of(kind: str, logical: dict[str, Any] | None) -> Column:
    """Whether a row's columns type and logical_type are these, as far as the order depends on them."""
    own = (F.col("type") == kind) & F.col("logical_type.name").eqNullSafe(logical and logical["name"])
    for part in ("unit", "scale", "is_signed"):
        own &= F.col(f"logical_type.{part}").eqNullSafe(logical and logical[part])
    return own


def ordered_kinds(rows: DataFrame) -> list[tuple[Column, Callable[[Column], Column]]]:
    """For each type among rows of chunks that has a known order: which rows are of it, and the key of a bound's bytes."""
    found = [(is_of(kind, logical), order_of(kind, logical)) for kind, logical in kinds_of(rows)]
    return [(own, order[0]) for own, order in found if order]


def may_hold(low_bytes: Column, high_bytes: Column, kinds: list[Kind], low: Any, high: Any, trusted: Column | None = None) -> Column:
    """Whether rows with columns type and logical_type, among `kinds`, and with these bounds can hold a value in low..high
    (None: no limit). Bounds of bytes that are not `trusted` exclude nothing: the order of deprecated ones is undefined.

    Ranges are of the values as people see them: numbers, decimals, dates, timestamps (naive: as stored), times, text,
    bytes, UUIDs; temporal columns take stored numbers, too. NaN is in no range that has an upper limit; without one a
    range has it, and columns of floats, whose bounds leave NaN out, may hold it."""
    if not kinds:
        return F.lit(True)
    outside = None
    for kind, logical in kinds:
        own = is_of(kind, logical)
        excluded = _outside(low_bytes, high_bytes, kind, logical, low, high)
        if trusted is not None and kind in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
            excluded &= trusted
        outside = F.when(own, excluded) if outside is None else outside.when(own, excluded)
    return ~outside.otherwise(False)


def chunks_that_may_hold(chunks: DataFrame, low: Any, high: Any) -> DataFrame:
    """Chunks of any types that can hold a value in low..high by their statistics. A chunk of nulls only has no bounds
    and holds no value."""
    s = F.col("statistics")
    only_nulls = F.coalesce(s["null_count"] == F.col("num_values"), F.lit(False))
    old = F.coalesce(deprecated(s), F.lit(False))
    return chunks.where(~only_nulls & may_hold(min_bytes(s), max_bytes(s), kinds_of(chunks), low, high, ~old))
