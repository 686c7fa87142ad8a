"""Physical values as logical ones: whole Arrow columns at once, and single values of statistics."""

from __future__ import annotations

import datetime
import decimal
import struct
import uuid
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Julian day of 1970-01-01. Fixed value.
EPOCH_JULIAN_DAY = 2440588
_PHYSICAL = {"BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "INT96": T.BinaryType(), "BYTE_ARRAY": T.BinaryType(), "FIXED_LEN_BYTE_ARRAY": T.BinaryType()}
_TEXT = ("STRING", "ENUM", "JSON")
_PER_SECOND = {"MILLIS": 1_000, "MICROS": 1_000_000, "NANOS": 1_000_000_000}


def spark_type(kind: str, logical: dict[str, Any] | None, compat: bool = False, apply: bool = True) -> T.DataType:
    """Type of the values of a column of physical type `kind`.

    Decimals keep their scale whatever stores them, unsigned integers are widened, timestamps are exact: adjusted ones
    TIMESTAMP, others TIMESTAMP_NTZ (nanoseconds: truncated to microseconds). TIME values are ISO text, UUIDs text.
    compat leaves decimals of integers and byte arrays and unsigned integers as they are stored."""
    plain = _PHYSICAL[kind]
    if not apply:
        return plain
    if kind == "INT96":
        return T.TimestampNTZType()
    name = logical["name"] if logical else None
    if name in _TEXT and kind == "BYTE_ARRAY":
        return T.StringType()
    if name == "DECIMAL" and (kind in ("FIXED_LEN_BYTE_ARRAY", "INT32", "INT64", "BYTE_ARRAY")) and not (compat and kind != "FIXED_LEN_BYTE_ARRAY"):
        return T.DecimalType(min(38, logical["precision"]), logical["scale"])
    if name == "DATE" and kind == "INT32":
        return T.DateType()
    if name == "TIME" and kind in ("INT32", "INT64") and not (compat and kind == "INT64"):
        return T.StringType()
    if name == "TIMESTAMP" and kind == "INT64":
        return T.TimestampType() if logical["is_adjusted_to_utc"] else T.TimestampNTZType()
    if name == "INTEGER" and logical["is_signed"] is False and not compat:
        return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[logical["bit_width"]]
    if name == "UUID" and kind == "FIXED_LEN_BYTE_ARRAY":
        return T.StringType()
    if name == "FLOAT16" and kind == "FIXED_LEN_BYTE_ARRAY":
        return T.FloatType()
    return plain


def _decimals(unscaled: list[int | None], logical: dict[str, Any]) -> pa.Array:
    kind = pa.decimal128(min(38, logical["precision"]), logical["scale"])
    with decimal.localcontext(decimal.Context(prec=60)):
        return pa.array([None if v is None else decimal.Decimal(v).scaleb(-logical["scale"]) for v in unscaled], kind)


def _iso_time(value: int, unit: str) -> str:
    per = _PER_SECOND[unit]
    seconds, part = divmod(value, per)
    text = f"{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    if not part:
        return text
    digits = len(str(per)) - 1
    return f"{text}.{part:0{digits}}" + "0" * max(0, 6 - digits)


def _bytes(found: pa.Array) -> list[bytes | None]:
    return found.to_pylist()


def convert(found: pa.Array, kind: str, logical: dict[str, Any] | None, compat: bool = False, apply: bool = True) -> pa.Array:
    """An Arrow column of physical values as the type that spark_type names."""
    target = spark_type(kind, logical, compat, apply)
    name = logical["name"] if logical else None
    if not apply:
        return found.cast(pa.binary()) if isinstance(target, T.BinaryType) else found
    if kind == "INT96":
        raw = [None if b is None else struct.unpack("<qi", b) for b in _bytes(found)]
        return pa.array([None if r is None else (r[1] - EPOCH_JULIAN_DAY) * 86_400_000_000 + r[0] // 1000 for r in raw], pa.int64()).cast(pa.timestamp("us"))
    if isinstance(target, T.StringType):
        if name == "UUID":
            return pa.array([None if b is None else str(uuid.UUID(bytes=b)) for b in _bytes(found)], pa.string())
        if name == "TIME":
            return pa.array([None if v is None else _iso_time(v, logical["unit"]) for v in found.to_pylist()], pa.string())
        return found.cast(pa.binary()).cast(pa.string())
    if isinstance(target, T.DecimalType):
        if name == "INTEGER":
            return pa.array([None if v is None else decimal.Decimal(v & (1 << 64) - 1) for v in found.to_pylist()], pa.decimal128(20, 0))
        whole = found.to_pylist()
        return _decimals([None if v is None else int.from_bytes(v, "big", signed=True) if isinstance(v, bytes) else v for v in whole], logical)
    if isinstance(target, T.DateType):
        return found.cast(pa.int32()).cast(pa.date32())
    if isinstance(target, (T.TimestampType, T.TimestampNTZType)):
        if logical["unit"] == "NANOS":
            micros = pa.array([None if v is None else v // 1000 for v in found.to_pylist()], pa.int64())
        else:
            micros = pc.multiply(found, pa.scalar(1000 if logical["unit"] == "MILLIS" else 1, pa.int64()))
        return micros.cast(pa.timestamp("us", "UTC" if isinstance(target, T.TimestampType) else None))
    if name == "INTEGER" and not compat and logical["is_signed"] is False:
        mask = (1 << logical["bit_width"]) - 1
        wide = {8: pa.int16(), 16: pa.int32(), 32: pa.int64()}[logical["bit_width"]]
        return pc.bit_wise_and(found.cast(pa.int64()), pa.scalar(mask, pa.int64())).cast(wide)
    if name == "FLOAT16" and isinstance(target, T.FloatType):
        return pa.array([None if b is None else struct.unpack("<e", b)[0] for b in _bytes(found)], pa.float32())
    return found.cast(pa.binary()) if isinstance(target, T.BinaryType) else found


def single(raw: bytes | None, kind: str) -> Any:
    """A statistic's bytes as a physical value; None for none. Numbers of too few bytes are None, too."""
    if raw is None:
        return None
    sizes = {"BOOLEAN": 1, "INT32": 4, "INT64": 8, "FLOAT": 4, "DOUBLE": 8, "INT96": 12}
    if kind in sizes and len(raw) < sizes[kind]:
        return None
    if kind == "BOOLEAN":
        return bool(raw[0])
    if kind in ("INT32", "INT64"):
        return int.from_bytes(raw[: sizes[kind]], "little", signed=True)
    if kind in ("FLOAT", "DOUBLE"):
        return struct.unpack("<f" if kind == "FLOAT" else "<d", raw[: sizes[kind]])[0]
    return bytes(raw)


def as_text(raw: bytes | None, kind: str, logical: dict[str, Any] | None) -> str | None:
    """A statistic as text, after its logical type; bytes that are no text as hex."""
    value = single(raw, kind)
    if value is None:
        return None
    arrow = {"BOOLEAN": pa.bool_(), "INT32": pa.int32(), "INT64": pa.int64(), "FLOAT": pa.float32(), "DOUBLE": pa.float64()}.get(kind, pa.large_binary())
    try:
        found = convert(pa.array([value], arrow), kind, logical)[0].as_py()
    except (ValueError, KeyError, struct.error, pa.ArrowException, OverflowError):
        found = value
    if isinstance(found, bytes):
        return found.hex()
    if isinstance(found, (datetime.datetime, datetime.date)):
        return found.isoformat(" ") if isinstance(found, datetime.datetime) else found.isoformat()
    if isinstance(found, float):
        return repr(float(np.float32(found))) if kind == "FLOAT" else repr(found)
    return str(found).lower() if isinstance(found, bool) else str(found)


@F.pandas_udf(T.StringType())
def stat_text(raw: pd.Series, kind: pd.Series, logical: pd.DataFrame) -> pd.Series:
    """as_text of each row's bytes."""
    known = [{k: v for k, v in x.items() if not pd.isna(v)} for x in logical.to_dict("records")]
    clean = [dict.fromkeys(logical) | {k: int(v) if k in ("bit_width", "scale", "precision") else v for k, v in x.items()} if x else None for x in known]
    return pd.Series([as_text(None if r is None else bytes(r), k, x) for r, k, x in zip(raw, kind, clean, strict=True)], dtype=object)


def min_bytes(statistics: Column) -> Column:
    """min_value, or the deprecated min where that is absent."""
    return F.coalesce(statistics["min_value"], statistics["min"])


def max_bytes(statistics: Column) -> Column:
    return F.coalesce(statistics["max_value"], statistics["max"])


def deprecated(statistics: Column) -> Column:
    """Whether only the deprecated bounds are there, whose order is not defined for byte strings."""
    return statistics["min_value"].isNull() & statistics["max_value"].isNull() & (statistics["min"].isNotNull() | statistics["max"].isNotNull())


def int_stat(raw: Column) -> Column:
    """Little-endian bytes of an INT32 or INT64 as long, without Python."""
    whole = F.conv(F.hex(_reversed(raw)), 16, -10).cast("long")
    return F.when(F.octet_length(raw) == 8, whole).when(F.octet_length(raw) == 4, F.when(whole >= (1 << 31), whole - (1 << 32)).otherwise(whole))


def _reversed(raw: Column) -> Column:
    """The bytes from the last to the first."""
    text = F.hex(raw)
    pairs = F.transform(F.sequence(F.octet_length(raw) - 1, F.lit(0), F.lit(-1)), lambda i: F.substring(text, 2 * i + 1, F.lit(2)))
    return F.when(F.octet_length(raw) > 0, F.unhex(F.array_join(pairs, "")))


def logical_type_of_converted(converted: Column) -> Column:
    """Name of the logical type that a converted type stands for."""
    direct = {"UTF8": "STRING", "MAP": "MAP", "MAP_KEY_VALUE": "MAP", "LIST": "LIST", "ENUM": "ENUM", "DECIMAL": "DECIMAL", "DATE": "DATE", "JSON": "JSON", "BSON": "BSON"}
    named = F.create_map(*[F.lit(x) for kv in direct.items() for x in kv])[converted]
    return F.coalesce(named, F.when(converted.startswith("TIME_"), "TIME").when(converted.startswith("TIMESTAMP_"), "TIMESTAMP").when(converted.rlike("^U?INT_"), "INTEGER"))
