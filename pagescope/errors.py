"""Errors of reading Parquet files; their class names are what relations report in `error_class`."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class ParquetError(ValueError):
    """Any fault of a file's contents."""


class CorruptFile(ParquetError):
    """Bytes that contradict the format."""


class BadMagic(CorruptFile):
    """The file doesn't start or end with the magic bytes."""


class ThriftError(CorruptFile):
    """A Thrift record can't be read."""


class Shortfall(ThriftError):
    """A record goes on for at least `missing` bytes after the bytes at hand."""

    def __init__(self, missing: int):
        super().__init__(f"the record needs {missing} more bytes")
        self.missing = missing


class Unsupported(ParquetError):
    """Something that the format allows and this engine doesn't read."""


class UnsupportedCodec(Unsupported):
    def __init__(self, codec: str):
        super().__init__(f"codec {codec} can't be read here")
        self.codec = codec


@contextmanager
def reading(what: str) -> Iterator[None]:
    """Low-level errors leave as CorruptFile that says what was being read; typed ones pass."""
    try:
        yield
    except ParquetError:
        raise
    except (ValueError, IndexError, KeyError, TypeError, OverflowError, UnicodeDecodeError, EOFError, RecursionError, MemoryError) as error:
        raise CorruptFile(f"{what}: {type(error).__name__}: {error}") from error
