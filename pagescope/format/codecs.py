"""Decompression of page bodies. C libraries that Arrow brings do the work."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable

import pyarrow as pa

from ..errors import CorruptFile, UnsupportedCodec

#: Codecs that Arrow knows under another name.
_ARROW = {"SNAPPY": "snappy", "BROTLI": "brotli", "ZSTD": "zstd", "LZ4_RAW": "lz4_raw"}


def _gzip(data: bytes) -> bytes:
    """All members of a gzip stream, one after the other."""
    out = io.BytesIO()
    while data:
        member = zlib.decompressobj(zlib.MAX_WBITS | 32)
        out.write(member.decompress(data))
        out.write(member.flush())
        if not member.eof:
            raise CorruptFile("a gzip stream ends early")
        data = member.unused_data.lstrip(b"\0")
    return out.getvalue()


def _lz4_block(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def _lzo_block(data: bytes, size: int) -> bytes:
    """One block, by the optional library `lzo`."""
    try:
        import lzo
    except ImportError:
        raise UnsupportedCodec("LZO") from None
    try:
        return lzo.decompress(bytes(data), False, size)
    except lzo.error as error:
        raise OSError(str(error)) from error


def _framed(data: bytes, size: int, block: Callable[[bytes, int], bytes]) -> bytes:
    """Codecs of older writers: blocks that two big-endian lengths precede, or else one bare block."""
    at, parts = 0, []
    try:
        while at < len(data):
            whole, packed = (int.from_bytes(data[at + i : at + i + 4], "big") for i in (0, 4))
            if at + 8 + packed > len(data) or not whole:
                raise ValueError
            parts.append(block(data[at + 8 : at + 8 + packed], whole))
            at += 8 + packed
        found = b"".join(parts)
        if len(found) == size:
            return found
    except (ValueError, OSError):
        pass
    return block(data, size)


def decompress(data: bytes, codec: str, size: int) -> bytes:
    """data as `size` bytes; other results are damage."""
    try:
        if codec == "UNCOMPRESSED":
            found = bytes(data)
        elif not size and not data:
            found = b""
        elif codec == "GZIP":
            found = _gzip(bytes(data))
        elif codec == "LZ4":
            found = _framed(bytes(data), size, _lz4_block)
        elif codec == "LZO":
            found = _framed(bytes(data), size, _lzo_block)
        elif codec in _ARROW and pa.Codec.is_available(_ARROW[codec]):
            found = pa.Codec(_ARROW[codec]).decompress(data, size, asbytes=True) if size else b""
        else:
            raise UnsupportedCodec(codec)
    except (OSError, zlib.error, pa.ArrowException) as error:
        raise CorruptFile(f"a {codec} body can't be decompressed: {error}") from error
    if len(found) != size:
        raise CorruptFile(f"a body of {len(found)} bytes where {size} were declared")
    return found
