"""Value and level encodings as numpy and Arrow operations on whole pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..errors import CorruptFile, Unsupported

_FIXED = {"INT32": np.dtype("<i4"), "INT64": np.dtype("<i8"), "FLOAT": np.dtype("<f4"), "DOUBLE": np.dtype("<f8")}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptFile("a number in a page ends early")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _zigzag(data: bytes, at: int) -> tuple[int, int]:
    n, at = _varint(data, at)
    return (n >> 1) ^ -(n & 1), at


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """`count` numbers of `width` bits each, lowest bits first, as uint64."""
    if not width or not count:
        return np.zeros(count, np.uint64)
    need = (width * count + 7) // 8
    if len(data) < need:
        raise CorruptFile("packed numbers end early")
    raw = np.frombuffer(data, np.uint8, need)
    if width in (8, 16, 32, 64):
        return raw.view(f"<u{width // 8}").astype(np.uint64)
    bits = np.unpackbits(raw, bitorder="little", count=width * count).reshape(count, width)
    padded = np.zeros((count, 64), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def hybrid(data: bytes, at: int, end: int, width: int, count: int) -> np.ndarray:
    """RLE / bit-packing hybrid: `count` numbers from data[at:end]."""
    if width > 32:
        raise CorruptFile(f"numbers of {width} bits")
    out = np.empty(count, np.int64)
    done, size = 0, (width + 7) // 8
    while done < count:
        if at >= end:
            raise CorruptFile(f"{done} of {count} numbers in a page")
        header, at = _varint(data, at)
        if header & 1:
            n = (header >> 1) * 8
            length = (header >> 1) * width
            here = min(n, count - done)
            body = data[at : min(at + length, end)]
            if len(body) < length:  # a writer may leave out padding at the end
                body = bytes(body) + bytes(length - len(body)) if len(body) * 8 >= here * width else body
            out[done : done + here] = unpack(body, width, here)
            at += length
        else:
            here = min(header >> 1, count - done)
            if not header >> 1:
                raise CorruptFile("a run of no numbers")
            if at + size > end:
                raise CorruptFile("a run without its number")
            out[done : done + here] = int.from_bytes(data[at : at + size], "little")
            at += size
        done += here
    return out


def bit_packed_levels(data: bytes, at: int, width: int, count: int) -> tuple[np.ndarray, int]:
    """The deprecated encoding of levels, highest bits first; and where it ends."""
    need = (width * count + 7) // 8
    if at + need > len(data):
        raise CorruptFile("levels end early")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, need, at), count=width * count).reshape(count, width)
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1)), at + need


def delta_binary_packed(data: bytes, at: int, bits: int) -> tuple[np.ndarray, int]:
    """All numbers of the stream, wrapped to `bits` bits, and where it ends."""
    block, at = _varint(data, at)
    minis, at = _varint(data, at)
    total, at = _varint(data, at)
    first, at = _zigzag(data, at)
    if not minis or block % minis or block // minis % 8:
        raise CorruptFile("blocks of deltas of odd sizes")
    if total > 64 * (len(data) + 1) * max(1, block):
        raise CorruptFile("more deltas than bytes could hold")
    per = block // minis
    steps = [np.array([first & (1 << 64) - 1], np.uint64)] if total else []
    left = total - 1
    while left > 0:
        low, at = _zigzag(data, at)
        widths = data[at : at + minis]
        at += minis
        if len(widths) < minis:
            raise CorruptFile("a block of deltas ends early")
        for width in widths:
            if left <= 0:
                break
            if width > 64:
                raise CorruptFile(f"deltas of {width} bits")
            length = per * width // 8
            here = min(per, left)
            steps.append(unpack(data[at : at + length], width, here) + np.uint64(low & (1 << 64) - 1))
            at += length
            left -= here
    values = np.cumsum(np.concatenate(steps), dtype=np.uint64) if steps else np.zeros(0, np.uint64)
    return (values.astype(np.uint32).view(np.int32) if bits == 32 else values.view(np.int64)), at


def _binary(lengths: np.ndarray, body: bytes | np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if len(lengths) and (lengths.min() < 0 or offsets[-1] > len(body)):
        raise CorruptFile("byte strings longer than their page")
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def delta_length_byte_array(data: bytes, at: int, count: int) -> pa.Array:
    lengths, at = delta_binary_packed(data, at, 32)
    return _binary(lengths[:count].astype(np.int64), data[at:])


def delta_byte_array(data: bytes, at: int, count: int) -> pa.Array:
    shared, at = delta_binary_packed(data, at, 32)
    lengths, at = delta_binary_packed(data, at, 32)
    if len(shared) != len(lengths):
        raise CorruptFile("as many prefixes as suffixes are needed")
    out, last = [], b""
    for keep, more in zip(shared[:count].tolist(), lengths[:count].tolist(), strict=True):
        if not 0 <= keep <= len(last) or more < 0 or at + more > len(data):
            raise CorruptFile("a prefix or suffix longer than there are bytes")
        last = last[:keep] + data[at : at + more]
        at += more
        out.append(last)
    return pa.array(out, pa.large_binary())


def plain(data: bytes, at: int, kind: str, length: int | None, count: int) -> pa.Array:
    """PLAIN values; fewer bytes than `count` values take are damage."""
    left = len(data) - at
    if kind in _FIXED:
        if left < count * _FIXED[kind].itemsize:
            raise CorruptFile(f"{left} bytes for {count} values of type {kind}")
        return pa.array(np.frombuffer(data, _FIXED[kind], count, at))
    if kind == "BOOLEAN":
        if left * 8 < count:
            raise CorruptFile(f"{left} bytes for {count} booleans")
        return pa.array(np.unpackbits(np.frombuffer(data, np.uint8, (count + 7) // 8, at), bitorder="little", count=count).astype(bool))
    if kind in ("INT96", "FIXED_LEN_BYTE_ARRAY"):
        size = 12 if kind == "INT96" else length
        if size is None or size < 0 or left < count * size:
            raise CorruptFile(f"{left} bytes for {count} values of {size} bytes")
        return _binary(np.full(count, size, np.int64), data[at : at + count * size])
    out, end = [], len(data)
    for _ in range(count):
        size = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + size > end:
            raise CorruptFile("a byte string longer than its page")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return pa.array(out, pa.large_binary())


def byte_stream_split(data: bytes, at: int, kind: str, length: int | None, count: int) -> pa.Array:
    size = _FIXED[kind].itemsize if kind in _FIXED else length
    if kind not in (*_FIXED, "FIXED_LEN_BYTE_ARRAY") or not size:
        raise Unsupported(f"BYTE_STREAM_SPLIT of {kind}")
    if len(data) - at < size * count:
        raise CorruptFile(f"{len(data) - at} bytes for {count} values of {size} bytes")
    rows = np.ascontiguousarray(np.frombuffer(data, np.uint8, size * count, at).reshape(size, count).T)
    if kind in _FIXED:
        return pa.array(rows.ravel().view(_FIXED[kind]))
    return _binary(np.full(count, size, np.int64), rows.ravel())


def values(data: bytes, at: int, encoding: str, kind: str, length: int | None, count: int, dictionary: pa.Array | None) -> pa.Array:
    """`count` physical values of a page from `at` on."""
    if not count:
        return plain(b"", 0, kind, length, 0)
    if encoding == "PLAIN":
        return plain(data, at, kind, length, count)
    if encoding in ("PLAIN_DICTIONARY", "RLE_DICTIONARY"):
        if dictionary is None:
            raise CorruptFile("dictionary indices without a dictionary")
        if at >= len(data):
            raise CorruptFile("dictionary indices without a width")
        index = hybrid(data, at + 1, len(data), data[at], count)
        if len(index) and (index.max() >= len(dictionary) or index.min() < 0):
            raise CorruptFile("a dictionary index beyond the dictionary")
        return dictionary.take(pa.array(index))
    if encoding == "RLE":
        if kind == "BOOLEAN":
            size = int.from_bytes(data[at : at + 4], "little")
            return pa.array(hybrid(data, at + 4, min(len(data), at + 4 + size), 1, count).astype(bool))
        if kind in ("INT32", "INT64"):
            return pa.array(hybrid(data, at + 1, len(data), data[at], count).astype(_FIXED[kind]))
        raise Unsupported(f"RLE of {kind}")
    if encoding == "DELTA_BINARY_PACKED" and kind in ("INT32", "INT64"):
        found, _ = delta_binary_packed(data, at, 32 if kind == "INT32" else 64)
        if len(found) < count:
            raise CorruptFile(f"{len(found)} of {count} values in a page")
        return pa.array(found[:count])
    if encoding == "DELTA_LENGTH_BYTE_ARRAY":
        found = delta_length_byte_array(data, at, count)
    elif encoding == "DELTA_BYTE_ARRAY":
        found = delta_byte_array(data, at, count)
    elif encoding == "BYTE_STREAM_SPLIT":
        found = byte_stream_split(data, at, kind, length, count)
    else:
        raise Unsupported(f"encoding {encoding} of {kind}")
    if len(found) < count:
        raise CorruptFile(f"{len(found)} of {count} values in a page")
    return found
