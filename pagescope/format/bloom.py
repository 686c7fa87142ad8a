"""Split-block bloom filters: xxHash64 and probes."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

from ..errors import Unsupported

#: Multipliers of the eight bit choices (public format specification). Fixed values.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BLOCK_BYTES = 32
#: Primes of xxHash64 (public algorithm). Fixed values.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_ALL = (1 << 64) - 1


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _ALL


def _round(lane: int, word: int) -> int:
    return _turn((lane + word * P2) & _ALL, 31) * P1 & _ALL


def xxh64(data: bytes, seed: int = 0) -> int:
    """xxHash64, unsigned."""
    at, n = 0, len(data)
    if n >= 32:
        lanes = [(seed + P1 + P2) & _ALL, (seed + P2) & _ALL, seed & _ALL, (seed - P1) & _ALL]
        stripes = n // 32
        for words in struct.iter_unpack("<4Q", data[: stripes * 32]):
            lanes = [_round(lane, word) for lane, word in zip(lanes, words, strict=True)]
        at = stripes * 32
        h = sum(_turn(lane, k) for lane, k in zip(lanes, (1, 7, 12, 18), strict=True)) & _ALL
        for lane in lanes:
            h = ((h ^ _round(0, lane)) * P1 + P4) & _ALL
    else:
        h = (seed + P5) & _ALL
    h = (h + n) & _ALL
    while at + 8 <= n:
        h = (_turn(h ^ _round(0, int.from_bytes(data[at : at + 8], "little")), 27) * P1 + P4) & _ALL
        at += 8
    if at + 4 <= n:
        h = (_turn(h ^ int.from_bytes(data[at : at + 4], "little") * P1 & _ALL, 23) * P2 + P3) & _ALL
        at += 4
    for byte in data[at:]:
        h = _turn(h ^ byte * P5 & _ALL, 11) * P1 & _ALL
    h = (h ^ h >> 33) * P2 & _ALL
    h = (h ^ h >> 29) * P3 & _ALL
    return h ^ h >> 32


def encode(value: Any, kind: str) -> bytes:
    """A value as PLAIN writes it, without the length of byte strings."""
    if kind in ("INT32", "INT64") and isinstance(value, int) and not isinstance(value, bool):
        return value.to_bytes(4 if kind == "INT32" else 8, "little", signed=True)
    if kind in ("FLOAT", "DOUBLE"):
        return struct.pack("<f" if kind == "FLOAT" else "<d", value)
    if kind in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") and isinstance(value, (str, bytes, bytearray)):
        return value.encode() if isinstance(value, str) else bytes(value)
    raise Unsupported(f"a bloom probe of {type(value).__name__} in a column of type {kind}")


def explain(bitset: bytes, value: Any, kind: str) -> dict[str, Any]:
    """How a lookup goes: the hash, the block its upper half selects, and eight bits of it that its lower half does."""
    h = xxh64(encode(value, kind))
    blocks = len(bitset) // BLOCK_BYTES
    block = (h >> 32) * blocks >> 32
    own = bitset[block * BLOCK_BYTES : (block + 1) * BLOCK_BYTES]
    bits = []
    for i, (salt, word) in enumerate(zip(SALTS, struct.unpack("<8I", own), strict=True)):
        bit = ((h & 0xFFFFFFFF) * salt & 0xFFFFFFFF) >> 27
        bits.append({"word_index": i, "bit_index": bit, "is_set": bool(word >> bit & 1)})
    return {"hash": h, "block_index": block, "num_blocks": blocks, "block_bytes": own, "bits": bits, "might_contain": all(b["is_set"] for b in bits)}


def might_contain(bitset: bytes, hashes: np.ndarray) -> np.ndarray:
    """Lookups of many hashes (uint64) at once."""
    words = np.frombuffer(bitset, "<u4").reshape(-1, 8)
    block = ((hashes >> np.uint64(32)) * np.uint64(len(words)) >> np.uint64(32)).astype(np.int64)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bit = (low[:, None] * np.array(SALTS, np.uint32)) >> np.uint32(27)
    return ((words[block] >> bit) & np.uint32(1)).all(1)
