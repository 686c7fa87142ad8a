"""Bloom lookups as columns; all of it is the JVM's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..format.bloom import P1, P2, P4, P5, SALTS

#: Seed that the engine's own hash function starts with. Fixed value.
ENGINE_SEED = 42
_ALL = (1 << 64) - 1


def _opening() -> int:
    """The long whose hash from ENGINE_SEED is 0, as a signed number: each step of the hash of eight bytes can be undone.
    Hashed before another value, it makes that value's hash the one of seed 0, which bloom filters use."""
    back = lambda x, n: (x >> n | x << (64 - n)) & _ALL
    lane = back(-P4 * pow(P1, -1, 1 << 64) & _ALL, 27) ^ (ENGINE_SEED + P5 + 8) & _ALL
    found = back(lane * pow(P1, -1, 1 << 64) & _ALL, 31) * pow(P2, -1, 1 << 64) & _ALL
    return found - (1 << 64) if found >> 63 else found


OPENING = _opening()
#: Types whose values the engine hashes by the bytes that PLAIN writes.
_HASHED = {"INT32": "int", "INT64": "bigint", "FLOAT": "float", "DOUBLE": "double", "BYTE_ARRAY": "binary", "FIXED_LEN_BYTE_ARRAY": "binary", "INT96": "binary"}


def xxh64(value: Column) -> Column:
    """xxHash64 with seed 0 of a value's bytes, as signed long: of ints and longs in little-endian order, of floats and
    doubles by their bits (one pattern for all NaN), of text and bytes as they are. Null for null."""
    return F.when(value.isNotNull(), F.xxhash64(F.lit(OPENING), value))


def hashed(value: Column, kind: str) -> Column:
    """Hash of a value as a column of physical type `kind` stores it. The engine takes zeros of both signs for one."""
    own = value.cast(_HASHED[kind])
    if kind not in ("FLOAT", "DOUBLE"):
        return xxh64(own)
    minus = F.lit(-(1 << 31)).cast("int") if kind == "FLOAT" else F.lit(-(1 << 63)).cast("bigint")
    return F.when(own.cast("string") == "-0.0", xxh64(minus)).otherwise(xxh64(own))


def block_index(hash_: Column, num_blocks: Column) -> Column:
    """Block that the upper half of the hash selects."""
    return F.shiftright(F.shiftrightunsigned(hash_, 32) * num_blocks, 32)


def bit_checks(hash_: Column, block: Column) -> Column:
    """array<struct<word_index, bit_index, is_set>> of the eight bits of a block that the lower half of the hash selects."""
    low = hash_.bitwiseAND(F.lit(0xFFFFFFFF))
    checks = []
    for i, salt in enumerate(SALTS):
        upper = F.shiftleft((low * F.lit(salt >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)  # in halves: a long has no room for the product
        bit = F.shiftright((low * F.lit(salt & 0xFFFF) + upper).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")
        byte = F.conv(F.hex(F.substring(block, F.shiftright(bit, 3) + 4 * i + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1
        checks.append(F.struct(F.lit(i).alias("word_index"), bit.alias("bit_index"), is_set.alias("is_set")))
    return F.array(*checks)


def explain(hash_: Column, index: Column, block: Column, num_blocks: Column) -> Column:
    """struct<hash, block_index, num_blocks, block_bytes, bits, might_contain>: how a lookup goes."""
    bits = bit_checks(hash_, block)
    return F.struct(
        hash_.alias("hash"), index.alias("block_index"), num_blocks.alias("num_blocks"), block.alias("block_bytes"), bits.alias("bits"),
        F.forall(bits, lambda b: b["is_set"]).alias("might_contain"),
    )
