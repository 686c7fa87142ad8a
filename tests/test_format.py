"""Decoders without Spark: Thrift, schemas, encodings, codecs, hashes."""

from __future__ import annotations

import gzip
import struct
import sys
import types

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagescope.errors import CorruptFile, Shortfall, ThriftError, Unsupported, UnsupportedCodec
from pagescope.format import bloom, encodings, footer, thrift
from pagescope.format.codecs import decompress
from pagescope.format.records import wkb_type
from pagescope.format.schema import effective_logical_type, tree


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> bytes:
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def pack(values: list[int], width: int) -> bytes:
    bits = sum(v << (i * width) for i, v in enumerate(values))
    return bits.to_bytes((len(values) * width + 7) // 8, "little")


def test_thrift_reads_lists_of_booleans_and_skips_unknown_fields():
    # ColumnIndex: null_pages [false, true], min/max of one byte each, order 1; then an unknown map field 40
    record = b"\x19\x21\x02\x01" + b"\x19\x28\x01a\x00" + b"\x19\x28\x01b\x00" + b"\x15\x02" + b"\x0b\x50\x01\x85\x01x\x02" + b"\x00"
    found, size = thrift.read("ColumnIndex", record + b"rest", 100)
    assert found["null_pages"] == [False, True]
    assert found["min_values"] == [b"a", b""] and found["boundary_order"] == 1
    assert (found["_start"], found["_length"], size) == (100, len(record), len(record))


def test_thrift_faults_are_typed():
    with pytest.raises(Shortfall) as short:
        thrift.read("KeyValue", b"\x18\x05ab")
    assert short.value.missing == 3
    with pytest.raises(ThriftError, match="without key"):
        thrift.read("KeyValue", b"\x00")
    with pytest.raises(ThriftError, match="wire type"):
        thrift.read("KeyValue", b"\x15\x02\x00")
    with pytest.raises(ThriftError):
        thrift.read("KeyValue", b"\x18" + b"\xff" * 12)


@given(st.binary(max_size=60))
@settings(max_examples=300, deadline=None)
def test_damaged_records_raise_only_typed_errors(data):
    for name in ("FileMetaData", "PageHeader", "ColumnIndex", "OffsetIndex", "BloomFilterHeader"):
        try:
            thrift.read(name, data)
        except (ThriftError, UnicodeDecodeError):
            pass


def element(name, kind=None, repetition=None, children=None, **more):
    keys = ("type", "type_length", "repetition_type", "name", "num_children", "converted_type", "scale", "precision", "field_id", "logical_type")
    return dict.fromkeys(keys) | {"name": name, "type": kind, "repetition_type": repetition, "num_children": children, "_start": 0, "_length": 0} | more


def test_schema_levels_and_paths():
    nodes = tree([element("root", children=2), element("a", repetition=1, children=1, converted_type=3), element("list", repetition=2, children=1), element("element", 1, 1), element("b", 6, 0, converted_type=0)])
    assert [(n["full_path"], n["definition_level"], n["repetition_level"]) for n in nodes] == [("", 0, 0), ("a", 1, 0), ("a.list", 2, 1), ("a.list.element", 3, 1), ("b", 0, 0)]
    assert nodes[3]["list_semantics"] == "MODERN_LIST"
    assert effective_logical_type(nodes[4])["name"] == "STRING"
    assert effective_logical_type({"logical_type": None, "converted_type": "UINT_16", "scale": None, "precision": None})["is_signed"] is False
    assert effective_logical_type({"logical_type": None, "converted_type": "DECIMAL", "scale": None, "precision": None}) | {} == effective_logical_type({"logical_type": None, "converted_type": "DECIMAL", "scale": 0, "precision": 10})


@pytest.mark.parametrize("elements", [[], [element("root", children=2), element("a", 1, 0)], [element("root", children=1), element("a", 1, 0), element("b", 1, 0)], [element("root", children=1), element("a", 99, 0)]])
def test_bad_schemas(elements):
    with pytest.raises(CorruptFile):
        tree(elements)


@given(st.integers(1, 32).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, (1 << w) - 1), max_size=70))))
@settings(max_examples=200, deadline=None)
def test_unpack(case):
    width, values = case
    assert encodings.unpack(pack(values, width), width, len(values)).tolist() == values


def test_hybrid_runs_and_packs():
    data = varint(5 << 1) + b"\x03" + varint(1 << 1 | 1) + pack([0, 1, 2, 3, 0, 1, 2, 3], 2)
    assert encodings.hybrid(data, 0, len(data), 2, 11).tolist() == [3] * 5 + [0, 1, 2, 3, 0, 1]
    with pytest.raises(CorruptFile):
        encodings.hybrid(data, 0, len(data), 2, 14)
    with pytest.raises(CorruptFile):
        encodings.hybrid(b"\x00\x01", 0, 2, 1, 1)


def test_bit_packed_levels_have_highest_bits_first():
    found, end = encodings.bit_packed_levels(bytes([0b00011011]), 0, 2, 4)
    assert (found.tolist(), end) == ([0, 1, 2, 3], 1)


def delta_stream(values: list[int], bits: int = 64) -> bytes:
    deltas = [b - a for a, b in zip(values[:-1], values[1:], strict=True)]
    out = varint(128) + varint(4) + varint(len(values)) + zigzag(values[0] if values else 0)
    for at in range(0, len(deltas), 128):
        block = deltas[at : at + 128]
        low = min(block)
        block = [(d - low) & (1 << 64) - 1 for d in block]
        minis = [block[i : i + 32] for i in range(0, 128, 32)]
        widths = [max((v.bit_length() for v in m), default=0) for m in minis]
        out += zigzag(low) + bytes(widths) + b"".join(pack(m + [0] * (32 - len(m)), w) if m else b"" for m, w in zip(minis, widths, strict=True))
    return out


@given(st.lists(st.integers(-(2**40), 2**40), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_delta_binary_packed(values):
    found, _ = encodings.delta_binary_packed(delta_stream(values), 0, 64)
    assert found.tolist() == values


def test_delta_wraps_around():
    data = varint(128) + varint(4) + varint(2) + zigzag(2**31 - 1) + zigzag(1) + bytes([0, 0, 0, 0])
    assert encodings.delta_binary_packed(data, 0, 32)[0].tolist() == [2**31 - 1, -(2**31)]


def test_delta_byte_arrays():
    words = [b"apple", b"apply", b"ape", b""]
    data = delta_stream([0, 4, 2, 0]) + delta_stream([5, 1, 1, 0]) + b"applyye"[:0] + b"apple" + b"y" + b"e"
    assert encodings.delta_byte_array(data, 0, 4).to_pylist() == words
    assert encodings.delta_length_byte_array(delta_stream([1, 0, 2]) + b"abc", 0, 3).to_pylist() == [b"a", b"", b"bc"]
    with pytest.raises(CorruptFile):
        encodings.delta_byte_array(delta_stream([3]) + delta_stream([1]) + b"x", 0, 1)


def test_plain_and_split_values():
    assert encodings.plain(struct.pack("<3i", 1, -2, 3), 0, "INT32", None, 3).to_pylist() == [1, -2, 3]
    assert encodings.plain(b"\x05", 0, "BOOLEAN", None, 3).to_pylist() == [True, False, True]
    assert encodings.plain(b"\x01\0\0\0a\0\0\0\0", 0, "BYTE_ARRAY", None, 2).to_pylist() == [b"a", b""]
    assert encodings.plain(b"abcd", 0, "FIXED_LEN_BYTE_ARRAY", 2, 2).to_pylist() == [b"ab", b"cd"]
    x = np.array([1.5, -2.5, 3.0], "<f8")
    assert encodings.byte_stream_split(x.view(np.uint8).reshape(3, 8).T.tobytes(), 0, "DOUBLE", None, 3).to_pylist() == x.tolist()
    for short in (lambda: encodings.plain(b"\0" * 7, 0, "INT64", None, 1), lambda: encodings.plain(b"\x09\0\0\0a", 0, "BYTE_ARRAY", None, 1), lambda: encodings.byte_stream_split(b"abc", 0, "FLOAT", None, 1)):
        with pytest.raises(CorruptFile):
            short()


def test_dictionary_indices_are_checked():
    words = pa.array([b"x", b"y"])
    assert encodings.values(b"\x01" + varint(3 << 1) + b"\x01", 0, "RLE_DICTIONARY", "BYTE_ARRAY", None, 3, words).to_pylist() == [b"y"] * 3
    with pytest.raises(CorruptFile):
        encodings.values(b"\x02" + varint(1 << 1) + b"\x03", 0, "PLAIN_DICTIONARY", "BYTE_ARRAY", None, 1, words)
    with pytest.raises(CorruptFile):
        encodings.values(b"\x01\x02\x01", 0, "PLAIN_DICTIONARY", "BYTE_ARRAY", None, 1, None)
    with pytest.raises(Unsupported):
        encodings.values(b"\0", 0, "BIT_PACKED", "INT32", None, 1, None)


@pytest.mark.parametrize("data", [b"", b"a", b"hello " * 200, bytes(range(256)) * 50, bytes(100_000)])
def test_codecs(data):
    for codec, arrow in (("SNAPPY", "snappy"), ("ZSTD", "zstd"), ("BROTLI", "brotli"), ("LZ4_RAW", "lz4_raw")):
        assert decompress(pa.Codec(arrow).compress(data, asbytes=True), codec, len(data)) == data
    half = len(data) // 2
    assert decompress(gzip.compress(data[:half]) + gzip.compress(data[half:]), "GZIP", len(data)) == data
    raw = pa.Codec("lz4_raw").compress(data, asbytes=True)
    if data:
        assert decompress(struct.pack(">II", len(data), len(raw)) + raw, "LZ4", len(data)) == data
    assert decompress(data, "UNCOMPRESSED", len(data)) == data


def test_codec_faults():
    with pytest.raises(UnsupportedCodec) as error:
        decompress(b"x", "LZO", 1)
    assert error.value.codec == "LZO"
    for codec in ("SNAPPY", "GZIP", "ZSTD", "BROTLI", "LZ4_RAW", "LZ4", "UNCOMPRESSED"):
        with pytest.raises(CorruptFile):
            decompress(b"not compressed at all", codec, 1000)


def test_lzo_by_its_library(monkeypatch):
    """A stand-in for the library, whose blocks are the bytes backwards."""

    class error(Exception):  # noqa: N801
        pass

    def back(data, header, size):
        if header or len(data) != size:
            raise error("no block")
        return data[::-1]

    monkeypatch.setitem(sys.modules, "lzo", types.SimpleNamespace(decompress=back, error=error))
    framed = b"".join(len(x).to_bytes(4, "big") * 2 + x for x in (b"cba", b"ed"))
    assert decompress(b"cba", "LZO", 3) == b"abc" and decompress(framed, "LZO", 5) == b"abcde"
    with pytest.raises(CorruptFile):
        decompress(b"cba", "LZO", 9)


@given(st.binary(max_size=300), st.sampled_from([0, 1, 2**64 - 1]))
@settings(max_examples=200, deadline=None)
def test_xxh64(data, seed):
    assert bloom.xxh64(data, seed) == xxhash.xxh64(data, seed).intdigest()


def test_xxh64_of_nothing():
    assert bloom.xxh64(b"") == 0xEF46DB3751D8E999


def test_bloom_explanation_agrees_with_lookup():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 256, 4 * 32, dtype=np.uint8).tobytes()
    for value in range(200):
        told = bloom.explain(bits, value, "INT64")
        assert told["num_blocks"] == 4 and len(told["bits"]) == 8 and told["block_bytes"] == bits[told["block_index"] * 32 :][:32]
        assert told["might_contain"] == bool(bloom.might_contain(bits, np.array([told["hash"]], np.uint64))[0])
    with pytest.raises(Unsupported):
        bloom.explain(bits, True, "BOOLEAN")


def test_footer_bounds():
    tail = (10).to_bytes(4, "little") + b"PAR1"
    assert footer.locate(tail, 100) == (82, 10)
    for bad, size in ((tail, 11), (tail, 21), (b"\0\0\0\0PAR1", 100), (b"\xff\xff\xff\xffPAR1", 100), (b"\x0a\0\0\0PAR2", 100)):
        with pytest.raises(CorruptFile):
            footer.locate(bad, size)
    with pytest.raises(Unsupported):
        footer.locate(b"\x0a\0\0\0PARE", 100)


def test_geometry_types():
    assert [wkb_type(x) for x in (0, 1, 1003, 2016, 3007)] == ["GEOMETRY", "POINT", "POLYGON_Z", "TIN_M", "GEOMETRYCOLLECTION_ZM"]
    with pytest.raises(CorruptFile):
        wkb_type(4001)
