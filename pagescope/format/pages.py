"""Page headers and bodies."""

from __future__ import annotations

import zlib
from typing import Any

import numpy as np
import pyarrow as pa

from ..errors import CorruptFile, Unsupported, reading
from . import encodings, thrift
from .codecs import decompress
from .records import ENCODINGS, PAGE_TYPES, named


def statistics(found: dict[str, Any] | None) -> dict[str, Any] | None:
    return None if found is None else {k: v for k, v in found.items() if not k.startswith("_")}


def header(data: bytes, at: int) -> dict[str, Any]:
    """The page whose header starts data and lies at `at` in the file; Shortfall if data is too short."""
    found, size = thrift.read("PageHeader", data, at)
    kind = named(PAGE_TYPES, found["type"], "page type")
    own = found[{"DATA_PAGE": "data_page_header", "DATA_PAGE_V2": "data_page_header_v2", "DICTIONARY_PAGE": "dictionary_page_header", "INDEX_PAGE": "index_page_header"}[kind]]
    if own is None and kind != "INDEX_PAGE":
        raise CorruptFile(f"a {kind} without its own header")
    own = own or {}
    if found["compressed_page_size"] < 0 or found["uncompressed_page_size"] < 0:
        raise CorruptFile("a page of negative size")
    encoding = lambda key: named(ENCODINGS, own.get(key), "encoding")
    return {
        "page_type": kind, "start_offset": at, "header_size": size, "compressed_page_size": found["compressed_page_size"], "uncompressed_page_size": found["uncompressed_page_size"],
        "crc": None if found["crc"] is None else found["crc"] & 0xFFFFFFFF, "num_values": own.get("num_values"), "num_nulls": own.get("num_nulls"), "num_rows": own.get("num_rows"), "encoding": encoding("encoding"),
        "dl_encoding": encoding("definition_level_encoding"), "rl_encoding": encoding("repetition_level_encoding"), "dl_bytes": own.get("definition_levels_byte_length"), "rl_bytes": own.get("repetition_levels_byte_length"),
        "is_compressed": (own.get("is_compressed") is not False) if kind == "DATA_PAGE_V2" else None, "is_sorted": own.get("is_sorted"), "statistics": statistics(own.get("statistics")),
    }


def crc_ok(page: dict[str, Any], body: bytes) -> bool | None:
    """Whether the checksum fits; None where there is none."""
    return None if page["crc"] is None else zlib.crc32(body) == page["crc"]


def dictionary(page: dict[str, Any], body: bytes, codec: str, kind: str, length: int | None) -> pa.Array:
    with reading("a dictionary page"):
        if page["encoding"] not in ("PLAIN", "PLAIN_DICTIONARY"):
            raise Unsupported(f"a dictionary encoded as {page['encoding']}")
        return encodings.plain(decompress(body, codec, page["uncompressed_page_size"]), 0, kind, length, page["num_values"])


def _width(level: int) -> int:
    return level.bit_length()


def _levels(data: bytes, at: int, encoding: str | None, most: int, count: int) -> tuple[np.ndarray, int]:
    """Levels of a page of the first version, and where they end."""
    if not most:
        return np.zeros(count, np.int64), at
    if encoding == "BIT_PACKED":
        return encodings.bit_packed_levels(data, at, _width(most), count)
    size = int.from_bytes(data[at : at + 4], "little")
    end = at + 4 + size
    if at + 4 > len(data) or end > len(data):
        raise CorruptFile("levels longer than their page")
    return encodings.hybrid(data, at + 4, end, _width(most), count), end


def decode(page: dict[str, Any], body: bytes, codec: str, kind: str, length: int | None, most_dl: int, most_rl: int, words: pa.Array | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Definition levels, repetition levels and the physical values, null where the definition level says so."""
    with reading("a data page"):
        count = page["num_values"]
        if count < 0:
            raise CorruptFile("a page of negative length")
        if page["page_type"] == "DATA_PAGE_V2":
            dl_size, rl_size = page["dl_bytes"], page["rl_bytes"]
            if min(dl_size, rl_size) < 0 or dl_size + rl_size > len(body):
                raise CorruptFile("levels longer than their page")
            rl = encodings.hybrid(body, 0, rl_size, _width(most_rl), count) if most_rl else np.zeros(count, np.int64)
            dl = encodings.hybrid(body, rl_size, rl_size + dl_size, _width(most_dl), count) if most_dl else np.zeros(count, np.int64)
            rest, size = body[dl_size + rl_size :], page["uncompressed_page_size"] - dl_size - rl_size
            data, at = decompress(rest, codec if page["is_compressed"] and rest else "UNCOMPRESSED", size if rest else 0), 0
        else:
            data = decompress(body, codec, page["uncompressed_page_size"])
            rl, at = _levels(data, 0, page["rl_encoding"], most_rl, count)
            dl, at = _levels(data, at, page["dl_encoding"], most_dl, count)
        if count and (dl.max() > most_dl or rl.max() > most_rl):
            raise CorruptFile("a level beyond the schema's")
        there = dl == most_dl
        found = encodings.values(data, at, page["encoding"], kind, length, int(there.sum()), words)
        if len(found) != count:
            place = np.cumsum(there) - 1
            found = found.take(pa.array(place, mask=~there)) if len(found) else pa.nulls(count, found.type)
        return dl, rl, found
