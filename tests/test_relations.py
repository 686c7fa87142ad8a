"""Relations over files that the tests write, against pyarrow and the native scan."""

from __future__ import annotations

import datetime
import decimal
import http.server
import json
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagescope import catalog
from pagescope.operators import metrics
from pagescope.operators import relations as R
from pagescope.operators.values import column_values
from pagescope.plans.session import Lens
from pagescope.sources.ranges import Ranges

N = 3000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("files")


def write(folder, name, table, **options):
    path = str(folder / f"{name}.parquet")
    pq.write_table(table, path, **options)
    return path


def sample(n=N):
    rng = np.random.default_rng(1)
    hole = lambda x: pa.array(x, mask=rng.random(n) < 0.2)
    return pa.table({
        "i32": hole(rng.integers(-(2**31), 2**31 - 1, n).astype(np.int32)), "i64": hole(np.cumsum(rng.integers(0, 9, n))), "f32": hole(rng.random(n).astype(np.float32)), "f64": hole(rng.random(n)), "flag": hole(rng.random(n) < 0.5),
        "text": pa.array([None if i % 7 == 0 else f"wörd-{i % 50}" for i in range(n)]), "raw": pa.array([bytes([i % 256]) * (i % 5) for i in range(n)]), "fixed": pa.array([i.to_bytes(4, "big") for i in range(n)], pa.binary(4)),
    })


def native(path, column):
    return pq.read_table(path, columns=[column])[column].to_pylist()


def decoded(spark, path, column, **options):
    rows = Lens(spark, path).values(column, **options).orderBy("row_group", "ord").collect()
    return [r["value"] for r in rows]


def same(a, b):
    norm = lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else v
    return [norm(x) for x in a] == [norm(x) for x in b]


CASES = {
    "dict_snappy": {"compression": "snappy"},
    "plain_v2_gzip": {"use_dictionary": False, "compression": "gzip", "data_page_version": "2.0", "data_page_size": 1024, "write_page_index": True},
    "plain_zstd": {"use_dictionary": False, "compression": "zstd", "row_group_size": 1000, "write_page_checksum": True},
    "brotli": {"compression": "brotli", "data_page_version": "2.0"},
    "lz4": {"compression": "lz4", "data_page_size": 512},
    "none": {"compression": "none", "dictionary_pagesize_limit": 64},
    "delta": {"use_dictionary": False, "column_encoding": {"i32": "DELTA_BINARY_PACKED", "i64": "DELTA_BINARY_PACKED", "text": "DELTA_BYTE_ARRAY", "raw": "DELTA_LENGTH_BYTE_ARRAY", "fixed": "DELTA_BYTE_ARRAY", "flag": "RLE", "f32": "BYTE_STREAM_SPLIT", "f64": "BYTE_STREAM_SPLIT"}},
    "split": {"use_dictionary": False, "column_encoding": {"i32": "BYTE_STREAM_SPLIT", "i64": "BYTE_STREAM_SPLIT", "fixed": "BYTE_STREAM_SPLIT", "f64": "BYTE_STREAM_SPLIT"}, "data_page_version": "2.0"},
}


@pytest.mark.parametrize("case", CASES)
def test_values_equal_another_reader(spark, folder, case):
    path = write(folder, case, sample(), **CASES[case])
    found = R.page_values(Lens(spark, path).pages()).orderBy("column_id", "row_group", "page_ordinal", "entry_ordinal").toPandas()
    for column in sample().column_names:
        own = found[found.column_path == column]
        slot = R.SLOT[own.type.iloc[0]]
        got = [None if n else v[slot] for n, v in zip(own.is_null, own.value, strict=True)]
        want = native(path, column)
        got = [x.decode() if column == "text" and x is not None else x for x in (bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in got)]
        assert got == want, (case, column)


def test_pages_by_index_equal_pages_by_walking(spark, folder):
    path = write(folder, "indexed", sample(), use_dictionary=["text"], data_page_size=1024, write_page_index=True, row_group_size=1500)
    lens = Lens(spark, path)
    one, two = lens.pages(), lens.pages(by_index=False)
    assert one.count() > 30 and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert R.tiling(one, lens.chunks).where("not tiles").count() == 0
    meta = pq.read_metadata(path)
    assert {(r.row_group, r.column_id): r.total_compressed_size for r in lens.chunks.collect()} == {(g, c): meta.row_group(g).column(c).total_compressed_size for g in range(2) for c in range(8)}


def test_null_pages_are_seen(spark, folder):
    rows = spark.range(2000).coalesce(1).select(F.when(F.col("id") >= 1000, F.col("id") - 1000).cast("int").alias("x"))
    path = str(folder / "null_pages")
    rows.write.option("parquet.page.row.count.limit", "100").parquet(path)
    index = R.column_index(Lens(spark, path).chunks).orderBy("page_ordinal").collect()
    assert index[0].null_page and not index[-1].null_page and sum(r.null_count for r in index) == 1000
    shown = metrics.index_bounds_text(R.column_index(Lens(spark, path).chunks), Lens(spark, path).chunks).orderBy("page_ordinal").collect()
    assert shown[0]["min"] is None and shown[-1]["max"] == "999"


def test_checksums(spark, folder):
    path = write(folder, "sums", sample(), write_page_checksum=True, compression="none", use_dictionary=False)
    lens = Lens(spark, path)
    pages = lens.pages(verify=True).collect()
    assert all(p.crc_ok for p in pages)
    damaged = bytearray(open(path, "rb").read())
    damaged[pages[3].start_offset + pages[3].header_size + 1] ^= 0xFF
    (folder / "damaged_sums.parquet").write_bytes(damaged)
    assert Lens(spark, str(folder / "damaged_sums.parquet")).pages(verify=True).where("not crc_ok").count() == 1


def test_logical_types(spark, folder):
    stamp = datetime.datetime(2001, 2, 3, 4, 5, 6, 789012)
    table = pa.table({
        "date": pa.array([datetime.date(1969, 12, 31), None, datetime.date(2024, 2, 29)]), "utc": pa.array([stamp, None, stamp], pa.timestamp("us", "UTC")), "local": pa.array([stamp, None, stamp], pa.timestamp("us")),
        "nanos": pa.array([1, None, -1], pa.timestamp("ns")), "time": pa.array([datetime.time(1, 2, 3), None, datetime.time(23, 59, 59, 5)], pa.time64("us")), "d9": pa.array([decimal.Decimal("1.23"), None, decimal.Decimal("-0.01")], pa.decimal128(4, 2)),
        "d38": pa.array([decimal.Decimal("12345678901234567890.5"), None, decimal.Decimal("-1.5")], pa.decimal128(25, 1)), "u8": pa.array([255, None, 0], pa.uint8()), "u32": pa.array([2**32 - 1, None, 0], pa.uint32()), "u64": pa.array([2**64 - 1, None, 0], pa.uint64()), "half": pa.array([np.float16(1.5), None, np.float16(-2)], pa.float16()),
    })
    path = write(folder, "logical", table, store_decimal_as_integer=True)
    get = lambda c, **o: decoded(spark, path, c, **o)
    assert get("date") == [datetime.date(1969, 12, 31), None, datetime.date(2024, 2, 29)]
    assert get("local") == [stamp, None, stamp]
    assert get("nanos") == [datetime.datetime(1970, 1, 1), None, datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    assert get("time") == ["01:02:03", None, "23:59:59.000005"]
    assert get("d9") == [decimal.Decimal("1.23"), None, decimal.Decimal("-0.01")] and get("d9", compat=True) == [123, None, -1]
    assert get("d38") == [decimal.Decimal("12345678901234567890.5"), None, decimal.Decimal("-1.5")]
    assert get("u8") == [255, None, 0] and get("u32") == [2**32 - 1, None, 0] and get("u32", compat=True) == [-1, None, 0]
    assert get("u64") == [decimal.Decimal(2**64 - 1), None, decimal.Decimal(0)]
    assert get("half") == [1.5, None, -2.0]
    assert get("date", apply_logical=False) == [-1, None, 19782]
    utc = Lens(spark, path).values("utc")
    assert utc.where(F.col("value") == F.to_timestamp(F.lit("2001-02-03 04:05:06.789012"))).count() == 2


def test_uuid_and_int96(spark, folder):
    one = uuid.uuid4()
    path = write(folder, "uuid", pa.table({"u": pa.array([one.bytes], pa.uuid() if hasattr(pa, "uuid") else pa.binary(16))}))
    if hasattr(pa, "uuid"):
        assert decoded(spark, path, "u") == [str(one)]
    path = write(folder, "int96", pa.table({"t": pa.array([datetime.datetime(2020, 1, 2, 3, 4, 5, 6)], pa.timestamp("us"))}), use_deprecated_int96_timestamps=True)
    assert decoded(spark, path, "t") == [datetime.datetime(2020, 1, 2, 3, 4, 5, 6)]


def test_projection_and_row_groups(spark, folder):
    path = write(folder, "groups", sample(), row_group_size=1000)
    assert {r[0] for r in Lens(spark, path, columns=["i32", "text", "missing"]).chunks.select("column_path").distinct().collect()} == {"i32", "text"}
    assert Lens(spark, path, columns=[]).chunks.count() == 0
    assert Lens(spark, path, row_groups=[1]).pages().select("row_group").distinct().collect() == [(1,)]
    assert Lens(spark, path, row_groups=[]).pages().count() == 0
    whole = Lens(spark, path).chunks.where("column_path = 'i32'")
    part = Lens(spark, path, columns=["i32"]).chunks
    assert part.select("row_group", "statistics", "data_page_offset", "start_offset").exceptAll(whole.select("row_group", "statistics", "data_page_offset", "start_offset")).count() == 0


def test_sorting_columns_key_values_and_statistics(spark, folder):
    path = write(folder, "sorted", pa.table({"a": [1, 2, 3], "b": ["x", "", "z"]}).replace_schema_metadata({"k": "v"}), sorting_columns=[pq.SortingColumn(0, True, False)])
    lens = Lens(spark, path)
    (row,) = metrics.sorting_columns(lens.relation("row_groups")).collect()
    assert (row.column_idx, row.descending, row.nulls_first) == (0, True, False)
    assert lens.relation("key_values").where("key = 'k'").select(F.col("value").cast("string")).collect() == [("v",)]
    bounds = {r.column_path: (r["min"], r["max"], r.null_count) for r in metrics.chunk_bounds_text(lens.chunks).collect()}
    assert bounds == {"a": ("1", "3", 0), "b": ("", "z", 0)}


def test_names_with_dots(spark, folder):
    path = write(folder, "dots", pa.table({"a.b": [1, 2], "a": pa.array([{"b": 3}, {"b": 4}])}))
    rows = Lens(spark, path).chunks.select("column_id", "path").orderBy("column_id").collect()
    assert [r.path for r in rows] == [["a.b"], ["a", "b"]]


def test_dictionaries(spark, folder):
    path = write(folder, "dictionary", sample(), dictionary_pagesize_limit=1 << 20)
    lens = Lens(spark, path)
    words = R.dictionary_values(lens.pages()).where("column_path = 'text'").select(F.col("value.bin").cast("string")).collect()
    assert {w[0] for w in words} == set(native(path, "text")) - {None}
    assert metrics.fully_dictionary_encoded(lens.pages()).where("column_path = 'text'").count() == 1


def test_queries_read_what_dictionaries_and_statistics_lack(spark, tmp_path):
    n = 3000
    keys = {"o_orderkey": range(n), "o_orderstatus": ["F", "O", None] * (n // 3), "o_orderpriority": [f"p{i % 5}" for i in range(n)], "o_custkey": range(n)}
    for name, table in {"orders": keys, "lineitem": {"l_linenumber": range(9), "l_returnflag": [f"r{i}" for i in range(9)]}, "nation": {"n_regionkey": range(4), "n_name": [f"n{i}" for i in range(4)]}, "customer": {"c_mktsegment": ["a", "b"]}}.items():
        pq.write_table(pa.table({c: list(v) for c, v in table.items()}), tmp_path / f"{name}.parquet", dictionary_pagesize_limit=256, data_page_size=256, write_batch_size=16, use_dictionary=name == "orders", write_statistics=name == "nation")
    found = {r.c: r.n for r in catalog.dictionary_cardinality(spark, str(tmp_path)).collect()}
    assert found == {"o_orderstatus": 2, "o_orderpriority": 5, "o_custkey": n}
    assert sorted(r.v for r in catalog.dictionary_values(spark, str(tmp_path)).collect()) == ["a", "b", *[f"n{i}" for i in range(4)], *[f"r{i}" for i in range(9)]]
    assert sorted(map(tuple, catalog.stats_only_agg(spark, str(tmp_path)).collect())) == [("l_linenumber", 0, 8, 9), ("n_regionkey", 0, 3, 4), ("o_orderkey", 0, n - 1, n)]


def test_pruning(spark, folder):
    path = write(folder, "prune", pa.table({"x": list(range(10_000)), "s": [f"{i:05}" for i in range(10_000)]}), row_group_size=1000, write_page_index=True, data_page_size=512, write_batch_size=50, use_dictionary=False)
    chunks = Lens(spark, path).chunks
    assert [r[0] for r in metrics.prune_chunks(chunks, "x", 2500, 3500).select("row_group").orderBy("row_group").collect()] == [2, 3]
    assert [r[0] for r in metrics.prune_chunks(chunks, "s", "09999", "zzz").select("row_group").collect()] == [9]
    spans = metrics.prune_pages(chunks, "x", 2500, 2510).collect()
    assert spans and all(r.row_group == 2 and r.first_row <= 510 and r.last_row >= 500 for r in spans) and sum(r.last_row - r.first_row + 1 for r in spans) < 400
    assert tuple(metrics.stats_only_agg(chunks, "x").first()) == (0, 9999, 10_000, True)


def test_damaged_files_give_typed_errors(spark, folder, tmp_path):
    good = open(write(folder, "good", pa.table({"x": pa.array(range(100))})), "rb").read()
    size = int.from_bytes(good[-8:-4], "little")
    at = len(good) - 8 - size
    bad = {"empty": b"", "short": good[:11], "magic": good[:-4] + b"\0\0\0\0", "start": b"XXXX" + good[4:], "zero": good[:-8] + b"\0\0\0\0PAR1", "long": good[:-8] + b"\xff\xff\xff\xffPAR1", "cut": good[: at + size // 2] + good[-8:]}
    for i in (2, 6, 12, 24, 48, 80):
        bad[f"flip{i}"] = good[: at + i] + bytes([good[at + i] ^ 0xFF]) + good[at + i + 1 :]
    for name, data in bad.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    rows = {r.file_path.rpartition("/")[2]: r for r in R.files(R.footers(spark, str(tmp_path), mode="PERMISSIVE")).collect()}
    typed = {"CorruptFile", "BadMagic", "ThriftError", "Shortfall", "Unsupported", None}
    assert {r.error_class for r in rows.values()} <= typed
    for name in ("short", "magic", "start", "zero", "long", "cut"):
        assert rows[f"{name}.parquet"].error_class, name
    with pytest.raises(Exception, match="magic"):
        R.footers(spark, str(tmp_path / "magic.parquet")).collect()
    assert R.files(R.footers(spark, str(folder / "good.parquet"))).first().row_count == 100


def test_damaged_pages(spark, folder, tmp_path):
    path = write(folder, "body", pa.table({"x": pa.array([f"value {i}" for i in range(500)])}), compression="snappy", use_dictionary=False)
    page = Lens(spark, path).pages().first()
    data = bytearray(open(path, "rb").read())
    data[page.start_offset + page.header_size : page.start_offset + page.header_size + 20] = b"\xff" * 20
    (tmp_path / "body.parquet").write_bytes(data)
    with pytest.raises(Exception, match="CorruptFile"):
        R.page_values(Lens(spark, str(tmp_path / "body.parquet")).pages()).collect()
    data[page.start_offset : page.start_offset + 4] = b"\xff" * 4
    (tmp_path / "header.parquet").write_bytes(data)
    found = R.pages(Lens(spark, str(tmp_path / "header.parquet")).chunks, mode="PERMISSIVE").first()
    assert found.error_class in ("ThriftError", "CorruptFile", "Shortfall")


class _Handler(http.server.SimpleHTTPRequestHandler):
    folder = ""

    def do_HEAD(self):  # noqa: N802
        self._answer(False)

    def do_GET(self):  # noqa: N802
        self._answer(True)

    def _answer(self, body):
        data = open(f"{self.folder}/{self.path.lstrip('/')}", "rb").read()
        asked = self.headers.get("Range")
        if asked:
            a, b = asked.removeprefix("bytes=").split("-")
            data = data[int(a) : int(b) + 1]
        self.send_response(206 if asked else 200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if body:
            self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_http_ranges(spark, folder):
    write(folder, "remote", sample(), row_group_size=1000)
    _Handler.folder = str(folder)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/remote.parquet"
        assert Lens(spark, url).chunks.count() == 24
        with Ranges(url) as ranges:
            assert R.read_footer(ranges)["row_group_count"] == 3 and ranges.requests <= 2
        assert sorted(x for x in decoded(spark, url, "i64") if x is not None) == sorted(x for x in native(str(folder / "remote.parquet"), "i64") if x is not None)
    finally:
        server.shutdown()


def test_compression_metrics(spark, folder):
    path = write(folder, "ratio", sample())
    meta = pq.read_metadata(path).row_group(0)
    found = metrics.compression(Lens(spark, path).chunks, "file_path").first()
    sizes = [meta.column(i) for i in range(8)]
    assert found.total_compressed == sum(c.total_compressed_size for c in sizes) and abs(found.ratio - found.total_compressed / found.total_uncompressed) < 1e-12
    assert metrics.compression_rollup(Lens(spark, path).chunks).count() == 8 + 1 + 1
    empty = metrics.compression(Lens(spark, write(folder, "none_at_all", pa.table({"x": pa.array([], pa.int64())}))).chunks, "file_path").collect()
    assert all(r.ratio >= 0 for r in empty)


def test_records_of_files_that_the_native_scan_refuses(spark, folder):
    rows = [{"id": i, "half": np.float16(i / 2), "tags": None if i % 5 == 0 else [f"t{j}" if j % 2 else None for j in range(i % 4)], "pairs": [(f"k{j}", j) for j in range(i % 3)], "s": None if i % 7 == 0 else {"x": float(i), "y": [i] * (i % 2)}} for i in range(60)]
    kind = pa.schema([("id", pa.int64()), ("half", pa.float16()), ("tags", pa.list_(pa.string())), ("pairs", pa.map_(pa.string(), pa.int32())), ("s", pa.struct([("x", pa.float64()), ("y", pa.list_(pa.int64()))]))])
    path = write(folder, "refused", pa.Table.from_pylist(rows, kind), use_dictionary=False, column_encoding={"s.x": "BYTE_STREAM_SPLIT"}, row_group_size=25, data_page_size=64)
    found = Lens(spark, path).records().orderBy("row_group", "record").collect()
    got = [{"id": r.id, "half": r.half, "tags": r.tags, "pairs": [tuple(p) for p in r.pairs], "s": r.s and r.s.asDict()} for r in found]
    assert got == [r | {"half": float(r["half"])} for r in rows]
    part = Lens(spark, path).records(columns=["s.y", "id"])
    assert part.columns == ["file_path", "row_group", "record", "id", "s"] and part.schema["s"].dataType.names == ["y"]


def test_wrong_mixture_of_columns_is_refused(spark, folder):
    path = write(folder, "mixture", sample())
    with pytest.raises(Exception, match="several types"):
        column_values(Lens(spark, path).pages())


def test_schema_json_is_stable(spark):
    assert json.loads(R.schema_of(R.PAGE).json())["fields"][0]["name"] == "file_path"
