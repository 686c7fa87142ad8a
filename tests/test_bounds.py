"""Pruning by bounds of every type: no chunk or page that holds a value of the range goes."""

from __future__ import annotations

import datetime
import decimal
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagescope.functions import bounds
from pagescope.operators import metrics
from pagescope.plans.session import Lens

N, GROUP = 2000, 250
D = decimal.Decimal
_DAY = datetime.timedelta(days=1)


def _table():
    base = np.arange(N)
    near = (base - N // 2) / 8.0
    return pa.table({
        "f64": near, "f32": near.astype(np.float32), "half": near.astype(np.float16), "u32": (base * 2_000_000 + 100_000_000).astype(np.uint32), "u64": base.astype(np.uint64) * np.uint64(9 * 10**15),
        "i32": (base - N // 2).astype(np.int32), "i8": (base // 16 - 60).astype(np.int8), "dec9": pa.array([D(int(b) - N // 2) / 100 for b in base], pa.decimal128(9, 2)),
        "dec30": pa.array([D(int(b) - N // 2) * D(10) ** 15 + D("0.5") for b in base], pa.decimal128(30, 1)), "date": [datetime.date(1967, 4, 1) + int(b) * _DAY for b in base],
        "ts": pa.array([datetime.datetime(1969, 12, 1) + datetime.timedelta(minutes=int(b) * 41, microseconds=7) for b in base], pa.timestamp("us")),
        "utc": pa.array([datetime.datetime(1969, 12, 1) + datetime.timedelta(minutes=int(b) * 41) for b in base], pa.timestamp("ms", "UTC")),
        "time": pa.array([datetime.time(int(b) // 3600, int(b) // 60 % 60, int(b) % 60) for b in base], pa.time64("us")),
        "text": [f"{b:05}é" for b in base], "raw": pa.array([int(b).to_bytes(3, "big") for b in base], pa.binary(3)), "flag": base >= N // 2,
    })


UTC = datetime.timezone.utc
RANGES = {
    "f64": (-3.0, 4.5), "f32": (0.0, 0.0), "half": (-125, -120.3), "u32": (2**31 - 5, 2**31 + 10**7), "u64": (2**63 - 1, 2**63 + 4 * 10**16), "i32": (-3, 7.5), "i8": (-60, -59), "dec9": (D("1.005"), D("1.021")),
    "dec30": (-(10**15), 3 * 10**15), "date": (datetime.date(1969, 12, 30), datetime.date(1970, 1, 3)), "ts": (datetime.datetime(1970, 1, 1), datetime.datetime(1970, 1, 2)),
    "utc": (datetime.datetime(1970, 1, 1, tzinfo=UTC), datetime.datetime(1970, 1, 2, tzinfo=UTC)), "time": (datetime.time(0, 30), datetime.time(0, 31)), "text": ("00100", "00110"), "raw": (b"\0\1\0", b"\0\1\3"), "flag": (True, True),
}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bounds") / "t.parquet")
    pq.write_table(_table(), path, row_group_size=GROUP, write_page_index=True, data_page_size=400, write_batch_size=50, use_dictionary=False, store_decimal_as_integer=True)
    return Lens(spark, path, persist=True), _table()


def test_chunks_of_every_type(written):
    lens, table = written
    found = None
    for column, (low, high) in RANGES.items():
        part = metrics.prune_chunks(lens.chunks, column, low, high).select("column_path", "row_group")
        found = part if found is None else found.unionByName(part)
    kept = {(r.column_path, r.row_group) for r in found.collect()}
    want = set()
    for column, (low, high) in RANGES.items():
        values = table[column].to_pylist()
        parts = [values[i : i + GROUP] for i in range(0, N, GROUP)]
        want |= {(column, g) for g, part in enumerate(parts) if max(part) >= low and min(part) <= high}
    assert kept == want


@pytest.mark.parametrize("column", ["f64", "u32", "dec30", "utc", "text"])
def test_pages_hold_all_rows_of_the_range(written, column):
    lens, table = written
    low, high = RANGES[column]
    spans = metrics.prune_pages(lens.chunks, column, low, high).collect()
    rows = {r.row_group * GROUP + i for r in spans for i in range(r.first_row, r.last_row + 1)}
    need = {i for i, v in enumerate(table[column].to_pylist()) if low <= v <= high}
    assert need and need <= rows and len(rows) < N // 4


def test_open_ranges_and_unknown_values(written):
    lens, _ = written
    kept = lambda *asked: metrics.prune_chunks(lens.chunks, *asked).count()
    assert kept("f64", None, -100.0) == 1 and kept("f64", 100.0, None) == 8  # NaN lies above all and outside the bounds
    assert kept("i32", 900, None) == 1 and kept("f64", "x", "y") == 8 and kept("text", 1, 2) == 8 and kept("nothing", 1, 2) == 0


def test_statistics_of_other_types_are_not_exact(written):
    lens, _ = written
    assert tuple(metrics.stats_only_agg(lens.chunks, "i32").first()) == (-N // 2, N // 2 - 1, N, True)
    for column in ("f64", "u32", "date", "text", "dec9"):
        assert tuple(metrics.stats_only_agg(lens.chunks, column).first()) == (None, None, N, False)


def test_signed_zeros_nan_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"x": pa.array([-0.0, 0.0, math.nan, None, None, 5.0, 6.0, 7.0]), "n": pa.array([1, 1, None, None, None, None, 2, 2])}), path, row_group_size=2)
    chunks = Lens(spark, path).chunks
    groups = lambda *asked: {r.row_group for r in metrics.prune_chunks(chunks, *asked).collect()}
    assert {0} <= groups("x", 0.0, 0.0) <= {0, 1} and {0} <= groups("x", -0.0, -0.0) <= {0, 1} and {1, 3} <= groups("x", 6.0, None)
    assert groups("n", 0, 9) == {0, 3}


@given(st.floats(allow_nan=False), st.floats(allow_nan=False), st.sampled_from([4, 8]))
@settings(max_examples=300, deadline=None)
def test_float_keys_keep_the_order(value, limit, size):
    near = float(np.float32(value)) if size == 4 else value
    key = bounds._float_key(size)
    own = key(near, True), key(near, False)  # of either zero, both
    assert (near >= limit) <= (own[1] >= key(limit, True)) and (near <= limit) <= (own[0] <= key(limit, False))
    if near != 0 and math.isfinite(limit) and abs(limit) < 1e38:
        assert (near >= limit) == (own[0] >= key(limit, True)) or limit == 0 or abs(limit) < 1e-44


def test_order_is_unknown_for(spark):
    assert bounds.order_of("INT96", None) is None and bounds.order_of("FIXED_LEN_BYTE_ARRAY", {"name": "INTERVAL"}) is None
    frame = spark.createDataFrame([(bytes(12), bytes(12), "INT96", None)], "lo binary, hi binary, type string, logical_type struct<name:string,unit:string,scale:int,is_signed:boolean>")
    assert frame.where(bounds.may_hold(F.col("lo"), F.col("hi"), [("INT96", None)], 5, 6)).count() == 1
