"""Registered queries on tables that are folders, that have other row groups, and on other numbers of rows than the given ones."""

from __future__ import annotations

import datetime

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from pagescope.operators import metrics
from pagescope.plans.session import Lens

SMOKE = __spark_entry__.SMOKE_DIR


def ran(spark, name, sf_dir):
    return __spark_entry__.queries()[name](spark, str(sf_dir))


def orders_of(folder, keys, customers=None, files=1):
    """orders of these keys, as a folder of files."""
    (folder / "orders.parquet").mkdir(parents=True)
    whole = pa.table({
        "o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array(customers or keys, pa.int64()), "o_orderstatus": ["O"] * len(keys), "o_totalprice": [5000.0 + k % 7 for k in keys],
        "o_orderdate": pa.array([datetime.datetime(1995, 2, 1)] * len(keys), pa.timestamp("us")), "o_orderpriority": ["1-URGENT"] * len(keys),
    })
    for i in range(files):
        pq.write_table(whole.slice(i * len(keys) // files, (i + 1) * len(keys) // files - i * len(keys) // files), folder / "orders.parquet" / f"part-{i:04}.parquet")
    return folder


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The smallest tables, each a folder of three files of other row groups, with equal file names."""
    made = tmp_path_factory.mktemp("tables") / "sf"
    for table in Path(SMOKE).glob("*.parquet"):
        rows = pq.read_table(table)
        (made / table.name).mkdir(parents=True)
        for i in range(3):
            start, end = i * len(rows) // 3, (i + 1) * len(rows) // 3
            pq.write_table(rows.slice(start, end - start), made / table.name / f"part-{i:04}.parquet", row_group_size=max(1, len(rows) // 7))
    return made


def test_nested_assembly_joins_written_streams(spark):
    found = ran(spark, "assemble_nested", SMOKE)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # the joins' plan holds no steps from the listing on
    assert "BroadcastHashJoin" not in plan
    assert found.count() == spark.read.parquet(f"{SMOKE}/orders.parquet").count()


def test_prune_types_of_large_keys_and_of_ranges_without_rows(spark, tmp_path):
    """Keys whose u32 would be below 0; prices that no range of f64 and f32 has; several files for a column."""
    keys = [100, 500, 967, *range(4_294_000, 4_303_000)]
    found = {r["c"]: (r["n"], r["lo"], r["hi"]) for r in ran(spark, "prune_types", orders_of(tmp_path, keys)).collect()}
    dated = (len(keys), 100, 4_302_999)
    assert found == {"f64": (0, None, None), "f32": (0, None, None), "dec": (0, None, None), "u32": (3, 100, 967), "day": dated, "stamp": dated, "text": (2, 100, 500)}


def test_row_index_to_page_of_several_row_groups(spark, tmp_path):
    """An offset index counts from its row group on."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "16384")
    try:
        (found,) = ran(spark, "row_index_to_page", orders_of(tmp_path, list(range(5, 20_005)), files=2)).collect()
    finally:
        hadoop.unset("parquet.block.size")
    assert (found["n"], found["lo"]) == (20_000, 5)


def test_bloom_filters_grow_with_the_keys(spark, tmp_path, monkeypatch):
    from pagescope import written

    monkeypatch.setattr(written, "FILTER_KEYS", 100, raising=False)
    shared = Path(written.shared_path(spark).removeprefix("file:"))
    before = set(shared.glob("bloom-*"))
    found = ran(spark, "bloom_present_and_absent", orders_of(tmp_path, list(range(450))))
    (made,) = set(shared.glob("bloom-*")) - before
    assert len(list(made.glob("*.parquet"))) == 5
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()  # blocks and values pass through no single process
    assert {(r["k"], r["might"]) for r in found.collect()} == {(k, k % 2 == 0) for k in range(900)}


@pytest.mark.parametrize("name", ["chunk_minmax", "chunk_minmax_double"])
def test_bounds_over_all_chunks(spark, folders, name):
    found = ran(spark, name, folders)
    assert sorted(map(str, found.collect())) == sorted(map(str, ran(spark, name, SMOKE).collect()))


def test_bounds_go_by_the_type_and_tell_what_they_lack(spark, tmp_path):
    for i, (n, text) in enumerate([(9, "b"), (10, "a"), (-2, None)]):
        pq.write_table(pa.table({"n": pa.array([n], pa.int64()), "text": pa.array([text], pa.string()), "bare": [n]}), tmp_path / f"{i}.parquet", write_statistics=["n", "text"])
    found = {r["column_path"]: (r["min"], r["max"], r["null_count"], r["known"]) for r in metrics.column_bounds_text(Lens(spark, str(tmp_path)).chunks).collect()}
    assert found["n"] == ("-2", "10", 0, True) and found["text"] == ("a", "b", 1, True) and not found["bare"][3]


def test_bounds_without_statistics_come_from_values(spark, folders, tmp_path):
    (tmp_path / "sf").mkdir()
    for table in Path(SMOKE).glob("*.parquet"):
        pq.write_table(pq.read_table(table), tmp_path / "sf" / table.name, write_statistics=False)
    for name in ("chunk_minmax", "chunk_minmax_double", "chunk_null_counts"):
        assert sorted(map(str, ran(spark, name, tmp_path / "sf").collect())) == sorted(map(str, ran(spark, name, SMOKE).collect())), name


@pytest.mark.parametrize("name", ["chunk_null_counts", "row_count_per_table", "page_value_totals"])
def test_a_folder_of_files_is_one_table(spark, folders, name):
    assert sorted(map(str, ran(spark, name, folders).collect())) == sorted(map(str, ran(spark, name, SMOKE).collect()))


def test_compression_ratio_goes_by_file_names(spark, folders):
    found = {r["f"]: r["c"] for r in ran(spark, "compression_ratio", folders).collect()}
    sizes = {r["f"]: r["c"] for r in ran(spark, "compression_rollup", folders).where("p is null and f is not null").collect()}
    assert len(found) == 3 and found == sizes
