"""Dumps, views, the command line, bloom lookups, the stream and the driver's contract."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagescope.__main__ import main
from pagescope.format import bloom
from pagescope.functions import blooms
from pagescope.functions.sizes import human_bytes, shortened
from pagescope.operators import metrics, nesting
from pagescope.operators import relations as R
from pagescope.plans.progress import progress
from pagescope.plans.session import RELATIONS, Lens
from pagescope.sources import dumps
from pagescope.sources.ranges import Ranges
from pagescope.streaming import catalogue


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = tmp_path_factory.mktemp("plans") / "t.parquet"
    table = pa.table({"id": range(1000), "name": [f"n{i % 9}" for i in range(1000)], "tags": [[str(i)] * (i % 3) for i in range(1000)]})
    pq.write_table(table, at, row_group_size=400, write_page_index=True, data_page_version="2.0", store_decimal_as_integer=True)
    return str(at)


@pytest.fixture(scope="module")
def bloomed(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bloom") / "b")
    rows = spark.range(500).coalesce(1).select((F.col("id") * 7).alias("k"), F.concat(F.lit("s"), F.col("id")).alias("s"), F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("d"))
    writer = rows.write.option("parquet.enable.dictionary", "false")
    for c in rows.columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "500")
    writer.parquet(at)
    return at


def test_dump_and_restore(spark, path, tmp_path):
    lens = Lens(spark, path)
    whole = lens.dump().first().json
    assert dumps.is_dump(whole) and not dumps.is_dump('{"a": 1}') and not dumps.is_dump("PAR1")
    (tmp_path / "d.json").write_text(whole)
    back = Lens(spark, str(tmp_path / "d.json"), from_dumps=True)
    for name in ("row_groups", "schema_elements", "column_chunks"):
        a, b = lens.relation(name), back.relation(name)
        skip = [c for c in ("sorting_columns", "key_values") if c in a.columns]
        assert a.drop(*skip).exceptAll(b.drop(*skip)).count() == 0, name
    assert lens.pages().drop("crc_ok").exceptAll(back.pages().drop("crc_ok")).count() == 0
    document = json.loads(whole)
    assert document["_meta"]["model"] == "file" and document["metadata"]["row_count"] == 1000
    assert [p["page_type"] for p in document["column_chunks"][0]["data_pages"]] == ["DATA_PAGE_V2"]
    small = json.loads(dumps.metadata_only(back.dumps).first().json)
    assert small["_meta"]["model"] == "metadata" and small["metadata"] == document["metadata"] and "column_chunks" not in small
    assert json.loads(lens.dump(metadata_only=True).first().json)["metadata"] == document["metadata"]


def test_dump_keeps_columns_of_one_dotted_name(spark, tmp_path):
    pq.write_table(pa.table({"a.b": [1, 2, 3], "a": [{"b": "x"}, {"b": "y"}, None]}), tmp_path / "t.parquet")
    lens = Lens(spark, str(tmp_path / "t.parquet"))
    document = json.loads(lens.dump().first().json)
    document["metadata"]["num_rows"] = 4
    next(iter(document["metadata"]["row_groups"][0]["column_chunks"].values()))["key_values"] = [{"key": "k", "value": "dg=="}]
    foot = dumps.footer_of(document)
    assert [(c["path"], c["type"]) for c in foot["row_groups"][0]["columns"]] == [(["a.b"], "INT64"), (["a", "b"], "BYTE_ARRAY")]
    assert foot["num_rows"] == 4 and foot["row_count"] == 3 and foot["row_groups"][0]["columns"][0]["key_values"] == [{"key": "k", "value": b"v"}]
    assert foot["column_orders"] == lens.footers.first()["column_orders"] if "column_orders" in lens.footers.columns else "column_orders" in document["metadata"]
    (tmp_path / "d.json").write_text(lens.dump().first().json)
    back = Lens(spark, str(tmp_path / "d.json"), from_dumps=True)
    assert sorted(map(str, lens.pages().drop("crc_ok").collect())) == sorted(map(str, back.pages().drop("crc_ok").collect()))


def test_dump_with_wrong_path_is_refused(spark, path):
    document = json.loads(Lens(spark, path).dump().first().json)
    document["column_chunks"][0]["path_in_schema"] = "nowhere"
    frame = spark.createDataFrame([("x", json.dumps(document))], "file_path string, json string")
    with pytest.raises(Exception, match="isn't in the metadata"):
        dumps.restore_pages(frame).collect()


def test_views(spark, path):
    assert len(Lens(spark, path).register("v_")) == len(RELATIONS)
    assert spark.sql("SELECT sum(num_values) n FROM v_column_chunks WHERE column_path = 'id'").first().n == 1000
    assert spark.sql("SELECT count(*) n FROM v_files JOIN v_row_groups USING (file_path)").first().n == 3


def test_table_functions(spark, path):
    from pagescope.plans import udtf

    udtf.register(spark)
    assert spark.sql(f"SELECT * FROM parquet_pages('{path}')").count() == Lens(spark, path).pages().count()
    assert spark.sql(f"SELECT sum(num_values) n FROM parquet_chunks('{path}') WHERE column_path = 'id'").first().n == 1000


def test_links(spark, path):
    lens = Lens(spark, path)
    elements = lens.relation("schema_elements")
    assert nesting.unlinked(lens.chunks, elements).count() == 0
    assert nesting.unlinked(lens.chunks.withColumn("column_path", F.lit("x")), elements).count() == 9
    assert nesting.find_element(elements, "tags.list.element").first().repetition_level == 1
    assert nesting.count_leaves(elements).first().leaf_columns == 3


def test_command_line(spark, path, capsys, tmp_path):
    assert main(["schema", path], spark) == 0
    assert "  id: INT64 (OPTIONAL)" in capsys.readouterr().out
    assert main(["meta", path], spark) == 0 and "1000" in capsys.readouterr().out
    assert main(["meta", path, "--key", "nothing"], spark) == 1
    assert main(["row-groups", path, "--column", "id"], spark) == 0 and "399" in capsys.readouterr().out
    assert main(["pages", path, "--column", "name", "--row-group", "1"], spark) == 0 and "DICTIONARY_PAGE" in capsys.readouterr().out
    assert main(["dump", path], spark) == 0
    (tmp_path / "d.json").write_text(capsys.readouterr().out)
    assert main(["schema", "--from-dump", str(tmp_path / "d.json")], spark) == 0 and "name" in capsys.readouterr().out
    (tmp_path / "bad.parquet").write_bytes(b"nothing that is Parquet")
    assert main(["schema", str(tmp_path / "bad.parquet")], spark) == 1


def test_command_line_shows_every_row(spark, capsys, tmp_path):
    pq.write_table(pa.table({"id": list(range(2400))}), tmp_path / "many.parquet", row_group_size=2)
    for verb in (["row-groups"], ["pages", "--column", "id"]):
        assert main([verb[0], str(tmp_path / "many.parquet"), *verb[1:]], spark) == 0
        header, *rows = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
        assert [int(g) for g in dict.fromkeys(r[header.index("row_group")] for r in rows)] == list(range(1200))
    assert main(["meta", str(tmp_path / "many.parquet"), "--key", "nothing"], spark) == 1
    told = capsys.readouterr()
    assert told.out == "" and "nothing found" in told.err


def test_command_line_refuses_unknown_columns(spark, path, capsys):
    for verb in ("row-groups", "pages"):
        assert main([verb, path, "--column", "nope"], spark) == 1
        told = capsys.readouterr()
        assert told.out == "" and "no column nope" in told.err


def test_schema_of_dumps(spark, path, bloomed, capsys, tmp_path):
    for source in (path, bloomed):
        whole = Lens(spark, source).dump()
        assert dumps.check(whole).collect() == [] and dumps.check(dumps.metadata_only(whole)).collect() == []
    text = Lens(spark, path).dump().first().json
    row = spark.createDataFrame([(text,)], "json string").select(F.from_json("json", dumps.dump_schema()).alias("d")).select("d.*").first()
    document = json.loads(text)
    assert row.metadata.row_groups[1].column_chunks["id"].metadata.statistics.null_count == 0
    assert row.column_chunks[0].data_pages[0].start_offset == document["column_chunks"][0]["data_pages"][0]["start_offset"]
    assert json.loads(row.metadata.schema_root) == document["metadata"]["schema_root"]
    document["metadata"]["row_groups"][0]["column_chunks"]["id"]["metadata"]["codec"] = None
    document["metadata"]["row_count"] = "1000"
    document |= {"more": 1, "_meta": document["_meta"] | {"format_version": 99}}
    bad = spark.createDataFrame([("a", json.dumps(document)), ("b", "{"), ("c", "[]")], "file_path string, json string")
    found = {(r.file_path, r.path): r.fault for r in dumps.check(bad).collect()}
    assert found.pop(("b", "")).startswith("a dump that isn't JSON") and "99" in found.pop(("a", "_meta.format_version"))
    assert found == {("a", "more"): "unknown", ("a", "metadata.row_count"): "not of type bigint", ("a", "metadata.row_groups[0].column_chunks['id'].metadata.codec"): "missing", ("c", ""): "not an object"}
    assert main(["dump-schema"], spark) == 0
    (tmp_path / "schema.json").write_text(capsys.readouterr().out)
    assert main(["dump-schema", "--check", str(tmp_path / "schema.json")], spark) == 0
    (tmp_path / "schema.json").write_text("{}")
    assert main(["dump-schema", "--check", str(tmp_path / "schema.json")], spark) == 1
    (tmp_path / "good.json").write_text(text)
    (tmp_path / "bad.json").write_text(json.dumps(document))
    assert main(["check-dump", str(tmp_path / "good.json")], spark) == 0 and capsys.readouterr().out == ""
    assert main(["check-dump", str(tmp_path / "bad.json")], spark) == 1 and "unknown" in capsys.readouterr().out


def test_progress(spark, path, capsys):
    told = []
    with progress(spark, lambda *step: told.append(step)):
        spark.range(8, numPartitions=8).mapInPandas(lambda batches: (time.sleep(0.5) or b for b in batches), "id long").count()
    assert told and all(phase.startswith("stage ") and 0 <= done <= total for phase, done, total in told)
    assert any(total == 8 for _, _, total in told) and len({done for _, done, total in told if total == 8}) > 1
    assert main(["--progress", "meta", path], spark) == 0 and "1000" in capsys.readouterr().out
    assert main(["-v", "meta", path + "-none"], spark) == 1 and "Traceback" in capsys.readouterr().err


def test_work_is_spread_whatever_adaptive_execution_does(spark, tmp_path):
    for i in range(12):
        pq.write_table(pa.table({"x": range(4000), "y": range(4000)}), tmp_path / f"{i}.parquet", use_dictionary=False, data_page_size=1024, write_batch_size=64)
    cores = spark.sparkContext.defaultParallelism
    lens = Lens(spark, str(tmp_path))
    used = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert used(lens.listed) >= cores and used(lens.footers) >= cores and used(lens.pages()) >= cores and used(R.data_pages(lens.pages())) >= cores


def test_sizes(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 40,), (None,)], "n long").select(human_bytes(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["0 B", "1023 B", "1.5 KB", "5.0 TB", None]
    assert spark.sql(f"select '{'x' * 50}' t").select(shortened(F.col("t"))).first()[0] == "x" * 39 + "…"


@pytest.mark.parametrize(("column", "there", "absent"), [("k", 3493, 3494), ("i", 499, 5000), ("d", 3.0, 3.5), ("s", "s77", "nothing")])
def test_bloom_lookups(spark, bloomed, column, there, absent):
    chunks = Lens(spark, bloomed).chunks
    kind = {"k": "long", "i": "int", "d": "double", "s": "string"}[column]
    values = spark.createDataFrame([(there,), (absent,)], f"value {kind}")
    found = {r["value"]: r for r in metrics.probe(chunks, column, values, explain=True).collect()}
    assert found[there].might_contain and found[there].probe.might_contain
    bits = R.bloom_filters(chunks.where(F.col("column_path") == column)).first()
    for value, row in found.items():
        told = bloom.explain(bytes(bits.bitset), value, bits.type)
        signed = told["hash"] - (1 << 64) if told["hash"] >> 63 else told["hash"]
        assert (row.probe.hash, row.probe.block_index, row.might_contain) == (signed, told["block_index"], told["might_contain"])
        assert [(b.word_index, b.bit_index, b.is_set) for b in row.probe.bits] == [tuple(b.values()) for b in told["bits"]]
    whole = spark.read.parquet(bloomed).select(F.col(column).alias("value"))
    assert metrics.probe(chunks, column, whole).where("not might_contain").count() == 0


@pytest.mark.parametrize(("kind", "type_", "values"), [
    ("INT64", "long", [-5, -1, 0, 1, 7, 2**63 - 1, -(2**63)]), ("INT32", "int", [-5, 0, 9, -(2**31)]), ("DOUBLE", "double", [0.0, -0.0, 1.5, -2.25]), ("FLOAT", "float", [0.0, -0.0, 1.5, -2.25]),
    ("BYTE_ARRAY", "string", ["", "a", "abc", "x" * 31, "y" * 32, "é" * 40, "z" * 77]), ("FIXED_LEN_BYTE_ARRAY", "binary", [bytearray(b"1234"), bytearray(b"12345678"), bytearray(range(61))]),
])
def test_hashes_are_those_of_the_format(spark, kind, type_, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], f"v {type_}").select("v", blooms.hashed(F.col("v"), kind).alias("h")).collect()
    for r in rows[:-1]:
        h = bloom.xxh64(bloom.encode(bytes(r.v) if isinstance(r.v, bytearray) else r.v, kind))
        assert r.h == (h - (1 << 64) if h >> 63 else h), r
    assert rows[-1].h is None


def test_spans_grow_by_what_is_missing(tmp_path):
    from pagescope.format import thrift

    record = b"\x18\x03key\x18" + bytes([0xE8, 0x07]) + b"v" * 1000 + b"\x00"
    at = tmp_path / "r"
    at.write_bytes(b"....." + record + b"after")
    with Ranges(str(at)) as ranges:
        found = ranges.span(5, lambda data, base: thrift.read("KeyValue", data, base)[0], guess=16)
        assert found["value"] == b"v" * 1000 and ranges.reads == 3 and ranges.bytes_read <= len(record) + 16 + 5
    at.write_bytes(record[:500])
    with Ranges(str(at)) as ranges, pytest.raises(Exception, match="end of the file"):
        ranges.span(0, lambda data, base: thrift.read("KeyValue", data, base)[0], guess=16)


def test_stream_of_new_files(spark, tmp_path):
    folder, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    Path(folder).mkdir()
    for i in range(2):
        pq.write_table(pa.table({"x": range(10 * (i + 1))}), f"{folder}/{i}.parquet")
        catalogue.catalogue(spark, folder, table, state).awaitTermination()
    found = spark.read.parquet(table)
    assert found.count() == 2 and found.agg(F.sum("num_values")).first()[0] == 30


def test_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40


def test_entry_without_optional_parts(tmp_path):
    """The entry imports where the optional package and the pipeline are absent."""
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((root / name).read_text())
    (tmp_path / "pagescope").mkdir()
    for part in (root / "pagescope").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "pagescope" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'compression_rollup' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_entry(spark):
    if not Path(__spark_entry__.SMOKE_DIR).exists():
        pytest.skip("the driver's tables are not here")
    assert __spark_entry__.entry(spark).count() > 0
