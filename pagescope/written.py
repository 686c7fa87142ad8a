"""Registered queries over files that they write: with nulls, several row groups, other codecs, encodings, pages and shapes
than the given tables have. Each is the rows of a table; the SQL gives them from the table itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .catalog import ORACLES, _copy, query, shared_path
from .operators import metrics, nesting
from .operators import relations as R
from .operators.records import read_records
from .plans import show
from .plans.session import Lens

#: Rows of a row group.
GROUP = 400
#: Bytes of a row group of nested records that are assembled by joins.
NESTED_GROUP = 8 << 20

#: Columns of every physical type, with nulls; read by both engines.
_FLAT = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 1000 - 500 AS INTEGER) END AS i32,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 1000003 - o_custkey END AS i64,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_totalprice AS FLOAT) END AS f32,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS f64,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 3 = 0 END AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('k', o_orderkey % 97, ' ', o_orderpriority) END AS text
FROM orders"""


def _table(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables or ("orders",):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def _file_system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def written(spark: SparkSession, rows: DataFrame, kind: pa.Schema | None = None, **options: Any) -> str:
    """The folder, shared by all executors, of files that tasks write with Arrow's writer: row groups of GROUP rows. kind:
    the columns' Arrow types, where they are not Spark's own."""
    path = f"{shared_path(spark)}/written-{uuid.uuid4().hex}"
    options = {"row_group_size": GROUP} | options

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        held = list(batches)
        if sum(map(len, held)):
            found = pa.Table.from_batches(held)
            system, inner = _file_system(path)
            system.create_dir(inner, recursive=True)
            pq.write_table(found.cast(kind) if kind else found, f"{inner}/{uuid.uuid4().hex}.parquet", filesystem=system, **options)
            yield pa.RecordBatch.from_pydict({"rows": [len(found)]})

    rows.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return path


CASES: dict[str, dict[str, Any]] = {
    "gzip": {"compression": "gzip"},
    "v2_zstd": {"compression": "zstd", "data_page_version": "2.0", "use_dictionary": False, "data_page_size": 1024, "write_page_index": True},
    "v2_dictionary": {"compression": "snappy", "data_page_version": "2.0", "data_page_size": 512},
    "delta_lz4": {"compression": "lz4", "use_dictionary": False, "column_encoding": {"id": "DELTA_BINARY_PACKED", "i32": "DELTA_BINARY_PACKED", "i64": "DELTA_BINARY_PACKED", "f32": "BYTE_STREAM_SPLIT", "f64": "BYTE_STREAM_SPLIT", "flag": "RLE", "text": "DELTA_BYTE_ARRAY"}},
    "lengths_brotli": {"compression": "brotli", "use_dictionary": False, "column_encoding": {"id": "BYTE_STREAM_SPLIT", "i32": "BYTE_STREAM_SPLIT", "i64": "DELTA_BINARY_PACKED", "f32": "PLAIN", "f64": "PLAIN", "flag": "PLAIN", "text": "DELTA_LENGTH_BYTE_ARRAY"}},
    "plain": {"compression": "none", "use_dictionary": False},
}


def _case(name: str, options: dict[str, Any]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = written(spark, _table(spark, sf_dir, _FLAT).repartition(2, "id"), **options)
        return Lens(spark, path).records().drop("file_path", "row_group", "record")

    run.__name__ = f"records_{name}"
    query(_FLAT)(run)


for _name, _options in CASES.items():
    _case(_name, _options)

_LOGICAL = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(9, 2)) END AS d9,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(16, 3)) END AS d16,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(-o_totalprice AS DECIMAL(30, 2)) END AS d30,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 256 AS SMALLINT) END AS u8,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 4294967295 - o_orderkey END AS u32
FROM orders"""


@query(_LOGICAL)
def records_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals of all three kinds of storage, dates and unsigned integers."""
    kind = pa.schema([("id", pa.int64()), ("d9", pa.decimal128(9, 2)), ("d16", pa.decimal128(16, 3)), ("d30", pa.decimal128(30, 2)), ("day", pa.date32()), ("u8", pa.uint8()), ("u32", pa.uint32())])
    path = written(spark, _table(spark, sf_dir, _LOGICAL), kind, store_decimal_as_integer=True)
    return Lens(spark, path).records().drop("file_path", "row_group", "record")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(-1 - o_orderkey AS INTEGER) END AS u32, CAST(epoch_us(o_orderdate) // 86400000000 AS INTEGER) AS day FROM orders")
def records_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical types left out for some columns only."""
    rows = _table(spark, sf_dir, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 4294967295 - o_orderkey END AS u32, CAST(o_orderdate AS DATE) AS day FROM orders")
    path = written(spark, rows, pa.schema([("id", pa.int64()), ("u32", pa.uint32()), ("day", pa.date32())]))
    return Lens(spark, path).records(as_stored=["u32", "day"]).select("id", "u32", "day")


_SPARK_NESTED = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE transform(filter(sequence(0L, o_orderkey % 4), j -> j < o_orderkey % 4), j -> CASE WHEN j % 2 = 1 THEN NULL ELSE concat('t', j) END) END AS tags,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE named_struct('x', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END, 'ys', filter(sequence(0L, o_orderkey % 3), j -> j > 0)) END AS s,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE map_from_entries(filter(array(named_struct('k', 'a', 'v', o_orderkey), named_struct('k', 'b', 'v', CAST(NULL AS BIGINT))), e -> o_orderkey % 3 > 0 OR e.k = 'a')) END AS m,
  transform(filter(sequence(0L, o_orderkey % 3), j -> j > 0), j -> named_struct('k', j, 'v', array(j, j + 1))) AS deep
FROM orders"""

_NESTED = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 4)::BIGINT END AS tags_size,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE array_to_string(list_transform(range(o_orderkey % 4), lambda j: CASE WHEN j % 2 = 1 THEN '-' ELSE concat('t', j) END), ',') END AS tags,
  o_orderkey % 6 = 0 AS no_s, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS s_x,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 3)::BIGINT END AS ys_size,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 > 0 THEN 'a,b' ELSE 'a' END AS m_keys,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS m_a,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1:1,2' ELSE '1:1,2;2:2,3' END AS deep
FROM orders"""


def _nested_columns(rows: DataFrame) -> DataFrame:
    """Nested records as plain columns. Maps come as arrays of (key, value)."""
    pair = F.filter("m", lambda e: e["key"] == "a")
    deep = F.array_join(F.transform("deep", lambda e: F.concat(e["k"].cast("string"), F.lit(":"), F.array_join(e["v"].cast("array<string>"), ","))), ";")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return rows.select(
        "id", size("tags").alias("tags_size"), F.array_join("tags", ",", "-").alias("tags"), F.col("s").isNull().alias("no_s"), F.col("s.x").alias("s_x"), size("s.ys").alias("ys_size"),
        F.array_join(F.transform("m", lambda e: e["key"]), ",").alias("m_keys"), F.element_at(pair, 1)["value"].alias("m_a"), deep.alias("deep"),
    )


@query(_NESTED)
def records_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, structs, maps and lists of structs of lists: null, empty, filled, with null elements; decoded by row group."""
    path = f"{shared_path(spark)}/nested-{uuid.uuid4().hex}"
    _table(spark, sf_dir, _SPARK_NESTED).write.option("parquet.block.size", "65536").parquet(path)
    return _nested_columns(Lens(spark, path).records())


@query(_NESTED)
def assemble_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins of leaf streams. Each stream is written before the joins: their plan is then of scans of known sizes,
    not of all steps from the listing on, which the driver would hold for each of its stages. Row groups are of a bounded
    size, as the windows are over one each."""
    path = f"{shared_path(spark)}/nested-{uuid.uuid4().hex}"
    _table(spark, sf_dir, _SPARK_NESTED).write.option("parquet.block.size", str(NESTED_GROUP)).parquet(path)
    lens = Lens(spark, path, persist=True)
    nodes = lens.schema_nodes()
    leaves = [n["full_path"] for n in nodes if n["element_type"] == "column"]
    place = ["file_path", "row_group", "ord", "definition_level", "repetition_level", "value"]
    streams = {leaf: spark.read.parquet(_copy(spark, lens.values(leaf).select(place))) for leaf in leaves}
    lens.footers.unpersist()
    return _nested_columns(nesting.assemble(nodes, streams))


@query(_NESTED)
def shred_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records shredded to leaf streams and assembled again."""
    path = f"{shared_path(spark)}/nested-{uuid.uuid4().hex}"
    _table(spark, sf_dir, _SPARK_NESTED).coalesce(1).write.parquet(path)
    nodes = Lens(spark, path).schema_nodes()
    rows = spark.read.parquet(path)
    streams = {"id": rows.select(F.lit(0).alias("g"), F.col("id").alias("key"), F.array().cast("array<int>").alias("place"), F.col("id").alias("value"), F.lit(1).alias("definition_level"), F.lit(0).alias("repetition_level"))}
    for column in ("tags", "s", "m", "deep"):
        for leaf, stream in nesting.shred(rows, column, "id").items():
            streams[leaf] = stream.withColumnRenamed("id", "key").withColumn("g", F.lit(0))
    numbered = {leaf: s.withColumn("ord", F.row_number().over(W.partitionBy("g").orderBy("key", "place"))) for leaf, s in streams.items()}
    return _nested_columns(nesting.assemble(nodes, numbered, ("g",)))


# Pruning of several row groups by every kind of bounds -------------------------------------------------------------------

#: Values that 32 unsigned bits can't hold are null: no range has them.
_TYPED = """
SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS f64, CAST(o_totalprice AS FLOAT) AS f32, CASE WHEN o_orderkey BETWEEN 0 AND 4294967 THEN 4294967295 - o_orderkey * 1000 END AS u32, CAST(o_totalprice AS DECIMAL(12, 2)) AS dec,
  CAST(o_orderdate AS DATE) AS day, o_orderdate AS stamp, concat('p', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS text
FROM orders"""
#: Column, its Arrow type, range as SQL of both engines and as Python values.
_RANGES: tuple[tuple[str, str, str, str], ...] = (
    ("f64", "double", "1000", "2000.5"), ("f32", "double", "-5", "1500.25"), ("u32", "long", "4294000000", "4294967295"), ("dec", "decimal", "1000.005", "3000"),
    ("day", "date", "1995-01-01", "1995-03-31"), ("stamp", "timestamp", "1995-01-01 00:00:00", "1995-03-31 12:00:00"), ("text", "text", "p00000100", "p00000500"),
)
_SQL_OF = {
    "f64": "CAST(o_totalprice AS DOUBLE)", "f32": "CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE)", "u32": "(4294967295 - o_orderkey * 1000)", "dec": "CAST(o_totalprice AS DECIMAL(12, 2))",
    "day": "CAST(o_orderdate AS DATE)", "stamp": "o_orderdate", "text": "concat('p', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'))",
}


def _literal(kind: str, value: str) -> str:
    return {"date": f"DATE '{value}'", "timestamp": f"TIMESTAMP '{value}'", "text": f"'{value}'", "decimal": f"{value}::DECIMAL(12, 3)"}.get(kind, value)


def _python(kind: str, value: str) -> Any:
    import datetime
    import decimal

    made = {"double": float, "long": int, "decimal": decimal.Decimal, "date": datetime.date.fromisoformat, "timestamp": datetime.datetime.fromisoformat, "text": str}
    return made[kind](value)


_PRUNED = " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*)::BIGINT AS n, min(o_orderkey)::BIGINT AS lo, max(o_orderkey)::BIGINT AS hi, true AS pruned FROM orders WHERE {_SQL_OF[c]} BETWEEN {_literal(k, a)} AND {_literal(k, b)}" for c, k, a, b in _RANGES
)


def _sorted_files(spark: SparkSession, sf_dir: str) -> str:
    """For each column of _TYPED a folder of files with ranges of it, sorted by it, in row groups of a thousandth of the
    rows each, 1,000 at least. A task holds one row group; the sort is the engine's."""
    path = f"{shared_path(spark)}/typed-{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, _TYPED).withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))
    count = rows.count()
    most, parts = max(1000, count // 1000), max(1, min(R.tasks_for(spark), count // 4000))
    kind = pa.schema([("id", pa.int64()), ("f64", pa.float64()), ("f32", pa.float32()), ("u32", pa.uint32()), ("dec", pa.decimal128(12, 2)), ("day", pa.date32()), ("stamp", pa.timestamp("us")), ("text", pa.string())])

    def writer(by: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq
            from pyspark import TaskContext

            held, out, done = [], None, 0
            system, inner = _file_system(f"{path}/{by}")
            name = f"{inner}/{TaskContext.get().partitionId():05}.parquet"  # the same when a task runs again

            def flush(least: int) -> None:
                nonlocal held, out, done
                while held and (n := sum(map(len, held))) >= least:
                    whole = pa.Table.from_batches(held)
                    if out is None:
                        system.create_dir(inner, recursive=True)
                        out = pq.ParquetWriter(name, kind, filesystem=system, write_page_index=True, data_page_size=1024)
                    out.write_table(whole.slice(0, most).cast(kind), row_group_size=most)
                    done += min(n, most)
                    held = whole.slice(most).to_batches()

            for batch in batches:
                if len(batch):
                    held.append(batch)
                    flush(most)
            flush(1)
            if out is not None:
                out.close()
            yield pa.RecordBatch.from_pydict({"rows": [done]})

        return write

    for by, _, _, _ in _RANGES:
        ranged = rows.repartitionByRange(parts, by).sortWithinPartitions(by)
        ranged.mapInArrow(writer(by), "rows long").agg(F.sum("rows")).collect()
    return path


@query(_PRUNED)
def prune_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ranges of doubles, floats, unsigned integers, decimals, dates, timestamps and text, from the row groups that
    their bounds leave; some are left out for each."""
    lens = Lens(spark, _sorted_files(spark, sf_dir), persist=True)
    by = F.element_at(F.split("file_path", "/"), -2)
    groups = lens.chunks.where("column_path = 'id'").groupBy(by.alias("c")).agg(F.count("*").alias("groups"))
    out = None
    for column, kind, low, high in _RANGES:
        part = metrics.prune_chunks(lens.chunks.where(by == column), column, _python(kind, low), _python(kind, high)).select("file_path", "row_group", F.lit(column).alias("c"))
        out = part if out is None else out.unionByName(part)
    kept = out.groupBy("c", "file_path").agg(F.collect_set("row_group").alias("kept")).persist()  # a row for each file at most
    pruned = groups.join(kept.groupBy("c").agg(F.sum(F.size("kept")).alias("n")), "c", "left").select("c", (F.coalesce("n", F.lit(0)) < F.col("groups")).alias("pruned"))
    left = F.filter("row_groups", lambda g: F.array_contains("kept", g["row_group"]))
    feet = lens.footers.join(kept.select("file_path", "kept"), "file_path").withColumn("row_groups", left).drop("kept")
    nodes = lens.schema_nodes()
    rows = read_records(feet, nodes, [n["full_path"] for n in nodes if n["element_type"] == "column"], tasks=lens.tasks).withColumn("c", by)
    inside = None
    for column, kind, low, high in _RANGES:
        limits = [F.lit(_python(kind, v)) if kind != "timestamp" else F.lit(v).cast("timestamp_ntz") for v in (low, high)]
        one = (F.col("c") == column) & F.col(column).between(*limits)
        inside = one if inside is None else inside | one
    found = rows.where(inside).groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    every = spark.createDataFrame([(c,) for c, _, _, _ in _RANGES], "c string").join(found, "c", "left").join(pruned, "c", "left")
    return every.select("c", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", F.coalesce("pruned", F.lit(True)).alias("pruned"))


# Statistics, indexes, sizes and orders of row groups ----------------------------------------------------------------------

_GROUPED = f"SELECT *, (row_number() OVER (ORDER BY id) - 1) // {GROUP} AS g FROM ({_FLAT}) x"


def _in_order(spark: SparkSession, sf_dir: str, **options: Any) -> str:
    rows = _table(spark, sf_dir, _FLAT).repartition(1).sortWithinPartitions("id")
    return written(spark, rows, write_page_index=True, data_page_size=512, write_batch_size=50, use_dictionary=False, **options)


def _sums(sql: str) -> str:
    return f"SELECT g::BIGINT AS g, {sql} FROM ({_GROUPED}) y GROUP BY g"


@query(_sums("min(i64)::VARCHAR AS lo, max(i64)::VARCHAR AS hi, (count(*) - count(i64))::BIGINT AS nulls"))
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and nulls of a column in each of several row groups."""
    found = metrics.chunk_bounds_text(Lens(spark, _in_order(spark, sf_dir)).chunks.where("column_path = 'i64'"))
    return found.select(F.col("row_group").cast("long").alias("g"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("null_count").alias("nulls"))


@query(_sums("min(i64)::BIGINT AS lo, max(i64)::BIGINT AS hi, (count(*) - count(i64))::BIGINT AS nulls"))
def page_index_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and nulls of pages by the column index, together for each row group."""
    chunks = Lens(spark, _in_order(spark, sf_dir)).chunks.where("column_path = 'i64'")
    found = metrics.index_bounds_text(R.column_index(chunks), chunks)
    return found.groupBy(F.col("row_group").cast("long").alias("g")).agg(F.min(F.col("min").cast("long")).alias("lo"), F.max(F.col("max").cast("long")).alias("hi"), F.sum("null_count").alias("nulls"))


@query(_sums("count(*)::BIGINT AS n, count(text)::BIGINT AS there, sum(strlen(text))::BIGINT AS bytes"))
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of levels and bytes of text of each row group."""
    chunks = Lens(spark, _in_order(spark, sf_dir)).chunks.where("column_path = 'text'")
    s = F.col("size_statistics")
    return chunks.select(F.col("row_group").cast("long").alias("g"), F.col("num_values").alias("n"), F.element_at(s["definition_level_histogram"], 2).alias("there"), s["unencoded_byte_array_data_bytes"].alias("bytes"))


@query(_sums("count(*)::BIGINT AS n, count(*)::BIGINT AS entries, true AS first_is_zero"))
def pages_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found by the offset index: their entries, and the rows that the index says, of each row group."""
    chunks = Lens(spark, _in_order(spark, sf_dir)).chunks.where("column_path = 'i32'")
    pages = R.pages(chunks).where("page_type <> 'DICTIONARY_PAGE'").groupBy("row_group").agg(F.sum("num_values").alias("entries"))
    index = R.offset_index(chunks).groupBy("row_group").agg(F.min("first_row_index").alias("first"))
    rows = chunks.select("row_group", "row_count").join(pages, "row_group").join(index, "row_group")
    return rows.select(F.col("row_group").cast("long").alias("g"), F.col("row_count").alias("n"), "entries", (F.col("first") == 0).alias("first_is_zero"))


@query(_sums("0 AS column_idx, true AS descending, false AS nulls_first"))
def sorting_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.parquet as pq

    path = _in_order(spark, sf_dir, sorting_columns=[pq.SortingColumn(0, True, False)])
    return metrics.sorting_columns(Lens(spark, path).relation("row_groups")).select(F.col("row_group").cast("long").alias("g"), "column_idx", "descending", "nulls_first")


@query(f"SELECT id, text FROM ({_GROUPED}) y WHERE g IN (1, 3)")
def row_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, _in_order(spark, sf_dir), row_groups=[1, 3], columns=["id", "text"]).records().select("id", "text")


@query(_sums("count(*)::BIGINT AS pages_ok, count(*)::BIGINT AS n"))
def page_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of pages whose checksum fits their body."""
    pages = Lens(spark, _in_order(spark, sf_dir, write_page_checksum=True), columns=["f64"]).pages(verify=True)
    return pages.groupBy(F.col("row_group").cast("long").alias("g")).agg(F.sum(F.when(F.col("crc_ok"), F.col("num_values"))).alias("pages_ok"), F.sum("num_values").alias("n"))


@query(f"SELECT g::BIGINT AS g, count(*)::BIGINT AS rows, min(i32)::VARCHAR AS lo, max(i32)::VARCHAR AS hi, (count(*) - count(i32))::BIGINT AS nulls FROM ({_GROUPED}) y GROUP BY g")
def cli_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `row-groups PATH --column i32` shows, without sizes."""
    found = show.row_group_rows(Lens(spark, _in_order(spark, sf_dir)), "i32")
    return found.select(F.col("row_group").cast("long").alias("g"), F.col("row_count").alias("rows"), F.col("min").alias("lo"), F.col("max").alias("hi"), "nulls")


@query(f"SELECT g::BIGINT AS g, count(*)::BIGINT AS n FROM ({_GROUPED}) y WHERE g = 2 GROUP BY g")
def cli_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `pages PATH --column text --row-group 2` shows: entries of its pages."""
    found = show.page_rows(Lens(spark, _in_order(spark, sf_dir)), "text", 2)
    return found.groupBy(F.col("row_group").cast("long").alias("g")).agg(F.sum("num_values").alias("n"))


@query(f"SELECT count(*)::BIGINT AS n, min(id)::BIGINT AS lo, max(id)::BIGINT AS hi, 1 AS unreadable FROM ({_FLAT}) x")
def permissive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a folder in which one file is damaged: its fault is a row, the others' records are all there."""
    path = written(spark, _table(spark, sf_dir, _FLAT).repartition(2, "id"))

    def spoil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sum(map(len, batches))
        if rows:
            system, inner = _file_system(path)
            with system.open_output_stream(f"{inner}/damaged.parquet") as out:
                out.write(b"PAR1 and nothing else that is Parquet PAR1")
        yield pa.RecordBatch.from_pydict({"n": [rows]})

    spark.range(1).repartition(1).mapInArrow(spoil, "n long").collect()
    feet = R.footers(spark, path, mode="PERMISSIVE")
    bad = R.files(feet).where("error_class is not null").agg(F.count("*").cast("int").alias("unreadable"))
    rows = Lens(spark, path, mode="PERMISSIVE").records(columns=["id"]).where("error_class is null")
    return rows.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).join(F.broadcast(bad))


# Bloom filters ------------------------------------------------------------------------------------------------------------

#: Keys of a file at most, and keys that its filter is made for as a multiple of those: with the default chance of 0.01, this
#: many times 9.7 bits, which is a little below 128 bytes a key and is rounded up to a power of two.
FILTER_KEYS, FILTER_ROOM = 1 << 18, 105


@query("SELECT CAST(o_custkey AS BIGINT) * 2 + d AS k, d = 0 AS might FROM (SELECT DISTINCT o_custkey FROM orders) x, (SELECT 0 AS d UNION ALL SELECT 1) y")
def bloom_present_and_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are there and keys that are not, in filters so large that no absent key is likely to be found: files and bytes
    of filters grow with the keys. A block of 32 bytes gets one key of four at most on average, and finds an absent key
    with chance 3e-11: with a million keys in four files 1e-4 for all lookups together."""
    keys = _table(spark, sf_dir, "SELECT DISTINCT CAST(o_custkey AS BIGINT) * 2 AS k FROM orders")
    path = f"{shared_path(spark)}/bloom-{uuid.uuid4().hex}"
    count = keys.count()
    files = max(2, -(-count // FILTER_KEYS))
    wide = max(1_000_000, FILTER_ROOM * -(-count // files))
    options = {"parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.expected.ndv#k": str(wide), "parquet.bloom.filter.max.bytes": str(64 << 20), "parquet.enable.dictionary": "false"}
    keys.repartition(files, "k").write.options(**options).parquet(path)
    probes = keys.select(F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    found = metrics.probe(Lens(spark, path).chunks, "k", probes, "k")
    return found.groupBy(F.col("value").alias("k")).agg(F.bool_or("might_contain").alias("might"))


@query("SELECT c_name AS s, length(c_name)::BIGINT AS n FROM customer")
def bloom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in a filter: all of it is found."""
    names = _table(spark, sf_dir, "SELECT DISTINCT c_name AS s FROM customer", "customer")
    path = f"{shared_path(spark)}/bloom-{uuid.uuid4().hex}"
    names.coalesce(1).write.options(**{"parquet.bloom.filter.enabled#s": "true", "parquet.bloom.filter.expected.ndv#s": "20000", "parquet.enable.dictionary": "false"}).parquet(path)
    found = metrics.probe(Lens(spark, path).chunks, "s", names, "s", explain=True)
    return found.where("might_contain and size(probe.bits) = 8").select(F.col("value").alias("s"), F.length("value").cast("long").alias("n"))


# Dumps --------------------------------------------------------------------------------------------------------------------

@query(ORACLES["column_chunks"])
def dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column chunks of dumps that were written as files, found to be dumps, and read again."""
    from .catalog import TABLES, chunk_rows

    path = f"{shared_path(spark)}/dumps-{uuid.uuid4().hex}"
    Lens(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]).dump().select("json").write.option("maxRecordsPerFile", 1).text(path)
    return chunk_rows(Lens(spark, path, from_dumps=None).chunks)

