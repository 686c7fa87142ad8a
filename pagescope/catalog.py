"""Registered queries of the engine and the SQL that must give the same rows.

SQL over files names the folder that the rows are compared on; SQL over tables uses the registered views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import blooms, logical
from .operators import metrics, nesting
from .operators import relations as R
from .plans.session import Lens
from .sources import dumps

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_AT = "/root/testdata/sf0.01"
_ALL = f"'{_AT}/*.parquet'"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(made: Query) -> Query:
        QUERIES[made.__name__] = made
        if sql:
            ORACLES[made.__name__] = sql
        return made

    return add


def _lens(spark: SparkSession, sf_dir: str, *tables: str) -> Lens:
    return Lens(spark, [f"{sf_dir}/{t}.parquet" for t in tables or TABLES])


def _file() -> Column:
    return F.element_at(F.split("file_path", "/"), -1).alias("f")


#: Rows of a page of row_index_to_page's copy.
PAGE_ROWS = 1000

def _table_name(sf_dir: str) -> Column:
    """The table that a file belongs to: a table is a file or a folder of files."""
    folder = re.escape(sf_dir.rstrip("/").rsplit("/", 1)[-1])
    return F.regexp_extract("file_path", rf"^.*?/{folder}/([^/]+)\.parquet(?:/|$)", 1).alias("t")


def _bounds(spark: SparkSession, sf_dir: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """t, c, lo, hi (text) and nulls of these columns of tables, whatever files and row groups they have: from statistics,
    and from the values of columns whose statistics don't tell."""
    chunks = _lens(spark, sf_dir, *dict.fromkeys(t for t, _ in wanted)).chunks.withColumn("t", _table_name(sf_dir))
    own = chunks.where(F.concat_ws("/", "t", "column_path").isin([f"{t}/{c}" for t, c in wanted]))
    found = metrics.column_bounds_text(own, "t").withColumnsRenamed({"column_path": "c", "min": "lo", "max": "hi", "null_count": "nulls"}).persist()
    rows = found.where("known").drop("known")
    for t, c in [(r["t"], r["c"]) for r in found.where("not known").select("t", "c").distinct().collect()]:
        value = F.col("value")
        scanned = _lens(spark, sf_dir, t).values(c).agg(F.min(value).cast("string").alias("lo"), F.max(value).cast("string").alias("hi"), F.count_if(value.isNull()).alias("nulls"))
        rows = rows.where(~((F.col("t") == t) & (F.col("c") == c))).unionByName(scanned.select(F.lit(t).alias("t"), F.lit(c).alias("c"), "lo", "hi", "nulls"))
    every = spark.createDataFrame(wanted, "t string, c string")
    return every.join(rows, ["t", "c"], "left").withColumn("nulls", F.coalesce("nulls", F.lit(0)))


_BASE = "parse_filename(file_name) AS f"
_PATH = "replace(path_in_schema, ', ', '.')"


@query(f"SELECT parse_filename(file_name) AS f, {_PATH} AS p, sum(total_compressed_size)::BIGINT AS c, sum(total_uncompressed_size)::BIGINT AS u FROM parquet_metadata({_ALL}) GROUP BY ROLLUP(1, 2)")
def compression_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _lens(spark, sf_dir).chunks.withColumn("f", _file())
    return chunks.rollup("f", F.col("column_path").alias("p")).agg(F.sum("total_compressed_size").alias("c"), F.sum("total_uncompressed_size").alias("u"))


@query(f"SELECT f, c, u, c / u AS ratio, (1 - c / u) * 100 AS saved FROM (SELECT parse_filename(file_name) AS f, sum(total_compressed_size)::DOUBLE AS c, sum(total_uncompressed_size)::DOUBLE AS u FROM parquet_metadata({_ALL}) GROUP BY 1)")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.compression(_lens(spark, sf_dir).chunks.withColumn("f", _file()), "f")
    return found.select("f", F.col("total_compressed").cast("double").alias("c"), F.col("total_uncompressed").cast("double").alias("u"), "ratio", F.col("space_saved_percent").alias("saved"))


@query(f"SELECT {_BASE}, num_rows::BIGINT AS num_rows, num_row_groups::BIGINT AS row_group_count, file_size_bytes::BIGINT AS file_size, footer_size::BIGINT AS footer_size, format_version::BIGINT AS version, created_by FROM parquet_file_metadata({_ALL})")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.file_summary(_lens(spark, sf_dir).footers)
    return found.select(_file(), "num_rows", "row_group_count", "file_size", "footer_size", F.col("version").cast("long").alias("version"), "created_by")


@query(" UNION ALL ".join(f"SELECT '{t}' AS t, count(*)::BIGINT AS n FROM {t}" for t in TABLES))
def row_count_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.files(_lens(spark, sf_dir).footers).groupBy(_table_name(sf_dir)).agg(F.sum("row_count").alias("n"))


@query(f"SELECT {_BASE}, row_group_id::BIGINT AS g, column_id::BIGINT AS i, {_PATH} AS p, type AS kind, compression AS codec, num_values::BIGINT AS n, data_page_offset::BIGINT AS data_at, dictionary_page_offset::BIGINT AS dictionary_at, total_compressed_size::BIGINT AS c, total_uncompressed_size::BIGINT AS u FROM parquet_metadata({_ALL})")
def column_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(_lens(spark, sf_dir).chunks)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    long = lambda c, name: F.col(c).cast("long").alias(name)
    sizes = (("num_values", "n"), ("data_page_offset", "data_at"), ("dictionary_page_offset", "dictionary_at"), ("total_compressed_size", "c"), ("total_uncompressed_size", "u"))
    return chunks.select(_file(), long("row_group", "g"), long("column_id", "i"), F.col("column_path").alias("p"), F.col("type").alias("kind"), "codec", *[long(*x) for x in sizes])


@query(f"SELECT parse_filename(file_name) AS f, row_group_id::BIGINT AS g, max(row_group_num_rows)::BIGINT AS n, max(row_group_bytes)::BIGINT AS b, count(*)::BIGINT AS columns FROM parquet_metadata({_ALL}) GROUP BY 1, 2")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_groups(_lens(spark, sf_dir).footers).select(_file(), F.col("row_group").cast("long").alias("g"), F.col("row_count").alias("n"), F.col("total_byte_size").alias("b"), F.col("column_count").cast("long").alias("columns"))


@query(f"SELECT {_BASE}, column_id::BIGINT AS i, unnest(string_split(encodings, ', ')) AS encoding FROM parquet_metadata({_ALL})")
def chunk_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens(spark, sf_dir).chunks.select(_file(), F.col("column_id").cast("long").alias("i"), F.explode("encodings").alias("encoding"))


@query(f"SELECT parse_filename(file_name) AS f, compression AS codec, type AS kind, count(*)::BIGINT AS chunks, sum(total_compressed_size)::BIGINT AS c FROM parquet_metadata({_ALL}) GROUP BY ALL")
def codec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens(spark, sf_dir).chunks.groupBy(_file(), "codec", F.col("type").alias("kind")).agg(F.count("*").alias("chunks"), F.sum("total_compressed_size").alias("c"))


@query(f"SELECT f, p, c FROM (SELECT parse_filename(file_name) AS f, {_PATH} AS p, total_compressed_size::BIGINT AS c FROM parquet_metadata({_ALL})) ORDER BY c DESC, f, p LIMIT 10")
def widest_columns_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens(spark, sf_dir).chunks.select(_file(), F.col("column_path").alias("p"), F.col("total_compressed_size").alias("c")).orderBy(F.desc("c"), "f", "p").limit(10)


@query(f"SELECT parse_filename(file_name) AS f, name, type AS kind, type_length, repetition_type AS repetition, num_children::BIGINT AS children, converted_type FROM parquet_schema({_ALL})")
def schema_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.schema_elements(_lens(spark, sf_dir).footers).select(_file(), "name", F.col("type").alias("kind"), F.col("type_length").cast("string").alias("type_length"), "repetition", F.col("num_children").cast("long").alias("children"), "converted_type")


@query(f"SELECT parse_filename(file_name) AS f, decode(key) AS key, octet_length(value)::BIGINT AS size FROM parquet_kv_metadata({_ALL})")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.key_values(_lens(spark, sf_dir).footers).select(_file(), "key", F.octet_length("value").cast("long").alias("size"))


@query("SELECT 'o_orderkey' AS c, min(o_orderkey)::BIGINT AS lo, max(o_orderkey)::BIGINT AS hi, count(o_orderkey)::BIGINT AS n FROM orders UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber), count(l_linenumber) FROM lineitem UNION ALL SELECT 'n_regionkey', min(n_regionkey), max(n_regionkey), count(n_regionkey) FROM nation")
def stats_only_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for t, c in (("orders", "o_orderkey"), ("lineitem", "l_linenumber"), ("nation", "n_regionkey")):
        lens = _lens(spark, sf_dir, t)
        found = metrics.stats_only_agg(lens.chunks, c)
        if not found.where("exact").count():
            found = lens.values(c).agg(F.min("value").cast("long").alias("min_value"), F.max("value").cast("long").alias("max_value"), F.count("value").alias("value_count"))
        parts.append(found.select(F.lit(c).alias("c"), F.col("min_value").alias("lo"), F.col("max_value").alias("hi"), F.col("value_count").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _text_bounds(t: str, c: str, shown: str) -> str:
    return f"SELECT '{c}' AS c, {shown.format(f'min({c})')} AS lo, {shown.format(f'max({c})')} AS hi, (count(*) - count({c}))::BIGINT AS nulls FROM {t}"


_BOUNDS = (("customer", "c_custkey", "{}::VARCHAR"), ("orders", "o_orderdate", "{}::VARCHAR"), ("nation", "n_name", "{}"), ("part", "p_brand", "{}"), ("conversations", "role", "{}"), ("labels", "quality", "{}::VARCHAR"), ("events", "event_id", "{}::VARCHAR"))


@query(" UNION ALL ".join(_text_bounds(*x) for x in _BOUNDS))
def chunk_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, [(t, c) for t, c, _ in _BOUNDS]).select("c", "lo", "hi", "nulls")


@query("SELECT 's_acctbal' AS c, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part")
def chunk_minmax_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bounds(spark, sf_dir, [("supplier", "s_acctbal"), ("part", "p_retailprice")])
    return found.select("c", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))


_NULLS = (("lineitem", "l_orderkey"), ("lineitem", "l_returnflag"), ("documents", "text"), ("documents", "source"), ("events", "value"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, (count(*) - count({c}))::BIGINT AS nulls FROM {t}" for t, c in _NULLS))
def chunk_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.concat_ws("/", "t", "c").isin([f"{t}/{c}" for t, c in _NULLS])
    chunks = _lens(spark, sf_dir, *dict.fromkeys(t for t, _ in _NULLS)).chunks.select(_table_name(sf_dir), F.col("column_path").alias("c"), F.col("statistics.null_count").alias("nulls"))
    found = chunks.where(wanted).groupBy("t", "c").agg(F.sum("nulls").alias("nulls"), F.bool_and(F.col("nulls").isNotNull()).alias("known")).persist()
    rows = found.where("known").drop("known")
    for t, c in [(r["t"], r["c"]) for r in found.where("not known").collect()]:
        scanned = _lens(spark, sf_dir, t).values(c).agg(F.count_if(F.col("value").isNull()).alias("nulls"))
        rows = rows.unionByName(scanned.select(F.lit(t).alias("t"), F.lit(c).alias("c"), "nulls"))
    return spark.createDataFrame(_NULLS, "t string, c string").join(rows, ["t", "c"], "left").withColumn("nulls", F.coalesce("nulls", F.lit(0)))


@query(f"SELECT f, i, page_type, encoding, sum(n)::BIGINT AS n FROM (SELECT parse_filename(file_name) AS f, column_id::BIGINT AS i, e.page_type AS page_type, e.encoding AS encoding, e.count AS n FROM (SELECT file_name, column_id, unnest(encoding_stats) AS e FROM parquet_metadata({_ALL}))) GROUP BY ALL")
def encoding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.encoding_stats(_lens(spark, sf_dir).chunks).groupBy(_file(), F.col("column_id").cast("long").alias("i"), "page_type", "encoding").agg(F.sum("count").alias("n"))


@query(f"SELECT f, i, page_type, encoding, sum(n)::BIGINT AS n FROM (SELECT parse_filename(file_name) AS f, column_id::BIGINT AS i, e.page_type AS page_type, e.encoding AS encoding, e.count AS n FROM (SELECT file_name, column_id, unnest(encoding_stats) AS e FROM parquet_metadata({_ALL}))) GROUP BY ALL")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens(spark, sf_dir).pages().groupBy(_file(), F.col("column_id").cast("long").alias("i"), "page_type", "encoding").agg(F.count("*").alias("n"))


@query("SELECT 'lineitem' AS t, 11 * count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'orders', 6 * count(*)::BIGINT FROM orders UNION ALL SELECT 'documents', 5 * count(*)::BIGINT FROM documents UNION ALL SELECT 'nation', 3 * count(*)::BIGINT FROM nation")
def page_value_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lens(spark, sf_dir, "lineitem", "orders", "documents", "nation").pages().where("page_type <> 'DICTIONARY_PAGE'")
    return found.groupBy(_table_name(sf_dir)).agg(F.sum("num_values").alias("n"))


@query(f"SELECT parse_filename(file_name) AS f, column_id::BIGINT AS i, true AS tiles FROM parquet_metadata({_ALL})")
def page_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens(spark, sf_dir)
    return R.tiling(lens.pages(), lens.chunks).select(_file(), F.col("column_id").cast("long").alias("i"), "tiles")


def _decoded(name: str, table: str, column: str, path: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lens(spark, sf_dir, table).values(path or column).select(F.col("value").alias(column))

    run.__name__ = f"decode_{name}"
    query(f"SELECT {column} FROM {table}")(run)


for _name, _table, _column in (("int32", "lineitem", "l_linenumber"), ("int64", "lineitem", "l_orderkey"), ("double", "lineitem", "l_extendedprice"), ("string", "lineitem", "l_returnflag"), ("text", "documents", "text"), ("timestamp", "orders", "o_orderdate")):
    _decoded(_name, _table, _column)


@query("SELECT unnest(embedding) AS x FROM embeddings")
def decode_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens(spark, sf_dir, "embeddings").values("embedding.list.element").select(F.col("value").alias("x"))


@query("SELECT epoch_us(ts)::BIGINT AS ts, event_id FROM events")
def decode_physical_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens(spark, sf_dir, "events")
    stamps = lens.values("ts", apply_logical=False).select("row_group", "ord", F.col("value").alias("ts"))
    ids = lens.values("event_id").select("row_group", "ord", F.col("value").alias("event_id"))
    return stamps.join(ids, ["row_group", "ord"]).select("ts", "event_id")


def _entries(found: DataFrame) -> DataFrame:
    """column_path and physical value: dictionary entries where all pages of a chunk are indices, else its pages' values."""
    key, whole = ["file_path", "row_group", "column_id"], metrics.fully_dictionary_encoded(found)
    words = R.dictionary_values(found).join(whole, key, "left_semi").select("column_path", "value")
    rest = R.page_values(found.join(whole, key, "left_anti")).where("not is_null").select("column_path", "value")
    return words.unionByName(rest)


@query("SELECT DISTINCT n_name AS v FROM nation UNION ALL SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT DISTINCT l_returnflag FROM lineitem")
def dictionary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens(spark, sf_dir, "nation", "customer", "lineitem")
    found = R.pages(lens.chunks.where(F.col("column_path").isin("n_name", "c_mktsegment", "l_returnflag")))
    return _entries(found).select("column_path", F.col("value.bin").cast("string").alias("v")).distinct().select("v")


@query("SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus)::BIGINT AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders")
def dictionary_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _lens(spark, sf_dir, "orders").chunks.where(F.col("column_path").isin("o_orderstatus", "o_orderpriority", "o_custkey"))
    return _entries(R.pages(own)).groupBy(F.col("column_path").alias("c")).agg(F.countDistinct("value").alias("n"))


@query("SELECT CASE WHEN i = 1 THEN 0 ELSE 1 END AS rl, 3 AS dl, count(*)::BIGINT AS n FROM (SELECT generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def level_histogram_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lens(spark, sf_dir, "embeddings").values("embedding.list.element")
    return nesting.level_histogram(found).select(F.col("repetition_level").alias("rl"), F.col("definition_level").alias("dl"), "n")


@query("SELECT vec_id, CASE WHEN i = 1 THEN 0 ELSE 1 END AS rl, 3 AS dl, x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings)")
def shred_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    (stream,) = nesting.shred(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id").values()
    return stream.select("vec_id", F.col("repetition_level").alias("rl"), F.col("definition_level").alias("dl"), F.col("value").alias("x"))


@query("SELECT vec_id, embedding, label FROM embeddings")
def assemble_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens(spark, sf_dir, "embeddings").records().select("vec_id", "embedding", "label")


@query("SELECT count(*)::BIGINT AS n, min(l_orderkey)::BIGINT AS lo, max(l_orderkey)::BIGINT AS hi FROM lineitem WHERE l_orderkey BETWEEN 100 AND 2000")
def rowgroup_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = metrics.prune_chunks(_lens(spark, sf_dir, "lineitem").chunks, "l_orderkey", 100, 2000)
    found = R.pages(kept)
    from .operators.values import column_values

    values = column_values(found, ("INT64", None)).where(F.col("value").between(100, 2000))
    return values.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def shared_path(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A temporary one only where none is set and all tasks
    run on this machine, as in tests."""
    import tempfile

    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def _copy(spark: SparkSession, table: DataFrame, **options: str) -> str:
    """A copy of a table with what the given files lack, in the folder that all executors share."""
    import uuid

    path = f"{shared_path(spark)}/copy-{uuid.uuid4().hex}"
    table.write.options(**options).parquet(path)
    return path


@query("SELECT count(*)::BIGINT AS n, sum(o_totalprice)::DECIMAL(18, 2) AS total FROM orders WHERE o_orderkey BETWEEN 5000 AND 5200")
def page_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the pages that the column index leaves, read by their row numbers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartitionByRange(2, "o_orderkey").sortWithinPartitions("o_orderkey")
    path = _copy(spark, orders, **{"parquet.page.size": "4096", "parquet.page.row.count.limit": "500"})
    spans = metrics.prune_pages(Lens(spark, path).chunks, "o_orderkey", 5000, 5200).groupBy("file_path").agg(F.collect_list(F.struct("first_row", "last_row")).alias("spans"))
    rows = spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("_metadata.file_path").alias("at"), F.col("_metadata.row_index").alias("row"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    kept = rows.join(spans, name(F.col("at")) == name(F.col("file_path"))).where(F.exists("spans", lambda s: F.col("row").between(s["first_row"], s["last_row"])))
    return kept.where(F.col("o_orderkey").between(5000, 5200)).agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(18,2)").alias("total"))


@query("SELECT count(*)::BIGINT AS n, true AS found FROM (SELECT DISTINCT o_custkey FROM orders)")
def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    path = _copy(spark, keys.coalesce(1), **{"parquet.bloom.filter.enabled#o_custkey": "true", "parquet.bloom.filter.expected.ndv#o_custkey": "20000", "parquet.enable.dictionary": "false"})
    found = metrics.probe(Lens(spark, path).chunks, "o_custkey", keys.select("o_custkey").distinct(), "o_custkey")
    return found.groupBy("value").agg(F.bool_or("might_contain").alias("found")).groupBy("found").agg(F.count("*").alias("n")).select("n", "found")


@query()
def bloom_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    path = _copy(spark, keys.coalesce(1), **{"parquet.bloom.filter.enabled#p_partkey": "true", "parquet.bloom.filter.expected.ndv#p_partkey": "20000", "parquet.enable.dictionary": "false"})
    wanted = keys.select((F.col("p_partkey") * 3).alias("value"))
    return metrics.probe(Lens(spark, path).chunks, "p_partkey", wanted, explain=True).select("value", "probe.hash", "probe.block_index", "probe.bits", "probe.might_contain")


def _xxh64_sql() -> str:
    """xxHash64 of eight bytes, step by step in 128 bits modulo 2**64."""
    from .format.bloom import P1, P2, P3, P4, P5

    one = 1 << 64
    wide = lambda x: f"'{x}'::UHUGEINT"
    times = lambda x, p: f"(({x})::UHUGEINT * {wide(p)} % {wide(one)})"
    turn = lambda x, n: f"({times(x, 1 << n)} + ({x})::UHUGEINT // {wide(1 << (64 - n))})::UBIGINT"
    fold = lambda x, n: f"xor({x}, {x} >> {n})"
    return f"""
WITH a AS (SELECT p_partkey, {times("p_partkey", P2)}::UBIGINT AS x FROM part),
b AS (SELECT p_partkey, xor('{(P5 + 8) % one}'::UBIGINT, {times(turn("x", 31), P1)}::UBIGINT) AS x FROM a),
c AS (SELECT p_partkey, (({times(turn("x", 27), P1)} + {wide(P4)}) % {wide(one)})::UBIGINT AS x FROM b),
d AS (SELECT p_partkey, {times(fold("x", 33), P2)}::UBIGINT AS x FROM c),
e AS (SELECT p_partkey, {times(fold("x", 29), P3)}::UBIGINT AS x FROM d),
f AS (SELECT p_partkey, {fold("x", 32)} AS x FROM e)
SELECT p_partkey, CASE WHEN x >= '{1 << 63}'::UBIGINT THEN (x::HUGEINT - '{one}'::HUGEINT)::BIGINT ELSE x::BIGINT END AS hashed FROM f"""


@query(_xxh64_sql())
def xxh64_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return keys.select("p_partkey", blooms.hashed(F.col("p_partkey"), "INT64").alias("hashed"))


@query(f"SELECT parse_filename(file_name) AS f, count(*)::BIGINT AS chunks, sum(num_values)::BIGINT AS n, sum(total_compressed_size)::BIGINT AS c FROM parquet_metadata({_ALL}) GROUP BY 1")
def dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens(spark, sf_dir)
    chunks = R.column_chunks(dumps.restore(lens.dump()))
    return chunks.groupBy(_file()).agg(F.count("*").alias("chunks"), F.sum("num_values").alias("n"), F.sum("total_compressed_size").alias("c"))


@query("SELECT count(*)::BIGINT AS n, min(o_orderkey)::BIGINT AS lo FROM orders")
def row_index_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the page that holds them: the native scan's row numbers against the offset index. Rows meet pages by blocks of
    PAGE_ROWS row numbers, of which a page covers one or two."""
    path = _copy(spark, spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), **{"parquet.page.row.count.limit": str(PAGE_ROWS)})
    from pyspark.sql import Window as W

    lens = Lens(spark, path, persist=True)
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("f")
    at = ["file_path", "row_group"]
    own = lens.chunks.where("column_path = 'o_orderkey' and offset_index_offset is not null")
    before = F.coalesce(F.sum("row_count").over(W.partitionBy("file_path").orderBy("row_group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = R.row_groups(lens.footers).select(*at, "row_count", before.alias("before"))  # an index counts from its row group on
    after = F.lead("first_row_index").over(W.partitionBy(*at).orderBy("page_ordinal"))
    spans = R.offset_index(own).withColumn("next", after).join(groups, at)
    pages = spans.select(name("file_path"), (F.col("before") + F.col("first_row_index")).alias("start"), (F.col("before") + F.coalesce("next", "row_count")).alias("end")).where("start < end")
    block = lambda c: F.floor(c / PAGE_ROWS)
    pages = pages.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))))
    rows = spark.read.parquet(path).select("o_orderkey", name("_metadata.file_name"), F.col("_metadata.row_index").alias("row")).withColumn("block", block(F.col("row")))
    held = rows.join(pages, ["f", "block"]).where((F.col("start") <= F.col("row")) & (F.col("row") < F.col("end")))
    return held.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"))


@query(f"SELECT sum(total_compressed_size)::BIGINT AS c FROM parquet_metadata({_ALL}) WHERE replace(path_in_schema, ', ', '.') IN ('l_orderkey', 'o_orderkey')")
def projected_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES], columns=["l_orderkey", "o_orderkey", "not.there"])
    return lens.chunks.agg(F.sum("total_compressed_size").alias("c"))


@query("SELECT count(*)::BIGINT AS leaves FROM (SELECT name FROM parquet_schema('/root/testdata/sf0.01/*.parquet') WHERE type IS NOT NULL)")
def count_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.count_leaves(R.schema_elements(_lens(spark, sf_dir).footers)).agg(F.sum("leaf_columns").alias("leaves"))


@query("SELECT n_name AS value, n_nationkey AS k FROM nation")
def page_values_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of different types from one relation, joined by their places."""
    found = R.page_values(_lens(spark, sf_dir, "nation").pages())
    at = ["file_path", "row_group", "page_ordinal", "entry_ordinal"]
    names = found.where("column_path = 'n_name'").select(*at, metrics.physical_value("BYTE_ARRAY").cast("string").alias("value"))
    keys = found.where("column_path = 'n_nationkey'").select(*at, metrics.physical_value("INT32").alias("k"))
    return names.join(keys, at).select("value", "k")


@query(f"SELECT type AS kind, compression AS codec, count(*)::BIGINT AS n FROM parquet_metadata({_ALL}) GROUP BY ALL")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lens(spark, sf_dir).register("parquet_")
    return spark.sql("SELECT type AS kind, codec, count(*) AS n FROM parquet_column_chunks GROUP BY type, codec")


@query(f"SELECT name, 'STRING' AS logical FROM parquet_schema({_ALL}) WHERE converted_type = 'UTF8'")
def converted_to_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.schema_elements(_lens(spark, sf_dir).footers).where("converted_type = 'UTF8'")
    return found.select("name", logical.logical_type_of_converted(F.col("converted_type")).alias("logical"))
