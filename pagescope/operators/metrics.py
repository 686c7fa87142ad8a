"""Sizes, bounds, pruning and lookups over the relations; all of it Catalyst's."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import blooms, bounds, logical
from .relations import SLOT, bloom_blocks, bloom_filters, column_index, offset_index


def ratio(compressed: Column, uncompressed: Column) -> Column:
    return F.when(uncompressed > 0, compressed / uncompressed).otherwise(F.lit(0.0))


def compression(chunks: DataFrame, *by: str) -> DataFrame:
    """Bytes, ratio, per cent saved and MB by any columns of chunks."""
    sums = chunks.groupBy(*by).agg(F.sum("total_compressed_size").alias("total_compressed"), F.sum("total_uncompressed_size").alias("total_uncompressed"))
    share = ratio(F.col("total_compressed"), F.col("total_uncompressed"))
    return sums.withColumns({"ratio": share, "space_saved_percent": F.when(F.col("total_uncompressed") > 0, (1 - share) * 100).otherwise(0.0), "compressed_mb": F.col("total_compressed") / (1 << 20), "uncompressed_mb": F.col("total_uncompressed") / (1 << 20)})


def compression_rollup(chunks: DataFrame) -> DataFrame:
    """Bytes and ratio of each column in each file, of each file, and of all."""
    sums = chunks.rollup("file_path", "column_path").agg(F.sum("total_compressed_size").alias("total_compressed"), F.sum("total_uncompressed_size").alias("total_uncompressed"))
    return sums.withColumn("ratio", ratio(F.col("total_compressed"), F.col("total_uncompressed")))


def file_summary(feet: DataFrame) -> DataFrame:
    return feet.select("file_path", "file_size", "version", "created_by", "num_rows", "row_count", "row_group_count", "column_count", "footer_offset", "footer_size")


def codec_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("codec", "type").agg(F.count("*").alias("chunks"), F.sum("total_compressed_size").alias("total_compressed"))


def chunk_bounds_text(chunks: DataFrame) -> DataFrame:
    """min and max of each chunk as text after its logical type; null where no statistics are there."""
    s = F.col("statistics")
    return chunks.select(
        "file_path", "row_group", "column_id", "column_path", "type", logical.stat_text(logical.min_bytes(s), "type", "logical_type").alias("min"), logical.stat_text(logical.max_bytes(s), "type", "logical_type").alias("max"),
        s["null_count"].alias("null_count"), s["distinct_count"].alias("distinct_count"), logical.deprecated(s).alias("deprecated"), s["is_min_value_exact"].alias("min_exact"), s["is_max_value_exact"].alias("max_exact"),
    )


def column_bounds_text(chunks: DataFrame, *by: str) -> DataFrame:
    """min and max, as text after its logical type, and nulls of each column over all of its chunks, by any columns of chunks;
    `known` is whether statistics tell: no chunk lacks bounds, has inexact ones or an unknown number of nulls. Bounds are
    compared in the order that the column's type has. NaN is in no bounds."""
    s, low, high = F.col("statistics"), logical.min_bytes(F.col("statistics")), logical.max_bytes(F.col("statistics"))
    empty = s["null_count"] == F.col("num_values")
    exact = F.coalesce(s["is_min_value_exact"], F.lit(True)) & F.coalesce(s["is_max_value_exact"], F.lit(True))
    trusted = ~(F.coalesce(logical.deprecated(s), F.lit(False)) & F.col("type").isin("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"))
    lows, highs, ordered = [], [], F.lit(False)
    for of, key in bounds.ordered_kinds(chunks):
        lows.append(F.min_by(F.when(of, low), F.when(of, key(low))))
        highs.append(F.max_by(F.when(of, high), F.when(of, key(high))))
        ordered |= of & key(low).isNotNull() & key(high).isNotNull()
    sure = F.coalesce(s["null_count"].isNotNull() & (empty | ordered & exact & trusted), F.lit(False))
    none = F.lit(None).cast("binary")
    found = chunks.groupBy(*by, "column_path", "type", "logical_type").agg(
        F.coalesce(*lows, none).alias("low"), F.coalesce(*highs, none).alias("high"), F.sum(s["null_count"]).alias("null_count"), F.bool_and(sure).alias("known")
    )
    return found.select(*by, "column_path", logical.stat_text("low", "type", "logical_type").alias("min"), logical.stat_text("high", "type", "logical_type").alias("max"), "null_count", "known")


def index_bounds_text(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Column index rows with min and max as text; null for pages of nulls only."""
    kinds = chunks.select("file_path", "row_group", "column_id", "type", "logical_type")
    joined = index.join(kinds, ["file_path", "row_group", "column_id"])
    shown = lambda c: F.when(~F.col("null_page"), logical.stat_text(c, "type", "logical_type"))
    return joined.withColumn("min", shown("min_bytes")).withColumn("max", shown("max_bytes")).drop("type", "logical_type")


def prune_chunks(chunks: DataFrame, column: str, low: Any, high: Any) -> DataFrame:
    """Chunks of a column that can hold a value in low..high (None: no limit) by their statistics, in the order that the
    column's physical and logical type has; see bounds.may_hold. The types are looked up in the footers first."""
    return bounds.chunks_that_may_hold(chunks.where(F.col("column_path") == column), low, high)


def prune_pages(chunks: DataFrame, column: str, low: Any, high: Any) -> DataFrame:
    """Rows first_row..last_row of the pages of a column that can hold a value in low..high by their column index;
    chunks without one are not in the result."""
    at = ["file_path", "row_group", "column_id"]
    own = chunks.where((F.col("column_path") == column) & F.col("column_index_offset").isNotNull() & F.col("offset_index_offset").isNotNull())
    kinds = own.select(*at, "type", "logical_type", "row_count")
    room = bounds.may_hold(F.col("min_bytes"), F.col("max_bytes"), bounds.kinds_of(own), low, high)
    kept = column_index(own).join(kinds.drop("row_count"), at).where(~F.col("null_page") & room).select(*at, "page_ordinal")
    after = F.lead("first_row_index").over(W.partitionBy(*at).orderBy("page_ordinal"))
    places = offset_index(own).select(*at, "page_ordinal", "first_row_index").withColumn("next_row", after)
    spans = places.join(kinds.select(*at, "row_count"), at).join(kept, [*at, "page_ordinal"])
    last = F.coalesce("next_row", "row_count") - 1
    return spans.select(*at, "page_ordinal", F.col("first_row_index").alias("first_row"), last.alias("last_row"))


def stats_only_agg(chunks: DataFrame, column: str) -> DataFrame:
    """min, max and count of a column of signed integers from statistics alone, and whether they can be trusted (`exact`):
    the column is of that kind everywhere, and no chunk lacks bounds, has inexact ones, or an unknown number of nulls.
    Where not, scan. Bounds of other columns are null and never exact: floats leave NaN out, byte strings may be cut."""
    own, s, name = chunks.where(F.col("column_path") == column), F.col("statistics"), F.col("logical_type.name")
    whole = F.col("type").isin("INT32", "INT64") & (name.isNull() | (name == "INTEGER") & F.coalesce("logical_type.is_signed", F.lit(True)))
    whole = F.coalesce(whole, F.lit(False))
    low, high = (F.when(whole, logical.int_stat(f(s))) for f in (logical.min_bytes, logical.max_bytes))
    known = s["null_count"].isNotNull() & ((low.isNotNull() & high.isNotNull()) | (s["null_count"] == F.col("num_values")))
    exact = F.coalesce(s["is_min_value_exact"], F.lit(True)) & F.coalesce(s["is_max_value_exact"], F.lit(True))
    sure = F.coalesce(whole & known & exact & (F.col("max_repetition_level") == 0), F.lit(False))
    return own.agg(
        F.min(low).alias("min_value"), F.max(high).alias("max_value"), F.sum(F.col("num_values") - s["null_count"]).alias("value_count"),
        F.coalesce(F.bool_and(sure), F.lit(False)).alias("exact"),
    )


def probe(chunks: DataFrame, column: str, values: DataFrame, value: str = "value", explain: bool = False) -> DataFrame:
    """Bloom lookups of each row of values in the filters of a column: file_path, row_group, the value, might_contain
    (and probe, its derivation). Null values are left out.

    A lookup reads one block of 32 bytes of a filter. Values meet blocks, not filters: each value is hashed once and has
    one block index for each size of filters (their headers tell the sizes, a few in all), and joins the blocks of that
    index. Neither a whole filter nor all values pass through one task."""
    own = chunks.where((F.col("column_path") == column) & F.col("bloom_filter_offset").isNotNull())
    shapes = bloom_filters(own, bits=False).select("type", "num_blocks").distinct().collect()
    out = None
    for kind in sorted({r["type"] for r in shapes}):
        sizes = F.array(*[F.lit(r["num_blocks"]) for r in shapes if r["type"] == kind])
        wanted = values.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), blooms.hashed(F.col(value), kind).alias("hashed"))
        wanted = wanted.withColumn("num_blocks", F.explode(sizes)).withColumn("block_index", blooms.block_index(F.col("hashed"), F.col("num_blocks")))
        blocks = bloom_blocks(own.where(F.col("type") == kind)).select("file_path", "row_group", "num_blocks", "block_index", "block")
        met = wanted.join(blocks.hint("merge"), ["num_blocks", "block_index"])  # by what it is made of, the engine takes it for small
        if explain:
            told = blooms.explain(F.col("hashed"), F.col("block_index"), F.col("block"), F.col("num_blocks"))
            found = met.select("file_path", "row_group", "value", told.alias("probe")).withColumn("might_contain", F.col("probe.might_contain"))
        else:
            bits = blooms.bit_checks(F.col("hashed"), F.col("block"))
            found = met.select("file_path", "row_group", "value", F.forall(bits, lambda b: b["is_set"]).alias("might_contain"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return values.sparkSession.createDataFrame([], f"file_path string, row_group int, value {dict(values.dtypes)[value]}, might_contain boolean")
    return out


def fully_dictionary_encoded(page_rows: DataFrame) -> DataFrame:
    """Chunks whose data pages are all dictionary indices: their dictionary is what distinct values they can have."""
    data = page_rows.where(F.col("page_type").startswith("DATA_PAGE"))
    return data.groupBy("file_path", "row_group", "column_id", "column_path").agg(F.bool_and(F.col("encoding").isin("PLAIN_DICTIONARY", "RLE_DICTIONARY")).alias("only_indices")).where("only_indices").drop("only_indices")


def physical_value(kind: str) -> Column:
    """The value of a row of page_values or dictionary_values, of a column of physical type `kind`."""
    return F.col("value")[SLOT[kind]]


def sorting_columns(groups: DataFrame) -> DataFrame:
    return groups.select("file_path", "row_group", F.posexplode("sorting_columns").alias("position", "s")).select("file_path", "row_group", "position", "s.*")
