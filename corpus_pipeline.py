"""Corpus pipeline: rejects low quality, removes near-duplicates and repeated passages, mixes sources, packs.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescope.llm import minhash, mixing, packing, quality, suffix
from pagescope.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from labelled rows of its input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more): that with the smallest
    doc_id, once if its row is repeated. Several texts of one doc_id are documents by themselves; of those in one group
    the one with the least hash stays. Documents without words or without doc_id are in no group and stay. Rows go by
    numbers, which are written with them, so no two documents are taken for one."""
    rows = cut(docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("node")))
    keyed = rows.where("doc_id is not null")
    found = minhash.near_duplicates(keyed.select(F.col("node").alias("doc_id"), "text"), words=5, percent=80, band_rows=4)
    found = cut(found.select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("component")))
    order = F.struct("doc_id", "text_key", "lang", "source", "n_chars", "node")
    grouped = keyed.select("doc_id", "text_key", "lang", "source", "n_chars", "node").join(found.where("n_shingles > 0"), "node")
    firsts = grouped.groupBy("component").agg(F.min(order)["node"].alias("node")).select("node")
    kept = cut(firsts.unionByName(found.where("n_shingles = 0").select("node")))
    return keyed.join(kept, "node", "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null").select(*COLUMNS))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings of 200 bytes cover. Documents of which no word is left go;
    those that had none before stay."""
    text = suffix.dedup(docs.select(*COLUMNS), carry=("doc_id", "lang", "source"), as_text=True).withColumnRenamed("kept", "text")
    left = text.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole epochs, then by key until its source's target is met. Rows of one
    doc_id with different texts, and rows without one, are documents by themselves. Rows of equal doc_id, source and text
    are taken together as often as all of them are, in the form of the least of them."""
    planned = mixing.plan(docs, table(spark, sf_dir, "labels"))
    copies = (F.col("epochs") * F.col("rows") + F.col("extra")).cast("int").alias("copies")
    taken = planned.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_key").alias("text_of"), "rows", copies).where("copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("text_of"))
    joined = docs.select(*COLUMNS).join(taken, same)
    equal = joined.where("rows > 1").groupBy("id", "of", "text_of", "copies").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*", "copies")
    each = joined.where("rows = 1").select(*COLUMNS, "copies").unionByName(equal)
    return each.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier, hashed candidates and byte-pair ids have no SQL; tests hold run() to a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
