"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to word budgets, whole epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, words

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most epochs of one source.
SHARE, MOST_EPOCHS = 1.5, 2.0
#: Quality weights of documents labelled good, not labelled, labelled bad.
QUALITY = {1: 1.0, None: 0.8, 0: 0.4}
#: Parts of the key's range; only the part in which a source's budget ends is sorted.
PARTS = 4096


def uniform(*cols: str) -> Column:
    """A number in (0, 1) that depends on the columns' values only."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds `target` to rows (source, source_size): share of all sizes by weight, no target above `most` times its
    source's size; what lies above is shared out again by weight. The closed form of that: the targets are
    min(most * size, level * weight) for the one level at which they sum to the whole. One row per source, so
    the windows without a partition see sources only, never documents."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy()
    full = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stepped = ranked.withColumn("i", F.row_number().over(full)).withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("i", "level"))).over(everything)["level"]
    return stepped.withColumn("level", F.coalesce(first, F.lit(float("inf")))).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, labels: DataFrame | None = None, share: float = SHARE, most: float = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, text_key, size, rows, source_size, target, key, epochs, extra for each different (doc_id, source, text)
    of documents: `rows` of them are equal; the mix takes each `epochs` times, and `extra` of them once more.

    A source's budget buys whole epochs first: every document once for each. What is left buys documents in the
    order of the keys -ln(u) / weight, u from a hash of doc_id (without one, of the text), as long as taking the next one
    brings the words taken nearer to the target. The keys' range has PARTS parts with a sum of sizes each; parts before
    the one in which the budget ends are taken whole, and only that part is sorted, so no source passes through one
    task, and neither do equal rows, which are counted, or rows without a doc_id, whose texts spread them."""
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("size"))
    counted = cut(keyed.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("rows")))
    u = F.when(F.col("doc_id").isNotNull(), uniform("doc_id")).otherwise(uniform("doc_id", "text_key"))
    rows = quality_weight(counted, labels).withColumn("key", -F.log(u) / F.col("weight")).drop("weight")
    rows = rows.withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * PARTS))
    sums = cut(rows.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("rows")).alias("part_size")))
    budget = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = budget.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    a, b = sums.withColumn("before", before), budget.withColumnRenamed("source", "of")
    parts = a.join(b, a["source"].eqNullSafe(b["of"])).drop("of")
    parts = cut(parts.withColumnRenamed("source", "plan_source").withColumnRenamed("part", "plan_part"))
    planned = rows.join(parts, rows["source"].eqNullSafe(parts["plan_source"]) & (rows["part"] == parts["plan_part"]))
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_size") > F.col("rest"))
    all_of_it = (F.col("before") + F.col("part_size") <= F.col("rest")) & (F.col("rest") > 0)
    whole = planned.where(~ends_here).withColumn("extra", F.when(all_of_it, F.col("rows")).otherwise(0))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    taken = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0))
    fits = (taken + F.col("size") - F.col("size") / 2 <= F.col("rest")).cast("long")
    several = F.floor((F.col("rest") - taken) / F.greatest("size", F.lit(1)) + 0.5)
    some = F.when((F.col("rows") == 1) | (F.col("size") == 0), fits * F.col("rows")).otherwise(F.greatest(F.lit(0), F.least("rows", several)))
    ending = planned.where(ends_here).withColumn("extra", some)
    out = ["doc_id", "source", "text_key", "size", "rows", "source_size", "target", "key", "epochs", "extra"]
    return whole.select(*out).unionByName(ending.select(*out))


#: Equal rows that one row of a task becomes at a time.
RUN_ROWS = 100_000


def mix(docs: DataFrame, labels: DataFrame | None = None, share: float = SHARE, most: float = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, key, epochs, extra (0 or 1), taken for each row of documents; see `plan`.

    Null text has no words; null source is a source, the last; rows without a doc_id are documents by themselves, keyed
    by their texts. Repeated rows are documents by themselves; ties go by doc_id, then size, then the text's hash. A
    source without words has target 0. Empty table: no rows."""
    planned = plan(docs, labels, share, most, weights)
    single = planned.where("rows = 1")
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN_ROWS))
    first = F.col("run") * RUN_ROWS
    several = planned.where("rows > 1").withColumn("run", F.explode(runs)).withColumn("nth", F.explode(F.sequence(first, F.least(first + RUN_ROWS, F.col("rows")) - 1)))
    several = several.withColumn("extra", (F.col("nth") < F.col("extra")).cast("long")).drop("run", "nth")
    rows = single.unionByName(several).drop("rows", "text_key")
    return rows.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("extra")))


def quality_weight(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds `weight`, which follows from the quality label of the document, if it has one."""
    if labels is None:
        return docs.withColumn("weight", F.lit(QUALITY[None]))
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(QUALITY[None])
    joined = docs.join(label, docs["doc_id"] == label["labelled"], "left")
    return joined.withColumn("weight", weight).drop("labelled", "quality")
