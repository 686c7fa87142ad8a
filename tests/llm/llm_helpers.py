from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; tables may have them, too.
CLASHING = ("size", "key", "row", "component", "label", "score", "text_key", "set_key", "name", "spans", "body", "part", "weight", "shard", "vector", "class", "rank", "turns", "piece")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Documents with nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(1, 150)), "en", f"s{i % 3}", None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t", "en", None, 3), (None, base, "en", "s1", 5), (None, None, None, None, None)]
    rows += [(110, base, "en", "s0", 1), (111, base, "en", "s0", 1), (111, base, "en", "s0", 1), (112, base + " more", "en", "s1", 1), (112, words(rng, 30), "en", "s2", 1)]
    rows += [(120, words(rng, 30_000), "en", "s0", 1), (121, "ab " * 20_000, "en", "s0", 1), (122, "x" * 50_000, "en", "s0", 1), (123, "Größe ñandú 漢字 🙂 " * 40, "de", "s4", 1), (124, "one", "en", "s4", 3), (125, "ONE", "en", "s4", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), KIND).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


def clashing(df):
    """df with more columns, of names that operators use inside."""
    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
