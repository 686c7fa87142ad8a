"""Suffix-array dedup, MinHash, pivots, vantage-point trees, components and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import KIND, clashing, odd_rows, rows_of, words
from pyspark.sql import functions as F

import corpus_pipeline
from pagescope.llm import minhash, pivots, suffix, vptree
from pagescope.llm import vectors as vectors_
from pagescope.llm.common import shingle_sets
from pagescope.llm.components import components
from pagescope.llm.gsaca import suffix_array


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=400, deadline=None)
def test_suffix_array(x):
    assert suffix_array(np.array(x, np.int64)) == sorted(range(len(x)), key=lambda i: x[i:])


@given(st.text(alphabet="ab", max_size=12), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_suffix_array_of_powers(word, times):
    x = list((word * times).encode())
    assert suffix_array(np.array(x, np.int64)) == sorted(range(len(x)), key=lambda i: x[i:])


def without_repeats(texts: list[bytes], window: int) -> list[tuple[int, int, int, str]]:
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def repeating_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    passage, line = words(rng, 60), words(rng, 45)
    rows = [(i, words(rng, rng.randint(0, 120)) + " " + passage[rng.randint(0, 9) :] + " " + words(rng, rng.randint(0, 60)), "en", "s", 0) for i in range(30)]
    rows += [(100 + i, (line + "\n") * rng.randint(1, 4) + words(rng, 20), "en", "s", 0) for i in range(6)]
    rows += [(200, "ab " * 400, "en", "s", 0), (201, "ab " * 67, "en", "s", 0), (202, "x" * 199, "en", "s", 0), (203, "x" * 200, "en", "s", 0), (204, "x" * 201, "en", "s", 0), (205, "y" * 200, "en", "s", 0), (206, "漢字かな" * 30 + words(rng, 5), "en", "s", 0), (207, "字かな漢" * 30, "en", "s", 0)]
    near = words(rng, 300).split()
    for i in range(12):
        own = list(near)
        own[rng.randrange(300)] = "changed"
        rows.append((300 + i, " ".join(own), "en", "s", 0))
    return rows


@pytest.mark.parametrize("hot", [4096, 2, 5])
def test_repeats_are_removed(spark, hot):
    rows = repeating_rows(1) + odd_rows()
    df = spark.createDataFrame(rows, KIND).repartition(4)
    found = suffix.dedup(clashing(df), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
    want = Counter((r[0], *w) for r, w in zip(rows, without_repeats([(r[1] or "").encode() for r in rows], 200), strict=True))
    assert Counter(tuple(r) for r in found.collect()) == want


def test_repeats_in_small_windows(spark, none):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 300))), "", "", 0) for i in range(40)]
    found = suffix.dedup(spark.createDataFrame(rows, KIND), window=12, gram=4).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
    want = Counter((r[0], *w) for r, w in zip(rows, without_repeats([r[1].encode() for r in rows], 12), strict=True))
    assert Counter(tuple(r) for r in found.collect()) == want
    assert suffix.dedup(none).count() == 0


def test_windows_of_stretches_against_all_pairs():
    rng = np.random.default_rng(4)
    parts = [rng.integers(97, 100, rng.integers(5, 60)).astype(np.uint8) for _ in range(60)]
    parts[10:20] = [parts[0]] * 10
    group = np.array([i % 3 for i in range(60)], np.int64)
    offsets = np.cumsum([0, *map(len, parts)])
    data = np.concatenate(parts)
    got = suffix.repeated(data, offsets, group, 8)
    seen = defaultdict(set)
    for i, p in enumerate(parts):
        for j in range(len(p) - 7):
            seen[group[i], p[j : j + 8].tobytes()].add(i)
    for i, p in enumerate(parts):
        for j in range(len(p) - 7):
            # A window is asked for in other stretches; one that repeats within its own only may go either way.
            if len(seen[group[i], p[j : j + 8].tobytes()]) > 1:
                assert got[offsets[i] + j]
            elif (p[None, :].tobytes().count(p[j : j + 8].tobytes())) == 1 and got[offsets[i] + j]:
                own = p.tobytes()
                assert sum(own[k : k + 8] == p[j : j + 8].tobytes() for k in range(len(own) - 7)) > 1


def test_a_wrong_suffix_array_changes_the_answer(monkeypatch):
    rng = random.Random(6)
    passage = words(rng, 80).encode()
    texts = [words(rng, 40).encode() + passage + words(rng, 40).encode() for _ in range(6)] + [passage] * 3 + [b"ab" * 300, b"cab" * 200]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    group = np.zeros(len(texts), np.int64)
    right = suffix.repeated(data, offsets, group, 100)
    assert right.sum() > 6 * 200
    for wrong in (lambda x: list(range(len(x))), lambda x: suffix_array(x)[::2] + suffix_array(x)[1::2]):
        monkeypatch.setattr(suffix, "suffix_array", wrong)
        assert suffix.repeated(data, offsets, group, 100).sum() < right.sum()


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=8), st.integers(3, 9))
@settings(max_examples=200, deadline=None)
def test_repeated_windows_of_small_alphabets(texts, window):
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = suffix.repeated(data, offsets, np.zeros(len(texts), np.int64), window)
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    once = Counter({t: sum(t in x for x in texts) for t in count})
    for i, t in enumerate(texts):
        for j in range(len(t) - window + 1):
            own = t[j : j + window]
            assert got[offsets[i] + j] <= (count[own] > 1) and (once[own] < 2 or got[offsets[i] + j])


def test_bytes_decide_where_hashes_agree(monkeypatch):
    """Even if all hashes of partial chunks were equal, only equal windows count."""
    rng = random.Random(7)
    texts = [words(rng, 60).encode() for _ in range(12)]
    texts += [texts[0][50:250] + words(rng, 5).encode(), texts[0]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    right = suffix.repeated(data, offsets, np.zeros(len(texts), np.int64), 80)
    monkeypatch.setattr(suffix, "mix64", lambda x: x & np.uint64(1))
    assert (suffix.repeated(data, offsets, np.zeros(len(texts), np.int64), 80) == right).all() and right.any()


def shingles(text: str | None, k: int) -> frozenset:
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(own[i : i + k]) for i in range(len(own) - k + 1)) if len(own) >= k else frozenset([tuple(own)] if own else [])


@given(st.lists(st.text(alphabet="aAbB éÉ\t", max_size=20), max_size=6), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_shingle_sets(texts, k):
    raw = [t.encode() for t in texts]
    sets, bounds = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), k)
    own = [sets[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
    assert [len(s) for s in own] == [len(shingles(t, k)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(own[i], own[j])) == len(shingles(a, k) & shingles(b, k))


def grouped(rows: list[tuple], k: int, percent: int) -> dict[int, int]:
    sets = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                one, two = sorted((root(a), root(b)))
                up[two] = one
    return {d: root(d) for d in up}


def near_rows(seed: int, base_words: int = 90, copies: int = 60) -> list[tuple]:
    """A family of near copies, many of them just below the threshold to each other, and chains."""
    rng = random.Random(seed)
    base, rows = words(rng, base_words).split(), []
    for i in range(copies):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            own[rng.randrange(base_words)] = f"w{rng.random()}"
        rows.append((1000 + i, " ".join(own), "en", "s", 0))
    chain = words(rng, 60).split()
    for i in range(10):
        rows.append((2000 + i, " ".join(chain), "en", "s", 0))
        chain = [*chain[2:], f"c{i}", f"d{i}"]
    return rows


@pytest.mark.parametrize(("k", "percent", "rows_of_band"), [(3, 85, 5), (5, 80, 4)])
def test_near_duplicates(spark, k, percent, rows_of_band):
    rows = near_rows(1) + odd_rows()
    found = minhash.near_duplicates(clashing(spark.createDataFrame(rows, KIND).repartition(4)), words=k, percent=percent, band_rows=rows_of_band).collect()
    want = grouped(rows, k, percent)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((r[0], len(shingles(r[1], k))) for r in rows)
    assert {r.doc_id: r.component_id for r in found} == want | {None: None}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_near_duplicates_in_blocks(spark, none, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "GROUP_PAIRS", 5)
    rows = near_rows(2, copies=40)
    found = minhash.near_duplicates(spark.createDataFrame(rows, KIND), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == grouped(rows, 3, 85)
    assert minhash.near_duplicates(none).count() == 0


def test_pairs_of_a_bucket_are_compared_whatever_their_signatures(spark):
    rng = random.Random(8)
    base = words(rng, 60).split()
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), words(rng, 60)]
    rows = []
    for i, text in enumerate(texts):
        signature = np.arange(100, dtype=np.uint16) + 100 * i  # the same in one band only
        signature[:5] = 7
        rows.append((1, 0, 99, i, i, len(shingles(text, 3)), signature.tobytes(), zstandard.compress(text.encode())))
    df = spark.createDataFrame(rows, "bucket long, band int, head long, set_key long, component long, n_shingles long, signature binary, body binary")
    assert [sorted(r) for r in minhash._across(df, 3, 85, 100, 5).collect()] == [[0, 1]]


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    for n, j in ((30, 0.5), (200, 0.8)):
        errors = []
        for _ in range(80):
            both = int(n * 2 * j / (1 + j))
            shared = rng.integers(0, 2**63, both, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, n - both, dtype=np.uint64)])) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            errors.append((s[0] == s[1]).mean() - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(j * (1 - j) / 100) * 1.05
    alone = rng.integers(0, 2**63, 500, dtype=np.uint64)
    together = minhash.signatures(np.concatenate([alone[:3], alone]), np.array([0, 3, 3, 503]))
    assert (together[0] == minhash.signatures(alone[:3], np.array([0, 3]))[0]).all() and (together[2] == minhash.signatures(alone, np.array([0, 500]))[0]).all()


def test_signatures_equal_the_scalar_algorithm():
    """SuperMinHash element by element, with a permutation of its own for each (Fisher-Yates as it is read)."""
    rng = np.random.default_rng(6)
    m, sets = 16, [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 12, 200)]
    for own in sets:
        least = [(m + 1) << 24] * m
        for e in own:
            p = list(range(m))
            for j in range(m):
                x = int(minhash.mix64(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
                k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                least[p[j]] = min(least[p[j]], (j << 24) + (x >> 40))
        want = (minhash.mix64(np.array(least, np.uint64)) >> np.uint64(48)).astype(np.uint16)
        assert (minhash.signatures(own, np.array([0, len(own)]), m)[0] == want).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            one, two = sorted((root(a), root(b)))
            up[two] = one
    assert found == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


EMBEDDED = "vec_id long, embedding array<float>, label int"


def vector_rows(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(12):
        center = rng.standard_normal(16)
        for j in range(rng.integers(1, 9)):
            rows.append((100 * i + j, (center + 0.12 * rng.standard_normal(16) * (j > 0)).astype(np.float32).tolist(), i % 3))
    rows += [(5000 + i, rng.standard_normal(16).astype(np.float32).tolist(), i % 3) for i in range(150)]
    rows += [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, [None] + [1.0] * 15, 1), (6003, [float("nan")] * 16, 1), (6004, [float("inf")] + [1.0] * 15, 1), (6005, [], 1), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1)]
    rows += [(6010, rows[0][1], None), (None, rows[0][1], 0), (6011, rows[0][1], rows[0][2]), (6012, rows[0][1], rows[0][2]), (6012, rows[0][1], rows[0][2]), (6013, [2 * x for x in rows[0][1]], rows[0][2])]
    return rows


def able(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b) -> float:
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) if len(a) == len(b) else -2.0


def test_near_vectors(spark):
    rows = vector_rows(1)
    df = clashing(spark.createDataFrame(rows, EMBEDDED).repartition(3))
    found = pivots.near_vectors(df.drop("vector").withColumn("vector", F.lit(1))).collect()
    assert len(found) == len(rows)
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    good = [r for r in rows if able(r[1]) and r[2] is not None and r[0] is not None]
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a[2] == b[2] and cosine(a[1], b[1]) >= 0.93:
                links[a[0], i] += 1
                one, two = sorted((root(a[0]), root(b[0])))
                up[two] = one
    want = Counter((r[0], links[r[0], i], root(r[0])) for i, r in enumerate(good)) + Counter((r[0], 0, r[0]) for r in rows if r not in good)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in found)
    assert pivots.near_vectors(spark.createDataFrame([], EMBEDDED)).count() == 0


def links_by_brute_force(x: np.ndarray, label: np.ndarray, least: float) -> set[tuple[int, int]]:
    u = vectors_.unit(x.astype(float))
    a, b = np.nonzero(np.triu(u @ u.T >= least, 1) & (label[:, None] == label[None, :]))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def spread_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random vectors, and pairs of them just above the threshold, where the index is weakest."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 48))
    for i in range(0, n // 2, 2):
        own = x[i] / np.linalg.norm(x[i])
        away = rng.standard_normal(48)
        away -= own * (away @ own)
        c = rng.uniform(0.931, 0.97)
        x[i + 1] = c * own + np.sqrt(1 - c * c) * away / np.linalg.norm(away)
    return x.astype(np.float32), np.arange(n) // 2 % 2


@pytest.mark.parametrize(("n", "exact"), [(1500, False), (6000, False), (1500, True)])
def test_recall_of_the_permutation_index(spark, monkeypatch, n, exact):
    monkeypatch.setattr(pivots, "BLOCK", 700)
    x, label = spread_vectors(n, 4)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))], EMBEDDED)
    want = Counter(i for pair in links_by_brute_force(x, label, 0.93) for i in pair)
    found = {r.vec_id: r.n_links for r in pivots.near_vectors(df, exact=exact).collect()}
    assert all(found[i] <= want[i] for i in range(n))
    share = sum(found.values()) / sum(want.values())
    assert share == 1 if exact else share >= 0.97


def test_lists_come_whole_whatever_the_batches():
    rng = np.random.default_rng(3)
    names = np.sort(rng.integers(0, 12, 200))
    table = pa.table({"label": [f"l{x // 4}" for x in names], "dim": [3] * 200, "list": names % 4, "low": [0] * 200, "high": [0] * 200, "place": range(200)})
    for size in (1, 3, 7, 50, 200):
        found = [(t["label"][0].as_py(), t["list"][0].as_py(), t["place"].to_pylist()) for t in pivots._whole_lists(iter(table.to_batches(max_chunksize=size)))]
        assert found == [(f"l{x // 4}", x % 4, np.flatnonzero(names == x).tolist()) for x in np.unique(names).tolist()]


def test_nearest_is_exact_at_factor_one(spark):
    rows = vector_rows(3)
    df = clashing(spark.createDataFrame(rows, EMBEDDED).repartition(3)).drop("vector")
    asked = df.where("vec_id % 50 = 0")
    found = defaultdict(list)
    for r in vptree.nearest(df, asked, k=5, factor=1.0, shard_rows=60).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {r[0]: r[1] for r in rows if able(r[1]) and r[0] is not None}
    queries = [q for q in good if q % 50 == 0]
    assert set(found) == set(queries)
    for q in queries:
        near = sorted(((-cosine(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))
        got = found[q]
        assert [r for r, _, _ in got] == list(range(1, min(5, len(near)) + 1))
        assert [s for _, _, s in got] == pytest.approx([-s for s, _ in near[:5]], abs=1e-12)
        assert [i for _, i, _ in got] == [i for _, i in sorted((round(s, 12), i) for s, i in near)[: len(got)]]


def test_nearest_of_many_copies_and_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:1400] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], EMBEDDED)
    found = defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=1000).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found[0] == [1000, 1001, 1002, 1003, 1004] and found[1050][:4] == [0, 1000, 1001, 1002]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in [i for i in range(0, 3000, 50) if not (i == 0 or 1000 <= i < 1400)]:
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(found[q]))
        total += 5
    assert hits / total >= 0.9
    empty = spark.createDataFrame([], EMBEDDED)
    assert vptree.nearest(empty, empty).count() == 0 and vptree.nearest(df, empty).count() == 0


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_nearest_with_rows_repeated_often(spark, factor):
    """Repeated rows, of the query's own id, too, and rows of one id with many vectors take no other id's place."""
    near, far = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, near, 0)] * 10 + [(8, near, 0)] + [(5, near, 0)] * 13 + [(20 + i, [1.0, 1.0 + i, 0.0], 0) for i in range(4)]
    rows += [(40, [0.01 * i, 0.0, 1.0], 0) for i in range(12)] + [(41 + i, [1.0, 0.0, 2.0 - 0.1 * i], 0) for i in range(5)] + [(60, far, 0)]
    df = spark.createDataFrame(rows, EMBEDDED).repartition(3)
    found = defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id in (5, 60)").distinct(), k=5, factor=factor).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    vectors = defaultdict(set)
    for i, v, _ in rows:
        vectors[i].add(tuple(v))
    score = lambda q, i: max(round(cosine(list(q), list(v)), 9) for v in vectors[i])
    for query, q in ((5, near), (60, far)):
        assert found[query] == sorted((i for i in vectors if i != query), key=lambda i: (-score(q, i), i))[:5]
    assert found[5][:2] == [3, 8] and found[60][0] == 40


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_ties_go_to_smaller_ids_wherever_their_vectors_are(spark, factor):
    """Vectors of one direction, scaled by powers of two and by other numbers, and vectors as far on different sides: ties
    of exact cosines, many more than k, in many shards; and lengths whose squares overflow or vanish."""
    rng = np.random.default_rng(8)
    base = rng.integers(-8, 9, 12).astype(float)
    rows = [(i, (base * 2.0 ** (i % 40 - 20)).tolist(), 0) for i in range(1, 200)]
    rows += [(1000 + i, (base * m).tolist(), 0) for i, m in enumerate((3.0, 5.0, 7.0, 1e200, 1e-200, 2.0**900))]
    for i in range(300):
        other = np.zeros(12)
        other[i % 12] = (-1) ** (i // 12)
        rows.append((2000 + i, other.tolist(), 0))
    rows += [(3000, [1.0] * 12, 0), (3050, [1e200] * 12, 0)] + [(4000 + i, rng.standard_normal(12).tolist(), 0) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), list(map(float, v)), int(n)) for i, v, n in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    found = defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id in (1, 7, 50, 100, 1003, 2000, 3000, 3050)"), k=5, factor=factor, shard_rows=50).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    vectors = {i: vectors_.scaled(np.array([v], float))[0] for i, v, _ in rows}
    for query in (1, 7, 50, 100, 1003, 2000, 3000, 3050):
        others = [i for i in vectors if i != query]
        scores = vectors_.cosine(np.tile(vectors[query], (len(others), 1)), np.array([vectors[i] for i in others]))
        want = sorted(zip(others, scores.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:5]
        if factor == 1.0 or want[-1][1] > 0.99:
            assert found[query] == want, query
        assert all(np.isfinite(s) for _, s in found[query]) and len(found[query]) == 5
    assert [i for i, _ in found[7]] == [i for i in range(1, 7) if i != 7][:5]


def test_a_group_of_copies_travels_as_few_rows():
    x = np.repeat(np.random.default_rng(1).standard_normal((3, 4)), (5000, 1, 20), 0)
    ids = np.concatenate([np.arange(5000)[::-1], [7], np.arange(20)])
    kept = vptree._few(ids, x * 2.0 ** (np.arange(len(x)) % 5)[:, None], 10)
    assert sorted(ids[kept].tolist()) == sorted([*range(10), 7, *range(10)])


def test_near_duplicate_stage_drops_near_duplicates_only(spark):
    """Texts of one doc_id go by themselves; what stays of repeated rows doesn't depend on their order."""
    rng = random.Random(12)
    other = words(rng, 60)
    rows = odd_rows() + near_rows(3, copies=20) + [(130, other, "en", "s2", 1), (130, words(rng, 50), "en", "s1", 1), (131, other, "en", "s1", 1), (140, words(rng, 9), "en", "s1", 1)]
    rows += [(r[0], r[1], "de", r[3], r[4]) for r in rows if r[0] == 140]
    nodes = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] and r[1].split()})
    root = grouped([(i, text) for i, (_, text) in enumerate(nodes)], 5, 80)
    want = [r for r in rows if r[0] is None or not (r[1] or "").split()]
    want += [min(r for r in rows if (r[0], r[1]) == nodes[i] and r[0] is not None) for i in root if root[i] == i]
    for seed in (1, 2):
        mixed = random.Random(seed).sample(rows, len(rows))
        found = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(mixed, KIND).repartition(3), "").collect()
        assert Counter(tuple(r) for r in found) == Counter(want)


def test_mixing_stage_takes_what_the_mix_says(spark, tmp_path):
    """Words of each source near its target, with null ids, repeated ids of other texts, equal rows, and empty tables."""
    rows = [(None, f"{'w ' * 9}{i}", "en", "a", 0) for i in range(40)] + [(7, "x " * 12, "en", "b", i) for i in range(30)] + [(8, f"{'z ' * 5}{i}", "en", "b", 0) for i in range(20)]
    rows += [(i, "y " * 9, "en", None, 0) for i in range(100, 160)] + [(200, None, "en", "c", 0), (201, "", None, "c", 0), (None, None, None, None, None)]
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    found = corpus_pipeline.mixing_stage(spark, clashing(docs), str(tmp_path)).collect()
    size = lambda text: len((text or "").split())
    whole = Counter()
    for r in rows:
        whole[r[3]] += size(r[1])
    targets = {r.source: r.target for r in corpus_pipeline.mixing.targets(spark.createDataFrame(list(whole.items()), "source string, source_size long")).collect()}
    for source in whole:
        got = sum(size(r.text) for r in found if r.source == source)
        assert abs(got - targets[source]) <= max(size(r[1]) for r in rows if r[3] == source) / 2 + 1e-9, source
    had, left = Counter(r[:4] for r in rows), Counter((r.doc_id, r.text, r.lang, r.source) for r in found)
    assert all(left[k] <= 2 * had[k] for k in left) and set(left) <= set(had)


def test_stages_of_empty_tables(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_pipeline(spark, tmp_path):
    """run() on a small corpus, and each stage's decisions against brute force on its own input."""
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(40, 120)), "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(500 + i, words(rng, 60).upper().replace(" ", "!! "), "en", f"s{i % 3}", 0) for i in range(60)]
    passage = words(rng, 50)
    rows += [(700 + i, words(rng, 80) + " " + passage + " " + words(rng, 70), "en", "s1", 0) for i in range(5)]
    rows += [(800 + i, rows[i][1], "en", "s2", 0) for i in range(10)]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 150)] + [(500 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "mixing sources", "best-fit packing"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, str(tmp_path))
        df.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept.append([r.asDict() for r in docs.collect()])
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, near, short, mixed, packed = kept
    ids = lambda part: {r["doc_id"] for r in part}
    assert not any(500 <= i < 560 for i in ids(good)) and len(ids(good) & set(range(150))) >= 145 and {700, 701, 702, 703, 704} <= ids(good)
    want = grouped([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert ids(near) == {d for d, c in want.items() if d == c} and len(near) == len(ids(near))
    removed = without_repeats([r["text"].encode() for r in near], 200)
    left = {r["doc_id"]: w for r, w in zip(near, removed, strict=True)}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in short} == {d: w[3] for d, w in left.items()} and any(w[1] for w in left.values())
    assert all(r["n_chars"] == len(r["text"]) for r in short)
    size = Counter()
    for r in short:
        size[r["source"]] += len(r["text"].split())
    got = Counter()
    for r in mixed:
        got[r["source"]] += len(r["text"].split())
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values()) and all(got[s] <= 2 * size[s] for s in size)
    assert all(n <= 2 for n in Counter(r["doc_id"] for r in mixed).values())
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")) == rows_of(docs.drop("sequence_id", "offset"))
