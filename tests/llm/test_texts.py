"""Chat formatting, classifiers, mixing, packing and sharding."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import clashing, odd_rows, rows_of, words
from pyspark.sql import functions as F

from pagescope.llm import chat, mixing, packing, quality, sharding, toxicity
from pagescope.llm.common import word_bounds

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<", "[", "[TURN]user[/TURN]", "<\\/s>", "", "a\\nb", "<|im_start|>", "<s", "🙂[/TURN]", "\n</s>\n", "[\\TURN]", "<<SYS>>x<</SYS>>"]


def digest(turns):
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [(i, j, ("user", "assistant", "system")[j % 3], t) for i in range(4) for j, t in enumerate(NASTY[i:])]
    rows += [(9, 0, None, None), (9, 1, "assistant", None), (9, 1, "assistant", None), (None, 0, "user", "x"), (8, None, "we[TURN]ird", "a"), (8, 2, "assistant", "b"), (8, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    found = {r.conv_id: r for r in chat.digests(chat.chat(clashing(df))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == digest(turns), c
    pieces = chat.chat(df)
    assert found[0].formatted_chars == sum(len(r.piece) for r in pieces.where("conv_id = 0").collect())
    for r in pieces.collect():
        inside = r.piece[len(chat.OPEN) : -len(chat.CLOSE)].replace(chat.NAMED, "", 1)
        assert not any(c in inside for c in chat.CONTROLS)


def test_chat_layouts(spark):
    message = "struct<role:string,content:string>"
    frames = {
        "messages": (spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], f"messages array<{message}>"), [("user", "q"), ("assistant", "a")]),
        "from_value": (spark.createDataFrame([([("human", "q"), ("gpt", "a")],)], "conversations array<struct<from:string,value:string>>"), [("user", "q"), ("assistant", "a")]),
        "instruction": (spark.createDataFrame([("do", "this", "done")], "instruction string, input string, output string"), [("user", "do\n\nthis"), ("assistant", "done")]),
        "prompt_completion": (spark.createDataFrame([("p", "c", 1)], "prompt string, completion string, extra int"), [("user", "p"), ("assistant", "c")]),
        "prompt_response": (spark.createDataFrame([(None, "p", "c")], "system string, prompt string, response string"), [("user", "p"), ("assistant", "c")]),
    }
    for name, (df, want) in frames.items():
        assert chat.layout_of(df.schema).name == name
        assert [(r.role, r.text) for r in chat.canonical(df).orderBy("turn").collect()] == want, name
    with pytest.raises(ValueError, match="no layout"):
        chat.layout_of(spark.createDataFrame([(1,)], "x int").schema)
    with pytest.raises(ValueError, match="several"):
        chat.layout_of(spark.createDataFrame([("a",) * 4], "prompt string, completion string, question string, answer string").schema)


def test_chat_json_of_mixed_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "1"}, {"role": "assistant", "content": "2"}]}, {"prompt": "3", "completion": "4"}, {"id": 7, "messages": [{"role": "user", "content": "5"}]}, {"unknown": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,)], "json string")
    assert sorted(r.text for r in chat.canonical_json(df).collect()) == ["1", "2", "3", "4", "5"]
    assert chat.canonical_json(df).where("conv_id = 7").count() == 1
    assert chat.unknown_json(df).count() == 3


def test_json_records_and_schemas_follow_one_rule(spark):
    """A field more than the layout has, an empty list, and null texts are no reason to leave a record out."""
    records = [{"prompt": "a", "completion": "b", "score": 1.5}, {"messages": []}, {"id": 9, "messages": [], "lang": "en"}, {"question": None, "answer": "c"}, {"system": "", "prompt": "d", "response": "e"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "json string")
    assert chat.unknown_json(df).count() == 0
    assert sorted(r.text for r in chat.canonical_json(df).collect()) == ["", "a", "b", "c", "d", "e"]
    both = spark.createDataFrame([(json.dumps({"prompt": "a", "completion": "b", "question": "c", "answer": "d"}),)], "json string")
    assert chat.unknown_json(both).count() == 1 and chat.canonical_json(both).count() == 0
    plan = chat.canonical_json(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2  # with and without an id


def test_equal_records_are_conversations_by_themselves(spark):
    df = spark.createDataFrame([("p", "c")] * 100 + [("p", "d")], "prompt string, completion string").repartition(3)
    records = [json.dumps({a: "p", b: "c"}) for a, b in (("prompt", "completion"), ("question", "answer"))] * 50
    for found in (chat.canonical(df), chat.canonical_json(spark.createDataFrame([(r,) for r in records], "json string"))):
        rows = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns")).collect()
        assert len(rows) in (100, 101) and all([tuple(t) for t in r.turns] == [(0, "user"), (1, "assistant")] for r in rows)
    ids = lambda: sorted(r.conv_id for r in chat.canonical(df.repartition(5)).collect())
    assert ids() == ids()


def test_chat_empty(spark):
    assert chat.digests(chat.chat(spark.createDataFrame([], TURNS))).count() == 0


@given(st.lists(st.text(alphabet=" \t\n aé漢", max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_never_cross_texts(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    start, end = word_bounds(data, offsets)
    whole = b"".join(raw)
    assert [whole[a:b] for a, b in zip(start, end, strict=True)] == [w for r in raw for w in re.findall(rb"[^\x20\x09-\x0D]+", r)]


def labelled(spark, make, n=400):
    rng = random.Random(2)
    rows = [(i, *make(rng, i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark, odd, none):
    docs, labels, truth = labelled(spark, lambda rng, bad: ((words(rng, 80).upper().replace(" ", "!! ") if bad else words(rng, 80)), 0 if bad else 1))
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality.score(docs, quality.fit(docs, flipped))) == rows_of(quality.score(docs, model))  # held-out labels don't count
    found = quality.score(clashing(odd), model)
    assert found.count() == odd.count() and found.where("score is null or isnan(score)").count() == 0
    assert quality.score(none, model).count() == 0
    unknown = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(odd, unknown).collect()} == {0.5}


def test_quality_scores_by_brute_force(spark, odd):
    """The scores of whole texts, block by block, with plain calls of the library; and a sample that repeats."""
    import zstandard

    docs, labels, _ = labelled(spark, lambda rng, bad: ((words(rng, 80).upper() if bad else words(rng, 80)), 0 if bad else 1))
    twice = docs.unionByName(docs.where("doc_id < 50").withColumn("text", F.concat(F.lit("zz "), "text"))).repartition(5)
    model = quality.fit(twice, labels)
    assert model == quality.fit(docs.repartition(2), labels)

    def size(data: bytes, text: bytes) -> int:
        trained = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(one.compress(text[i : i + quality.BLOCK_BYTES])) for i in range(0, len(text), quality.BLOCK_BYTES))

    for r in quality.score(odd, model, keep=("text",)).collect():
        text = (r.text or "").encode()
        difference = sum(size(bad, text) - size(good, text) for good, bad in model.pairs) / max(1, len(text)) / len(model.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, model.slope * difference + model.bias)))), abs=1e-9)


def test_toxicity_scores_and_risk_by_brute_force(spark, odd):
    """Scores from the words of whole texts, one by one; and the risk that training lowers."""
    from pagescope.llm.common import Rolling

    rng = random.Random(4)
    unlabelled = [words(rng, 40) + (" vile" if i % 5 == 0 else "") for i in range(200)]
    positive = [words(rng, 40) + " vile" for _ in range(60)]
    model = toxicity.train(positive, unlabelled, 0.2)

    def hashed(word: bytes) -> int:
        return int(Rolling(np.frombuffer(word, np.uint8)).of(np.array([0]), np.array([len(word)]))[0])

    def plain(text: str | None) -> float:
        found = {w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())}
        found = {bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in found}
        ids = [hashed(w) >> (64 - toxicity.BITS) for w in found]
        ids += [((hashed(w[:p]) + p) & (1 << 64) - 1) >> (64 - toxicity.BITS) for w in found for p in toxicity.PREFIXES]
        z = sum(float(model.weights[i]) for i in ids) + model.bias
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    docs = odd.withColumn("text", F.when(F.col("doc_id") < 20, F.concat("text", F.lit(" VILE deeds"))).otherwise(F.col("text")))
    texts = Counter((r.doc_id, round(plain(r.text), 6)) for r in docs.collect())
    assert Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, model).collect()) == texts

    def risk(m) -> float:
        z = lambda part: np.array([math.log(s / (1 - s)) for s in (m.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in part)])
        zp, zu = z(positive), z(unlabelled)
        return 0.2 * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - 0.2 * np.logaddexp(0, zp).mean())

    assert risk(model) < 0.5 * risk(toxicity.Model(np.zeros_like(model.weights), math.log(0.25)))


def test_toxicity(spark, odd, none):
    bad_words = ["vile", "rotten", "nasty"]

    def make(rng, bad):
        text = words(rng, 100).split()
        if bad:
            for w in rng.sample(bad_words, 2):
                text.insert(rng.randrange(len(text)), w + rng.choice(["", "ly", "ness", "!"]))
        return " ".join(text), int(bad)

    docs, labels, truth = labelled(spark, make, 800)
    model = toxicity.fit(docs, labels)
    own = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.93
    assert all(r.predicted == int(r.score >= 0.5) for r in own)
    found = toxicity.score(clashing(odd), model)
    assert found.count() == odd.count() and found.where("score is null or isnan(score)").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0


def test_targets_meet_the_share(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 50, "B": 700, "z": 0}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    order = sorted([k for k in sizes if k is not None], key=lambda k: k.encode()) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:  # cap, and share the excess again, until none is above
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        above = {k for k in open_ if share[k] > 2 * sizes[k]}
        if not above:
            want |= share
            break
        for k in above:
            want[k] = 2.0 * sizes[k]
            left -= want[k]
        open_ -= above
    assert {r.source: pytest.approx(r.target) for r in found} == want


def test_mix(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    found = mixing.mix(clashing(odd), labels)
    rows = found.collect()
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((d, size(t), s) for d, t, _, s, _ in odd_rows())
    assert all(r["size"] * r.epochs <= r.taken <= 2 * r["size"] for r in rows)
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r["size"])
    for r in rows:
        assert abs(taken[r.source] - r.target) <= biggest[r.source] / 2 + 1
    assert rows_of(mixing.mix(odd.repartition(7), labels)) == rows_of(found)
    assert mixing.mix(none, labels).count() == 0 and mixing.mix(odd, None).count() == len(rows)


def test_mix_of_equal_rows_and_rows_without_ids(spark):
    """Rows without an id, and equal rows, are taken one by one: the words taken are as near to the target as rows allow."""
    rows = [(None, f"{'w ' * 10}{i}", "en", "a", 0) for i in range(40)] + [(7, "x " * 12, "en", "b", 0)] * 30 + [(i, "y " * 9, "en", "c", 0) for i in range(100, 160)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), None).collect()
    assert len(found) == len(rows)
    for source, size in (("a", 11), ("b", 12), ("c", 9)):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= size / 2 and all(r.extra in (0, 1) for r in own)
    planned = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert planned.where("source = 'b'").count() == 1 and planned.where("source = 'a'").select("key").distinct().count() == 40


def test_mix_prefers_weight(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "big" if i < 600 else "small", 0) for i in range(1200)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    rows = [r for r in mixing.mix(docs, labels, share=0.5).collect() if r.source == "big"]
    good = sum(r.taken for r in rows if r.doc_id % 2)
    assert good > 1.1 * sum(r.taken for r in rows if not r.doc_id % 2)


def check_packing(rows, most=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


def test_pack(spark, odd, none):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.public_files()[0])
    rows = packing.pack(clashing(odd), task_pieces=20).collect()
    check_packing(rows)
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for d, t, *_ in odd_rows():
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert pieces == want
    assert packing.pack(none).count() == 0


def test_encoders_agree():
    rng = random.Random(1)
    encoder = packing.Encoder.of(*packing.public_files())
    texts = [words(rng, 30), "", " ", "\n\n  x  \n", "don't we'll 123 4567 !!! ...", "漢字かな🙂 ñandú x y", "a" * 3000, "x" * 5000, "<|endoftext|> in <|endoftext|>", "\t\r\n 　", "é ​"]
    texts += ["".join(chr(rng.choice([32, 10, 39, 97, 66, 49, 233, 0x4E2D, 0x1F600, 0x300, 0xA0])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert encoder.ids(t) == encoder.slow.encode(t, add_special_tokens=False).ids, repr(t)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_places_as_defined(sizes):
    bins, gaps = packing.SumOfSquares(64), {}
    for size in sizes:
        count = Counter(g for g in gaps.values() if g)
        before = sum(c * c for c in count.values())

        def after(gap, size=size, count=count):
            new = Counter(count)
            if gap < 64:
                new[gap] -= 1
            if gap - size:
                new[gap - size] += 1
            return sum(c * c for c in new.values())

        options = {g for g in count if g >= size} | {64}
        at, offset = bins.place(size)
        gap = gaps.get(at, 64)
        assert offset == 64 - gap and gap >= size
        assert after(gap) - before == min(after(g) - before for g in options)
        gaps[at] = gap - size


def test_shards(spark, odd, none):
    rows = sharding.shard(clashing(odd), shards=5).collect()
    utf8 = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len(utf8(t)) + 16, zlib.crc32(utf8(t))) for d, t, *_ in odd_rows())
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    assert sharding.shard(none).count() == 0


def shards_by_brute_force(texts: list[str], bounds: list[int], keys: list[int]) -> list[int]:
    return [sum(b <= k for b in bounds) for k in keys]


def test_overfull_ranges_are_subdivided(spark):
    """Boundaries of a poor sample leave ranges with many times their share; what is subdivided holds it."""
    rng = random.Random(9)
    df = spark.createDataFrame([(i, words(rng, rng.randint(1, 40))) for i in range(3000)], "doc_id long, text string")
    rows = df.select(F.xxhash64("text").alias("key"), (F.octet_length("text") + 16).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")).persist()
    held = [(r["key"], r["size"]) for r in rows.collect()]
    keys, total = [k for k, _ in held], sum(n for _, n in held)
    bounds = np.sort(np.array(rng.sample(keys, 4), np.int64))
    most = total // 40

    def sampled(of, chance, seed):
        return np.sort(np.array([r.key for r in of.select("key").collect()], np.int64))

    def filled(at):
        out = Counter()
        for (_, n), r in zip(held, shards_by_brute_force([], at.tolist(), keys), strict=True):
            out[r] += n
        return out

    full = {r: n for r, n in filled(bounds).items() if n > 2 * most}
    assert full
    again = sharding._subdivided(rows, bounds, full, most, 32, sampled, 1)
    assert set(bounds.tolist()) <= set(again.tolist()) and max(filled(again).values()) <= 2 * most
    placed = rows.select("key", sharding._place(again)("key").alias("range")).collect()
    assert [r["range"] for r in placed] == shards_by_brute_force([], again.tolist(), [r["key"] for r in placed])
    found = sharding.shard(df, shards=4, ranges_per_shard=16, samples_per_range=1).collect()
    size = Counter()
    for r in found:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.05 * min(size.values())


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(1500)]
    rows = [(i, rng.choice(texts[:300]) if i % 3 == 0 else texts[i % 1500]) for i in range(4000)] + [(10_000 + i, "the same text in a third of all rows " * 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard(df, shards=8, ranges_per_shard=16).collect()
    size = Counter()
    for r in found:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.02 * min(size.values())
    text = dict(rows)
    shards = defaultdict(set)
    for r in found:
        shards[text[r.doc_id]].add(r.shard)
    assert [t for t, s in shards.items() if len(s) > 1] in ([], ["the same text in a third of all rows " * 3])
    assert math.isclose(sum(size.values()), sum(len(t) + 16 for _, t in rows))
