"""The registered queries of the operators; each returns the digest columns of its operator's whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, minhash, mixing, packing, pivots, quality, sharding, suffix, toxicity, vptree
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(asked, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.chat(rows.unionByName(more)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_array": op3_suffix_array,
    "op4_pivots": op4_pivots,
    "op5_toxicity": op5_toxicity,
    "op6_vptree": op6_vptree,
    "op7_minhash": op7_minhash,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}

#: Key of a document in the mix; the operator's formulas over all rows at once.
_OP8 = r"""
WITH docs AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
           / CASE l.quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM docs GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][(nth % 3 + 1)::INT]::DOUBLE AS w, 2.0 * s AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, nth) AS i,
         ((SELECT sum(s) FROM sources) * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
plan AS (
  SELECT source, s, least(cap, (SELECT level FROM levels WHERE level <= ratio ORDER BY i LIMIT 1) * w) AS target FROM levels),
runs AS (
  SELECT d.*, p.s, p.target, CASE WHEN p.s > 0 THEN floor(p.target / p.s) ELSE 0 END::BIGINT AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target,
       size * (epochs + CASE WHEN target - epochs * s > 0 AND run - size / 2 <= target - epochs * s THEN 1 ELSE 0 END)::BIGINT AS taken
FROM runs
"""

#: Digests of the turns themselves; the template adds 17 characters to a turn, and one for each backslash and control string.
_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role || text) + 17 + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[/?TURN\]'))
         + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[/?TURN\]')) AS chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_GROUPS = """
reach(node, other) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT r.node, l.other FROM reach r JOIN (SELECT a AS node, b AS other FROM links UNION SELECT b, a FROM links) l ON r.other = l.node)
"""

#: All pairs of one label, exactly.
_OP4 = f"""
WITH RECURSIVE links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.93),
{_GROUPS}
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE e.vec_id IN (l.a, l.b))::BIGINT AS n_links,
       least(e.vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.node = e.vec_id), e.vec_id)) AS component_id,
       coalesce((SELECT min(other) FROM reach r WHERE r.node = e.vec_id), e.vec_id) >= e.vec_id AS kept
FROM embeddings e
"""

#: All pairs that share a shingle, exactly.
_OP7 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM docs),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM items p JOIN items q ON p.x = q.x AND p.doc_id < q.doc_id AND p.n * 100 >= 85 * q.n AND q.n * 100 >= 85 * p.n
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_GROUPS},
least_of AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, coalesce(m, s.doc_id) >= s.doc_id AS kept
FROM sets s LEFT JOIN least_of ON node = s.doc_id
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": _OP1, "op4_pivots": _OP4, "op7_minhash": _OP7, "op8_mixing": _OP8}
