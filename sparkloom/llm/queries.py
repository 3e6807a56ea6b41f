"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, exact_dedup, importance, licences, line_dedup, mixing, near_dedup, packing, secrets, shards, tokens, topk, toxicity, trie
from .store import Workspace


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on two-word shingles at 80 %: doc_id, n_shingles, component_id, kept."""
    return near_dedup.near_duplicates(_docs(spark, sf_dir), shingle=2, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup: doc_id, n_lines, n_dropped, kept_sha256."""
    return line_dedup.dedup_lines(_docs(spark, sf_dir), with_text=False)


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS top_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.doc_id, pos, line, common.k IS NOT NULL AND keyed.doc_id < top_doc AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing into 2048-token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokens.token_pieces(_docs(spark, sf_dir), length=2048, with_ids=False)
    return packing.pack(pieces, capacity=packing.Capacity(tokens=2048, documents=2048, attention=2048 * 2048))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing by weights 3, 1, 2 and 150 %: doc_id, size, source_size, target, taken."""
    return mixing.mix_sources(_docs(spark, sf_dir), weights=(3, 1, 2), share=1.5, cap=2.0)


def op5_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards in training order, 512 ids a row: doc_id, start, length, slot, shard, byte_offset, offset, ids_crc32, row_crc32."""
    return shards.write_shards(_docs(spark, sf_dir), Workspace(spark, "shards").new_path("bin"), stride=512)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets with corpus-wide ownership: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secrets.scan_secrets(_docs(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by a CRF learnt from three folds of four: doc_id, held_out, lang_pred, score."""
    docs = _docs(spark, sf_dir)
    rows = docs.where(crf.fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    out = crf.identify_language(docs, rows)
    return out.select("doc_id", F.coalesce(crf.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity learnt from two folds of three: doc_id, held_out, score, predicted."""
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.fold(F.col("doc_id"), 3) != 1)
    out = toxicity.score_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return out.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of each query vector: query_id, rank, vec_id, score."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5, scale=256.0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling towards the benchmark: doc_id, n_features, weight, score, rank."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.importance_sample(_docs(spark, sf_dir), target, percent=5, least_words=20, seed=42).drop("n_words")


def _crc32_sql(expr: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit with the lowest bit of each byte first."""
    bits = f"list_transform(range(0, 8 * octet_length(encode({expr}))), lambda i: get_bit(encode({expr})::BIT, (i - i % 8 + 7 - i % 8)::INT)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: xor(a >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"


OP11_SQL = rf"""
WITH texts AS (
  SELECT 1 AS side, doc_id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark),
words AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT side, doc_id, unnest(w) AS f FROM words
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counted AS (SELECT side, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
named AS (SELECT f, {_crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted) d),
hits AS (SELECT side, doc_id, bucket, n FROM counted JOIN named USING (f)),
per AS (SELECT bucket, coalesce(sum(n) FILTER (side = 1), 0) AS s, coalesce(sum(n) FILTER (side = 2), 0) AS t FROM hits GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM per),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM per, whole),
weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM hits JOIN gains USING (bucket) WHERE side = 1 GROUP BY doc_id),
scored AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || words.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (doc_id) WHERE side = 1),
fit AS (SELECT *, n_words >= 20 AS ok FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id) AS place, count(*) FILTER (ok) OVER () AS n FROM fit)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= n * 5 // 100 THEN place END AS rank FROM placed
"""


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and tags: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, openness."""
    return licences.summarise(licences.find_licences(_docs(spark, sf_dir)))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), family=20)


OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM turns),
heads AS (
  SELECT conv_id, h, conv_id - conv_id % 20 AS head, least(h, coalesce(n_head, 0)) AS lent
  FROM (SELECT DISTINCT conv_id, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM turns) m
  LEFT JOIN (SELECT conv_id AS head_id, count(*) AS n_head FROM turns GROUP BY conv_id) c ON head_id = conv_id - conv_id % 20),
rebuilt AS (
  SELECT heads.conv_id, pos + 1 AS depth, k, words FROM heads JOIN numbered ON numbered.conv_id = head AND pos < lent
  UNION ALL
  SELECT heads.conv_id, pos - h + lent + 1, k, words FROM heads JOIN numbered ON numbered.conv_id = heads.conv_id AND pos >= h),
prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL AS parent, 0 AS words FROM heads
  UNION ALL
  SELECT conv_id, depth, string_agg(k, '') OVER w, coalesce(string_agg(k, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved
  FROM prefixes GROUP BY ALL),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT up.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM nodes low LEFT JOIN children USING (node) JOIN prefixes up ON up.conv_id = low.conv_id AND up.depth <= low.depth GROUP BY up.node),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM prefixes GROUP BY conv_id) l GROUP BY node)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes p ON p.node = nodes.parent
"""


QUERIES = (op1_near_dedup, op2_line_dedup, op3_exact_dedup, op4_best_fit_packing, op5_training_shards, op6_secret_scan, op7_mix_sources, op8_language_id, op9_toxicity, op10_top_k, op11_importance, op12_licences, op13_conversation_trie)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op10_top_k": OP10_SQL, "op11_importance": OP11_SQL, "op13_conversation_trie": OP13_SQL}
