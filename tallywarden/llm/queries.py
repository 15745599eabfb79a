"""The operators of this subpackage as queries over the stored tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywarden.llm import (
    byte_bpe,
    chat,
    jaccard,
    language_model,
    lines,
    merkle,
    mixing,
    nearest,
    prefix_trie,
    repeats,
    token_counts,
    toxicity,
    winnowing,
)
from tallywarden.llm.common import documents
from tallywarden.llm.oracle import merkle_sql, trie_sql

# Parts of the training mixture in bytes; all other sources share what is left.
SHARES = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.02}
EPOCHS = 1.0
SEED = 17


def op1_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), SHARES, EPOCHS, SEED)


def op2_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edited(documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_count_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "lines_removed")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.over_limit(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir), language_model.seventh_held_out())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, merkle.tampered(docs))


QUERIES = {
    q.__name__: q
    for q in (
        op1_poisson_mixture,
        op2_repeat_intervals,
        op3_voronoi_topk,
        op4_winnowing,
        op5_chat_format,
        op6_count_tree,
        op7_fuzzy_lines,
        op8_token_counts,
        op9_toxic_grammar,
        op10_byte_bpe,
        op11_prefix_trie,
        op12_elias_fano_lm,
        op13_merkle_manifest,
    )
}

_NAMED = ", ".join(f"('{name}', {share!r}::DOUBLE)" for name, share in SHARES.items())


def mixture_sql(docs: str, columns: str) -> str:
    """SQL for ``mix_sources`` over a table; ``columns`` are those of the result."""
    return f"""
WITH shares(name, share) AS (VALUES {_NAMED}),
placed AS (
  SELECT d.*, s.name AS named, coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) AS id
  FROM {docs} d LEFT JOIN shares s ON d.source = s.name),
sizes AS (SELECT named, sum(strlen(coalesce(text, '')) + 1) AS n_bytes FROM placed GROUP BY named),
rates AS (
  SELECT named, {EPOCHS!r}::DOUBLE * (SELECT sum(n_bytes) FROM sizes)
    * coalesce((SELECT share FROM shares WHERE name = named), {max(1 - sum(SHARES.values()), 0.0)!r}::DOUBLE) / n_bytes AS rate
  FROM sizes),
means AS (
  SELECT named, greatest(ceil(rate / {mixing.MEAN_PER_DRAW}), 1)::INT AS draws,
    rate / greatest(ceil(rate / {mixing.MEAN_PER_DRAW}), 1) AS mean FROM rates),
chances AS (
  SELECT named, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(k * ln(mean) - mean - lgamma(k + 1)) END AS chance
  FROM means, range(0, {mixing.STEPS + 1}) r(k) WHERE mean > 0 OR k = 0),
tables AS (SELECT named, k, sum(chance) OVER (PARTITION BY named ORDER BY k) AS upto FROM chances),
drawn AS (
  SELECT p.doc_id, p.id, p.text, p.named, j,
    ('0x' || substr(md5('{SEED}|' || j || '|' || p.id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, id, text, named FROM placed) p
  JOIN means m ON p.named IS NOT DISTINCT FROM m.named, range(1, 100000) g(j) WHERE j <= draws),
counts AS (
  SELECT d.doc_id, d.id, d.text, count(t.k) AS times
  FROM drawn d LEFT JOIN tables t ON d.named IS NOT DISTINCT FROM t.named AND t.upto <= d.u
  GROUP BY d.doc_id, d.id, d.text)
SELECT {columns}
FROM placed p JOIN counts c ON p.id = c.id AND p.text IS NOT DISTINCT FROM c.text, range(1, 100000) g(copy)
WHERE copy <= times"""


CHAT_SQL = f"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations),
conv AS (
  SELECT conv_id, count(*) AS turns, list({{'r': role, 't': text}} ORDER BY n) AS said FROM numbered GROUP BY conv_id),
firsts AS (SELECT said[1] AS head, * FROM conv),
distinct_conv AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, turns, head, said FROM firsts GROUP BY turns, head, said),
chosen AS (
  SELECT * FROM distinct_conv a WHERE NOT EXISTS (
    SELECT 1 FROM distinct_conv b WHERE a.head = b.head AND b.turns > a.turns AND b.said[1:a.turns] = a.said))
SELECT c.conv_id, ((n - 1) // {chat.TURNS_PER_SEGMENT})::INT AS segment,
  ceil(any_value(c.turns) / {chat.TURNS_PER_SEGMENT})::INT AS segments, any_value(c.turns)::BIGINT AS turns,
  any_value(c.copies)::BIGINT AS copies,
  string_agg('{chat.START}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
    || '{chat.END}' || chr(10), '' ORDER BY n) AS text
FROM chosen c JOIN numbered USING (conv_id) GROUP BY c.conv_id, segment"""

TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.vec, x.vec)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20"""

ORACLE = {
    "op1_poisson_mixture": mixture_sql(
        "documents",
        "p.doc_id, p.text, p.lang, p.source, p.n_chars, copy::INT AS copy, "
        f"('0x' || substr(md5('{SEED} order|' || p.id || '|' || copy), 1, 15))::BIGINT AS shuffle_key",
    ),
    "op3_voronoi_topk": TOPK_SQL,
    "op5_chat_format": CHAT_SQL,
    "op11_prefix_trie": trie_sql(),
    "op13_merkle_manifest": merkle_sql(),
}
