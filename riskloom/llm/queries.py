"""The operators' registered queries, each over its whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, eb_classifier, jaccard_join, mixing, piece_bpe, pivot_index, quality_rules, sharding, suffix_dedup, warc, whitening
from .common import bounded_batches, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eb_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(read(spark, sf_dir, "documents"), shards=8)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.chat_digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def _bounded(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _bounded(f) for f in (op1_quality_rules, op2_near_vectors, op3_jaccard_join, op4_suffix_dedup, op5_quality_classifier, op6_sharding, op7_chat_format, op8_warc, op9_mixing, op10_bpe, op11_whitening, op12_sentencepiece, op13_collocations)}
ORACLES = {
    "op7_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 r AS (SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') OR regexp_matches(text, '\\[blk]') AS bad, replace(replace(replace(replace(replace(text, '\', '\b'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\kINST]'), '[/INST]', '\k/INST]') AS escaped FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(role) + 13 + length(CASE WHEN bad THEN escaped ELSE text END))::BIGINT AS formatted_chars FROM r GROUP BY 1""",
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY 1)
 SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON f.h = p.h""",
    "op13_collocations": r"""WITH w AS MATERIALIZED (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
 f AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4)) AS v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30),
 c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
 parts AS MATERIALIZED (SELECT c.lang, c.phrase, c.a, j, array_to_string(c.ws[1:j], ' ') AS left_part, array_to_string(c.ws[j + 1:], ' ') AS right_part FROM c, (VALUES (1), (2), (3)) AS v(j) WHERE j < c.k),
 cut AS (SELECT parts.*, l.a AS l, r.a AS r, ((parts.a::HUGEINT * 2000000) // (l.a::HUGEINT + r.a))::BIGINT AS score FROM parts JOIN f l ON l.lang = parts.lang AND l.phrase = left_part JOIN f r ON r.lang = parts.lang AND r.phrase = right_part),
 best AS (SELECT lang, phrase, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 longer AS (SELECT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, max(c.a) AS most FROM c, (VALUES (1), (2), (3)) AS p(i), (VALUES (2), (3)) AS q(m) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL)
 SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a) JOIN n USING (lang) WHERE rank <= 2000""",
}
