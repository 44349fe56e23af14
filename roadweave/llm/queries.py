"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, host_rules, langid, mixing, quality, secret_scan, simhash_dedup, token_count, token_store, toxicity
from .common import table

END_OF_DOCUMENT = 49407


def tokenizer_path(name: str) -> str:
    """Vocabulary files are a parameter of the operators; the queries take the installed ones."""
    if importlib.util.find_spec("public_tokenizers") is None:
        raise FileNotFoundError("the public tokenizer files are not installed")
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op2_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return got.select("doc_id", "source", "lang", F.col("_rw_topic").alias("topic"), F.col("_rw_tokens").alias("n_tokens"), F.col("_rw_weight").alias("cell_weight"), F.col("_rw_probability").alias("probability"), F.col("_rw_sampled").alias("sampled"))


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "similarity", "window_start")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.flat_token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_OF_DOCUMENT)


def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_verdicts(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_mixing_weights,
        op3_simhash_near_duplicates,
        op4_token_output,
        op5_benchmark_decontamination,
        op6_token_counts,
        op7_host_quality_rules,
        op8_toxicity,
        op9_language_id,
        op10_secret_scan,
    )
}

_OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT rid, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g
  FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid
), lines AS (
  SELECT rid, l FROM d, unnest(string_split(text, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid
), c AS (
  SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source
), m AS (
  SELECT count(*) AS hosts, sum(n) AS n, sum(k) AS k, sum(k * k / n) AS kk FROM h
), moments AS (
  SELECT CAST(k / n AS DOUBLE) AS mu, kk / n - (k / n) * (k / n) - (k / n) * (1 - k / n) * hosts / n AS between_, * FROM m
), prior AS (
  SELECT CASE WHEN hosts < 2 OR k = 0 OR k = n THEN greatest(mu, 1e-6)
              ELSE mu * greatest(mu * (1 - mu) / greatest(between_, 1e-6) - 1, 1e-3) END AS a,
         CASE WHEN hosts < 2 OR k = 0 OR k = n THEN greatest(1 - mu, 1e-6)
              ELSE (1 - mu) * greatest(mu * (1 - mu) / greatest(between_, 1e-6) - 1, 1e-3) END AS b
  FROM moments
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND round((h.k + a) / (h.n + a + b), 6) <= 0.5 AS kept,
       h.n AS host_docs, CAST(h.k AS BIGINT) AS host_failed, round((h.k + a) / (h.n + a + b), 6) AS host_rate
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, prior
"""

_OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), bs AS (
  SELECT item_id, len(w) - 4 AS n, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM b, unnest(range(1, len(w) - 3)) AS u(i)
), bc AS (
  SELECT item_id, n, g, count(*) AS c FROM bs GROUP BY item_id, n, g
), ds AS (
  SELECT rid, len(w) - 4 AS len, i - 1 AS pos, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), met AS (
  SELECT rid, len, pos, item_id, n, g, c FROM ds JOIN bc USING (g)
), windows AS (
  SELECT DISTINCT rid, len, item_id, n, least(pos, greatest(len - n, 0)) AS st FROM met
), shared AS (
  SELECT w.rid, w.len, w.item_id, w.n, w.st, m.g, least(count(*), any_value(m.c)) AS o
  FROM windows w JOIN met m ON m.rid = w.rid AND m.item_id = w.item_id AND m.pos >= w.st AND m.pos < w.st + w.n
  GROUP BY w.rid, w.len, w.item_id, w.n, w.st, m.g
), scored AS (
  SELECT rid, item_id, st, sum(o) / (least(len, n) + n - sum(o)) AS s FROM shared GROUP BY rid, item_id, n, len, st
), best AS (
  SELECT rid, item_id, st, s, row_number() OVER (PARTITION BY rid, item_id ORDER BY s DESC, st) AS r FROM scored WHERE s >= 0.8 - 1e-12
)
SELECT doc_id, item_id, round(s, 6) AS similarity, CAST(st AS BIGINT) AS window_start FROM best JOIN d USING (rid) WHERE r = 1
"""

#: The others are not expressible in SQL (hash functions, models, tokenizers, offsets of matches);
#: their tests compare them with plain versions on small fixtures.
ORACLE_SQL: dict[str, str] = {"op5_benchmark_decontamination": _OP5_SQL, "op7_host_quality_rules": _OP7_SQL}
