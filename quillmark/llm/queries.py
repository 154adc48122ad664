"""The registered query of each operator for training data, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import tokenizer_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.tokenids import token_digests

    return token_digests(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir), target_entropy=0.998)


#: How texts begin that stand for licence files; fixed value.
_LICENCE_BEGINS = r"(?i)^[^a-z]*(licensed under|released under|this work is licensed|permission is hereby granted|redistribution and use|all rights reserved|(mit|isc|bsd|apache|mozilla public|gnu)\b.{0,24}licen[cs]e)"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path, so each stands at source/lang/<doc_id>.txt, and one whose text begins as licence texts do
    at source/lang/LICENSE-<doc_id>."""
    from quillmark.llm.licenses import scan_licenses

    licence = F.coalesce(F.col("text").rlike(_LICENCE_BEGINS), F.lit(False))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    path = F.concat_ws("/", "source", "lang", F.when(licence, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt"))))
    return scan_licenses(_documents(spark, sf_dir), path)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import toxicity

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels), [*toxicity.CATEGORIES, "toxic"], threshold=toxicity.THRESHOLD)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.omh import with_edits

    return with_edits(_documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), words=5, percent=85)


def op7_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.mtree import top_inner_products

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(vectors, F.col("vec_id") % 50 == 0, k=5)


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import quality

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels.where(~quality.held_out()), "quality")
    return quality.score(docs, weights, threshold=0.7).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), max_tokens=2048, end_id=0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.suffixdedup import remove_repeats

    out = remove_repeats(_documents(spark, sf_dir), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_temperature_mixing": op2_temperature_mixing,
        "op3_license_scan": op3_license_scan,
        "op4_toxicity_chain": op4_toxicity_chain,
        "op5_order_minhash": op5_order_minhash,
        "op6_near_dedup": op6_near_dedup,
        "op7_mtree_search": op7_mtree_search,
        "op8_quality_ftrl": op8_quality_ftrl,
        "op9_pattern_packing": op9_pattern_packing,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE len(q.e) > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens,
         coalesce(CAST(doc_id AS VARCHAR), '') || '|' || substr(md5(coalesce(text, '')), 1, 16) AS name FROM documents
), s AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source
), l AS (SELECT list(tokens / total ORDER BY source) AS x, max(total) AS total, count(*) AS n FROM (SELECT *, CAST(sum(tokens) OVER () AS BIGINT) AS total FROM s)
), b AS (
  SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS k
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, k + 1 FROM (
    SELECT low, high, k, mid, ln(z) - y / z - 0.998 * ln(n) >= 0 AS ok FROM (
      SELECT low, high, k, mid, n, list_sum(p) AS z, list_sum(list_transform(p, lambda v: v * ln(v))) AS y FROM (
        SELECT low, high, k, (low + high) / 2 AS mid, n, list_transform(x, lambda v: pow(v, (low + high) / 2)) AS p FROM b, l WHERE k < 40)))
), a AS (
  SELECT CASE WHEN (SELECT -list_sum(list_transform(x, lambda v: v * ln(v))) - 0.998 * ln(n) >= 0 FROM l) THEN 1.0 ELSE round(low, 9) END AS alpha FROM b WHERE k = 40
), p AS (SELECT source, s.tokens, docs, total, pow(s.tokens / total, alpha) AS p FROM s, a, l
), w AS (SELECT *, p / sum(p) OVER () AS share FROM p
), plan AS (
  SELECT source, round(share, 9) AS weight, tokens AS source_tokens, CAST(ceil(docs / 4096) AS BIGINT) AS blocks, CAST(floor(round(total * share, 6)) AS BIGINT) AS quota FROM w
), t AS (
  SELECT doc_id, name, d.source, d.tokens, weight, quota // source_tokens AS epochs, quota % source_tokens AS rest,
         CAST('0x' || substr(md5('0b|' || name), 1, 8) AS BIGINT) % blocks AS block
  FROM d JOIN plan USING (source)
), u AS (SELECT t.*, unnest(range(epochs + 1)) AS epoch FROM t
), r AS (
  SELECT *, row_number() OVER i AS doc_rank, sum(tokens) OVER (i ROWS UNBOUNDED PRECEDING) AS reach FROM u
  WINDOW i AS (PARTITION BY source, epoch, block ORDER BY md5('0|' || epoch || '|' || source || '|' || name), name, tokens)
), z AS (SELECT source, block, epochs, sum(tokens) AS block_tokens FROM t GROUP BY ALL
), y AS (SELECT source, block, block_tokens, unnest(range(epochs + 1)) AS epoch FROM z
), x AS (
  SELECT source, block, epoch, row_number() OVER i AS block_rank, sum(block_tokens) OVER (i ROWS UNBOUNDED PRECEDING) - block_tokens AS before FROM y
  WINDOW i AS (PARTITION BY source, epoch ORDER BY md5('0|' || epoch || '|' || source || '|b' || block))
)
SELECT doc_id, source, tokens, weight, epoch, block, CAST(block_rank AS INTEGER) AS block_rank, CAST(doc_rank AS INTEGER) AS doc_rank
FROM r JOIN x USING (source, block, epoch) WHERE epoch < epochs OR before + reach <= rest
"""


def _op3() -> str:
    from quillmark.llm.licenses import oracle_sql as scan

    licence = f"coalesce(regexp_matches(text, '{_LICENCE_BEGINS}'), FALSE)"
    number = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return scan(f"concat_ws('/', source, lang, CASE WHEN {licence} THEN 'LICENSE-' || {number} ELSE {number} || '.txt' END)", licence)


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": _op3(), "op2_temperature_mixing": _OP2, "op7_mtree_search": _OP7}
