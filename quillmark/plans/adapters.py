"""The engine's relations as views of the sample tables, once as DataFrames and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "2024-01-01 00:00:00"
NOW = "2024-01-03 12:00:00"
#: Words that occur in the sample texts, for queries over keyword lists.
SAMPLE_WORDS = ("the", "tion ", "and then", "ingest", "heitun", "ciónes", " ed ", "lement")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    base = F.lit(BASE).cast("timestamp")
    minutes = lambda n: base + F.make_dt_interval(mins=n)
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_name"), (F.substring("source", 4, 9).cast("int") % 3 + 1).alias("source_tier"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/a/"), F.col("doc_id").cast("string"), F.lit("?ref=x")).alias("source_url"),
        F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 10 != 0, minutes(F.col("doc_id").cast("int"))).alias("published_at"), minutes((F.col("doc_id") + 30).cast("int")).alias("fetched_at"),
    )


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; four outlets and four hours are an event, so events have many items."""
    event = F.expr("doc_id DIV 240 * 100 + coalesce(CAST(substr(source, 4) AS BIGINT), 0) DIV 4")
    return table(spark, sf_dir, "documents").select(event.alias("event_id"), F.col("doc_id").alias("raw_item_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = event_items(spark, sf_dir).join(raw_items(spark, sf_dir), F.col("raw_item_id") == F.col("id"))
    ts = F.coalesce("published_at", "fetched_at")
    out = joined.groupBy("event_id").agg(F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"), F.bool_or(F.col("source_tier") <= 2).alias("tier_1_anchor"), F.count("*").alias("n"))
    status = F.element_at(F.array(*map(F.lit, ("selected", "candidate", "published", "rejected"))), (F.col("event_id") % 4 + 1).cast("int"))
    score = F.when(F.col("event_id") % 11 != 0, F.round(F.col("n") * 1.5 + F.col("event_id") % 5, 4))
    return out.select("event_id", "first_seen_at", "last_seen_at", "tier_1_anchor", score.alias("importance_score"), status.alias("status"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("story_id"), "event_id", F.concat(F.lit("Story "), F.col("event_id").cast("string")).alias("headline"), (F.col("event_id") % 2 == 0).alias("editor_approved"), "importance_score")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items(spark, sf_dir).select(F.col("raw_item_id").alias("claim_id"), F.col("event_id").alias("story_id"), (F.col("raw_item_id") % 2 == 0).alias("verified"))


def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim cites its own item and the next one."""
    return claims(spark, sf_dir).select("claim_id", F.explode(F.array("claim_id", F.col("claim_id") + 1)).alias("raw_item_id"))


#: The same in DuckDB; each oracle adds its own SELECT.
PRELUDE = f"""
WITH raw_items AS (
  SELECT doc_id AS id, source AS source_name, CAST(substr(source, 4) AS INTEGER) % 3 + 1 AS source_tier,
    'https://www.' || source || '.example.com/a/' || doc_id || '?ref=x' AS source_url, substr(text, 1, 80) AS title, text AS content,
    CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '{BASE}' + to_minutes(doc_id) END AS published_at, TIMESTAMP '{BASE}' + to_minutes(doc_id + 30) AS fetched_at
  FROM documents),
event_items AS (SELECT doc_id // 240 * 100 + coalesce(CAST(substr(source, 4) AS BIGINT), 0) // 4 AS event_id, doc_id AS raw_item_id FROM documents),
events AS (
  SELECT event_id, first_seen_at, last_seen_at, tier_1_anchor, CASE WHEN event_id % 11 <> 0 THEN round(n * 1.5 + event_id % 5, 4) END AS importance_score,
    ['selected', 'candidate', 'published', 'rejected'][event_id % 4 + 1] AS status
  FROM (SELECT event_id, min(coalesce(published_at, fetched_at)) AS first_seen_at, max(coalesce(published_at, fetched_at)) AS last_seen_at,
    bool_or(source_tier <= 2) AS tier_1_anchor, count(*) AS n FROM event_items JOIN raw_items ON raw_item_id = id GROUP BY event_id)),
stories AS (SELECT event_id AS story_id, event_id, 'Story ' || event_id AS headline, event_id % 2 = 0 AS editor_approved, importance_score FROM events),
claims AS (SELECT raw_item_id AS claim_id, event_id AS story_id, raw_item_id % 2 = 0 AS verified FROM event_items),
claim_sources AS (SELECT claim_id, claim_id + unnest([0, 1]) AS raw_item_id FROM claims)
"""
