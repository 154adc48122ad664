"""The engine's relations as Parquet snapshots below one folder, in any store that Spark writes.

A write makes a new snapshot and never touches the one that readers have; the newest complete one counts, and one older
one is kept. Keys and deletions are functions of snapshots (`operators.tables`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.runtime import delete_path

SCHEMAS = {
    "raw_items": "id long, source_name string, source_tier int, source_url string, title string, content string, published_at timestamp, fetched_at timestamp, embedding array<float>, raw_data string, full_content string, full_content_fetched_at timestamp",
    "events": "event_id long, title string, summary string, importance_score float, tier_1_anchor boolean, first_seen_at timestamp, last_seen_at timestamp, status string",
    "event_items": "event_id long, raw_item_id long",
    "stories": "story_id long, event_id long, headline string, dek string, body_markdown string, editor_approved boolean, editor_notes string, agent_trace string, created_at timestamp",
    "claims": "claim_id long, story_id long, claim_text string, verified boolean, tier_1_backed boolean, ordinal int",
    "claim_sources": "claim_id long, raw_item_id long",
    "story_images": "story_id long, source_url string, local_path string, caption string, credit string, article_url string, ordinal int",
}
STATUSES = ("candidate", "selected", "published", "rejected")


class Store:
    """`store["events"]` reads, `store["events"] = df` writes the next snapshot."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Complete snapshots of a table, oldest first."""
        p, fs = self._path(f"{self.folder}/{name}")
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in found if n.startswith("v") and fs.exists(self._path(f"{self.folder}/{name}/{n}/_SUCCESS")[0])]
        return sorted(done)

    def __getitem__(self, name: str) -> DataFrame:
        have = self.versions(name)
        if not have:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v{have[-1]}")

    def __setitem__(self, name: str, df: DataFrame) -> None:
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        typed = df.select(*(df[c.name].cast(c.dataType).alias(c.name) for c in columns))
        have = self.versions(name)
        number = have[-1] + 1 if have else 1
        typed.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{number}")
        for old in have[:-1]:
            delete_path(self.spark, f"{self.folder}/{name}/v{old}")

    def truncate(self) -> None:
        """An empty snapshot of every table."""
        for name, schema in SCHEMAS.items():
            self[name] = self.spark.createDataFrame([], schema)
