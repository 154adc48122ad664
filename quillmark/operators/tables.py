"""Changes of stored relations as functions from old snapshot to new one; Parquet has no UPDATE, so each writes anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_key(batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return batch.withColumn("__n", n).where("__n = 1").drop("__n")


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The rows of a batch that are new by key, the first of each key."""
    return first_of_key(batch.join(existing.select(*key), key, "left_anti"), key, order)


def upsert(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    return batch.unionByName(existing.join(batch.select(*key), key, "left_anti"))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """All children of the given parents are replaced by the fresh ones."""
    return children.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def delete_cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key), key, "left_anti")


def update_where_found(existing: DataFrame, news: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns take the new value where one is there; without one they keep theirs."""
    renamed = news.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = existing.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns))


def repack_ordinals(df: DataFrame, parent: str, ordinal: str, tie: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(parent).orderBy(ordinal, tie)) - 1
    return df.withColumn(ordinal, n)


def apply_verdicts(images: DataFrame, verdicts: DataFrame) -> DataFrame:
    """images (image_id, story_id, ordinal, caption), verdicts (image_id, verdict, duplicate_of, caption): DROP deletes,
    KEEP that duplicates another known image deletes, other captions overwrite (400 characters), ordinals are repacked."""
    known = images.select(F.col("image_id").alias("duplicate_of"), F.lit(True).alias("__known"))
    v = verdicts.join(known, "duplicate_of", "left").select("image_id", "verdict", "duplicate_of", "__known", F.col("caption").alias("__caption"))
    joined = images.join(v, "image_id", "left")
    twin = F.coalesce("__known", F.lit(False)) & (F.col("duplicate_of") != F.col("image_id"))
    left = joined.where(~(F.coalesce(F.col("verdict") == "DROP", F.lit(False)) | F.coalesce(twin, F.lit(False))))
    caption = F.coalesce(F.when(F.trim("__caption") != "", F.substring("__caption", 1, 400)), F.col("caption"))
    return repack_ordinals(left.select("image_id", "story_id", "ordinal", caption.alias("caption")), "story_id", "ordinal", "image_id")
