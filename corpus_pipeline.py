"""From documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; it is written as Parquet and read
again. All but the last return the columns of documents, whatever further ones there are and however they are named.

Null texts are empty: they are never toxic, near copies of nothing, have no passages, cost one word in the mix and are
packed as their end id. Rows without id stay as they are. Rows of one id are one document to the second stage, of which
one row stays. Of exact copies the smallest id stays, whatever their order. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import delete_path, mark, release, scratch_path, tokenizer_path
from quillmark.llm.mixing import mixed_rows
from quillmark.llm.neardup import first_of_each_group
from quillmark.llm.packing import pack
from quillmark.llm.suffixdedup import cleaned_rows
from quillmark.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the labels, does not reject."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return first_of_each_group(docs, words=5, percent=85)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes and more that stand anywhere else too."""
    return cleaned_rows(docs, length=200)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of smaller sources up to one and a half times as often as the largest one's."""
    return mixed_rows(docs, budget="cover", max_repetition=1.5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), max_tokens=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: The stages that fit models and encode tokens have no SQL form; tests/llm/test_pipeline.py has a plain version of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the table documents. What a stage leaves in the shared folder goes when the next is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        since = mark(spark)
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since, keep=(path,))
        if before is not None:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
