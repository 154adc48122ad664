"""Bounded samples of labelled documents for classifiers that are fitted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import narrow

#: Documents a classifier is fitted on at most; which ones is decided by a hash of their ids.
MAX_TRAIN = 16_000


def training_rows(docs: DataFrame, labels: DataFrame, label_cols: list[str], max_rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most about max_rows labelled documents in one partition, ordered by a hash of their ids: doc_id, text, labels.

    Only the bounded sample of labels is broadcast, so no text but the sample's is moved. Rows of labels without id
    or with a null label take no part; of several for one id the largest label counts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in label_cols)).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in label_cols))
    sample = known.orderBy(F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), "doc_id").limit(max_rows)
    rows = narrow(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    return rows.repartition(1).sortWithinPartitions(F.crc32(F.concat(F.lit("o"), F.col("doc_id").cast("string"))), "doc_id")
