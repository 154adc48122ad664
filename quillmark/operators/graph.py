"""Connected components of a large graph as DataFrames.

Every node holds a label, at first its smallest neighbour or itself. In each round a node takes the smallest label
among its neighbours, the node that was its label takes it too, and labels are replaced by their own labels; path
lengths shrink geometrically. Each round is written to the shared store, so lineage stays short and lost executors
cost one round. Nothing is collected but the number of changed labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.runtime import drop_tables, materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Of edges with long columns src and dst: one row (id, component) per node that has an edge to another one;
    component is the smallest id of the node's component. Nulls and loops are ignored. The result is a table."""
    kept = edges.where("src != dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    both = materialize(kept.union(kept.select(F.col("dst"), F.col("src"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")), f"{name}-0")
    round_no = 0
    if not both.head(1):
        drop_tables(both)
        out = labels.select("id", F.col("label").alias("component"))
        out.quillmark_path = labels.quillmark_path
        return out
    while True:
        round_no += 1
        near = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("m"))
        own = labels.join(near, F.col("id") == F.col("src")).select("id", "label", F.least("label", "m").alias("m"))
        # what a node learns, and what the node that is its label learns from it
        told = own.select("id", "label", "m").unionByName(own.where("m < label").select(F.col("label").alias("id"), F.lit(None).cast("long").alias("label"), "m"))
        fresh = told.groupBy("id").agg(F.max("label").alias("old"), F.min("m").alias("m"))
        jump = fresh.select(F.col("id").alias("to"), F.col("m").alias("further"))
        step = materialize(
            fresh.join(jump, F.col("m") == F.col("to")).select("id", F.least("m", "further").alias("label"), (F.least("m", "further") != F.col("old")).alias("changed")),
            f"{name}-{round_no}",
        )
        drop_tables(labels)
        path = step.quillmark_path
        if not step.where("changed").head(1):
            drop_tables(both)
            out = step.select("id", F.col("label").alias("component"))
            out.quillmark_path = path
            return out
        labels = step.select("id", "label")
        labels.quillmark_path = path
