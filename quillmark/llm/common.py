"""What the operators for training data share: defaults and partition layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.runtime import delete_path, drop_tables, give_back_driver, lean, mark, materialize, release, scratch_path, shared_dir, ship_package

__all__ = ["delete_path", "drop_tables", "give_back_driver", "lean", "mark", "materialize", "release", "scratch_path", "shared_dir", "ship_package", "narrow", "text_or_empty", "tokenizer_path"]


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only an id as long and a text, null as empty, under fixed names; clashing extra columns are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
