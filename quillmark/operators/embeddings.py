"""Where vectors of texts come from: hashed terms, or a remote model in batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.config import Settings
from quillmark.functions import terms

DIM, BATCH, TRIES, PAUSE = 1024, 128, 3, 5.0


class EmbeddingBackend(Protocol):
    """Gives (id, embedding) for rows (id, text)."""

    name: str

    def embed(self, rows: DataFrame) -> DataFrame: ...


class HashedTerms:
    """Uni- and bigrams without stop words, hashed to DIM places, counts scaled to length one; rows are not shuffled."""

    name = "local"

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", self.column(rows, F.col("text")).alias("embedding"))

    def column(self, rows: DataFrame, text: Column) -> Column:
        return terms.dense(rows.sparkSession, text, self.dim)


class RemoteModel:
    """Calls `ask(texts) -> vectors` with BATCH texts at a time inside tasks; a batch that fails is tried again after a
    doubling pause, and then fails the task. `ask` is sent to tasks, and holds its own client."""

    def __init__(self, ask, name: str = "remote", batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE):
        self.ask, self.name, self.batch, self.tries, self.pause = ask, name, batch, tries, pause

    def embed(self, rows: DataFrame) -> DataFrame:
        ask, batch, tries, pause = self.ask, self.batch, self.tries, self.pause

        def one(texts: list[str]) -> list[list[float]]:
            import time

            for k in range(tries):
                try:
                    return ask(texts)
                except Exception:
                    if k + 1 == tries:
                        raise
                    time.sleep(pause * 2**k)
            raise ValueError("tries must be 1 at least")

        def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                listed = texts.fillna("").tolist()
                yield pd.Series([v for a in range(0, len(listed), batch) for v in one(listed[a : a + batch])])

        return rows.select("id", F.pandas_udf(each, "array<float>", F.PandasUDFType.SCALAR_ITER)(F.col("text")).alias("embedding"))


def get_backend(settings: Settings, ask=None) -> EmbeddingBackend:
    """`local`, `remote` (needs `ask`), or `auto`: remote where there are a key and `ask`."""
    choice = (settings.embedding_backend or "auto").lower()
    if choice == "auto":
        choice = "remote" if settings.has_embedding_key() and ask is not None else "local"
    if choice == "local":
        return HashedTerms()
    if choice == "remote" and ask is not None:
        return RemoteModel(ask, settings.embedding_model or "remote")
    raise ValueError(f"unknown embedding backend: {settings.embedding_backend}")


def without_vector(items: DataFrame, sources: list[str] | None = None) -> DataFrame:
    rows = items.where("embedding is null")
    return rows.where(F.col("source_name").isin(*sources)) if sources else rows


def pending(items: DataFrame, sources: list[str] | None = None, limit: int = 1_000_000) -> DataFrame:
    """Items (id, source_name, title, content, fetched_at, embedding) without a vector, first come first."""
    return without_vector(items, sources).orderBy("fetched_at", "id").limit(limit)


def embed_stage(items: DataFrame, backend: EmbeddingBackend, text: Column, sources: list[str] | None = None, limit: int | None = 1_000_000) -> DataFrame:
    """The items with vectors where one was missing; the others keep theirs. Without a limit no row is put in order,
    and the local backend's vectors are made where the rows are."""
    if limit is None and isinstance(backend, HashedTerms):
        open_ = F.col("embedding").isNull() & (F.col("source_name").isin(*sources) if sources else F.lit(True))
        new = F.when(open_, backend.column(items, F.when(open_, text)))
        return items.select(*(F.coalesce("embedding", new).alias("embedding") if c == "embedding" else F.col(c) for c in items.columns))
    rows = (without_vector(items, sources) if limit is None else pending(items, sources, limit)).select("id", text.alias("text"))
    news = backend.embed(rows).select("id", F.col("embedding").alias("__new"))
    joined = items.join(news, "id", "left")
    return joined.select(*(F.coalesce("embedding", "__new").alias("embedding") if c == "embedding" else F.col(c) for c in items.columns))
