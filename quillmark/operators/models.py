"""Where generated text can come in: a backend answers prompts in batches inside tasks; offline there is none.

Rules of the engine only ever make an answer stricter, so every operator works without a backend."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES, PAUSE = 3, 5.0
ROLES = ("router", "fact_extractor", "verifier", "context", "perspective", "editor", "reporter", "judge", "coherence")


class Backend(Protocol):
    """Sent to tasks by pickle; raises where it has no answer."""

    name: str

    def complete(self, system: str, prompts: list[str]) -> list[str]: ...


def retry_pause(attempt: int) -> float:
    """Seconds before the next attempt, doubling."""
    return PAUSE * 2**attempt


def answered(rows: DataFrame, prompt: Column, backend: Backend | None, system: str = "", tries: int = RETRIES, pause=retry_pause) -> DataFrame:
    """Adds answer and error (both null without a backend). A failing batch is tried again, then only its rows fail."""
    if backend is None:
        return rows.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    import time

    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in parts:
            for k in range(tries):
                try:
                    yield pd.DataFrame({"answer": backend.complete(system, prompts.tolist()), "error": None})
                    break
                except Exception as e:
                    if k + 1 == tries:
                        yield pd.DataFrame({"answer": None, "error": [f"{type(e).__name__}: {e}"[:400]] * len(prompts)})
                    else:
                        time.sleep(pause(k))

    said = F.pandas_udf(ask, "answer string, error string", F.PandasUDFType.SCALAR_ITER)
    return rows.withColumn("__said", said(prompt)).withColumns({"answer": F.col("__said.answer"), "error": F.col("__said.error")}).drop("__said")


def route(backends: dict[str, Backend], role: str) -> Backend | None:
    """The backend of a role, else the one under `default`, else none."""
    if role not in ROLES:
        raise ValueError(f"unknown role: {role}")
    return backends.get(role, backends.get("default"))
