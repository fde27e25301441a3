"""Model-backed steps: prompts are columns, answers come from a provider, one call a distinct prompt."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelProvider(Protocol):
    def __call__(self, prompt: str) -> str: ...


def stub_provider(prompt: str) -> str:
    """Deterministic: a digest of the prompt, as JSON."""
    return f'{{"answer": "{hashlib.sha256(prompt.encode()).hexdigest()[:16]}"}}'


def answered(rows: DataFrame, prompt: str, provider: ModelProvider = stub_provider, retries: int = 3, cache: DataFrame | None = None) -> DataFrame:
    """rows plus answer and error. Equal prompts are asked once; cache(prompt_hash, answer) spares
    those asked before; a prompt that fails on every try gets the error and a null answer."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for p in f["prompt"]:
                answer = error = None
                for _ in range(retries):
                    try:
                        answer, error = provider(p), None
                        break
                    except Exception as e:  # noqa: BLE001  a provider may raise anything
                        error = str(e)
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({"prompt_hash": f["prompt_hash"], "answer": answers, "error": errors})

    keyed = rows.withColumn("prompt_hash", F.sha2(F.col(prompt), 256))
    asked = keyed.select("prompt_hash", F.col(prompt).alias("prompt")).dropDuplicates(["prompt_hash"])
    if cache is not None:
        asked = asked.join(cache.select("prompt_hash").distinct(), "prompt_hash", "left_anti")
    told = asked.mapInPandas(ask, "prompt_hash string, answer string, error string")
    if cache is not None:
        told = told.unionByName(cache.select("prompt_hash", "answer", F.lit(None).cast("string").alias("error")))
    return keyed.join(told, "prompt_hash", "left")
