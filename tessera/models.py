"""The interface behind which models stand, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


class TextModel(Protocol):
    """Generates text for prompts; made once per task, and called with batches of rows."""

    def generate(self, prompts: pd.Series, limits: pd.Series) -> pd.Series: ...


class Echo:
    """Returns the prompt: a dry run."""

    def generate(self, prompts: pd.Series, limits: pd.Series) -> pd.Series:
        return prompts


#: Models by name; a factory is called in each task.
MODELS: dict[str, type] = {"echo": Echo}


def generated(prompts: DataFrame, model: str = "echo", attempts: int = 3) -> DataFrame:
    """`prompts` (columns prompt, max_tokens and any others) with the column generation.

    A batch that fails is tried again; after `attempts` failures its generations are one space, so
    that a task that Spark repeats gives the same rows.
    """
    factory = MODELS[model]
    schema = StructType([*prompts.schema.fields, StructField("generation", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = factory()
        for batch in batches:
            for left in range(attempts - 1, -1, -1):
                try:
                    batch["generation"] = own.generate(batch["prompt"], batch["max_tokens"])
                    break
                except (OSError, RuntimeError, ValueError):
                    if not left:
                        batch["generation"] = " "
            yield batch

    return prompts.mapInPandas(run, schema)


def embedded(texts: DataFrame, size: int = 64, column: str = "text") -> DataFrame:
    """`texts` with `vector`: hashed counts of words at length 1, a stand-in for an encoder."""
    from zlib import crc32

    schema = StructType([*texts.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch[column]:
                v = np.zeros(size, np.float32)
                for w in (text or "").split():
                    h = crc32(w.encode())
                    v[h % size] += 1 if h >> 16 & 1 else -1
                n = np.linalg.norm(v)
                rows.append((v / n if n else v).tolist())
            batch["vector"] = rows
            yield batch

    return texts.mapInPandas(run, schema)


def messages(system: str, prompt: Column) -> Column:
    """A chat of a system part and a user part."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def single_message(system: str, prompt: Column) -> Column:
    """The same for models without a system role: one user part, with a blank line between."""
    return F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", F.lit(system), prompt).alias("content")))


def logit_bias(favoured: list[list[int]], avoided: list[list[int]], up: int = 7, down: int = -100) -> dict[int, int]:
    """Bias by token id: all tokens of favoured words up; avoided words down, but only those of one token."""
    bias = {token: up for ids in favoured for token in ids}
    return bias | {ids[0]: down for ids in avoided if len(ids) == 1}
