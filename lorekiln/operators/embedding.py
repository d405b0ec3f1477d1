"""Embedding of texts by a pluggable strategy, and upkeep of a table of vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Strategy = Callable[[], Callable[[Sequence[str]], list[list[float]]]]


def hashing_strategy(dim: int = 64) -> Strategy:
    """A deterministic stand-in for a model: signed feature hashing of the words, scaled to length 1; '' gives zeros."""

    def load() -> Callable[[Sequence[str]], list[list[float]]]:
        def embed(texts: Sequence[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * dim
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                size = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / size for x in v])
            return out

        return embed

    return load


def embed(df: DataFrame, key: str, text: str, strategy: Strategy, batch: int = 128) -> DataFrame:
    """(key, embedding): the strategy is loaded once a task and gets `batch` texts at a time; a null text counts as ''."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = strategy()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": model([t or "" for t in part[text]])})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def upsert_vectors(vectors: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the rows of `new` in place of those with their ids; ids are unique in `new`."""
    return vectors.join(new.select(key), key, "left_anti").select(*vectors.columns).unionByName(new.select(*vectors.columns))


def delete_vectors(vectors: DataFrame, ids: DataFrame | None = None, key: str = "id", module: str | None = None, major: int | None = None, submodule: str | None = None) -> DataFrame:
    """The table without the given ids, or without the rows of a module (one without submodule means those with '')."""
    if ids is not None:
        return vectors.join(ids.select(key).distinct(), key, "left_anti").select(*vectors.columns)
    hit = F.lit(True)
    if module is not None:
        hit = hit & (F.col("module") == module) & (F.coalesce("submodule", F.lit("")) == (submodule or ""))
    if major is not None:
        hit = hit & (F.col("version_major") == major)
    return vectors.where(~F.coalesce(hit, F.lit(False)))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """chunks with their vector and `error`, set for a chunk without one; joined by key, never by position. A null vector is none."""
    own = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("__key"), column).dropDuplicates(["__key"])
    joined = chunks.join(own, chunks[key] == F.col("__key"), "left").drop("__key")
    return joined.withColumn("error", F.when(F.col(column).isNull(), "no vector"))
