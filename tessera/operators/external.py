"""Models outside Spark behind small interfaces: encoders, language models, annotators. Stubs are deterministic.

A model is built once in each task, calls are batched, failed batches are left out, so that the next run, which skips
what the success log holds, tries them again.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class Caller(Protocol):
    """Answers a JSON payload with JSON; raises RateLimited or any other error."""

    def call(self, payload: str) -> str: ...


class RateLimited(Exception):
    pass


class HashedGrams:
    """MDL-1's stub: unit vectors of hashed character trigrams."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for i, t in enumerate(texts):
            for k in range(max(1, len(t) - 2)):
                out[i, zlib.crc32(t[k : k + 3].encode()) % self.width] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def encoded(df: DataFrame, text: str, encoder: Callable[[], Encoder]) -> DataFrame:
    """MDL-1, MDL-3: df with `embedding`; each distinct text is encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for b in batches:
            yield b.assign(embedding=list(model.encode(b[text].tolist())))

    # Python sees each text once, in batches of rows that Spark bounds.
    once = df.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, embedding array<float>")
    return df.join(once, text, "left")


class LetterCounts:
    """A stub whose vectors a query can state: how often each letter from a to z stands in the lower-cased text."""

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        return np.array([[t.count(chr(97 + k)) for k in range(26)] for t in low], dtype=np.float32).reshape(len(texts), 26)


def with_memo(df: DataFrame, text: str, memo: DataFrame, encoder: Callable[[], Encoder]) -> tuple[DataFrame, DataFrame]:
    """MDL-2, MDL-3: df with `embedding` and `known`, and the memo (text, embedding) with what was new: only texts that it lacks are encoded, each once."""
    new = encoded(df.select(text).where(F.col(text).isNotNull()).join(memo.select(text), text, "left_anti").distinct(), text, encoder)
    every = memo.withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False)))
    return df.join(every, text, "left"), every.drop("known")


def retried(call: Callable[[], str], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """LLM-1: 30 s times 2^k after a rate limit, 2^k s after another error; None when all tries failed."""
    for k in range(tries):
        try:
            return call()
        except RateLimited:
            sleep(30 * 2**k)
        except Exception:  # noqa: BLE001  any failure of a remote model is retried
            sleep(2**k)
    return None


def called(items: DataFrame, batch: str, caller: Callable[[], Caller], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """LLM-1, LLM-4: batch, answer of each batch of items (columns batch and payload) that succeeded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = caller()
        answer = retried(lambda: model.call(json.dumps(pdf["payload"].tolist())), sleep=sleep)
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "answer": [answer]})[lambda x: x["answer"].notna()]

    return items.groupBy(batch).applyInPandas(run, f"{batch} string, answer string")


def summaries(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """LLM-4: a new summary where there is one, else the old; null is tried again next time."""
    return old.join(new.select(key, F.col("summary").alias("_new")), key, "left").withColumn("summary", F.coalesce("_new", "summary")).drop("_new")


def merge_rounds(categories: list[dict], plan: Callable[[list[dict]], list[list[int]]], size: int = 20, enough: int = 10, rounds: int = 10) -> list[list[int]]:
    """LLM-7: rounds of merging in batches, until no more than enough are left or nothing changes: the source ids of each category.

    categories are few by nature (one for each merged cluster); plan groups the places in a batch.
    """
    held = [[c["category_id"]] for c in categories]
    for _ in range(rounds):
        if len(held) <= enough:
            break
        new: list[list[int]] = []
        for k in range(0, len(held), size):
            part = held[k : k + size]
            new += [[x for i in g for x in part[i]] for g in plan([{"ids": p} for p in part])]
        if len(new) == len(held):
            break
        held = new
    return held


def annotated(df: DataFrame, text: str, annotator: Callable[[], Callable[[list[str]], list]], schema: str) -> DataFrame:
    """LLM-9, TRN-3: df with `annotation`, of the given type, from a model that is built once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = annotator()
        for b in batches:
            yield b.assign(annotation=model(b[text].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, annotation {schema}")
