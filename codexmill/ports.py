"""Where models plug in: embedding, reranking, completion. Each is applied as an Arrow UDF or on few rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions.text import embed_safe


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> list[float | None]: ...


class Completer(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class HashedTokens:
    """A deterministic embedder for tests: signed token hashes, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            tokens = np.array(text.lower().split(), dtype=object)
            if len(tokens):
                h = pd.util.hash_array(tokens, categorize=False)
                np.add.at(out[i], (h % np.uint64(self.dim)).astype(int), np.where(h >> np.uint64(63), 1, -1))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


#: What a refusal says that a shorter text may mend. Fixed values.
TOO_LONG = ("context length", "input_tokens", "too many tokens", "out of memory", "cuda error")


def in_parts(embed: Callable[[list[str]], np.ndarray], text: str) -> np.ndarray:
    """The vector of a text that the port refuses as too long: the mean over 2, 3, ... runs of lines, the fewest that it takes.

    There are never more runs than lines, so it ends; other errors go on as they are.
    """
    lines = text.splitlines()
    if not lines:
        raise ValueError("the text can't be split")
    for count in range(2, max(2, len(lines)) + 1):
        size = -(-len(lines) // min(count, len(lines)))
        runs = ["\n".join(lines[i : i + size]) for i in range(0, len(lines), size)]
        try:
            return np.mean(embed([r for r in runs if r.strip()]), axis=0)
        except Exception as error:
            if not too_long(error):
                raise
    raise ValueError("the text is too long even by lines")


def too_long(error: Exception) -> bool:
    return any(t in str(error).lower() for t in TOO_LONG)


def embedded_each(port: Embedder, texts: list[str]) -> list[np.ndarray]:
    """Vectors of texts: all at once, and if the port refuses that, halves of them, down to single texts, which are split by lines."""
    if not texts:
        return []
    try:
        return list(port.embed(texts))
    except Exception as error:
        if not too_long(error):
            raise
    if len(texts) == 1:
        return [in_parts(port.embed, texts[0])]
    half = len(texts) // 2
    return embedded_each(port, texts[:half]) + embedded_each(port, texts[half:])


def embedded(df: DataFrame, text: str, port: Embedder, out: str = "embedding") -> DataFrame:
    """df with the vectors of a text column; image markup and inline data are taken out first."""
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedded_each(port, texts.fillna("").tolist()))

    return df.withColumn(out, vectors(embed_safe(F.col(text))))


def reranked(query: Column, text: Column, port: Reranker) -> Column:
    """Scores of (query, text) pairs; null where the port has none."""
    @F.pandas_udf("double")
    def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(port.score(queries.tolist(), texts.tolist()), dtype="float64")

    return scores(query, text)


def completed(prompt: Column, port: Completer) -> Column:
    @F.pandas_udf("string")
    def replies(prompts: pd.Series) -> pd.Series:
        return pd.Series(port.complete(prompts.tolist()))

    return replies(prompt)


def retried(call: Callable[[], object], times: int = 3, wait: float = 1.0):
    """The call's result; on failure it is made again up to ``times`` times."""
    import time

    for left in range(times, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
