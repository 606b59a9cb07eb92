"""Pluggable column functions for embedding, extraction, reranking and generation, with offline stand-ins.

An embedder adds `vector` to rows with `text`, an extractor turns chunks into
triplets, a reranker adds `relevance`, a generator adds `answer` to rows with
`context` and `query`. All take and return DataFrames.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Plugin = Callable[[DataFrame], DataFrame]
KINDS = ("embedder", "extractor", "reranker", "generator", "analyzer")
_registered: dict[str, Plugin] = {}


def register(kind: str, function: Plugin) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    _registered[kind] = function


def registered(kind: str) -> Plugin | None:
    return _registered.get(kind)


class Rejected(Exception):
    """A call that will not succeed if repeated."""


def with_retries(call: Callable, retries: int = 2, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """`call` repeated after other errors than Rejected, waiting backoff, 2 backoff, 4 backoff ..."""

    def run(*args, **kwargs):
        for n in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except Rejected:
                raise
            except Exception:
                if n == retries:
                    raise
                sleep(backoff * 2**n)

    return run


def hash_embedder(dims: int = 64, batch: int = 32) -> Plugin:
    """Vectors of hashed words and word pairs: equal texts get equal vectors, shared words make them alike."""

    def vector(text: str) -> list[float]:
        v = np.zeros(dims)
        words = text.lower().split()
        for gram in [*words, *zip(words, words[1:])]:
            h = zlib.crc32(repr(gram).encode())
            v[h % dims] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            parts = [series.iloc[i : i + batch].map(lambda t: vector(t) if t and t.strip() else None) for i in range(0, len(series), batch)]
            yield pd.concat(parts) if parts else series

    return lambda rows: rows.withColumn("vector", embed("text"))


def embed_rows(rows: DataFrame, embedder: Plugin | None = None) -> DataFrame:
    """Rows with `vector`; blank texts are left out, a plug-in that loses rows is an error when counted."""
    return (embedder or registered("embedder") or hash_embedder())(rows.where(F.coalesce(F.trim("text"), F.lit("")) != ""))


#: Words that give away a question's intent, tried in order (fixed values).
INTENTS = (("comparison", "so sánh|khác nhau|giống nhau|compare"), ("relational", "quan hệ|liên hệ|giữa .+ và |between"), ("overview", "tổng quan|khái quát|tóm tắt|overview"), ("temporal", "năm nào|khi nào|bao giờ|thế kỷ|when"), ("multihop", "con của|người kế|dẫn đến|vì sao|why"))


def rule_analyzer(rows: DataFrame) -> DataFrame:
    """Questions with `intent`, by their words; factoid if none fits."""
    intent = F.lit("factoid")
    for name, words in reversed(INTENTS):
        intent = F.when(F.lower("query").rlike(words), name).otherwise(intent)
    return rows.withColumn("intent", F.coalesce(intent, F.lit("factoid")))


#: The answer where there is nothing to quote.
NOTHING = "Dữ liệu chưa có thông tin về câu hỏi này."


def extractive_generator(rows: DataFrame) -> DataFrame:
    """`answer`: the first source of the context, or that there is none."""
    first = F.regexp_extract("context", r'\[1\] \([^\n]*?\) "([^\n]*)"', 1)
    return rows.withColumn("answer", F.when(F.coalesce(first, F.lit("")) != "", F.concat(first, F.lit(" [1]"))).otherwise(F.lit(NOTHING)))
