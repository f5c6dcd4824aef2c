"""Models that a user plugs into retrieval: encoders, pair scorers and searches.

A plug-in names a factory (``package.module:function``) and its arguments; a worker calls it when the first batch comes and keeps
the model for all later ones, so that a large model is loaded once a worker and never travels. Texts come in Arrow batches.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantarow.functions.words import words
from vantarow.operators import retrieval


@runtime_checkable
class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of numbers for each text."""


@runtime_checkable
class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """One number for each (query, text): the larger, the better the text answers."""


class Search(Protocol):
    def search(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The best k of ``chunks`` (chunk_id, text) for each query (query_id, query): query_id, chunk_id, score, rank."""


_LOADED: dict[str, object] = {}
#: Words whose hashes a worker remembers.
MAX_WORDS = 1 << 18


@dataclass(frozen=True)
class Plugin:
    """A factory by name with its arguments (JSON values). Equal plug-ins share a worker's model."""

    factory: str
    arguments: dict = field(default_factory=dict, hash=False)

    @property
    def key(self) -> str:
        return f"{self.factory}{json.dumps(self.arguments, sort_keys=True)}"

    def load(self) -> object:
        if self.key not in _LOADED:
            module, _, name = self.factory.partition(":")
            _LOADED[self.key] = getattr(importlib.import_module(module), name)(**self.arguments)
        return _LOADED[self.key]


def encode(df: DataFrame, text: str, to: str, plugin: Plugin, batch: int = 64) -> DataFrame:
    """``df`` with the encoder's vector of column ``text``; a null text is encoded as an empty one."""

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = plugin.load()
        for part in parts:
            texts = part.fill_null("").to_numpy(zero_copy_only=False).tolist()
            made = [np.asarray(model.encode(texts[a : a + batch]), np.float32) for a in range(0, len(texts), batch)]
            yield retrieval.as_lists(made)

    return df.withColumn(to, vectors(F.col(text)))


def rerank(hits: DataFrame, k: int, plugin: Plugin, key: str = "chunk_id", batch: int = 32) -> DataFrame:
    """The first k of ``hits`` (query_id, key, query, text) by the pair scorer: query_id, key, score (9 places), rank; ties by key."""

    @F.pandas_udf("double")
    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = plugin.load()
        for queries, texts in parts:
            pairs = list(zip(queries.fillna("").tolist(), texts.fillna("").tolist()))
            made = [np.asarray(model.score(pairs[a : a + batch]), float) for a in range(0, len(pairs), batch)]
            yield pd.Series(np.concatenate(made) if made else np.empty(0))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    scored = hits.select("query_id", key, F.round(scores("query", "text"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Lexical:
    """Search by BM25."""

    def search(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.bm25_search(chunks.select("chunk_id", "text"), queries, k)


@dataclass(frozen=True)
class Dense:
    """Search by the vectors of an encoder."""

    encoder: Plugin

    def search(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        vectors = encode(chunks.select("chunk_id", "text"), "text", "embedding", self.encoder).select("chunk_id", "embedding")
        asked = encode(queries, "query", "embedding", self.encoder).select("query_id", "embedding")
        return retrieval.dense_search(vectors, asked, k, "chunk_id")


@dataclass(frozen=True)
class Fused:
    """Several searches, each to ``depth``, fused by reciprocal ranks."""

    searches: tuple
    depth: int = 50

    def search(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.hybrid_search({str(i): s.search(chunks, queries, self.depth) for i, s in enumerate(self.searches)}, k, "chunk_id")


@dataclass(frozen=True)
class Reranked:
    """A search to ``depth`` whose hits a pair scorer orders."""

    first: object
    scorer: Plugin
    depth: int = 30

    def search(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        hits = self.first.search(chunks, queries, self.depth).select("query_id", "chunk_id")
        return rerank(hits.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries, "query_id"), k, self.scorer)


# Plain models without weights: what stands in where no trained one is at hand, and in tests.


class HashedWords:
    """Unit vectors of counts of words, each at a place and with a sign from its hash."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions, self.places = dimensions, {}

    def _hashed(self, words: list[str]) -> list[int]:
        """Twice the place of each word, one more if it counts up; words met before are remembered."""
        new = [x for x in words if x not in self.places]
        if len(self.places) + len(new) > MAX_WORDS:
            self.places.clear()
            new = words
        for word in new:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self.places[word] = h % self.dimensions * 2 + (h >> 63)
        return [self.places[x] for x in words]

    def encode(self, texts: list[str]) -> np.ndarray:
        found, length = words(pa.array(texts, pa.string()))
        found = found.dictionary_encode()
        place = np.array(self._hashed(found.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)[found.indices.to_numpy()]
        at = np.repeat(np.arange(len(texts)), length) * self.dimensions + place // 2
        out = np.bincount(at, place % 2 * 2 - 1, minlength=len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class SharedWords:
    """Share of a query's different words that a text has; 0 for a query without words. ``log``: a file that notes each loading."""

    def __init__(self, log: str | None = None) -> None:
        if log:
            with open(log, "a", encoding="utf-8") as f:
                f.write(f"{os.getpid()}\n")

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        words = [(set(re.findall("[a-z0-9]+", a.lower())), set(re.findall("[a-z0-9]+", b.lower()))) for a, b in pairs]
        return np.array([len(a & b) / len(a) if a else 0.0 for a, b in words])
