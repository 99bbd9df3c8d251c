"""Quality classifier: supervised subword embeddings.

Each word and each character n-gram hashes to a learned vector; a document is the
average of its vectors, a softmax layer gives the class. Training is numpy
stochastic gradient descent over a bounded, documented sample of labelled rows in
one task; scoring runs over all rows in batches.

Beside words and n-grams, each pair of adjacent words has one of two vectors: equal
words or different ones. An average of word vectors cannot tell one word said over and
over from a text about it; without these vectors such texts are missed.

Defined results: a null or empty text has no features and gets the bias-only
score; without labelled rows every score is 0.5. A document with several labels
teaches each of them; a null label teaches nothing. A ``keep`` column named ``score``
is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogkit.llm.common import bounded_sample, code_points, map_in_pandas, small_batches

ORDERS = (3, 4)
SLICE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the words, of adjacent pairs (equal or not), and of the character
    n-grams of a text, slice by slice."""
    if not text:
        return
    shift = np.uint64(64 - bits)
    tokens = text.encode("utf-8", "replace").split()
    for start in range(0, len(tokens), SLICE):
        part = tokens[start : start + SLICE + 1]
        codes = pd.factorize(np.array(part, dtype=object))
        own = pd.util.hash_array(codes[1], categorize=False)[codes[0]].astype(np.uint64)
        yield ((own[:SLICE] * _MIX) >> shift).astype(np.int32)
        shape = (own[1:] == own[:-1]).astype(np.uint64) + np.uint64(7)
        yield ((shape * _MIX * _MIX) >> shift).astype(np.int32)
    points = code_points(text)
    for start in range(0, len(points), SLICE):
        part = points[start : start + SLICE + max(ORDERS) - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                yield ((h[:SLICE] * _MIX) >> shift).astype(np.int32)


def _bag(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    parts = list(features(text, bits))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, dim: int, epochs: int, rate: float, seed: int) -> np.ndarray:
    """The folded model: a logit difference for each bucket, and the bias last."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(y)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, share = bags[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            if len(ids):
                vectors[ids] -= step * share[:, None] * back
            done += 1
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]).astype(np.float32)


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "quality",
    key: str = "doc_id",
    bits: int = 17,
    dim: int = 10,
    epochs: int = 8,
    rate: float = 2.0,
    max_rows: int = 6_000,
    seed: int = 1,
) -> np.ndarray:
    """Learn label 1 against label 0 from at most about ``max_rows`` labelled rows,
    taken by a hash of the key; returns the folded model (2**bits + 1 floats)."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    rows = bounded_sample(rows, F.struct("k"), max_rows).select(F.lit(0).alias("g"), "k", "t", "y")

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["k", "y"], kind="stable")
        model = fit([_bag(t, bits) for t in b["t"]], b["y"].to_numpy(), bits, dim, epochs, rate, seed)
        return pd.DataFrame({"model": [model.tobytes()]})

    made = rows.groupBy("g").applyInPandas(learn, "model binary").collect()
    return np.frombuffer(bytes(made[0].model), np.float32) if made else np.zeros((1 << bits) + 1, np.float32)


def predict(docs: DataFrame, model: np.ndarray, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``keep`` columns of every row, then ``score``, the probability of label 1."""
    small_batches(docs.sparkSession)
    bits = (len(model) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text")).drop("score")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("score double").fields])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            logits = []
            for t in b.pop("__text"):
                total, n = 0.0, 0
                for ids in features(t, bits):
                    total += float(m.take(ids).sum(dtype=np.float64))
                    n += len(ids)
                logits.append(float(m[-1]) + total / max(n, 1))
            yield b.assign(score=1 / (1 + np.exp(-np.clip(np.array(logits, dtype=np.float64), -500, 500))))

    return map_in_pandas(rows, score, schema)
