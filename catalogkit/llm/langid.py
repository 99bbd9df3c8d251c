"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are summed per language with Spark; the matrix of
log probabilities (languages x buckets, a size fixed by parameters) is broadcast.
A batch of texts is a sparse matrix of (text, bucket) entries, whose product with
each language's column numpy sums by text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Rows with a null language or text
teach nothing. A null identifier counts as not held out. Ties go to the language
that sorts first. Repeated rows are scored each; extra columns are ignored; a
``keep`` column named like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogkit.llm.common import chunks, code_points, map_in_pandas, small_batches

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
SLICE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: str, bits: int, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of the lower-cased text, slice by slice."""
    points = code_points(text.lower())
    shift, longest = np.uint64(64 - bits), max(orders)
    for start in range(0, len(points), SLICE):
        part = points[start : start + SLICE + longest - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            if n in orders:
                yield ((h[:SLICE] * _MIX) >> shift).astype(np.int32)


def batch_buckets(texts: list[str], bits: int, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries of a batch, about ``SLICE`` characters at a time: the number of a text, and
    the bucket of an n-gram that lies in it."""
    lowered = [t.lower() for t in texts]
    shift = np.uint64(64 - bits)
    for at in chunks(lowered, SLICE):
        if len(at) == 1:
            for ids in ngram_buckets(texts[at[0]], bits, orders):
                yield np.full(len(ids), at[0]), ids
            continue
        points = code_points("".join(lowered[i] for i in at))
        text = np.repeat(at, [len(lowered[i]) for i in at])
        h = np.zeros(len(points), np.uint64)
        for n in range(1, min(max(orders), len(points)) + 1):
            h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            if n in orders:
                inside = text[: len(h)] == text[n - 1 :]
                yield text[: len(h)][inside], ((h * _MIX) >> shift).astype(np.int32)[inside]


def quota(sizes: list[int], most: int) -> int:
    """The bound for each label that leaves at most ``most`` rows together (one a label at
    least): labels with fewer rows keep them all."""
    left = most
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            return max(share, 1)
        left -= n
    return max(sizes, default=1)


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    bits: int = 15,
    smoothing: float = 0.5,
    max_rows: int = 40_000,
    max_labels: int = 1_000,
) -> tuple[list[str], np.ndarray]:
    """Labels in order and a float32 matrix (2**bits + 1 rows, one column a label)
    of log probabilities; the last row holds the log priors.

    Labels and priors come from all labelled rows. ``max_rows`` bounds the sample that
    n-grams are learned from (chosen by a hash of the key and the text, within each label:
    rare labels keep all their rows). More than ``max_labels`` labels raise, as the matrix
    would be too large to send.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y")).where("t is not null and y is not null")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(max_labels + 1).collect()}
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels, most = sorted(sizes), quota(list(sizes.values()), max_rows)
    if max(sizes.values(), default=0) > most:
        whole = 1_000_003
        cuts = rows.sparkSession.createDataFrame([(y, whole * min(most, n) // n) for y, n in sizes.items()], "y string, cut long")
        rows = rows.join(F.broadcast(cuts), "y").where(F.pmod(F.xxhash64(F.struct("k", "t"), F.lit("sample")), F.lit(whole)) < F.col("cut"))
    number = {y: i for i, y in enumerate(labels)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for t, y in zip(b["t"], b["y"]):
                c = total.setdefault(number[y], np.zeros(1 << bits, np.int64))
                for ids in ngram_buckets(t, bits):
                    c += np.bincount(ids, minlength=1 << bits)
        for y, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"y": np.int32(y), "b": at.astype(np.int32), "n": c[at]})

    found = rows.select("t", "y").mapInPandas(count, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(((1 << bits) + 1, len(labels)))
    if labels:
        counts[found["b"], found["y"]] = found["n"]
        grams = counts[:-1] + smoothing
        counts[:-1] = np.log(grams / grams.sum(axis=0))
        seen = np.array([sizes[y] for y in labels], np.float64)
        counts[-1] = np.log(seen / seen.sum())
    return labels, counts.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``keep`` columns of every row, then ``lang_pred`` and ``score``, the posterior
    probability of the language named."""
    small_batches(docs.sparkSession)
    labels, matrix = model
    bits = (len(matrix) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))  # a row a language
    rows = docs.select(*keep, F.col(text).alias("__text")).drop("lang_pred", "score")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("lang_pred string, score double").fields])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            texts = b.pop("__text").tolist()
            known = [i for i, t in enumerate(texts) if labels and t is not None and any(map(str.isalpha, t))]
            logs = np.repeat(m[:, -1:].astype(np.float64), len(known), axis=1)
            for at, ids in batch_buckets([texts[i] for i in known], bits):
                for y, column in enumerate(m):
                    logs[y] += np.bincount(at, column.take(ids), len(known))
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known:
                best = logs.argmax(axis=0)
                scores[known] = 1 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
                for i, y in zip(known, best):
                    langs[i] = labels[y]
            yield b.assign(lang_pred=langs, score=scores)

    return map_in_pandas(rows, score, schema)
