"""Quality rules: an isolation forest over rule statistics.

Each document gets statistics that quality rules look at (word and symbol counts,
repeated lines and repeated three-word windows, case and digit shares). Forests of random
splits are grown on a bounded sample, one on the statistics' excess over the range (and a
margin) that label-1 rows keep to, one on the statistics themselves; short average path
lengths mark anomalous documents, and the higher of both scores counts. Range and thresholds
come from all labelled rows: those that best separate label 0 from label 1 while they reject
``max_false`` of label 1 at most together. Where the second forest finds no label-0 row that
the first left, it rejects what is more unusual than every label-1 row.

Defined results: a null text counts as empty, has no words and fails the base
rules. Without labelled rows of both classes the forest rejects nothing. Every row
is judged by itself, so repeated rows get equal verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from catalogkit.llm.common import bounded_sample, map_in_pandas, small_batches, stored

SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STEPS = 1 << 16
SHARES = ("upper_share", "digit_share", "bang_share", "top_share")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, upper_share double, digit_share double, bang_share double, top_share double, n_lines long"


def text_stats(text: str | None) -> tuple:
    """Rule statistics of one text, in the order of ``STATS``."""
    text = text or ""
    tokens = text.encode("utf-8", "replace").split()
    n = len(tokens)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    chars = len(text) - blanks
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeated, distinct, top = 0, 0, 0
    if n:
        codes, values = pd.factorize(np.array(tokens, dtype=object))
        distinct = len(values)
        top = int(np.bincount(codes).max())
        if n >= 3:
            c = codes.astype(np.int64)
            pairs = pd.factorize(c[:-1] * distinct + c[1:])[0]
            windows = pd.factorize(pairs[:-1] * np.int64(distinct) + c[2:])[0]
            often = np.bincount(windows)[windows] > 1
            cover = np.zeros(n, bool)
            for i in range(3):
                cover[i : i + n - 2] |= often
            repeated = int(cover.sum())
    upper = len(re.findall("[A-Z]", text))
    digits = len(re.findall("[0-9]", text))
    return (n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, upper / max(chars, 1), digits / max(chars, 1), text.count("!") / max(chars, 1), top / max(n, 1), len(lines))


def with_stats(docs: DataFrame, text: str = "text", keep: tuple[Column, ...] = (), forest: tuple | None = None) -> DataFrame:
    """``keep`` columns of every row, then the statistics of its whole text; with a forest
    also ``anomaly``, in the same pass. A ``keep`` column named like one of these, or like a
    verdict, is replaced."""
    small_batches(docs.sparkSession)
    sent = None if forest is None else docs.sparkSession.sparkContext.broadcast(forest)
    names = StructType.fromDDL(STATS).names
    rows = docs.select(*keep, F.col(text).alias("__text")).drop(*names, "anomaly", "base_failed", "kept")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(STATS + (", anomaly double" if sent else "")).fields])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([text_stats(t) for t in b.pop("__text")], columns=names, index=b.index)
            if sent:
                made["anomaly"] = anomaly(_matrix(made), sent.value) if len(sent.value) else 0.0
            yield pd.concat([b, made], axis=1)

    return map_in_pandas(rows, measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _matrix(b: pd.DataFrame) -> np.ndarray:
    n = b["n_words"].clip(lower=1)
    shares = [b["n_symbols"] / n, b["n_dup_lines"] / b["n_lines"].clip(lower=1), b["n_repeat_words"] / n, *(b[x] for x in SHARES)]
    return np.column_stack([b["word_chars"] / n / 10, *shares]).astype(np.float64) ** 0.5  # the root spreads small shares


def grow(x: np.ndarray, trees: int, subsample: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Complete binary trees in arrays: feature (-1: leaf), split value, path length."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    feature = np.full((trees, (1 << (depth + 1)) - 1), -1, np.int32)
    split, path = np.zeros(feature.shape), np.zeros(feature.shape)
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while todo:
            node, level, rows = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            able = np.flatnonzero(high > low)
            if level == depth or len(rows) <= 1 or not len(able):
                path[t, node] = level + average_path(len(rows))
                continue
            f = int(rng.choice(able))
            at = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node] = f, at
            left = rows[:, f] <= at
            todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return feature, split, path, size


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def excess(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How far each statistic lies outside its usual range; 0 within."""
    return np.maximum(x - limits[1], 0) + np.maximum(limits[0] - x, 0)


def anomaly(x: np.ndarray, forest: tuple) -> np.ndarray:
    """Between 0 and 1; higher: isolated by fewer splits. The second forest's scores are
    shifted so that both have one threshold."""
    *parts, shifts, limits = forest
    scores = [isolation(seen, part) + shift for seen, part, shift in zip((excess(x, limits), x), parts, shifts)]
    return np.clip(np.maximum(*scores), 0, 1)


def isolation(x: np.ndarray, grown: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> np.ndarray:
    feature, split, path, size = grown
    total = np.zeros(len(x))
    for f, s, p in zip(feature, split, path):
        node = np.zeros(len(x), np.int64)
        for _ in range(feature.shape[1].bit_length() - 1):
            at = f[node]
            inner = at >= 0
            if not inner.any():
                break
            right = x[np.arange(len(x)), np.maximum(at, 0)] > s[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += p[node]
    return 2.0 ** (-total / len(feature) / max(average_path(size), 1e-9))


def train(
    stats: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    trees: int = 100,
    subsample: int = 256,
    max_rows: int = 20_000,
    max_false: float = 0.002,
    margin: float = 0.1,
    seed: int = 1,
) -> tuple[tuple, float]:
    """The forest and the score from which a document is rejected.

    At most about ``max_rows`` labelled rows (by a hash of the key) serve the growth of the
    forest; the usual ranges and the threshold come from all of them, by aggregates that
    combine on the map side.
    """
    y = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).where("__y in (0, 1)")
    rows = stored(stats.where(~base_failed()).join(y, F.col(key) == F.col("__k")).drop("__k"))
    b = bounded_sample(rows, F.struct(key), max_rows).toPandas().sort_values([key, "__y"], kind="stable")
    if len(b) < 2 or rows.agg(F.count_distinct("__y")).first()[0] < 2:
        return (), np.inf
    x = _matrix(b)
    low, high = usual_range(rows.where("__y = 1"), x.shape[1], max_false / 4)
    limits = np.array([low - margin * (high - low), high + margin * (high - low)])
    outer, inner = grow(excess(x, limits), trees, subsample, seed), grow(x, trees, subsample, seed)
    first = counts(rows, (outer, outer, (0, -1), limits))
    total = first[["good", "bad"]].sum()
    limit = threshold(first, total, max_false, 0)
    caught = first["step"] >= limit * STEPS
    second = counts(rows, (outer, inner, (0, 0), limits), limit)
    further = threshold(second, total, max_false, first.loc[caught, "good"].sum())
    if np.isinf(further):  # above all rows of label 1 that are left
        further = float((second.loc[second["good"] > 0, "step"].max() + 1) / STEPS)
    if np.isinf(limit):
        return (outer, inner, (-1, 0), limits), further
    return (outer, inner, (0, limit - further), limits), limit


def usual_range(rows: DataFrame, n: int, tail: float) -> np.ndarray:
    """The quantiles ``tail`` and 1 - ``tail`` of each statistic over all rows."""
    names = [f"x{i}" for i in range(n)]

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(_matrix(b), columns=names)

    x = rows.mapInPandas(matrix, ", ".join(f"{c} double" for c in names))
    found = x.agg(*(F.percentile_approx(c, [tail, 1 - tail], 100_000).alias(c) for c in names)).first()
    return np.array([found[c] for c in names]).T


def counts(rows: DataFrame, forest: tuple, below: float | None = None) -> pd.DataFrame:
    """``good`` and ``bad`` rows by ``step`` (of ``STEPS``) of their score, the highest first; with
    ``below`` by the second forest's score, of rows for which the first one's is less than that."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outer, inner, _, limits = sent.value
        for b in batches:
            x, y = _matrix(b), b["__y"].to_numpy()
            found = isolation(excess(x, limits), outer)
            if below is not None:
                left = found < below
                found, y = isolation(x[left], inner), y[left]
            yield pd.DataFrame({"step": np.floor(found * STEPS).astype(np.int64), "y": y})

    scored = rows.mapInPandas(score, "step long, y int").groupBy("step")
    return scored.agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")).toPandas().sort_values("step", ascending=False)


def threshold(c: pd.DataFrame, total: pd.Series, max_false: float, gone: int) -> float:
    """The score that separates best if ``gone`` rows of label 1 are rejected already."""
    good, bad = c["good"].cumsum() / total["good"], c["bad"].cumsum() / total["bad"]
    gain = (bad - good).where(c["good"].cumsum() + gone <= max_false * total["good"], -np.inf).to_numpy()
    return float(c["step"].iloc[int(np.argmax(gain))] / STEPS) if len(gain) and gain.max() > 0 else np.inf


def judge(stats: DataFrame, model: tuple[tuple, float]) -> DataFrame:
    """Adds ``base_failed``, ``anomaly`` (unless it is there) and ``kept`` to rows with statistics."""
    forest, limit = model
    if "anomaly" in stats.columns:
        return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
    sent = stats.sparkSession.sparkContext.broadcast(forest)
    schema = StructType([*stats.schema.fields, StructField("anomaly", DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(anomaly=anomaly(_matrix(b), sent.value) if len(sent.value) else 0.0)

    return map_in_pandas(stats, score, schema).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
