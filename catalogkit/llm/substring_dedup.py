"""Substring dedup: fixed-block anchors.

A word is removed if a window of ``window`` consecutive words that covers it also
starts in a document with a smaller identifier.

1. Documents are dealt to chunks by a hash of the identifier; every later step that needs
   texts reads this one exchange. A chunk is some megabytes, so there is no other bound.
2. Index and probe: the non-overlapping reference blocks of every document are the index,
   and every rolling window of ``block`` words probes it. Any full window holds a whole
   block if 2 * block - 1 <= window. Each chunk sends the distinct hashes of both, sorted and
   as differences, to the buckets of the hash they belong to; a bucket answers with two bits for
   each: is it a reference block that stands elsewhere as well, and is it one twice or more?
3. Extend: full windows around hits, keyed by 128 bits of hash of their words, get the
   smallest identifier they occur in, with map-side combining, so that no pair of
   documents is ever formed. The windows that a document owns go back to its chunk; what
   its other windows around hits cover, the maximal repeats, is removed.

The hashes of step 2 have eight bits more than the index needs at its size: a false hit costs a
window more in step 3 and changes nothing. Nothing is collected or broadcast.

Defined results: a null or empty text has no words and keeps the empty string. Null
identifiers rank last, among each other by a hash of the text (in the 2^32 largest numbers).
Rows that share an identifier count as one document, which removes nothing from itself and
is dealt to one chunk. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogkit.llm.common import chunks, distinct, small_batches

SLICE = 1 << 20
#: Bytes of text in a chunk, and rolling windows in a bucket.
CHUNK, BUCKET = 1 << 22, 1 << 22
LAST = (1 << 63) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


class WordHasher:
    """Hashes of the words of texts, by differences of prefix sums of byte powers."""

    def __init__(self, base: int):
        self.base, self.size = base, 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, SLICE)
            back = pow(self.base, -1, 1 << 64)
            self.powers = np.cumprod(np.full(self.size, self.base, np.uint64), dtype=np.uint64)
            self.inverse = np.cumprod(np.full(self.size, back, np.uint64), dtype=np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(31)
        h *= _ODD[0]
        return h ^ (h >> np.uint64(29))


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, starts and ends of all words, and where each text's words begin."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return data, starts, ends, np.searchsorted(starts, begins)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * _ODD[1] + h[i : i + len(out)]
    return (out ^ (out >> np.uint64(32))) * _ODD[2]


class Windows:
    """Rolling blocks and full windows of a chunk of texts."""

    def __init__(self, texts: list[str | None], hashers: list[WordHasher], block: int, window: int):
        data, starts, ends, self.begin = split_words([(t or "").encode("utf-8", "replace") for t in texts])
        self.words = [f(data, starts, ends) for f in hashers]
        self.n = n = len(starts)
        length = np.diff(self.begin)
        place = np.arange(n) - np.repeat(self.begin[:-1], length)
        left = np.repeat(length, length) - place  # words from here to the end of the text
        self.blocks = rolling(self.words[0], block)
        self.whole = left[: len(self.blocks)] >= block
        self.aligned = place[: len(self.blocks)] % block == 0
        self.full = left[: max(0, n - window + 1)] >= window
        self.block, self.window, self.length = block, window, length

    def keys(self, s: np.ndarray) -> list[np.ndarray]:
        """64 bits of hash by each hasher for the windows that start at s."""
        found = []
        for words in self.words:
            h = np.zeros(len(s), np.uint64)
            for i in range(self.window):
                h = h * _ODD[1] + words[s + i]
            found.append(((h ^ (h >> np.uint64(32))) * _ODD[2]).view(np.int64))
        return found

    def around(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold a block of each kind."""
        s, span = np.arange(len(self.full)), self.window - self.block + 1
        held = self.full
        for hits in (own, other):
            sums = np.concatenate([[0], np.cumsum(hits)])
            held = held & (sums[s + span] > sums[s])
        return np.flatnonzero(held)


class Index:
    """How hashes of blocks are cut into buckets, for an index of about ``words`` / block blocks."""

    def __init__(self, words: int, block: int, window: int, bucket: int):
        self.block, self.window = block, window
        self.cut = max(0, math.ceil(math.log2(max(1, words / bucket))))  # bits of the bucket's number
        self.rest = min(31, max(16, math.ceil(math.log2(max(2, words / block))) + 8 - self.cut))

    def hashes(self, w: Windows) -> np.ndarray:
        return w.blocks >> np.uint64(64 - self.cut - self.rest)

    def parts(self, texts: list[str], hashers: list[WordHasher]) -> list[tuple[list[int], Windows]]:
        return [(at, Windows([texts[i] for i in at], hashers, self.block, self.window)) for at in chunks(texts, SLICE)]

    def ask(self, b: pd.DataFrame) -> pd.DataFrame:
        """The questions of a chunk: for each bucket its distinct hashes in order, as differences in
        two halves, and whether each is a reference block once, more often, and a window elsewhere."""
        seen = [np.zeros(0, np.uint64)]
        for _, w in self.parts(b["__text"].fillna("").tolist(), [WordHasher(_BASES[0])]):
            seen.append(self.hashes(w)[w.whole] << np.uint64(1) | w.aligned[w.whole])
        marked = np.sort(np.concatenate(seen))
        h = marked >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(h)))
        own = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first) if len(h) else size
        flags = (np.minimum(own, 2) + 4 * (own < size)).astype(np.uint8)
        h = h[first]
        bucket = (h >> np.uint64(self.rest)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else first
        value = (h & np.uint64((1 << self.rest) - 1)).astype(np.uint32)
        rows = []
        for x, y in zip(edges, np.append(edges[1:], len(h))):
            step = np.diff(value[x:y], prepend=np.uint32(0))
            rows.append((int(b["__chunk"].iloc[0]), int(bucket[x]), (step & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), (step >> np.uint32(16)).astype(np.uint16).tobytes(), flags[x:y].tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "low", "high", "flags"])

    def answer(self, b: pd.DataFrame) -> pd.DataFrame:
        """A bucket's answers: which hashes are reference blocks and stand elsewhere as well."""
        steps = [np.frombuffer(x, np.uint16).astype(np.uint32) | np.frombuffer(y, np.uint16).astype(np.uint32) << np.uint32(16) for x, y in zip(b["low"], b["high"])]
        size = [len(x) for x in steps]
        flags = np.frombuffer(b"".join(b["flags"]), np.uint8)
        values, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint32) for x in steps]), return_inverse=True)
        own = np.bincount(at, weights=flags & 3, minlength=len(values))
        other = np.zeros(len(values), bool)
        other[at[flags >= 4]] = True
        bits = []
        for kind in ((own >= 1) & other, own >= 2):
            bits.append([np.packbits(x).tobytes() for x in np.split(kind[at], np.cumsum(size)[:-1])])
        return pd.DataFrame({"chunk": b["chunk"], "x": b["bucket"], "y": size, "bits": [x + y for x, y in zip(*bits)]})

    def around(self, texts: list[str], answers: pd.DataFrame, bases: tuple[int, ...]) -> list[tuple[list[int], Windows, np.ndarray]]:
        """Slices of a chunk's texts, with the starts of the windows around hits: in a repeat
        each document's block within the window stands in the other one."""
        parts = self.parts(texts, [WordHasher(x) for x in bases])
        hashes = [self.hashes(w) for _, w in parts]
        known = distinct(np.concatenate([np.zeros(0, np.uint64), *(h[w.whole] for h, (_, w) in zip(hashes, parts))]))
        kinds = [[np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]]
        for data, n in answers.sort_values("x")[["bits", "y"]].itertuples(index=False):
            both = np.frombuffer(data, np.uint8)
            for kind, half in zip(kinds, np.split(both, 2)):
                kind.append(np.unpackbits(half, count=int(n)))
        elsewhere, often = (np.concatenate(k).astype(bool) for k in kinds)
        some = elsewhere | often
        live, often = known[some], often[some]
        low = np.uint64(0xFFFFF)
        there = np.zeros(int(low) + 1, bool)  # most hashes are not live, which this tells quickly
        there[(live & low).astype(np.int64)] = True
        found = []
        for h, (at, w) in zip(hashes, parts):
            p = np.flatnonzero(there[(h & low).astype(np.int64)] & w.whole)
            k = np.searchsorted(live, h[p])
            p, k = p[k < len(live)], k[k < len(live)]
            same = live[k] == h[p]
            p, k = p[same], k[same]
            own, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
            own[p] = w.aligned[p]
            other[p] = ~w.aligned[p] | often[k]
            found.append((at, w, w.around(own, other)))
        return found


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[Column, ...] = (),
    block: int = 7,
    window: int = 13,
    chunk: int = CHUNK,
    bucket: int = BUCKET,
    with_text: bool = True,
) -> DataFrame:
    """``doc_id``, the ``keep`` columns, ``n_words``, ``n_removed``, ``kept_sha256`` (of the
    kept words joined by one space) and, if asked for, ``kept_text``, for every row."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block")
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    index = Index(size // 5, block, window, bucket)
    many = F.lit(max(1, math.ceil(size / chunk), min(64, size >> 18)))  # at least some tasks' worth

    id_type = docs.select(doc_id).schema[0].dataType
    rank = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(text), F.lit(1 << 32)))
    rows = docs.select(*keep, rank.alias("__id"), F.col(doc_id).isNull().alias("__unnamed"), F.col(text).alias("__text"))
    names = rows.columns[:-1]  # without the text
    texts = rows.withColumn("__chunk", F.pmod(F.xxhash64("__id"), many)).repartition("__chunk").groupBy("__chunk")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text).fields])

    def windows(b: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, made = b["__id"].to_numpy(np.int64), []
        for at, w, s in index.around(b["__text"].fillna("").tolist(), answers, _BASES):
            x, y = w.keys(s)
            made.append(pd.DataFrame({"a": x, "b": y, "id": np.repeat(ids[at], w.length)[s]}))
        return pd.concat(made) if made else pd.DataFrame({"a": [], "b": [], "id": []}, dtype=np.int64)

    def remove(b: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found, ids = b["__text"].fillna("").tolist(), b["__id"].to_numpy(np.int64)
        answered = known["bits"].notna()
        owned = known[~answered]
        made: list[tuple] = []
        for at, w, s in index.around(found, known[answered], _BASES[:1]):
            gone = s[~_contained((*w.keys(s), np.repeat(ids[at], w.length)[s]), (owned["x"].to_numpy(), owned["y"].to_numpy()))]
            marks = np.zeros(w.n + 1, np.int64)
            np.add.at(marks, gone, 1)
            np.add.at(marks, gone + window, -1)
            covered = np.cumsum(marks[: w.n]) > 0
            for k, i in enumerate(at):
                ours, mine = found[i].encode("utf-8", "replace").split(), covered[w.begin[k] : w.begin[k + 1]]
                n = int(mine.sum())
                kept = b" ".join(v for v, z in zip(ours, mine.tolist()) if not z) if n else b" ".join(ours)
                made.append((len(ours), n, hashlib.sha256(kept).hexdigest(), *([kept.decode()] * with_text)))
        out = pd.DataFrame(made, columns=schema.names[-3 - with_text :])
        return pd.concat([b[names].reset_index(drop=True), out], axis=1)

    asked = texts.applyInPandas(lambda b: index.ask(b), "chunk long, bucket long, low binary, high binary, flags binary")
    answers = asked.groupBy("bucket").applyInPandas(lambda b: index.answer(b), "chunk long, x long, y long, bits binary")
    around = texts.cogroup(answers.groupBy("chunk")).applyInPandas(windows, "a long, b long, id long")
    owned = around.groupBy("a", "b").agg(F.min("id").alias("id"))
    # of its windows a document knows those it owns by 64 bits; both numbers are never null, which pandas would make floats of
    back = owned.select(F.pmod(F.xxhash64("id"), many).alias("chunk"), F.col("a").alias("x"), F.col("id").alias("y"), F.lit(None).cast("binary").alias("bits"))
    known = answers.unionByName(back)
    done = texts.cogroup(known.groupBy("chunk")).applyInPandas(remove, schema)
    of = F.when(~F.col("__unnamed"), F.col("__id")).cast(id_type).alias("doc_id")
    return done.select(of, *(c for c in schema.names if c not in ("__id", "__unnamed")))


def _contained(some: tuple[np.ndarray, ...], known: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows of the first columns are among the rows of the others."""
    kind = np.dtype([(f"f{i}", np.int64) for i in range(len(some))])
    left, right = np.empty(len(some[0]), kind), np.empty(len(known[0]), kind)
    for side, columns in ((left, some), (right, known)):
        for name, column in zip(kind.names, columns):
            side[name] = column
    if not len(right):
        return np.zeros(len(left), bool)
    right = np.unique(right)
    return right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left
