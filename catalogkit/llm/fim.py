"""Fill-in-middle transformation: texts are cut in three at token boundaries, picked by rank.

The token boundaries of a text (code-point offsets) form a set in the manner of Roaring bit maps:
values go by their upper bits into containers of 65,536, each kept as a sorted array, a bit map or
runs, whichever is smallest, with cumulative cardinalities over the containers. Rank k is answered by
a search over the cardinalities and a select within one container.

Defined results: a null or empty text is plain, with no tokens. A text that contains a marker is
plain. A null key is hashed as empty text, so its rows are cut at the same ranks. Equal rows give equal results. Columns of
``docs`` named like a result are replaced by it. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from catalogkit.llm.common import code_points, small_batches

MARKERS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "fim_text")
CUTS = ["n", "first", "second"]
SPAN = 1 << 16
ARRAY, BITMAP, RUN = "array", "bitmap", "run"


def container(low: np.ndarray) -> tuple[str, tuple[np.ndarray, ...]]:
    """The smallest form of a sorted set of numbers below 65,536, with what select needs beside it."""
    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = {ARRAY: 2 * len(low), RUN: 4 * len(starts), BITMAP: SPAN // 8}
    kind = min(sizes, key=sizes.__getitem__)
    if kind == ARRAY:
        return kind, (low.astype(np.uint16),)
    if kind == RUN:
        return kind, (low[starts].astype(np.uint16), starts)
    bits = np.zeros(SPAN, bool)
    bits[low] = True
    words = np.packbits(bits, bitorder="little").view("<u8")
    return kind, (words, np.cumsum(np.bitwise_count(words), dtype=np.int64))


def select_in(kind: str, data: tuple[np.ndarray, ...], k: int) -> int:
    """The k-th number (from 0) of a container."""
    if kind == ARRAY:
        return int(data[0][k])
    if kind == RUN:
        first, before = data
        r = int(np.searchsorted(before, k, "right")) - 1
        return int(first[r]) + k - int(before[r])
    words, upto = data
    w = int(np.searchsorted(upto, k, "right"))
    left = k - (int(upto[w - 1]) if w else 0)
    return 64 * w + int(np.flatnonzero(np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little"))[left])


class OffsetSet:
    """A sorted set of offsets in containers, with ``select`` by rank."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> 16
        at = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[at]
        self.containers = [container(part & (SPAN - 1)) for part in np.split(offsets, at[1:])]
        self.upto = np.append(at[1:], len(offsets))  # cumulative cardinalities

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        c = int(np.searchsorted(self.upto, k, "right"))
        return (int(self.high[c]) << 16) + select_in(*self.containers[c], k - (int(self.upto[c - 1]) if c else 0))


def boundaries(text: str) -> np.ndarray:
    """0 and the end of each token; a token is white space with the word after it, or the white space
    at the end of the text."""
    points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else code_points(text)
    word = np.concatenate([(points != 32) & ((points < 9) | (points > 13)), [False]])
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.concatenate([[0], ends, [len(points)] if len(points) and not word[-2] else []]).astype(np.int64)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in CUTS]))
def cuts(texts: pd.Series, one: pd.Series, other: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """Number of tokens and, where wanted, the two cut offsets in order."""
    made = []
    for text, a, b, want in zip(texts, one, other, wanted):
        held = OffsetSet(boundaries(text))
        n = len(held) - 1
        low, high = sorted((int(a) % (n + 1), int(b) % (n + 1)))
        made.append((n, held.select(low), held.select(high)) if want else (n, 0, 0))
    return pd.DataFrame(made, columns=CUTS, dtype=np.int64)


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """All columns of ``docs``, then ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain) and ``fim_text``. ``rate`` of 100 texts are cut, ``spm_rate`` of
    100 of those with the suffix first."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = (whole != "") & ~F.greatest(*(F.contains(whole, F.lit(m)) for m in markers))
    rows = docs.select(*(c for c in docs.columns if c not in RESULTS), whole.alias("__text"), cut.alias("__cut"), *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)))
    form = F.when(~F.col("__cut") | (F.col("__h3") % 100 >= rate), "plain").when(F.col("__h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    rows = rows.withColumn("__at", cuts("__text", "__h1", "__h2", F.col("form") != "plain"))
    first, second, plain = F.col("__at.first"), F.col("__at.second"), F.col("form") == "plain"
    prefix, middle, suffix = F.substr("__text", F.lit(1), first), F.substr("__text", first + 1, second - first), F.substr("__text", second + 1)
    p, s, m = map(F.lit, markers)
    made = F.when(plain, F.col("__text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    results = (F.col("__at.n").alias("n"), F.col("form"), F.when(~plain, first).alias("prefix_chars"), F.when(~plain, second - first).alias("middle_chars"), made.alias("fim_text"))
    return rows.select(*(c for c in docs.columns if c not in RESULTS), *results)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before the transformation. A cut text contains no marker, so the parts are exact."""
    p, s, m = markers
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    last = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), last, between(s, m))).when(form == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(output)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256(concat('42:', doc_id)) h FROM documents),
e AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END u,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) b FROM e),
x AS (SELECT *, array_to_string(u[1:least(a, b)], '') p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') m, array_to_string(u[greatest(a, b) + 1:], '') s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) output_sha256, sha256(t) restored_sha256 FROM x"""
