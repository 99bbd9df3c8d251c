"""Token ids as ORC files: integers are run-length encoded in stripes, with row indexes and a Bloom
filter on the document ids.

Documents are dealt to files by ranges of their ids, so that files, stripes and row groups hold id
ranges that readers can leave out. Stripes are small against a read split, so several tasks share a
file. Each row has its place among the tokens of its file; a manifest with one row for each file
(``_manifest`` beside the files) has the place of the file among all tokens, its ids and its count.

Defined results: a null or empty text has the end token alone. Rows with a null id come first;
rows of one id stand in the order of a hash of their text, and are spread over files if they are
many. Repeated rows are written each. An empty table gives files without rows.
Columns of ``docs`` other than id and text are not written.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogkit.llm.common import small_batches, small_side

# fixed values: how the tokenizer parts a text; marks that never join a letter or digit before them
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?"
# letters that lower-casing and composition treat one by one
ACCENTED = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
LETTERS = re.compile(f"[A-Za-z{''.join(ACCENTED)}]+")
MOST_KNOWN = 10_000_000  # characters of the words whose ids a Python worker remembers


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer makes white space blanks, lower-cases, and takes parts by ``PARTS``, so that the ids of a text
    are those of its words, one after the other."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, first = (spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    same = [n.get("type") for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
    parted = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"] == {"Regex": PARTS}
    return bool(same and parted) and not any(t["lstrip"] or t["rstrip"] or not t["content"].startswith("<") or re.search(r"[\s.,;:!?]", t["content"]) for t in spec["added_tokens"])


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str] | pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function texts -> (number of ids of each text, all ids).

    A tokenizer that splits at white space is asked once for each word; marks at the end of a word that ends in
    a letter or digit are a part of their own, and are asked apart. A worker forgets the words when they have many
    characters in all."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    encode = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    joined = lambda ids: np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
    if not splits_at_space(path):

        def plain(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
            ids = encode(texts if isinstance(texts, list) else texts.to_pylist())
            return np.array([len(x) for x in ids], np.int64), joined(ids)

        return plain
    model = whole.model  # a word of these letters is one part, which the model takes once it is lower-cased and its bytes are characters
    as_bytes = str.maketrans({c: "".join(x for x, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)) for c in ACCENTED})
    number: dict[str, int] = {}  # word -> its entry and, 32 bits below, that of the marks at its end
    entry: dict[str, int] = {}
    state: dict = {}

    def forget() -> None:
        number.clear()
        entry.clear()
        entry[""] = 0
        state.update(chars=0, starts=np.zeros(2, np.int64), ids=np.zeros(0, np.int32))

    def learn(words: list[str]) -> None:
        parts = []
        for w in words:
            base = w.rstrip(MARKS)
            apart = len(base) < len(w) and (LETTERS.fullmatch(base) or (base.isascii() and base[-1:].isalnum()))
            parts.append((base, w[len(base) :]) if apart else (w, ""))
        new = set(chain.from_iterable(parts)).difference(entry)
        plain = [x for x in new if LETTERS.fullmatch(x)]
        others = list(new.difference(plain))
        ids = [[t.id for t in model.tokenize(x.lower() if x.isascii() else x.lower().translate(as_bytes))] for x in plain] + encode(others)
        entry.update(zip(chain(plain, others), range(len(entry), len(entry) + len(new))))
        ends = state["starts"][-1] + np.cumsum(list(map(len, ids)), dtype=np.int64)
        state.update(chars=state["chars"] + sum(map(len, words)), starts=np.concatenate([state["starts"], ends]), ids=np.concatenate([state["ids"], joined(ids)]))
        number.update((w, entry[base] << 32 | entry[marks]) for w, (base, marks) in zip(words, parts))

    def by_words(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not state or state["chars"] > MOST_KNOWN:
            forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # lower case at once, but for texts that may name a special token
        low = pc.if_else(pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<"))), pc.ascii_lower(texts), texts)
        found = pc.ascii_split_whitespace(low)  # may give empty words, which have no ids
        coded = found.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in words if w not in number]:
            learn(new)
        both = np.fromiter(map(number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        at = np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).ravel()
        starts = state["starts"]
        n = starts[at + 1] - starts[at]
        into = np.cumsum(n) - n  # where the ids of each entry go
        ids = state["ids"][np.repeat(starts[at] - into, n) + np.arange(int(n.sum()))]
        upto = np.concatenate([[0], np.cumsum(n)])[2 * (found.offsets.to_numpy() - found.offsets[0].as_py()).astype(np.int64)]
        return np.diff(upto), ids

    return by_words


def with_end(n: np.ndarray, ids: np.ndarray, end: int) -> np.ndarray:
    """The ids with the end token after each text."""
    out = np.full(len(ids) + len(n), end, np.int32)
    own = np.ones(len(out), bool)
    own[np.cumsum(n + 1) - 1] = False
    out[own] = ids
    return out


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, stripe_bytes: int = 16 << 20, files: int | None = None) -> None:
    """Encode all texts and write them below ``path`` in ascending order of ``key``: columns
    ``key``, ``file_start`` (ids before it in its file), ``n_tokens`` and ``ids``.

    ``files``: how many; by default the shuffle partitions of the session."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumns({"__tie": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    order = (key, "__tie", "__row")  # the last spreads equal rows, any order of which is the same
    dealt = rows.repartitionByRange(*((files,) if files else ()), *order).sortWithinPartitions(*order).drop("__tie", "__row")
    schema = StructType([dealt.schema[key], *StructType.fromDDL("file_start long, n_tokens int, ids array<int>").fields])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoder(tokenizer), 0
        for b in batches:
            n, ids = encode(b.column(1))
            ids, n = with_end(n, ids, end), n + 1
            upto = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at + upto - n), pa.array(n.astype(np.int32)), lists], names=schema.names)
            at += int(upto[-1]) if len(upto) else 0

    made = dealt.mapInArrow(make, schema).write.option("maxRecordsPerFile", 0).option("compression", "zstd")
    made.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 1_000).option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", 0.01).orc(path)
    per_file = spark.read.orc(path).groupBy(F.col("_metadata.file_path").alias("file"), F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("number"))
    listed = per_file.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.min(key).alias("low"), F.max(key).alias("high"))
    start = F.sum("tokens").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")  # one row for each file, as the driver lists them too
    listed.withColumn("start", start).write.parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows: the id, ``start`` (ids of all rows before it), ``n_tokens`` and ``ids``."""
    rows = spark.read.orc(path)
    places = small_side(manifest(spark, path).select(F.col("file").alias("__file"), F.col("start").alias("__start")), 1_000_000)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__at")).join(places, F.col("__at") == F.col("__file"))
    return placed.select(rows.columns[0], (F.col("__start") + F.col("file_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some ids. The manifest leaves out files, ORC's indexes and Bloom filters leave out
    stripes and row groups."""
    wanted = F.array(*map(F.lit, ids))
    listed = manifest(spark, path).where(F.exists(wanted, lambda i: (i >= F.col("low")) & (i <= F.col("high")))).select("file").collect() if ids else []  # at most all files, which the driver lists anyway
    rows = spark.read.orc([r.file for r in listed]) if listed else spark.read.orc(path).limit(0)
    return rows.where(F.col(rows.columns[0]).isin(ids))


def with_crc32(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``: the crc32 of the ids as little-endian unsigned 32-bit integers."""
    small_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != "ids"]
    schema = rows.select(*others).schema.add("ids_crc32", "long")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(others))
            data, at = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B"), lists.offsets.to_pylist()
            crcs = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(crcs, pa.int64())], names=schema.names)

    return rows.select(*others, "ids").mapInArrow(make, schema)
