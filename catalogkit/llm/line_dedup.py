"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its number of tokens and its ``depth`` leading tokens (a token with
a digit counts as a variable field, unless most of the line's tokens have one). Below such a leaf, a line has its full template and
generalised ones: the other tokens are cut into four parts, of which two are kept and
two become variable fields, so that lines with one template agree in at least half of
their tokens. Templates are counted over all documents by key (128 bits of a hash of the
template), with map-side combining; no leaf is ever gathered. A line is dropped if a template of it recurs in ``min_docs``
documents or more and this is not the first of them (the smallest identifier), so that
one copy of every line stays.

With ``wide``, lines of fewer than ``min_tokens`` tokens count in full, and more tokens are
generalised (``wide_keys``); with ``exact_docs``, whole lines of ``min_tokens`` tokens or more
recur in that many documents already. Without them the results are those of ``oracle``.

The recurring templates of the most documents are sent to the tasks, ``max_sent`` at most. Of the others a bit map of
fixed size tells which keys of a line may be among them; only these keys are joined with them, none of which
many documents hold.

Defined results: a null text counts as empty (one blank line). Blank lines and (unless
``wide``) lines of fewer than ``min_tokens`` tokens stay. Each row counts as a document; rows equal in
identifier and text get equal results; rows without an identifier come last, in the order of a hash of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogkit.llm.collocations import bit_map, is_set
from catalogkit.llm.common import SPACE, map_in_pandas, small_batches, stored

FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
PARTS = 4
FILTER_BITS = 26  # 8 MB
_FIELD, _DIGIT = re.compile(FIELD.encode()), re.compile(b"[0-9]")


def parsed(line: bytes) -> list[bytes]:
    """The tokens of a line, with variable fields for those that have a digit."""
    tokens = line.split()
    if _DIGIT.search(line):
        fields = _FIELD.sub(b"<*>", line).split()
        tokens = fields if 2 * fields.count(b"<*>") <= len(fields) else tokens
    return tokens


def template_keys(line: bytes, depth: int, min_tokens: int) -> list[bytes]:
    """The keys of a line's templates: full, then with two of four parts."""
    tokens = parsed(line)
    n, rest = len(tokens), len(tokens) - depth
    if n < min_tokens:
        return []
    keys = [xxhash.xxh3_128_digest(b"full " + b" ".join(tokens))]
    if rest >= PARTS:
        bound = [depth + rest * k // PARTS for k in range(PARTS + 1)]
        part = [b" ".join(tokens[bound[k] : bound[k + 1]]) for k in range(PARTS)]
        leaf = b"%d %s" % (n, b" ".join(tokens[:depth]))
        keys += [xxhash.xxh3_128_digest(b"%d %s / %s / %s" % (i * PARTS + j, leaf, part[i], part[j])) for i in range(PARTS) for j in range(i + 1, PARTS)]
    return keys


def wide_keys(line: bytes, depth: int, min_tokens: int) -> list[bytes]:
    """Further keys: lines of fewer than ``min_tokens`` tokens in full, short lines and leading
    tokens with one token left out, longer lines with three of four parts left out."""
    tokens = parsed(line)
    n, rest = len(tokens), len(tokens) - depth
    if n < min_tokens:
        return [xxhash.xxh3_128_digest(b"full " + b" ".join(tokens))] if n else []
    some = range(n if rest < PARTS else depth) if n > 1 else ()
    keys = [xxhash.xxh3_128_digest(b"out %d %d %s / %s" % (k, n, b" ".join(tokens[:k]), b" ".join(tokens[k + 1 :]))) for k in some]
    if rest >= PARTS:
        bound = [depth + rest * k // PARTS for k in range(PARTS + 1)]
        keys += [xxhash.xxh3_128_digest(b"part %d %d %s / %s" % (k, n, b" ".join(tokens[:depth]), b" ".join(tokens[bound[k] : bound[k + 1]]))) for k in range(PARTS)]
    return keys


def text_keys(text: str, depth: int, min_tokens: int, wide: bool = False, exact: bool = False) -> tuple[list[bytes], list[int]]:
    """Keys of all lines of a text, and the number of the line of each. With ``exact`` a byte
    tells the keys of whole lines, fields included, from those of templates."""
    keys, at = [], []
    for i, line in enumerate(text.encode("utf-8", "replace").split(b"\n")):
        own = template_keys(line, depth, min_tokens)
        if wide:
            own += wide_keys(line, depth, min_tokens)
        if exact:
            own = [k[:8] + b"\0" + k[9:] for k in own]
            tokens = line.split()
            if tokens and len(tokens) >= min_tokens:
                k = xxhash.xxh3_128_digest(b"line " + b" ".join(tokens))
                own.append(k[:8] + b"\1" + k[9:])
        keys += own
        at += [i] * len(own)
    return keys, at


def as_longs(keys: Iterable[bytes]) -> np.ndarray:
    """Both halves of each key, in a row each."""
    return np.ascontiguousarray(np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T)


def find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among known ones, which are sorted; -1 for those not there."""
    low, high = (np.searchsorted(known[0], keys[0], side) for side in ("left", "right"))
    at = np.full(len(low), -1)
    for step in range((high - low).max(initial=0)):
        here = np.minimum(low + step, len(known[0]) - 1)
        at = np.where((low + step < high) & (known[1][here] == keys[1]), here, at)
    return at


def placed(doc_id: str, text: str) -> tuple[Column, Column]:
    """Whether a row has no identifier, and its identifier, or a hash of its text in place of it: the order of documents."""
    return F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def recurring_templates(docs: DataFrame, doc_id: str, text: str, depth: int, min_docs: int, min_tokens: int, wide: bool = False, exact_docs: int | None = None) -> DataFrame:
    """``k0``, ``k1`` (halves of the key), ``unnamed``, ``first``, ``n`` (documents): templates in ``min_docs`` documents or more (whole lines in
    ``exact_docs``), and the first one (see ``placed``)."""
    how = (depth, min_tokens, wide, exact_docs is not None)
    least = F.lit(min_docs) if exact_docs is None else F.when(F.col("k1").bitwiseAND(F.lit(255)) == 1, exact_docs).otherwise(min_docs)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [set(text_keys(t or "", *how)[0]) for t in b["t"]]
            k0, k1 = as_longs(chain.from_iterable(own))
            n = [len(x) for x in own]
            yield pd.DataFrame({"k0": k0, "k1": k1, "unnamed": np.repeat(b["unnamed"].to_numpy(bool), n), "id": np.repeat(b["id"].to_numpy(np.int64), n)})

    unnamed, rank = placed(doc_id, text)
    rows = docs.select(unnamed.alias("unnamed"), rank.alias("id"), F.col(text).alias("t"))
    # identifiers and stand-ins apart, so that the sums are of plain numbers
    own, other = F.min(F.when(~F.col("unnamed"), F.col("id"))), F.min(F.when(F.col("unnamed"), F.col("id")))
    counted = rows.mapInPandas(parse, "k0 long, k1 long, unnamed boolean, id long").groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"), own.alias("own"), other.alias("other"))
    return stored(counted.where(F.col("n") >= least).select("k0", "k1", F.col("own").isNull().alias("unnamed"), F.coalesce("own", "other").alias("first"), "n"))


def sent_from(recurring: DataFrame, max_sent: int) -> int:
    """The least power of two so that ``max_sent`` templates or fewer are in so many documents."""
    count = {r.p: r["count"] for r in recurring.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()}
    least, total = 1 << 62, 0
    for p in sorted(count, reverse=True):
        total += count[p]
        if total > max_sent:
            return least
        least = 1 << p
    return 1


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 3, min_docs: int = 5, min_tokens: int = 3, max_sent: int = 2_000_000, wide: bool = False, exact_docs: int | None = None) -> DataFrame:
    """All columns with the text less its dropped lines, then ``n_lines`` and ``n_dropped``
    (columns that had these names are replaced)."""
    small_batches(docs.sparkSession)
    how = (depth, min_tokens, wide, exact_docs is not None)
    recurring = recurring_templates(docs, doc_id, text, depth, min_docs, min_tokens, wide, exact_docs)
    unnamed, rank = placed(doc_id, text)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*(F.col(c).alias(f"col_{c}") for c in others), unnamed.alias("__unnamed"), rank.alias("__id"))
    schema = StructType([*rows.schema.fields[:-2], *StructType.fromDDL("n_lines int, n_dropped int").fields])
    column = f"col_{text}"

    def cut(b: pd.DataFrame, gone: list[set[int]]) -> pd.DataFrame:
        lines = [(t or "").split("\n") for t in b[column]]
        left = [t if not g else "\n".join(x for i, x in enumerate(ls) if i not in g) for t, ls, g in zip(b[column], lines, gone)]
        return b.assign(**{column: left}, n_lines=[len(x) for x in lines], n_dropped=[len(g) for g in gone])[schema.names]

    least = sent_from(recurring, max_sent)
    known = recurring.where(F.col("n") >= least).drop("n").toPandas().sort_values(["k0", "k1"])  # max_sent rows at most
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(known.to_numpy(np.int64).T))
    rest = recurring.where(F.col("n") < least)
    few = rest.isEmpty()
    if not few:
        bits = docs.sparkSession.sparkContext.broadcast(bit_map(rest.select(F.col("k0").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("cell")), FILTER_BITS))

        def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = []
                for t, none, own, h in zip(b["t"], b["none"], b["id"], b["h"]):
                    keys, at = text_keys(t or "", *how)
                    k0, k1 = as_longs(keys)
                    hit = is_set(bits.value, k0 & ((1 << FILTER_BITS) - 1))
                    if hit.any():
                        made.append(pd.DataFrame({"k0": k0[hit], "k1": k1[hit], "line": np.array(at, np.int64)[hit], "none": none, "id": own, "h": h}))
                if made:
                    yield pd.concat(made)

        hashed = F.xxhash64(F.coalesce(F.col(column), F.lit("")))
        lines = rows.select(F.col("__unnamed").alias("none"), F.col("__id").alias("id"), F.col(column).alias("t"), hashed.alias("h")).mapInPandas(likely, "k0 long, k1 long, line long, none boolean, id long, h long")
        dropped = lines.join(rest, ["k0", "k1"]).where("id <> first or none <> unnamed").groupBy("none", "id", "h").agg(F.collect_set("line").alias("__gone"))
        rows = rows.withColumn("__h", hashed).join(dropped, (F.col("__unnamed") == F.col("none")) & (F.col("__id") == F.col("id")) & (F.col("__h") == F.col("h")), "left").drop("none", "id", "h", "__h")

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, unnamed, first = sent.value[:2], sent.value[2] == 1, sent.value[3]
        for b in batches:
            gone = []
            for t, none, own, more in zip(b[column], b["__unnamed"], b["__id"], [None] * len(b) if few else b["__gone"]):
                keys, at = text_keys(t or "", *how)
                found = find(known, as_longs(keys))
                gone.append({at[i] for i in np.flatnonzero(found >= 0) if first[found[i]] != own or unnamed[found[i]] != none} | (set() if more is None else set(more.tolist())))
            yield cut(b, gone)

    out = map_in_pandas(rows, drop, schema)
    return out.select(*(F.col(f"col_{c}").alias(c) for c in others), "n_lines", "n_dropped")


def oracle(depth: int = 3, min_docs: int = 5, min_tokens: int = 3) -> str:
    """The same in DuckDB SQL, with the templates themselves as keys."""
    b = [f"({depth} + (len(t) - {depth}) * {k} // {PARTS})" for k in range(PARTS + 1)]
    part = [f"list_slice(t, {b[k]} + 1, {b[k + 1]})" for k in range(PARTS)]
    some = ", ".join(f"concat('{i * PARTS + j} ', len(t), ' ', array_to_string(list_slice(t, 1, {depth}), ' '), ' / ', array_to_string({part[i]}, ' '), ' / ', array_to_string({part[j]}, ' '))" for i in range(PARTS) for j in range(i + 1, PARTS))
    return rf"""
    WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) no FROM documents),
    m AS (SELECT doc_id, no, line, list_filter(string_split_regex(line, '{SPACE}'), lambda x: x <> '') raw, list_filter(string_split_regex(regexp_replace(line, '{FIELD}', '<*>', 'g'), '{SPACE}'), lambda x: x <> '') masked FROM l),
    p AS (SELECT doc_id, no, line, CASE WHEN 2 * len(list_filter(masked, lambda x: x = '<*>')) <= len(masked) THEN masked ELSE raw END t FROM m),
    k AS (SELECT doc_id, no, line, CASE WHEN len(t) < {min_tokens} THEN [] WHEN len(t) - {depth} < {PARTS} THEN [concat('full ', array_to_string(t, ' '))]
          ELSE [concat('full ', array_to_string(t, ' ')), {some}] END ks FROM p),
    u AS (SELECT doc_id, no, unnest(ks) tk FROM k),
    r AS (SELECT tk, min(doc_id) first_id FROM u GROUP BY tk HAVING count(DISTINCT doc_id) >= {min_docs}),
    g AS (SELECT DISTINCT u.doc_id, u.no FROM u JOIN r ON u.tk = r.tk WHERE u.doc_id <> r.first_id)
    SELECT k.doc_id, CAST(count(*) AS BIGINT) n_lines, CAST(count(g.no) AS BIGINT) n_dropped,
           sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.no) FILTER (g.no IS NULL), '')) kept_sha256
    FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.no = g.no GROUP BY k.doc_id"""
