"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each document's set of word shingles is hashed once; its k smallest hashes are its
   sketch. Documents with equal sets form a class and go on as one node.
2. Inverted lists of retained values. The values of a sketch are put into one global order,
   rare ones first, and a node is listed under each ``RUN`` of them that stand next to each
   other: similar sets agree in most of the order, while others that happen to share a
   frequent value do not meet. Where sketches hold whole sets this finds every pair asked
   for (see ``runs`` and ``listed_values``); among the first ``LISTED`` values of longer ones it
   fails with a chance of about 2e-8 at a similarity of 0.8, if own values fall at random places
   of the order. What rare means comes from counts by hash in a table of fixed size. Lists
   with the same members count as one.
3. Overlaps are counted inside tasks, which get the members of a list with their sketches
   (``overlaps``: inverted lists again, of single values). The sketch of the union estimates
   each pair's similarity; pairs far below 0.8 are left out. A task gives out who hangs
   together, one row for each member, and never a pair.
4. What hangs together by estimate is a canopy; every similar pair lies within one. A
   canopy's members meet in a task with their whole texts, once each, and overlaps of the
   full sets confirm who is linked.

Groups beyond ``capacity`` are dealt to blocks that share some members (``joined``), which connects a group of
copies at the cost of its members. Where parts of a list are then still apart, its members are listed
anew under single values, the rarest first, as many as a similar set may have own ones and one more (``first_values``):
unlike members that have met under frequent values part, similar ones meet. Only in such a list beyond ``capacity``
do the blocks of the smaller parts meet the others.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing; a text of fewer words than a shingle has its words as the only one. Rows that
share an identifier are one document, in one component whatever their texts; a null identifier is linked with nothing. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import chunks, distinct, free, map_in_pandas, small_batches, stored
from catalogkit.llm.components import components
from catalogkit.llm.substring_dedup import WordHasher, rolling, split_words

K, LISTED, RUN, SHARED = 64, 44, 3, 32
COUNTERS = 1 << 18
SLICE = 1 << 20
#: Members of a list, and shingles of a canopy, that one task compares at once.
MEMBERS, SHINGLES = 2_048, 1 << 20
#: Values with more holders than this in a batch of tasks are counted by a matrix product.
HEAVY = 24
_BASE = 0x5851F42D4C957F2D
_TOP = np.uint64(32)


def shingle_sets(texts: list[str | None], n: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles (A-Z lower-cased)."""
    for at in chunks([t or "" for t in texts], SLICE):
        data, starts, ends, begin = split_words([(texts[i] or "").encode("utf-8", "replace").lower() for i in at])
        words = hasher(data, starts, ends)
        shingles = rolling(words, n)
        for a, b in zip(begin[:-1], begin[1:]):
            if b - a >= n:
                yield distinct(shingles[a : b - n + 1])
            else:
                yield rolling(words[a:b], b - a) if b > a else shingles[:0]


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, k: int = K) -> DataFrame:
    """``id``, ``n`` (set size), a 128-bit digest of the whole set, and its sketch (the upper
    32 bits of the k smallest hashes: equal ones by chance only make a pair look closer)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(_BASE)
        for b in batches:
            sets = [(len(s), xxhash.xxh128_digest(s.tobytes()), (s[:k] >> _TOP).astype(np.uint32).tobytes()) for s in shingle_sets(b["t"].tolist(), n, hasher)]
            yield pd.DataFrame({"id": b["id"], "n": [s[0] for s in sets], "digest": [s[1] for s in sets], "sketch": [s[2] for s in sets]})

    return map_in_pandas(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")), sketch, "id long, n long, digest binary, sketch binary")


def with_digest(docs: DataFrame, name: str, text: str = "text", n: int = 5) -> DataFrame:
    """All columns of ``docs`` and the digest of the set of shingles (null if it is empty)."""
    schema = docs.select("*", F.lit(None).cast("binary").alias(name)).schema

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(_BASE)
        for b in batches:
            yield b.assign(**{name: [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in shingle_sets(b[text].tolist(), n, hasher)]})

    return map_in_pandas(docs, add, schema)


def unsure(run: int, similarity: float) -> float:
    """Up to how many common values two sets may have no ``run`` of them in sequence.

    With i common values there are at most i * (1 - similarity) / similarity own ones of either
    set, which cut the order into one part more; parts of run - 1 each hold the most."""
    return (run - 1) / (1 - (run - 1) * (1 - similarity) / similarity)


def runs(n: int, similarity: float) -> list[int]:
    """The lengths of run under which a set of n values is listed: the longest that is sure
    for large sets, and shorter ones where n is too small for it."""
    longest = max(r for r in range(1, RUN + 1) if (r - 1) * (1 - similarity) < similarity - 1e-9)
    return [r for r in range(longest, 0, -1) if r == longest or n * similarity <= unsure(r + 1, similarity) + 1e-9]


def listed_values(n: int, run: int, similarity: float) -> int:
    """How many of n values, in order, hold a run that a similar set has as a run too.

    Before the first one, x own values of this set and y of the other part the common ones into
    parts of run - 1 at most; so it ends at place run * (x + 1) + (run - 1) * y at most, which is
    largest if all own values are in this set."""
    return math.floor(run * (1 - similarity) * n + 1e-9) + run


def rarity(nodes: DataFrame):
    """Counts of the values by hash, sent to all tasks: the global order puts rare values first."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["sketch"]), np.uint32) % COUNTERS, minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    counts = np.zeros(COUNTERS, np.int64)
    found = nodes.select("sketch").mapInPandas(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[found["slot"]] = found["n"]
    return nodes.sparkSession.sparkContext.broadcast(counts)


def listed(nodes: DataFrame, similarity: float, counts, k: int = K, choose: Callable[[np.ndarray, int], list[np.ndarray]] | None = None) -> DataFrame:
    """``value``, ``node``: each node under the runs of values in the order of its sketch, or under what ``choose``
    takes of its values in this order."""

    def take_runs(x: np.ndarray, n: int) -> list[np.ndarray]:
        whole = n <= similarity * k  # beyond this size a similar set may be larger than a sketch
        return [rolling(x[: listed_values(n, r, similarity) if whole else LISTED], r) for r in runs(n, similarity)]

    take = choose or take_runs

    def list_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = []
            for data, n in zip(b["sketch"], b["n"]):
                x = np.frombuffer(data, np.uint32)
                x = x[np.lexsort((x, counts.value[x % COUNTERS]))].astype(np.uint64)
                values.append(np.concatenate(take(x, n)).view(np.int64))
            if values:
                yield pd.DataFrame({"value": np.concatenate(values), "node": np.repeat(b["node"].to_numpy(), [len(v) for v in values])})

    return nodes.select("node", "n", "sketch").mapInPandas(list_nodes, "value long, node long")


def first_values(similarity: float, k: int = K) -> Callable[[np.ndarray, int], list[np.ndarray]]:
    """The first values of a sketch, of which similar sets share one at least: the first common value in the order
    comes after own values only, of which a whole set of n has (1 - similarity) * n at most; of a sketch
    of k, six standard deviations more than that share."""
    own = (1 - similarity) * k + 6 * math.sqrt(k * similarity * (1 - similarity))
    return lambda x, n: [x[: math.floor((1 - similarity) * n + 1e-9) + 1 if n <= similarity * k else math.ceil(own) + 1]]


def distinct_lists(lists: DataFrame) -> DataFrame:
    """``group``, ``node``, ``weight`` (1) and ``total``: the lists of several nodes, each set of members once."""
    lists = lists.repartition("value")  # dealt once for the counts and for the members
    h = F.xxhash64("node")
    counted = lists.groupBy("value").agg(F.count(F.lit(1)).alias("total"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 8)).alias("y"))
    own = ("total", "low", "high", "x", "y")
    kept = counted.where("low < high").groupBy(*own).agg(F.min("value").alias("value"))
    return lists.join(kept.select("value", "total"), "value").select(F.col("value").alias("group"), "node", F.lit(1).alias("weight"), "total")


def overlaps(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i < j and how many values they share, for all pairs of n rows that share some.

    ``values`` belong to ``row``, which is sorted. The holders of each value are its inverted list;
    short lists count by shifts, long ones by products of row x value matrices."""
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(values)))
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = (size > 1) & (size <= HEAVY)
    start, size, heavy = start[short], size[short], (start[size > HEAVY], size[size > HEAVY])
    place, left = np.repeat(start, size) + _within(size), np.repeat(size, size) - _within(size)
    for shift in range(1, int(size.max(initial=1))):
        at = place[left > shift]
        codes.append(row[at].astype(np.int64) * n + row[at + shift])
        counts.append(np.ones(len(at), np.int64))
    if len(heavy[0]):
        holders = row[np.repeat(heavy[0], heavy[1]) + _within(heavy[1])]
        column = np.repeat(np.arange(len(heavy[0])), heavy[1])
        some, at = np.unique(holders, return_inverse=True)
        shared = np.zeros((len(some), len(some)), np.float32)
        for c in range(0, len(heavy[0]), 4096):
            there = (column >= c) & (column < c + 4096)
            m = np.zeros((len(some), min(4096, len(heavy[0]) - c)), np.float32)
            m[at[there], column[there] - c] = 1
            shared += m @ m.T
        i, j = np.nonzero(np.triu(shared, 1))
        codes.append(some[i].astype(np.int64) * n + some[j])
        counts.append(shared[i, j].astype(np.int64))
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
    i, j = np.divmod(code, n) if n else (code, code)
    return i[i < j], j[i < j], total[i < j]


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the given sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def hanging(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs i, j connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that no (``group``, ``block``), which come in sequence, is parted."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        same = (b["group"] == b["group"].iloc[-1]) & (b["block"] == b["block"].iloc[-1])
        first = int(np.argmax(same.to_numpy()))
        if first or (held and (held[-1]["group"].iloc[-1], held[-1]["block"].iloc[-1]) != (b["group"].iloc[0], b["block"].iloc[0])):
            yield pd.concat([*held, b.iloc[:first]], ignore_index=True)
            held = []
        held.append(b.iloc[first:])
    if held:
        yield pd.concat(held, ignore_index=True)


def similar(compare: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task: rows of some groups -> ``a``, ``b``, a row of a group and the first it hangs together with.
    ``compare`` gets the rows and their group's number and returns pairs of rows."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches):
            changed = (b["group"].diff().ne(0) | b["block"].diff().ne(0)).to_numpy()
            i, j = compare(b, np.cumsum(changed))
            apart = (b["root"].to_numpy()[i] != b["root"].to_numpy()[j])
            label, node = hanging(len(b), i[apart], j[apart]), b["node"].to_numpy()
            other = label != np.arange(len(b))
            yield pd.DataFrame({"a": node[other], "b": node[label[other]]})

    return task


def by_estimate(similarity: float, k: int = K):
    """Pairs whose sketches overlap enough: by the share of the values up to the smaller of both
    ends that both hold, six standard deviations below ``similarity`` at least; where both
    sketches hold whole sets, ``similarity`` itself."""

    def compare(b: pd.DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) // 4 for x in b["sketch"]], np.int64)
        values, row = np.frombuffer(b"".join(b["sketch"]), np.uint32).astype(np.uint64), np.repeat(np.arange(len(b)), size)
        i, j, shared = overlaps((group.astype(np.uint64)[row] << _TOP) | values, row, len(b))
        n, begin = b["n"].to_numpy(), np.cumsum(size) - size
        placed = (row.astype(np.uint64) << _TOP) | values
        end = np.where(n > k, values[begin + size - 1], np.uint64(0xFFFFFFFF))
        both = np.minimum(end[i], end[j])
        union = sum(np.searchsorted(placed, (x.astype(np.uint64) << _TOP) | both, side="right") - begin[x] for x in (i, j)) - shared
        whole = (n[i] <= k) & (n[j] <= k)
        floor = np.where(whole, similarity, similarity - 6 * np.sqrt(similarity * (1 - similarity) / np.maximum(union, 1)))
        likely = (shared >= floor * union - 1e-9) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        return i[likely], j[likely]

    return similar(compare)


def by_full_sets(n: int, similarity: float):
    """Pairs of texts whose full sets of shingles are similar enough."""
    p = round(100 * similarity)

    def compare(b: pd.DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = list(shingle_sets(b["t"].tolist(), n, WordHasher(_BASE)))
        size = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(b)), size)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        i, j, shared = overlaps(group[row].astype(np.int64) << 32 | code, row, len(b))
        same = 100 * shared >= p * (size[i] + size[j] - shared)
        return i[same], j[same]

    return similar(compare)


def joined(members: DataFrame, data: DataFrame, task: Callable, capacity: int, split: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """``node``, ``root``: what ``task`` connects of the ``members`` (``group``, ``node``, ``weight``,
    ``total`` weight of the group) with their ``data`` (``node``, ...), and what is ``known`` (``node``, ``root``).

    Groups heavier than ``capacity`` are dealt to blocks by a hash of the node; about ``SHARED``
    members come to every block, which connects the parts of a group of copies. Groups
    that are then in several parts go on. With ``split`` (nodes -> ``value``, ``node``) they are listed
    anew, each member under further values of which similar ones share one at least, so that members
    that are not alike part. Without it, blocks of members outside the largest part meet
    each other and those of the largest part, whose members do not meet again."""

    def links(rows: DataFrame) -> DataFrame:
        dealt = rows.join(data, "node").repartition("group", "block").sortWithinPartitions("group", "block", "node")
        return stored(dealt.mapInPandas(task, "a long, b long").distinct())

    def blocks(weight: str, most: int, seed: int):
        n = F.ceil(F.col(weight) / F.lit(most)).cast("long")
        return n, F.pmod(F.xxhash64("node", F.lit(seed)), n)

    if known is None:
        members = stored(members.withColumn("root", F.col("node")))
        before = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    else:  # groups within one part have nothing to find
        placed = members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = placed.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("group")
        members = stored(placed.join(several, "group", "left_semi"))
        before = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
    n, own = blocks("total", capacity, 0)
    common = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("total") / F.col("weight") / SHARED))) == 0
    large = members.where(F.col("total") > capacity)
    rows = members.where(F.col("total") <= capacity).select("group", F.lit(0).cast("long").alias("block"), "node", "root")
    dealt = large.select("group", F.explode(F.when(common, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array(own))).alias("block"), "node", "root")
    first = links(rows.unionByName(dealt))
    roots = components(first.unionByName(before))
    placed = large.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("group", "root").agg(F.sum("weight").alias("part"))
    parts = parts.groupBy("group").agg(F.sum("part").alias("all"), F.max(F.struct("part", "root")).alias("main")).where("main.part < all")
    parts = parts.select("group", F.col("main.root").alias("main"), F.col("main.part").alias("inside"), (F.col("all") - F.col("main.part")).alias("outside"))
    apart = stored(placed.join(parts, "group"))
    if apart.isEmpty():
        free(first, members, apart)
        return roots
    if split:
        again = apart.select("group", "node").join(split(apart.select("node").distinct()), "node")
        lists = again.select(F.xxhash64("group", "value").alias("value"), "node")  # lists of one hash only meet more
        connected = joined(distinct_lists(lists), data, task, capacity, known=roots)
        free(first, members, apart)
        return connected
    (outer, at), (inner, place) = blocks("outside", capacity // 2, 2), blocks("inside", capacity // 2, 3)
    width = outer + inner
    upto, start = (lambda a, b: F.sequence(a, b)), F.lit(0).cast("long")
    meet_outer = F.transform(upto(start, outer - 1), lambda x: F.least(x, at) * width + F.greatest(x, at))
    meet_inner = F.transform(upto(outer, width - 1), lambda x: at * width + x)
    meets = F.when(F.col("root") == F.col("main"), F.transform(upto(start, outer - 1), lambda x: x * width + outer + place)).otherwise(F.concat(meet_outer, meet_inner))
    second = links(apart.select("group", F.explode(meets).alias("block"), "node", "root"))
    connected = components(second.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    free(first, second, members, apart)
    return connected


def by_identifier(made: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``named`` (``digest``, ``component``) with the components of rows that share an identifier made one, and the
    component of each identifier whose rows have different sets (None: there is none)."""
    differ = made.where("id is not null").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("id")
    shared = stored(made.where("n > 0").join(differ, "id", "left_semi").select("id", "digest"))
    if shared.isEmpty():
        free(shared)
        return named, None
    rows = shared.join(named, "digest")
    low = rows.groupBy("id").agg(F.min("component").alias("low"))
    again = components(rows.join(low, "id").select(F.col("component").alias("a"), F.col("low").alias("b")))
    named = named.join(again, F.col("component") == F.col("node"), "left").select("digest", F.coalesce("root", "component").alias("component"))
    return named, shared.join(named, "digest").groupBy("id").agg(F.min("component").alias("own"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, k: int = K, most: tuple[int, int] = (MEMBERS, SHINGLES)) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (smallest identifier reachable) and ``digest`` of the
    set (null if it is empty) for every row. ``most``: what a task compares at once."""
    small_batches(docs.sparkSession)
    made = stored(sketches(docs, doc_id, text, n, k))
    valid = made.where("id is not null and n > 0")
    nodes = stored(valid.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    counts = rarity(nodes)
    split = lambda some: listed(nodes.join(some, "node", "left_semi"), similarity, counts, k, first_values(similarity, k)).distinct()
    likely = joined(distinct_lists(listed(nodes, similarity, counts, k)), nodes.select("node", "n", "sketch"), by_estimate(similarity, k), most[0], split)
    canopies = likely.select("node", F.col("root").alias("group")).join(nodes.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    canopies = stored(canopies.join(canopies.groupBy("group").agg(F.sum("weight").alias("total")), "group"))
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("t")).join(canopies.select("node"), "node", "left_semi")
    texts = texts.groupBy("node", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t")).drop("h")  # repeated rows once
    roots = joined(canopies, texts, by_full_sets(n, similarity), most[1])
    free(canopies)

    named = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    named, owned = by_identifier(made, named)
    out = made.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    out = out.withColumn("own", F.lit(None).cast("long")) if owned is None else out.join(owned, "id", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("own", "component", "id")).alias("component_id"), "digest")
