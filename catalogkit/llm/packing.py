"""Best-fit packing of documents into token sequences, with swap-based local search.

Documents become token ids; only those longer than a sequence are cut. Pieces are
dealt to groups of bounded size. Within a group they are packed by best fit in
descending length; then, while the free space could still empty a bin, pieces of all
underfull bins, the emptiest first, are moved, exchanged one for one, or two for one, into
others, each step increasing the sum of squared fills, until no step is left.

Defined results: a null or empty text is the end token alone. Repeated rows are packed
each. An empty table gives no rows. No piece is dropped or cut further.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogkit.llm.common import apply_in_pandas, map_in_pandas, small_batches, stored

PIECES = "piece int, start long, length long, ids_crc32 long"
PLACE = ("sequence_id", "offset")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function text -> ids, as the tokenizer file gives them.

    Where the same vocabulary is there as ranks, the quicker library does the work,
    except for texts that name a special token."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, FileNotFoundError):
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: whole.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else quick.encode_ordinary(text)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[Column, ...] = (), capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """``keep`` columns, then one row for each piece (and its token ids, if asked for). A ``keep``
    column named like a result (``pack``'s too) is replaced by it."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text")).drop("ids", *StructType.fromDDL(PIECES).names, *PLACE)
    names = rows.columns[:-1]
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(PIECES + ", ids array<int>" * with_ids).fields])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            at, made = [], []
            for i, t in enumerate(b["__text"]):
                ids = array("I", encode(t) if t else ())
                ids.append(end)
                data = memoryview(ids).cast("B")  # unsigned 32-bit; little-endian, as the machines are
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    made.append((k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), *([ids[start : start + n]] * with_ids)))
            found = pd.DataFrame(made, columns=schema.names[len(names) :])
            yield pd.concat([b[names].iloc[at].reset_index(drop=True), found], axis=1)

    return map_in_pandas(rows, make, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if some bin has room for exactly r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins


class Bins:
    """Bins with tables of the underfull ones by room and by the lengths that they hold (length 0:
    any). Lengths are at most the capacity, so the tables cover every piece and pair exactly."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
        self.capacity, self.size = capacity, lengths.tolist()
        self.held: list[dict[int, list[int]]] = [{} for _ in bins]
        for own, b in zip(self.held, bins):
            for p in b:
                own.setdefault(self.size[p], []).append(p)
        self.fill = [sum(self.size[p] for p in b) for b in bins]
        self.found: dict[int, set[int]] = {}  # length * (capacity + 1) + room -> bins
        self.live = np.zeros(0, np.int64)  # the keys of ``found`` with bins, in order

    def show(self, b: int, on: bool) -> None:
        """Put an underfull bin into the tables, or take it out."""
        room = self.capacity - self.fill[b]
        for n in (0, *self.held[b]) if 0 < room < self.capacity else ():
            at = n * (self.capacity + 1) + room
            there = self.found.setdefault(at, set())
            before = bool(there)
            (there.add if on else there.discard)(b)
            if before != bool(there):
                place = int(np.searchsorted(self.live, at))
                self.live = np.insert(self.live, place, at) if on else np.delete(self.live, place)

    def step(self, s: int) -> tuple[tuple[int, ...], int, int] | None:
        """The step from bin s (not in the tables) that raises the sum of squared fills most:
        lengths of the one or two pieces to give, the bin, and the length to take (0: none)."""
        own = sorted(self.held[s])
        out = {n + m: (n, m) for i, n in enumerate(own) for m in own[i:] if n != m or len(self.held[s][n]) > 1} | {n: (n,) for n in own}
        most = np.zeros(2 * self.capacity + 1, np.int64)  # the largest sum up to each number
        sums = np.array(list(out))
        most[sums] = sums
        most = np.maximum.accumulate(most)
        at = self.live
        back, room = np.divmod(at, self.capacity + 1)
        grown = most[back + room] - back  # for one length and room the largest sum gains most
        gain = np.where(grown > 0, grown * (self.capacity - room - self.fill[s] + grown), 0)
        k = int(np.argmax(gain)) if len(gain) else -1
        if k < 0 or gain[k] <= 0:
            return None
        return out[int(back[k] + grown[k])], next(iter(self.found[int(at[k])])), int(back[k])

    def move(self, s: int, t: int, n: int) -> None:
        own = self.held[s][n]
        self.held[t].setdefault(n, []).append(own.pop())
        if not own:
            del self.held[s][n]
        self.fill[s] -= n
        self.fill[t] += n


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that increase the sum of squared fills.

    A bin gives one or two pieces and takes none or one back. Stops when the free space is less
    than a bin, which no packing could save, or when a whole pass over all underfull bins, the
    emptiest first, brings no gain."""
    slack = len(bins) * capacity - int(lengths.sum())
    if slack < capacity:
        return bins
    state, gained = Bins(bins, lengths, capacity), True
    fill = state.fill
    for b in range(len(bins)):
        state.show(b, True)
    while gained and slack >= capacity:
        gained = False
        for s in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__):
            if slack < capacity:
                break
            state.show(s, False)
            while 0 < fill[s] < capacity and (best := state.step(s)):
                gained = True
                out, t, back = best
                state.show(t, False)
                for n in out:
                    state.move(s, t, n)
                if back:
                    state.move(t, s, back)
                state.show(t, True)
            state.show(s, True)
            slack -= capacity * (fill[s] == 0)
    return [[p for ps in own.values() for p in ps] for own in state.held if own]


def pack(rows: DataFrame, length: str = "length", capacity: int = 1024, per_group: int = 200_000) -> DataFrame:
    """All columns of ``rows`` (pieces), then ``sequence_id`` and ``offset`` (columns that had
    these names are replaced)."""
    rows = stored(rows.drop(*PLACE))
    groups = max(1, math.ceil(rows.count() / per_group))
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # by its place in the stored table, so that equal rows are spread
    schema = StructType(rows.schema.fields).add("sequence_id", "long").add("offset", "long")

    def one(b: pd.DataFrame) -> pd.DataFrame:
        lengths = b[length].to_numpy(np.int64)
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        number, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = k, at
                at += lengths[i]
        return b.assign(sequence_id=number * groups + b["__group"], offset=offset).drop(columns="__group")

    return apply_in_pandas(dealt.groupBy("__group"), one, schema)
