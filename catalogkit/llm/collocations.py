"""Phrase collocations: counts of all phrases of two to four words from sorted suffix pointers.

A suffix is the words from one place on, at most four and within its piece of text. The frequent leading
words and leading pairs are counted first; a suffix ends before its first infrequent pair, as no frequent
phrase goes on there. Suffixes are counted within a task, then routed by their two leading words (three
where the pair is hot), so that all that share them meet. There a multikey three-way quicksort parts
the suffix pointers by the word at one depth into smaller, equal and larger; the equal part holds all
places of one phrase, so its size is the count, and it is parted on at the next depth up to four words. Parts with fewer
places than a candidate needs are abandoned.

Words go as 64-bit hashes of language and word, which are checked against all distinct words: if two share
a hash, another seed is taken. Filters of frequent words and pairs are bit maps of fixed size; what
they let pass by chance is counted and falls then.

Defined results: a null or empty text has no words. A null language is ``und``. Equal rows count each. An
empty table, or one without frequent phrases, gives no rows. Columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogkit.llm.common import ascii_lower, distinct, free, small_batches, stored

DEPTH = 4
CHUNK = 2_000_000  # places that a task holds at once; words of one chunk are numbered in 21 bits
WORD_BITS, PAIR_BITS = 26, 27  # of the filters: 8 and 16 MB
HOT = 2_000  # a word, pair or phrase is hot with more than one of so many places: so there are no more of them
BREAK, EMPTY = 0, 1  # codes of what stands between pieces
CODES = [f"c{i + 1}" for i in range(DEPTH)]
SUFFIX = f"route long, deep boolean, {', '.join(f'{c} long' for c in CODES)}, n long"


def tokens(text: Column) -> Column:
    """Words and line feeds, which stand for the ends of pieces (one at the end of the text too); may hold empty strings."""
    marked = F.translate(ascii_lower(F.coalesce(text, F.lit(""))), ".,;:!?\x0b\x0c\r", "\n" * 9)
    return F.split(F.replace(F.concat(marked, F.lit("\n")), F.lit("\n"), F.lit(" \n ")), "[ \t]+")


def code(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(word, lang, F.lit(seed))


def counted_words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(tokens(F.col(text))).alias("word"))
    return rows.where(~F.col("word").isin("", "\n")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def seed_without_collisions(words: DataFrame) -> int:
    seed = 0
    while True:
        shared = words.groupBy(code(F.col("lang"), F.col("word"), seed).alias("c")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("c").isin(BREAK, EMPTY))
        if shared.isEmpty():
            return seed
        seed += 1


def bit_map(cells: DataFrame, bits: int) -> np.ndarray:
    """Bits (packed, lowest first) that are set at the numbers in column ``cell``. Parts of 4 KB, 2 ** (bits - 15)
    at most whatever the input, come to the driver."""
    parts = cells.groupBy(F.shiftright("cell", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("cell") % (1 << 15)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[r.at << 12 : (r.at + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def is_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def mixed(*codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the columns, row by row."""
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Codes of consecutive texts without the empty ones, ``size`` at most, and then the first of what follows (or breaks)
    as far as a suffix reaches."""
    rest = np.zeros(0, np.int64)
    for b in batches:
        codes = b.column(0).flatten().to_numpy()
        rest = np.concatenate([rest, codes[codes != EMPTY]])
        while len(rest) >= size + DEPTH - 1:
            yield rest[: size + DEPTH - 1]
            rest = rest[size:]
    if len(rest):
        yield np.concatenate([rest, np.full(DEPTH - 1, BREAK, np.int64)])


def equal_rows(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and the sums of their ``n``."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return [c[first] for c in columns], np.add.reduceat(n, first)


def suffixes(a: np.ndarray, frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """The suffixes that begin in one chunk, counted: each ends before its first infrequent pair."""
    m = len(a) - (DEPTH - 1)
    good = is_set(frequent, a & ((1 << WORD_BITS) - 1)) & (a != BREAK)
    at = np.flatnonzero(good[:-1] & good[1:])
    h = mixed(a[at], a[at + 1])
    on = is_set(pairs, cell(h, PAIR_BITS))
    goes_on = np.zeros(len(a), bool)
    goes_on[at[on]] = True
    hashes = np.zeros(len(a), np.int64)
    hashes[at] = h
    at = np.flatnonzero(goes_on[:m])
    third = goes_on[at + 1]
    fourth = third & goes_on[at + 2]
    numbers = distinct(a)
    own = np.searchsorted(numbers, a)  # 64-bit codes as small numbers
    none = np.int64(len(numbers))
    numbers = np.append(numbers, BREAK)
    w = [own[at], own[at + 1], np.where(third, own[at + 2], none), np.where(fourth, own[np.minimum(at + 3, len(a) - 1)], none)]
    route, is_hot = hashes[at], np.isin(hashes[at], hot)
    (front, w3, w4), n = equal_rows([w[0] << 42 | w[1] << 21 | w[2], w[2], w[3]], np.ones(len(at), np.int64))
    c = [numbers[front >> 42], numbers[(front >> 21) & ((1 << 21) - 1)], numbers[w3], numbers[w4]]
    route = mixed(c[0], c[1])
    is_hot = np.isin(route, hot)
    deep = is_hot & (c[2] != BREAK)
    # a hot pair is counted by rows of its own; what follows it goes by three words
    (p1, p2), pn = equal_rows([c[0][is_hot], c[1][is_hot]], n[is_hot])
    keep = ~is_hot | deep
    route = np.where(deep, mixed(c[0], c[1], c[2]), route)
    zero = np.zeros(len(p1), np.int64)
    columns = [np.concatenate(x) for x in ((route[keep], mixed(p1, p2)), (deep[keep], zero > 0), (c[0][keep], p1), (c[1][keep], p2), (c[2][keep], zero), (c[3][keep], zero), (n[keep], pn))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["route", "deep", *CODES, "n"])


def equal_partitions(words: np.ndarray, weight: np.ndarray, least: int, shortest: int) -> list[tuple[int, int, int]]:
    """Multikey three-way quicksort of suffix pointers: (length, a pointer, size) of each equal part of at least
    ``least`` places and ``shortest`` words or more. ``words``: one row for each depth; BREAK ends a suffix."""
    found, depth = [], len(words)
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        p, d = todo.pop()
        key = words[d][p]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        same = key == pivot
        equal = p[same]
        if len(equal) < len(p):
            for part in (p[key < pivot], p[key > pivot]):
                if len(part) and weight[part].sum() >= least:
                    todo.append((part, d))
        if pivot != BREAK and (size := int(weight[equal].sum())) >= least:
            if d + 1 >= shortest:
                found.append((d + 1, int(equal[0]), size))
            if d + 1 < depth:
                todo.append((equal, d + 1))
    return found


def phrase_counts(docs: DataFrame, words: DataFrame, total: int, seed: int, least: int, lang: str, text: str, chunk: int = CHUNK, hot_share: int = HOT) -> DataFrame:
    """Phrases of 2 to 4 words with at least ``least`` places: their codes (0 after the last) and ``f``. ``total``: all words."""
    spark = docs.sparkSession
    small_batches(spark)
    own = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    coded = docs.select(F.transform(tokens(F.col(text)), lambda w: F.when(w == "\n", BREAK).when(w == "", EMPTY).otherwise(code(own, w, seed))).alias("codes"))
    frequent = spark.sparkContext.broadcast(bit_map(words.where(F.col("n") >= least).select(code(F.col("lang"), F.col("word"), seed).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("cell")), WORD_BITS))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in chunks(batches, chunk):
            a = a[: len(a) - (DEPTH - 2)]
            good = is_set(frequent.value, a & ((1 << WORD_BITS) - 1)) & (a != BREAK)
            at = np.flatnonzero(good[:-1] & good[1:])
            (h,), n = equal_rows([mixed(a[at], a[at + 1])], np.ones(len(at), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    pairs = stored(coded.mapInArrow(count_pairs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    known = spark.sparkContext.broadcast(bit_map(pairs.select(F.shiftrightunsigned("h", 64 - PAIR_BITS).alias("cell")), PAIR_BITS))
    hot = np.array([r.h for r in pairs.where(F.col("n") > total // hot_share).select("h").collect()], np.int64)  # fewer than hot_share
    free(pairs)

    def list_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in chunks(batches, chunk):
            yield suffixes(a, frequent.value, known.value, hot)

    buckets = max(1, -(-total // (chunk // 4)))
    routed = coded.mapInArrow(list_suffixes, SUFFIX).withColumn("bucket", F.pmod("route", F.lit(buckets))).drop("route")

    def sort(t: pa.Table) -> pa.Table:
        deep, n = (t.column(c).to_numpy() for c in ("deep", "n"))
        w = np.stack([t.column(c).to_numpy() for c in CODES])
        found = []
        for part, shortest in ((~deep, 2), (deep, 3)):
            if part.any():
                own = w[:, part]
                found += [(*np.where(np.arange(DEPTH) < k, own[:, i], BREAK), size) for k, i, size in equal_partitions(own, n[part], least, shortest)]
        made = np.array(found, np.int64).reshape(-1, DEPTH + 1)
        return pa.table({c: made[:, i] for i, c in enumerate((*CODES, "f"))})

    return routed.groupBy("bucket").applyInArrow(sort, f"{', '.join(f'{c} long' for c in CODES)}, f long")


def attached(rows: DataFrame, counts: DataFrame, at: str, columns: list[str], limit: int, salts: int = 32) -> DataFrame:
    """``columns`` of the counts of the phrase in struct column ``at``. Rows that ask for a phrase of more than ``limit`` places, of
    which there are so few that all tasks know them, are dealt to salts, so that no phrase is a hot key."""
    side = counts.select(F.struct(*CODES).alias("__at"), "f", *columns)
    often = F.broadcast(side.where(F.col("f") > limit).select(F.col("__at").alias("__often")))
    salted = rows.join(often, F.col(at) == F.col("__often"), "left").withColumn("__salt", F.when(F.col("__often").isNotNull(), F.pmod(F.xxhash64(*CODES), F.lit(salts)).cast("int")).otherwise(0))
    spread = side.withColumn("__own", F.explode(F.when(F.col("f") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("f")
    return salted.join(spread, (F.col(at) == F.col("__at")) & (F.col("__salt") == F.col("__own"))).drop("__at", "__own", "__salt", "__often")


def first_by(df: DataFrame, by: str, k: int, order: list[Column], place=F.row_number, salts: int = 64) -> DataFrame:
    """Rows whose ``place`` in their group is k at most, with ``rank``: in parts first, then the best of those."""
    part = df.withColumn("__part", F.pmod(F.xxhash64(*CODES), F.lit(salts)))
    best = part.withColumn("rank", place().over(W.partitionBy(by, "__part").orderBy(*order))).where(F.col("rank") <= k)
    return best.withColumn("rank", place().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k).drop("__part")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 2_000, inside: int = 80, chunk: int = CHUNK, hot_share: int = HOT) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a (its count), l and r (of the two parts at the
    cut with the lowest score), n (words of the language), score.

    Candidates have ``least`` places or more; those of which ``inside`` of 100 places are within one longer candidate are dropped."""
    words = stored(counted_words(docs, lang, text))
    seed = seed_without_collisions(words)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    phrases = stored(phrase_counts(docs, words, total, seed, least, lang, text, chunk, hot_share))
    zero = F.lit(0).cast("long")
    named = words.where(F.col("n") >= least).withColumn("c1", code(F.col("lang"), F.col("word"), seed))
    single = named.select("c1", *(zero.alias(c) for c in CODES[1:]), F.col("n").alias("f"), "lang")
    counts = phrases.withColumn("lang", F.lit(None).cast("string")).unionByName(single)
    limit = total // hot_share

    def part(i: int, j: int) -> Column:
        """Words i to j (from 1) as a phrase."""
        return F.struct(*(F.col(f"c{i + k}").alias(c) if i + k <= j else zero.alias(c) for k, c in enumerate(CODES)))

    size = sum(((F.col(c) != 0).cast("int") for c in CODES[1:]), F.lit(1))
    rows = phrases.withColumn("k", size)
    sides = F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("cut"), F.lit(k).alias("of"), F.lit(side).alias("left"), p.alias("part")) for k in range(2, DEPTH + 1) for i in range(1, k) for side, p in ((True, part(1, i)), (False, part(i + 1, k))))), lambda x: x["of"] == F.col("k")))
    asked = rows.select(*CODES, F.col("f").alias("a"), sides.alias("x")).select(*CODES, "a", "x.cut", "x.left", "x.part")
    told = attached(asked, counts.withColumn("m", F.col("f")), "part", ["m", "lang"], limit)
    both = told.groupBy(*CODES, "a", "cut").agg(F.max(F.when(F.col("left"), F.col("m"))).alias("l"), F.max(F.when(~F.col("left"), F.col("m"))).alias("r"), F.max("lang").alias("lang"))
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (l + r)")  # exact beyond 64 bits
    scored = both.withColumn("score", score).groupBy(*CODES, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"), F.max("lang").alias("lang"))
    inner = F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("of"), part(i, j).alias("p")) for k in range(3, DEPTH + 1) for i in range(1, k) for j in range(i + 1, k + 1) if j - i + 1 < k)), lambda x: x["of"] == F.col("k")))
    longest = rows.select("f", inner.alias("x")).groupBy("x.p").agg(F.max("f").alias("__longer"))
    candidates = scored.withColumn("p", F.struct(*CODES)).join(longest, "p", "left").where(F.col("__longer").isNull() | (100 * F.col("__longer") < inside * F.col("a")))
    candidates = candidates.select("lang", *CODES, "a", "x.l", "x.r", "x.score")
    best = stored(first_by(candidates, "lang", most, [F.col("score").desc(), F.col("a").desc()], F.rank).drop("rank"))
    free(phrases)
    spelled = best.select(*CODES, F.posexplode(F.array(*CODES)).alias("at", "c")).where("c <> 0").join(named.select(F.col("c1").alias("c"), "word"), "c")
    spelled = spelled.groupBy(*CODES).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # four words at most
    ranked = first_by(best.join(spelled, CODES), "lang", most, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")])
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () id, coalesce(lang, 'und') lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps FROM documents),
p AS (SELECT lang, unnest(ps) p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM p),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) ph FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM w, (SELECT unnest([1, 2, 3, 4]) k))),
f AS MATERIALIZED (SELECT lang, k, array_to_string(ph, ' ') phrase, count(*) f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f a, string_split(phrase, ' ') ws FROM f WHERE k > 1),
x AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) cut FROM c),
s AS (SELECT x.lang, x.k, x.phrase, x.a, cut, l.f l, r.f r, 2000000 * CAST(x.a AS HUGEINT) // (l.f + r.f) score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
m AS (SELECT lang, k, phrase, a, arg_min({'l': l, 'r': r, 's': score}, score * 10 + cut) b FROM s GROUP BY ALL),
i AS (SELECT lang, a, unnest(list_transform(list_filter([[1, 2], [2, 3], [3, 4], [1, 3], [2, 4]], lambda y: y[2] <= k AND y[2] - y[1] + 1 < k), lambda y: array_to_string(ws[y[1]:y[2]], ' '))) phrase FROM c),
z AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY b.s DESC, m.a DESC, encode(m.phrase)) "rank" FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100 * i.a >= 80 * m.a))
SELECT z.lang, "rank", phrase, a, b.l l, b.r r, n, CAST(b.s AS BIGINT) score FROM z JOIN n ON z.lang = n.lang WHERE "rank" <= 2000"""
