"""Which titles are alike: sets of words compared block against block."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordspark.operators.joins import heavy_join

#: A title similarity below this says another work.
POSSIBLE = 0.60
#: Rows of a side in one block, and rows that share one title in one group of it.
BLOCK, GROUP = 150_000, 64
#: Places of common words read at once, and bits of a table of titles by words.
PLACES, BITS = 1 << 21, 1 << 26


def blocks(rows: int, tasks: int) -> int:
    """Into how many blocks a side goes: blocks of both sides meet in four cells a task, or more where they would grow too large."""
    return max(ceil(rows / BLOCK), min(isqrt(4 * tasks - 1) + 1, ceil(rows / 2000)), 1)


def _needed(n: np.ndarray) -> np.ndarray:
    return np.ceil(n * (POSSIBLE / 0.95) - 1e-9).astype(np.int64)


def _within(count: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _cuts(count: np.ndarray) -> Iterator[slice]:
    """Runs of about PLACES in all."""
    ends = np.cumsum(count)
    at = np.searchsorted(ends, np.arange(PLACES, (ends[-1] if len(ends) else 0) + PLACES, PLACES), side="right")
    lo = 0
    for hi in np.unique(np.append(at, len(count))):
        if hi > lo:
            yield slice(lo, hi)
            lo = hi


class _Titles:
    """Titles as runs of word numbers: first and n of each, its word numbers, and 256 bits of them."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, self.n, self.first = words, n, np.append(0, np.cumsum(n))
        self.of = np.repeat(np.arange(len(n)), n)
        self.marks = np.zeros((len(n), 4), np.uint64)
        np.bitwise_or.at(self.marks, (self.of, words % 256 // 64), np.uint64(1) << (words % 64).astype(np.uint64))


def _meet(short: _Titles, long: _Titles, n_words: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """short, long, common words: all pairs with enough common words, where the long title has `least` words more, or further ones.

    A pair needs 0.60 / 0.95 of the shorter title's words, so it shares one of any so many of them that fewer are left than it needs: those that the
    fewest long titles have are looked up. A bit that the long title lacks is a word that it lacks; what the bits leave is counted.
    """
    order = np.argsort(-long.n, kind="stable")  # the place of a long title; those with enough words come first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size, marks = long.n[order], long.marks[order]
    n_long = max(len(order), 1)
    posts = np.sort(long.words * n_long + place[long.of])
    need = _needed(short.n)
    fits = np.searchsorted(-size, -(short.n + least), side="right")
    start = np.searchsorted(posts, short.words * n_long)
    count = np.searchsorted(posts, short.words * n_long + fits[short.of]) - start
    rarest = np.lexsort((count, short.of))
    first = rarest[_within(short.n) < (short.n - need + 1)[short.of]]
    first = first[count[first] > 0]
    places = np.bincount(short.of[first], count[first], len(short.n)).astype(np.int64)
    for cut in _cuts(places):  # all places of a title together, so that a pair is found once
        part = first[slice(*np.searchsorted(short.of[first], [cut.start, cut.stop]))]
        s = np.repeat(short.of[part], count[part])
        y = posts[np.repeat(start[part], count[part]) + _within(count[part])] % n_long
        lacking = np.zeros(len(s), np.int64)
        for k in range(4):
            lacking += np.bitwise_count(short.marks[s, k] & ~marks[y, k])
        left = short.n[s] - lacking >= need[s]
        s, y = np.divmod(np.unique(s[left] * n_long + y[left]), n_long)
        for a, b, k in _common(short, long, s, order[y], n_words):
            enough = k >= need[a]
            yield a[enough], b[enough], k[enough]


def _common(short: _Titles, long: _Titles, s: np.ndarray, y: np.ndarray, n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """s, y, number of common words: short titles' words are looked up in a table of bits, some of the long titles at a time."""
    by = np.argsort(y, kind="stable")
    s, y = s[by], y[by]
    titles, row = np.unique(y, return_inverse=True)
    rows = max(1, BITS // max(n_words, 1))
    table = np.zeros(min(rows, len(titles)) * n_words, bool)
    for k in range(0, len(titles), rows):
        some = titles[k : k + rows]
        held = long.words[np.repeat(long.first[some], long.n[some]) + _within(long.n[some])]
        at = np.repeat(np.arange(len(some)) * n_words, long.n[some]) + held
        table[at] = True
        lo, hi = np.searchsorted(row, [k, k + rows])
        for cut in _cuts(short.n[s[lo:hi]]):
            a, r = s[lo:hi][cut], row[lo:hi][cut] - k
            n = short.n[a]
            word = short.words[np.repeat(short.first[a], n) + _within(n)]
            seen = table[np.repeat(r * n_words, n) + word]
            yield a, y[lo:hi][cut], np.add.reduceat(seen, np.cumsum(n) - n, dtype=np.int64)
        table[at] = False


def _alike(t: pa.ListArray, c: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """t, c, title_sim, equal: places of alike titles of both lists of words."""
    numbers = pa.chunked_array([t.flatten(), c.flatten()]).dictionary_encode().combine_chunks()
    n_words = len(numbers.dictionary)
    word = numbers.indices.to_numpy().astype(np.int64)
    n_t = t.value_lengths().to_numpy().astype(np.int64)
    x, y = _Titles(word[: n_t.sum()], n_t), _Titles(word[n_t.sum() :], c.value_lengths().to_numpy().astype(np.int64))
    for short, long, least in ((x, y, 0), (y, x, 1)):
        for a, b, k in _meet(short, long, n_words, least):
            n, m = short.n[a], long.n[b]
            sim = np.maximum(k / (n + m - k), k / n * np.where(n >= 2, 0.95, 0.70))
            on = sim >= POSSIBLE
            a, b, sim, equal = a[on], b[on], sim[on], ((k == n) & (n == m))[on]
            yield (a, b, sim, equal) if short is x else (b, a, sim, equal)


def _groups(rows: DataFrame, key: str, fields: list[str], members: str) -> DataFrame:
    """words (one blank between them), members: the rows of a title, in groups of about GROUP where there are more."""
    rows = rows.where("words <> ''")
    often = rows.groupBy("words").agg(F.count("*").alias("copies")).where(F.col("copies") > GROUP)
    dealt = heavy_join(rows, often, ["words"], "left")
    part = F.pmod(F.xxhash64(key), F.ceil(F.coalesce("copies", F.lit(1)) / GROUP))
    return dealt.groupBy("words", part.alias("part")).agg(F.collect_list(F.struct(*fields)).alias(members)).drop("part")


def alike_rows(t: DataFrame, c: DataFrame, t_key: str, c_key: str) -> DataFrame:
    """title_sim, equal, and the columns of both sides: each row of t with each row of c whose title is alike (0.60 or more).

    Rows have `words`, a title's sorted different words with one blank between them (none: alike to nothing), in tables that are read several times. The rows of a title
    are compared as one group, or as several if they are many. Groups are dealt into blocks, and each block of one side meets
    each of the other in a cell, one task's work: nothing but the blocks is shuffled, and pairs are made where they are
    found. A block is copied as often as the other side has blocks.
    """
    spark = t.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    a, b = blocks(t.count(), tasks), blocks(c.count(), tasks)
    fields = lambda d: [x for x in d.columns if x != "words"]
    tg, cg = _groups(t, t_key, fields(t), "t"), _groups(c, c_key, fields(c), "c")
    spread = lambda n, seed, of: F.pmod(F.xxhash64("words", of, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda d, n: F.lit(None).cast(d.schema[n].dataType).alias(n)
    left = tg.withColumns({"i": spread(a, 1, "t")}).select("i", every(b).alias("j"), "words", "t", none(cg, "c"))
    right = cg.withColumns({"j": spread(b, 2, "c")}).select(every(a).alias("i"), "j", "words", none(tg, "t"), "c")
    cells = left.unionByName(right).repartition(4 * a * b, "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        is_t = pc.is_valid(table["t"])
        ts, cs = table.filter(is_t), table.filter(pc.invert(is_t))
        del table
        if not len(ts) or not len(cs):
            return
        words = lambda d: pc.split_pattern(d["words"], " ").combine_chunks()
        t_rows, c_rows = ts["t"].combine_chunks(), cs["c"].combine_chunks()
        for x, y, sim, equal in _alike(words(ts), words(cs)):
            for k in range(0, len(x), 10_000):
                cut = slice(k, k + 10_000)
                yield pa.record_batch({"title_sim": sim[cut], "equal": equal[cut], "t": t_rows.take(pa.array(x[cut])), "c": c_rows.take(pa.array(y[cut]))})

    schema = StructType().add("title_sim", "double").add("equal", "boolean").add(tg.schema["t"]).add(cg.schema["c"])
    met = cells.groupBy("i", "j").applyInArrow(compare, schema)
    one = met.select("title_sim", "equal", F.explode("t").alias("t"), "c")
    return one.select("title_sim", "equal", "t.*", F.explode("c").alias("c")).select("title_sim", "equal", *fields(t), "c.*")
