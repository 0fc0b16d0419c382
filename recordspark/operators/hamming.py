"""An index of 64-bit signatures for pairs within a Hamming distance.

The bits are cut into six blocks of 10 or 11. Two signatures at most 10 apart differ by at most one bit in
one of them, so it is enough that texts meet by a block's value, equal or one bit off. A signature is
filed once under each block's value; it asks at the values with one of its set bits cleared, since of two values one bit apart one has that
bit set: six rows to file and some 32 to ask, 38 in all, where equal blocks alone would need hundreds of keys. Rows that meet are sorted by length, so
a task compares only lengths that fit the ratio, many pairs in one numpy step. A pair counts in the first
block where it can meet, and in no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, BLOCKS = 64, 6
CUTS = [round(BITS * k / BLOCKS) for k in range(BLOCKS + 1)]
#: Rows under one value that one task compares; a value with more is cut into so large parts that meet by twos.
PART = 1 << 15
#: Rows of whole groups that are taken up together, and pairs compared in one step: some 10 MB a task.
BUNDLE, STEP = 1 << 14, 1 << 17


def filed(points: DataFrame) -> DataFrame:
    """key, asks, id, n, sim: the rows by which points (id, n, sim) meet."""
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("b"), F.lit(CUTS[k]).alias("low"), F.lit(CUTS[k + 1] - CUTS[k]).alias("width")) for k in range(BLOCKS)])).alias("x")
    rows = points.select("id", "n", "sim", block).select("id", "n", "sim", "x.*").withColumn("value", F.expr("shiftrightunsigned(sim, low) & (shiftleft(1L, width) - 1)"))
    cleared = F.expr("transform(filter(sequence(0, width - 1), i -> (value & shiftleft(1L, i)) != 0), i -> value - shiftleft(1L, i))")
    meets = F.explode(F.concat(F.array(F.struct(F.col("value").alias("v"), F.lit(False).alias("asks"))), F.transform(cleared, lambda v: F.struct(v.alias("v"), F.lit(True).alias("asks")))))
    return rows.select("id", "n", "sim", "b", meets.alias("m")).select((F.col("b") * 4096 + F.col("m.v")).cast("long").alias("key"), F.col("m.asks").alias("asks"), "id", "n", "sim")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with their part and the pair of parts they go to: most keys have one part, and no row is copied."""
    counts = rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > PART)
    large = {r["key"]: -(-r["c"] // PART) for r in counts.collect()}  # keys are fewer than BLOCKS * 2048
    if not large:
        return rows.withColumn("own", F.lit(0)).withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    table = F.broadcast(rows.sparkSession.createDataFrame(list(large.items()), "key long, parts long"))
    r = rows.join(table, "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    to = F.expr("transform(sequence(0, cast(coalesce(parts, 1) as int) - 1), o -> struct(least(o, own) as p, greatest(o, own) as q))")
    return r.withColumn("t", F.explode(to)).select(*rows.columns, "own", "t.p", "t.q")


def _first_block(x: np.ndarray) -> np.ndarray:
    """The first block in which two signatures with this difference are at most one bit apart."""
    first = np.full(len(x), -1, np.int64)
    for k in reversed(range(BLOCKS)):
        part = (x >> np.uint64(CUTS[k])) & np.uint64((1 << (CUTS[k + 1] - CUTS[k])) - 1)
        first[np.bitwise_count(part) <= 1] = k
    return first


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches as columns of whole groups (key, p, q), BUNDLE rows or a little more at a time; g numbers the groups."""
    have: list[dict[str, np.ndarray]] = []

    def whole(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        change = (np.diff(cols["key"]) != 0) | (np.diff(cols["p"]) != 0) | (np.diff(cols["q"]) != 0)
        return cols | {"g": np.concatenate(([0], np.cumsum(change)))}

    for batch in batches:
        have.append({name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)})
        if sum(len(h["key"]) for h in have) < BUNDLE:
            continue
        cols = whole({c: np.concatenate([h[c] for h in have]) for c in have[0]})
        last = int(np.searchsorted(cols["g"], cols["g"][-1]))
        rest = {c: v[last:] for c, v in cols.items() if c != "g"}
        if last:
            yield {c: v[:last] for c, v in cols.items()}
        have = [rest]
    if have and sum(len(h["key"]) for h in have):
        yield whole({c: np.concatenate([h[c] for h in have]) for c in have[0]})


def _meetings(r: dict[str, np.ndarray], within: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (id, id, distance) between every row and the filed rows of its group, those of the other part where two parts meet; all groups of a bundle at once."""
    ids, n, sim = r["id"], r["n"].astype(np.int64), r["sim"].astype(np.int64).view(np.uint64)
    asks, one_part, side = r["asks"].astype(bool), r["p"] == r["q"], (r["own"] != r["p"]).astype(np.int64)
    block = r["key"].astype(np.int64) >> 12
    wide = np.int64(1) << 32
    filed_rows = np.flatnonzero(~asks)
    place = (2 * r["g"] + side)[filed_rows] * wide + n[filed_rows]
    order = np.argsort(place, kind="stable")
    y_of, place = filed_rows[order], place[order]
    goes = np.flatnonzero(asks | one_part | (side == 0))  # of two parts, filed rows of the first look up those of the second
    seat = (2 * r["g"] + np.where(one_part, 0, 1 - side))[goes] * wide
    low = np.searchsorted(place, seat + np.floor(n[goes] * ratio * (1 - 1e-12)).astype(np.int64))
    high = np.searchsorted(place, seat + np.minimum(np.ceil(n[goes] / ratio * (1 + 1e-12)).astype(np.int64), wide - 1), side="right")
    ends = np.cumsum(high - low)
    k = 0
    while k < len(goes):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP, side="right")))
        count = (high - low)[k:stop]
        x = np.repeat(goes[k:stop], count)
        y = y_of[np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[k:stop], count)]
        apart = np.bitwise_count(sim[x] ^ sim[y])
        good = (apart <= within) & (asks[x] | ~one_part[x] | (x < y))
        x, y, apart = x[good], y[good], apart[good]
        good = (np.minimum(n[x], n[y]) / np.maximum(n[x], n[y]) >= ratio) & (_first_block(sim[x] ^ sim[y]) == block[x])
        if good.any():
            yield ids[x[good]], ids[y[good]], apart[good].astype(np.int32)
        k = stop


def near_points(points: DataFrame, within: int = 10, ratio: float = 0.82) -> DataFrame:
    """x, y, distance: every pair of points (id long, n int, sim long; ids unique), once, at most `within` bits apart (10 at most) and with a ratio of n of at least `ratio`.

    Every pair is found, whatever the size of a group; rows under one value are dealt out by twos of parts of 32,768.
    """
    if within >= 2 * BLOCKS:
        raise ValueError(f"{BLOCKS} blocks serve distances below {2 * BLOCKS}")
    rows = _dealt(filed(points.where("id is not null and n > 0 and sim is not null")))
    placed = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle in _bundles(batches):
            for x, y, distance in _meetings(bundle, within, ratio):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(distance, pa.int32())], names=["x", "y", "distance"])

    return placed.select("key", "p", "q", "own", "asks", "id", "n", "sim").mapInArrow(run, "x long, y long, distance int")
