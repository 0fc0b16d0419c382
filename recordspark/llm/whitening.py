"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

fit_whitening() keeps every distinct vector once, packed into blocks of a written table, and runs one
Spark job for each Lanczos step: every task multiplies its centred rows by a vector (Xv) and the
product by its rows again (X'u), and partial sums meet by vector entry, so that each step brings about
2 d numbers to the driver, whatever the number of rows. A left vector u is never stored: it equals
X g for a short g that the driver has, so tasks rebuild the earlier ones from their rows for the full
reorthogonalisation, and a lost executor costs its tasks only. The small bidiagonal matrix is
decomposed on the driver; apply() projects rows in one narrow pass.

Entries c become whole numbers floor(64 c) + 1,000,000, so sums and deviations are exact.

Nulls and ties: a vector that is null, empty, holds a null or non-finite entry, or one of 2^40 and more
is left out, as are vectors of another length than most distinct vectors have (the shorter length on a tie). Repeated
rows and ids stay, each with its result. Components without variance are left out, so one distinct
vector, or none, gives no rows. A deviation beyond 64 bits is null. Columns other than the two are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.llm.common import drop, prepare, release, tidy, written

#: Bytes of one block of packed vectors.
BLOCK = 1 << 20
#: Entries from here on are refused: whole numbers stay exact.
WIDEST = float(1 << 40)
SCALE, SHIFT = 64, 1_000_000
#: A product this far from orthogonal to earlier left vectors is formed again; what is this small against the largest value is zero.
AGAIN, ZERO = 1e-10, 1e-12


@dataclass
class Whitening:
    """n distinct vectors of d entries with sums S; components as columns, their eigenvalues, shares and the check on the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def _whole(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and whole entries of each vector that counts."""
    for k, vector in enumerate(column):
        if vector.is_valid and len(vector) and not vector.values.null_count:
            c = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(c).all() and (np.abs(c) < WIDEST).all():
                yield k, np.floor(SCALE * c).astype("<i8") + SHIFT


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x, the whole numbers as packed 64-bit integers, of every vector that counts."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = list(_whole(batch.column(1)))
            ids = batch.column(0).take(pa.array([k for k, _ in kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for _, x in kept], pa.binary())], names=[key, "x"])

    fields = [T.StructField(key, rows.schema[key].dataType), T.StructField("x", T.BinaryType())]
    return rows.select(key, vector).mapInArrow(tidy(run), T.StructType(fields))


def _packed(distinct: DataFrame) -> DataFrame:
    """Vectors as rows (d, n, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[bytes]] = {}

        def block(size: int) -> pa.RecordBatch:
            parts = have.pop(size)
            return pa.RecordBatch.from_pydict({"d": [size // 8], "n": [len(parts)], "block": [b"".join(parts)]}, schema=pa.schema([("d", pa.int64()), ("n", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            for x in batch.column(0).to_pylist():
                mine = have.setdefault(len(x), [])
                mine.append(x)
                if len(mine) * len(x) >= BLOCK:
                    yield block(len(x))
        for size in list(have):
            yield block(size)

    return distinct.mapInArrow(tidy(run), "d long, n long, block binary")


def _gathered(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Entry-wise sum over blocks of the vectors that of_block makes; tasks add up theirs, entries meet by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width), False
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += of_block(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d))
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["j", "v"])
        release()

    out = np.zeros(width)
    for r in blocks.select("d", "block").mapInArrow(run, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect():
        out[r["j"]] = r["v"]
    return out


def _sums(blocks: DataFrame, d: int) -> list[int]:
    """Exact sums of the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                total = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total, pa.int64())], names=["j", "v"])

    rows = blocks.select("block").mapInArrow(tidy(run), "j int, v long").groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return [int(v) for _, v in sorted((r["j"], r["v"]) for r in rows)]


def centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n in doubles; the whole part of the mean is taken off exactly."""
    low = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - low) - rest


def bidiagonal(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], d: int, wanted: int, tolerance: float = 0.0, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values and right singular vectors (columns) of a matrix X that only products reach.

    product(y, g) gives X'(Xy), (Xg)'(Xy) and |Xy|^2. d steps find every value, repeated ones too; with a tolerance above
    zero the steps end once the wanted values are that exact against the largest one (copies of a repeated value can then be missing).
    """
    rng = np.random.default_rng(seed)
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    diagonal, above, scale = [], [], 0.0

    def off(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def start() -> np.ndarray:
        w = off(rng.standard_normal(d))
        return w / np.linalg.norm(w)

    v, beta = start(), 0.0
    while True:
        right = np.column_stack([right, v])
        y = v - beta * short[:, -1] if short.shape[1] else v
        for _ in range(3):  # once is the rule; twice is enough
            p, c, square = product(y, short)
            y, p, square = y - short @ c, p - back @ c, square - c @ c
            if np.abs(c).max(initial=0.0) <= AGAIN * max(np.sqrt(max(square, 0.0)), ZERO * scale):
                break
        alpha = float(np.sqrt(max(square, 0.0)))
        scale = max(scale, alpha)
        if alpha <= ZERO * scale or alpha == 0:
            alpha, y, p = 0.0, np.zeros(d), np.zeros(d)
        short = np.column_stack([short, y / (alpha or 1.0)])
        back = np.column_stack([back, p / (alpha or 1.0)])
        diagonal.append(alpha)
        k = len(diagonal)
        small = np.diag(diagonal) + np.diag(above, 1)
        if k == d:
            break
        w = off(back[:, -1] - alpha * v)
        beta = float(np.linalg.norm(w))
        scale = max(scale, beta)
        if beta <= ZERO * scale or beta == 0:
            beta, v = 0.0, start()
        else:
            v = w / beta
        if tolerance and k >= wanted and beta:
            left, values, _ = np.linalg.svd(small)
            if (beta * np.abs(left[-1, :wanted]) <= tolerance * values[0]).all():
                break
        above.append(beta)
    _, values, rows = np.linalg.svd(small)
    vectors = right @ rows.T[:, :wanted]
    return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)


def fit_whitening(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, tolerance: float = 0.0) -> Whitening | None:
    """The whitening of the distinct vectors; None where they don't vary. As many passes over them as vectors have entries, fewer with a tolerance."""
    blocks = written(_packed(whole_vectors(rows, key, vector).select("x").distinct()), "whitening")
    try:
        most = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        if not most:
            return None
        d, n = most[0]["d"], most[0]["n"]
        blocks = blocks.where(F.col("d") == d)
        sums = _sums(blocks, d)
        centred = centring(n, sums)

        def product(y: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            def one(x: np.ndarray) -> np.ndarray:
                x = centred(x)
                u = x @ y
                return np.concatenate([x.T @ u, (x @ g).T @ u, [u @ u]])

            out = _gathered(blocks, one, d + g.shape[1] + 1)
            return out[:d], out[d:-1], float(out[-1])

        values, vectors = bidiagonal(product, d, min(components, d), tolerance)
        there = values > max(ZERO * values[0], 0.0) if len(values) else np.zeros(0, bool)
        values, vectors = values[there], vectors[:, there]
        m = len(values)
        if not m:
            return None
        eigen = values**2 / n
        to = vectors / np.sqrt(eigen)
        first = _gathered(blocks, lambda x: np.concatenate([(centred(x) @ to).sum(axis=0), [(centred(x) ** 2).sum()]]), m + 1)
        mean, trace = first[:m] / n, first[m] / n

        def second(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ to - mean
            return (w.T @ w).ravel()

        error = float(np.abs(_gathered(blocks, second, m * m).reshape(m, m) / n - np.eye(m)).max())
        return Whitening(n, sums, vectors, eigen, np.minimum(eigen / trace, 1.0), error)
    finally:
        drop(blocks)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over entries of (n x - S)^2 for each row; None beyond 64 bits."""
    off = (x.astype(np.float64) * n - np.array([float(s) for s in sums])) ** 2
    if max(float(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) < 2.0**61 and off.sum(axis=1).max(initial=0.0) < 2.0**61:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((int(c) * n - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def apply_whitening(rows: DataFrame, fit: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that counts and component."""
    kind = rows.schema[key].dataType
    names = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(a, b) for a, b in names.items()])
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, m = fit.components.shape
    to, centred = fit.components / np.sqrt(fit.values), centring(fit.n, fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero([len(x) == 8 * d for x in batch.column(1).to_pylist()])
            if not len(own):
                continue
            x = np.stack([np.frombuffer(batch.column(1)[int(k)].as_buffer(), "<i8") for k in own])
            spread = lambda a: np.repeat(a, m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(spread(own))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(own) * m, fit.n)),
                    pa.array([v for v in deviations(x, fit.n, fit.sums) for _ in range(m)], pa.int64()),
                    pa.array((centred(x) @ to).ravel()),
                    pa.array(np.tile(fit.explained, len(own))),
                    pa.array(np.full(len(own) * m, fit.identity_error)),
                ],
                names=[key, *names],
            )

    return whole_vectors(rows, key, vector).mapInArrow(tidy(run), schema)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Fits on the distinct vectors and whitens every row."""
    return apply_whitening(rows, fit_whitening(rows, key, vector, components), key, vector)
