"""What several operators share: shared-folder tables, word hashes over Arrow text, packing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch sent to Python, so that a worker's memory stays bounded; one longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of text hashed at a time.
CHUNK = 1 << 20

WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: documents may be long. These two settings of the session stay lowered afterwards, as results are lazy."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (have and have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; at its end the worker, which Spark keeps for later tasks, gives freed memory back to the system."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A table of texts that is one file, which as few tasks read as it has row groups, is dealt out to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and len(df.inputFiles()) == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened where the columns already have them (whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a new local one only where driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def held_out(doc_id, modulus: int, rest: int):
    """Column: crc32 of the id as text leaves this rest."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


# --- text as bytes -----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
OTHER_VALUES = mix(VALUES + np.uint64(0x632BE59BD9B4E019))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > CHUNK:
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Classes of bytes: blanks 0; words 1; for tokens, runs of ASCII punctuation are 2.
WORDS = _IS_WORD.astype(np.uint8)
TOKENS = WORDS.copy()
TOKENS[[k for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "_"]] = 2


def _word_bounds(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = classes[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    if len(raw):
        cut[1:-1] |= kind[1:] != kind[:-1]
    inside = kind > 0
    return np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, in order, and where each text's words begin."""
    start, end = _word_bounds(raw, offsets, classes)
    out = np.empty(len(start), dtype=np.uint64)
    k = 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK, side="right")))
        a, b = int(start[k]), int(end[stop - 1])
        up, down = powers(b - a + 1)
        part = raw[a:b]
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(VALUES[_LOWER[part] if lower else part] * up[: b - a], out=total[1:])
        s, e = start[k:stop] - a, end[k:stop] - a
        out[k:stop] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        k = stop
    return mix(out), np.searchsorted(start, offsets)


def pack(a: np.ndarray) -> bytes:
    """An array of fixed-width numbers, its byte planes apart, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


#: Vectors that one group of summed() adds; so many to the third power of tasks can take part.
FAN_IN = 64


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Element-wise sum of int64 vectors given as rows (slice, blob), as a tree of three levels: no group has more than FAN_IN tasks' vectors.

    The result has a fixed size, and one row per slice comes to the driver.
    """
    import pandas as pd

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1, np.int64)
        for blob in group["blob"]:
            total = total + unpack(blob, "<i8")
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "g": group["g"].iloc[:1], "blob": [pack(total)]})

    rows = parts.withColumn("g", F.spark_partition_id().cast("long"))
    for fan in (FAN_IN, FAN_IN, 1 << 40):
        rows = rows.withColumn("g", F.floor(F.col("g") / fan)).groupBy("slice", "g").applyInPandas(add, "slice long, g long, blob binary")
    out = np.zeros(width, np.int64)
    for r in rows.collect():
        part = unpack(r["blob"], "<i8")
        out[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    return out


def sliced(vector: np.ndarray, slices: int) -> pa.RecordBatch:
    """Rows for summed()."""
    parts = [pack(x) for x in vector.astype("<i8").reshape(slices, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int64()), pa.array(parts, pa.binary())], names=["slice", "blob"])


def crc_mod(value: int, modulus: int) -> int:
    return zlib.crc32(str(value).encode()) % modulus


#: A node with more than one in HOT of all edge ends is hot; so there are fewer than HOT hot nodes.
HOT = 1000
#: Edges that a task contracts at a time.
CONTRACT = 1_000_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components as (a, b), u > v: each task joins its edges to stars around their smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, t) for x in root if (t := top(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root.setdefault(a, a), root.setdefault(b, b)
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > CONTRACT:
                yield stars()
        yield stars()

    return edges.mapInArrow(tidy(run), "u long, v long")


def _with_least(ends: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """ends (u, v) with the m of their u from least (u, m, c); the few hot nodes are broadcast, so no task gets all edges of a hub."""
    is_hot = F.col("c") * HOT > F.lit(total)
    hot = F.broadcast(least.where(is_hot).select("u", "m"))  # fewer than HOT rows
    rest = ends.join(hot.select("u"), "u", "left_anti").join(least.where(~is_hot).select("u", "m"), "u")
    return ends.join(hot, "u").select("u", "v", "m").unionAll(rest.select("u", "v", "m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (a, b) rows: one row (node, component), the smallest node reachable.

    Tasks first join their own edges to stars; then large-star and small-star steps alternate until
    the edges are stars. Every round is a written table, so a lost executor costs one round, and the
    table before it is deleted. Minima are summed up before they are shuffled and hot nodes are
    joined by broadcast, so a hub is spread over tasks.
    Self edges and repeated edges are allowed; null nodes are ignored; no edges give no rows.
    """
    e = edges.selectExpr("cast(a as long) a", "cast(b as long) b").where("a is not null and b is not null and a <> b")
    if edges not in _PATHS:  # Python made them in this stage: a second worker beside each of its own would double the memory
        e = written(e, name)
    raw, e = e, written(contracted(e).distinct(), name)
    drop(raw)
    while True:
        n = e.count()
        ends = e.selectExpr("u n", "1 up", "0 down").unionAll(e.selectExpr("v", "0", "1")).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not n or not ends.where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            break
        both = e.unionAll(e.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("c")).selectExpr("u", "least(u, v) m", "c")
        # large star: every larger neighbour hangs on the smallest one
        large = _with_least(both, low, 2 * n).where("v > u and v <> m").selectExpr("v u", "m v")
        # small star: the smaller neighbours and the node itself hang on the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _with_least(large, least, n).selectExpr("v u", "m v").where("u <> v").unionAll(least.selectExpr("u", "m v")).distinct()
        before, e = e, written(small, name)
        drop(before)
    return e.selectExpr("u node", "v component").unionAll(e.selectExpr("v node", "v component").distinct())
