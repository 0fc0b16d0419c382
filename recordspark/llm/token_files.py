"""Token ids in binary shard files, found by key through a minimal perfect hash.

Folder: `shard-NNNNN.ids` (ids of records in ascending key order, 2 or 4 bytes each, then the
records' bounds and a trailer), `keys/` (one row per record), `index-NNNNN.mph` (one file per part
of the key space) and `meta.json` (number of parts, records and ids of each shard). An index file
has the bits of each level of its hash in blocks of 512, each behind the number of bits before it,
and then 16 bytes per key: fingerprint, count and place in the order of all records.
A lookup hashes the key to its part and to a bit on one level after the other (1.6 on average, for
any number of keys), reads that block, the 16 bytes of its slot, two bounds and the ids: a constant
number of short ranges, whatever the size of the files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.llm.bpe import encoder
from recordspark.llm.common import mix, prepare

MAGIC, INDEX_MAGIC = b"TOKIDS01", b"TOKMPH02"
#: Keys in one part of the index, and bytes of text in one shard where the session's shuffle partitions are fewer.
PART_KEYS, SHARD_BYTES = 100_000, 1 << 30
#: Bits per remaining key on each level; levels that an index file's head has room for.
GAMMA, LEVELS = 2.0, 62
#: A part is read whole when a lookup asks for more than one in WHOLE of its keys.
WHOLE = 64
BLOCK = np.dtype([("before", "<u8"), ("bits", "u1", 64)])
SLOT = np.dtype([("print", "<u4"), ("count", "<u4"), ("place", "<u8")])
HEAD = 16 + 16 * LEVELS


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5BF03635F0A31C87)) >> np.uint64(32)).astype("<u4")


def build_levels(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bits, blocks) of each level: a key alone in its place stays there, the rest go on to the next level."""
    levels: list[tuple[int, np.ndarray]] = []
    before = 0
    while len(keys):
        size = max(64, int(GAMMA * len(keys)))
        at = _place(keys, len(levels), size)
        alone = np.zeros(-(-size // 512) * 512, bool)
        alone[:size] = np.bincount(at, minlength=size) == 1
        blocks = np.zeros(len(alone) // 512, BLOCK)
        blocks["bits"] = np.packbits(alone).reshape(-1, 64)
        count = alone.reshape(-1, 512).sum(axis=1)
        blocks["before"] = before + np.cumsum(count) - count
        before += int(count.sum())
        levels.append((size, blocks))
        keys = keys[~alone[at]]
    return levels


def index_bytes(keys: np.ndarray, counts: np.ndarray, places: np.ndarray) -> bytes:
    """One index file over distinct 64-bit keys."""
    levels = build_levels(keys)
    head = np.zeros(HEAD // 8, "<u8")
    head[0], head[1] = np.frombuffer(INDEX_MAGIC, "<u8")[0], len(keys) << 8 | len(levels)
    at = HEAD
    for k, (size, blocks) in enumerate(levels):
        head[2 + 2 * k], head[3 + 2 * k] = size, at
        at += blocks.nbytes
    body = head.tobytes() + b"".join(b.tobytes() for _, b in levels)
    slots = np.zeros(len(keys), SLOT)
    own = IndexPart(body + slots.tobytes()).slots(keys)
    slots["print"][own], slots["count"][own], slots["place"][own] = fingerprints(keys), counts, places
    return body + slots.tobytes()


class IndexPart:
    """One index file, either whole in memory or read by ranges as keys are asked for."""

    def __init__(self, source, head: bytes | None = None):
        self.source, self.bytes_read = source, 0
        head = np.frombuffer(self._range(0, HEAD) if head is None else head, "<u8")
        if head[:1].tobytes() != INDEX_MAGIC:
            raise ValueError("no index file")
        self.n, n_levels = int(head[1]) >> 8, int(head[1]) & 255
        self.levels = [(int(head[2 + 2 * k]), int(head[3 + 2 * k])) for k in range(n_levels)]
        last = self.levels[-1] if self.levels else (0, HEAD)
        self.first_slot = last[1] + -(-last[0] // 512) * BLOCK.itemsize

    def _range(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.source[at : at + size] if isinstance(self.source, bytes) else self.source.read_at(size, at)

    def _rows(self, at: int, kind: np.dtype, rows: np.ndarray) -> np.ndarray:
        if isinstance(self.source, bytes):
            return np.frombuffer(self.source, kind, int(rows.max()) + 1 if len(rows) else 0, at)[rows]
        return np.frombuffer(b"".join(self._range(at + int(k) * kind.itemsize, kind.itemsize) for k in rows), kind)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Distinct numbers 0..n-1 for the keys of the index; -1 where no level takes the key, which then is not in it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (size, at) in enumerate(self.levels):
            if not len(left):
                break
            place = _place(keys[left], k, size)
            block = self._rows(at, BLOCK, place >> 9)
            inside = place & 511
            byte = block["bits"][np.arange(len(left)), inside >> 3]
            hit = (byte >> (7 - (inside & 7)).astype(np.uint8)) & 1 > 0
            ones = np.concatenate((np.zeros((len(left), 1), np.int64), np.cumsum(np.bitwise_count(block["bits"]), axis=1, dtype=np.int64)), axis=1)
            rank = block["before"].astype(np.int64) + ones[np.arange(len(left)), inside >> 3] + np.bitwise_count(byte.astype(np.uint16) >> (8 - (inside & 7)).astype(np.uint16)).astype(np.int64)
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among the keys, slot) of those whose fingerprint is there."""
        at = self.slots(keys)
        known = np.flatnonzero(at >= 0)
        slot = self._rows(self.first_slot, SLOT, at[known])
        own = slot["print"] == fingerprints(keys[known])
        return known[own], slot[own]


class Shard:
    """Reads records of one shard file."""

    def __init__(self, path: str):
        filesystem, name = _file(path)
        self.file, self.bytes_read = filesystem.open_input_file(name), 24
        size = self.file.size()
        n, width, magic = np.frombuffer(self.file.read_at(24, size - 24), [("n", "<u8"), ("width", "<u8"), ("magic", "S8")])[0]
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.width, self.n = int(width), int(n)
        self.first_bound = size - 24 - 8 * (self.n + 1)
        self._bounds: np.ndarray | None = None

    @property
    def bounds(self) -> np.ndarray:
        """All bounds at once, for reading many records."""
        if self._bounds is None:
            self._bounds = np.frombuffer(self._range(self.first_bound, 8 * (self.n + 1)), "<u8")
        return self._bounds

    def _range(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.file.read_at(size, at)

    def ids(self, record: int) -> np.ndarray:
        if self._bounds is None:
            a, b = (int(x) for x in np.frombuffer(self._range(self.first_bound + 8 * record, 16), "<u8"))
        else:
            a, b = int(self._bounds[record]), int(self._bounds[record + 1])
        return np.frombuffer(self._range(a * self.width, (b - a) * self.width), f"<u{self.width}").astype("<u4")


def _meta(path: str) -> dict:
    filesystem, name = _file(f"{path}/meta.json")
    with filesystem.open_input_file(name) as f:
        return json.loads(f.read())


def _part(path: str, number: int, whole: bool = False) -> IndexPart | None:
    """A part of the index; None where no key falls in it."""
    filesystem, name = _file(f"{path}/index-{number:05d}.mph")
    if filesystem.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    file = filesystem.open_input_file(name)
    return IndexPart(file.read()) if whole else IndexPart(file)


class TokenFiles:
    """Keyed access without Spark: get(key) reads a constant number of short ranges."""

    def __init__(self, path: str):
        meta = _meta(path)
        self.path, self.parts = path, meta["parts"]
        self.before = np.cumsum([0, *meta["records"]])
        self.bytes_read, self._open, self._shards = 0, {}, {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every record under the key, none for a key that is not there."""
        import xxhash

        number = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=42)
        number = (number - (1 << 64) * (number >> 63)) % self.parts
        if number not in self._open:
            self._open[number] = _part(self.path, number)
        part = self._open[number]
        if part is None:
            return []
        had = part.bytes_read
        _, slot = part.find(np.array([key], np.int64).view(np.uint64))
        self.bytes_read += part.bytes_read - had
        out = []
        for place in range(int(slot["place"][0]), int(slot["place"][0]) + int(slot["count"][0])) if len(slot) else ():
            shard = int(np.searchsorted(self.before, place, side="right")) - 1
            if shard not in self._shards:
                self._shards[shard] = Shard(f"{self.path}/shard-{shard:05d}.ids")
            had = self._shards[shard].bytes_read
            out.append(self._shards[shard].ids(place - int(self.before[shard])))
            self.bytes_read += self._shards[shard].bytes_read - had
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text (null: empty), appends end_id and writes shards and index under path.

    A shard has about SHARD_BYTES of text at most. Records stand in ascending key order over the shards; rows with the same key follow each other
    (by text hash, over several shards if they are many) and share an index slot; null keys come
    first and are in no index. An empty table gives an index without parts. path is a URI that
    pyarrow's file systems and Spark both reach. Files are written under a name of their own attempt
    and then renamed, so a repeated task is safe.
    """
    spark = docs.sparkSession
    prepare(spark)
    filesystem, name = _file(path)
    filesystem.create_dir(name, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "key", "h").sortWithinPartitions("key", "h").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, coder = TaskContext.get(), encoder(tokenizer)
        shard, width = context.partitionId(), 2 if max(end_id, coder.tokenizer.get_vocab_size()) < 1 << 16 else 4
        filesystem, name = _file(f"{path}/shard-{shard:05d}.ids")
        trial, sizes, out = f"{name}.{context.taskAttemptId()}", [], None
        for batch in batches:
            out = out or filesystem.open_output_stream(trial)
            found = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in coder.encode(batch.column(1).to_pylist())]
            out.write(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(f"<u{width}").tobytes())
            first = len(sizes)
            sizes += [len(x) for x in found]
            columns = [batch.column(0), pa.array([shard] * len(found), pa.int64()), pa.array(range(first, len(sizes)), pa.int64()), pa.array(sizes[first:], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "shard", "record", "n_tokens"])
        if out:
            out.write(np.concatenate(([0], np.cumsum(sizes))).astype("<u8").tobytes() + np.array([len(sizes), width], "<u8").tobytes() + MAGIC)
            out.close()
            filesystem.move(trial, name)

    rows.mapInArrow(write, "key long, shard long, record long, n_tokens long").write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    own = {r["shard"]: r for r in keys.groupBy("shard").agg(F.count("*").alias("n"), F.count("key").alias("k"), F.sum("n_tokens").alias("t")).collect()}  # one row per shard file
    shards = range(max(own, default=-1) + 1)
    records = [own[s]["n"] if s in own else 0 for s in shards]
    before = spark.createDataFrame([(s, int(b)) for s, b in zip(shards, np.cumsum([0, *records]))], "shard long, before long")
    placed = keys.where("key is not null").join(F.broadcast(before), "shard")  # one row per shard file
    slots = placed.groupBy("key").agg(F.min(F.col("before") + F.col("record")).alias("place"), F.count("*").alias("count"))
    parts = max(1, -(-sum(r["k"] for r in own.values()) // PART_KEYS))

    def build(group: pa.Table) -> pa.Table:
        number = group["part"][0].as_py()
        data = index_bytes(group["key"].to_numpy().astype(np.int64).view(np.uint64), group["count"].to_numpy(), group["place"].to_numpy())
        filesystem, name = _file(f"{path}/index-{number:05d}.mph")
        trial = f"{name}.{TaskContext.get().taskAttemptId()}"
        with filesystem.open_output_stream(trial) as out:
            out.write(data)
        filesystem.move(trial, name)
        return pa.table({"n": pa.array([len(group)], pa.int64())})

    slots.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(build, "n long").agg(F.sum("n")).first()
    meta = {"parts": parts, "records": [int(n) for n in records], "tokens": [int(own[s]["t"]) if s in own else 0 for s in shards]}
    with suppress(FileNotFoundError):
        filesystem.delete_file(f"{name}/meta.json")
    with filesystem.open_output_stream(f"{name}/meta.json") as out:
        out.write(json.dumps(meta).encode())


def find(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, shard, record) of every record of the keys; null keys and keys without a record give no row, repeated keys one lookup.

    Few keys of a part are looked up by ranges of its file, many by reading it once.
    """
    meta = _meta(path)
    parts, before = meta["parts"], np.cumsum([0, *meta["records"]])

    def look(wanted: pa.Table) -> pa.Table:
        key, place, count = wanted["key"].to_numpy().astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = _part(path, wanted["part"][0].as_py())
        if part is None:
            key = key[:0]
        else:
            if len(key) * WHOLE > part.n:
                part = _part(path, wanted["part"][0].as_py(), whole=True)
            own, slot = part.find(key.view(np.uint64))
            key, count = key[own], slot["count"].astype(np.int64)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            key, place = np.repeat(key, count), np.repeat(slot["place"].astype(np.int64), count) + nth
        shard = np.searchsorted(before, place, side="right") - 1
        return pa.table({"key": key, "shard": shard.astype(np.int64), "record": place - before[shard]})

    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).where("key is not null").distinct()
    return wanted.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(look, "key long, shard long, record long")


def read_records(found: DataFrame, path: str) -> DataFrame:
    """(key, shard, record, offset in the shard, n_tokens, crc32, ids) read from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        for batch in batches:
            ids, offset = [], []
            for k, record in zip(batch.column("shard").to_pylist(), batch.column("record").to_pylist()):
                if k != number:
                    number, shard = k, Shard(f"{path}/shard-{k:05d}.ids")
                offset.append(int(shard.bounds[record]))
                ids.append(shard.ids(record).tobytes())
            columns = [batch.column("key"), batch.column("shard"), batch.column("record"), pa.array(offset, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "shard", "record", "offset", "n_tokens", "crc32", "ids"])

    dealt = found.select("key", "shard", "record").repartition("shard").sortWithinPartitions("shard", "record")
    return dealt.mapInArrow(read, "key long, shard long, record long, offset long, n_tokens long, crc32 long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): ids in all shards before it; one row per shard."""
    tokens = _meta(path)["tokens"]
    return spark.createDataFrame([(s, int(b)) for s, b in zip(range(len(tokens)), np.cumsum([0, *tokens]))], "shard long, base long")
