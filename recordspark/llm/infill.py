"""Fill-in-the-middle transformation with content-defined chunk memoization.

A text is chunked where a rolling hash of its last 32 bytes has its low bits set, so equal passages give
equal chunks wherever they stand. What a chunk says about cuts - its line ends, its code points, the
code points before each line end, whether it holds a marker - is worked out once for each distinct
chunk and kept in a bounded cache of the worker; a chunk found there is compared byte by byte
before its summary is taken. Running sums over the summaries of a text's chunks then find the chunk
and the place of a cut, and the few bytes around a boundary tell markers that lie across it.

Texts go through narrow Arrow passes; nothing is shuffled, and the cache changes time only, never results.

Nulls and ties: a null text is empty; an empty text, or one that holds a marker, stays plain. A null id
counts as an empty string in the seed; repeated rows give repeated, equal results; other columns
are ignored, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.llm.common import CHUNK, VALUES, powers, prepare, text_buffer, tidy

#: Bytes under the rolling hash, smallest and largest chunk; one place in 1,024 is a chunk's end by its hash.
WINDOW, LEAST, MOST, MASK = 32, 256, 8192, np.uint64(1023) << np.uint64(40)
#: Bytes of chunks remembered in one generation of a worker's cache; two are kept.
REMEMBERED = 16 << 20
MARKERS = ("<P>", "<S>", "<M>")


def _marks(raw: np.ndarray) -> np.ndarray:
    """Places at which the rolling hash of the bytes before ends a chunk (0 before WINDOW bytes)."""
    found = []
    for a in range(0, len(raw), CHUNK - WINDOW):
        part = raw[a : a + CHUNK]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[: len(part)], out=total[1:])
        if len(part) < WINDOW:
            break
        rolling = (total[WINDOW:] - total[:-WINDOW]) * down[: len(part) - WINDOW + 1]
        found.append(np.flatnonzero((rolling * np.uint64(0x9E3779B97F4A7C15) & MASK) == MASK) + a + WINDOW)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def chunk_ends(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's UTF-8 bytes; none cuts a code point, only the last is shorter than LEAST."""
    marks = _marks(raw)
    ends, at, k = [], 0, 0
    while len(raw) - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[k]) if k < len(marks) else len(raw), at + MOST, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        at = end
    if at < len(raw):
        ends.append(len(raw))
    return ends


@dataclass(frozen=True, slots=True)
class Summary:
    """Of a chunk: code points, byte and code point offsets just after each line end, a marker inside."""

    points: int
    line_bytes: np.ndarray
    line_points: np.ndarray
    marked: bool


def summarise(chunk: bytes, markers: tuple[bytes, ...]) -> Summary:
    raw = np.frombuffer(chunk, np.uint8)
    begins = (raw & 0xC0) != 0x80
    after = np.flatnonzero(raw == 10) + 1
    return Summary(int(begins.sum()), after, np.cumsum(begins)[after - 1], any(m in chunk for m in markers))


class Memo:
    """Summaries by content: a hit is taken only where all bytes are the same (a dictionary compares keys that share a hash)."""

    def __init__(self, markers: tuple[bytes, ...], most: int = REMEMBERED) -> None:
        self.markers, self.most = markers, most
        self.new: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.size = self.hits = 0

    def of(self, chunk: bytes) -> Summary:
        have = self.new.get(chunk)
        if have is not None:
            self.hits += 1
            return have
        have = self.old.get(chunk)
        if have is None:
            have = summarise(chunk, self.markers)
        else:
            self.hits += 1
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[chunk] = have
        self.size += len(chunk) + 16 * len(have.line_bytes) + 300
        return have


class Combined:
    """One text as the running sums over its chunks' summaries."""

    def __init__(self, raw: np.ndarray, memo: Memo) -> None:
        data = raw.tobytes()
        ends = chunk_ends(raw)
        self.starts = [0, *ends[:-1]] if ends else []
        self.parts = [memo.of(data[a:b]) for a, b in zip(self.starts, ends)]
        self.lines = np.cumsum([0] + [len(p.line_bytes) for p in self.parts])
        self.points = np.cumsum([0] + [p.points for p in self.parts])
        self.size = len(data)
        self.units = int(self.lines[-1]) + (1 if data and data[-1] != 10 else 0)
        reach = max(map(len, memo.markers), default=1) - 1
        across = (data[max(0, e - reach) : e + reach] for e in ends[:-1])
        self.marked = any(p.marked for p in self.parts) or any(m in x for x in across for m in memo.markers)

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before unit k (all, for k = units)."""
        if k <= 0 or not self.parts:
            return 0, 0
        if k > self.lines[-1] or k >= self.units:
            return self.size, int(self.points[-1])
        c = int(np.searchsorted(self.lines, k)) - 1  # the chunk that holds the k-th line end
        i = k - int(self.lines[c]) - 1
        return self.starts[c] + int(self.parts[c].line_bytes[i]), int(self.points[c] + self.parts[c].line_points[i])


def draws(key: str, seed: int) -> list[Column]:
    """h1 to h4 of a row: four unsigned numbers from the hash of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output. rate and spm are in hundredths; units are lines with their ends.

    psm puts prefix, suffix and middle after their markers, spm suffix, prefix and middle; plain is the text itself.
    """
    prepare(docs.sparkSession)
    p, s, m = (x.encode() for x in markers)
    if len({p, s, m}) < 3 or any(a != b and a in b for a in (p, s, m) for b in (p, s, m)) or not all((p, s, m)):
        raise ValueError("markers must be three texts, none inside another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo((p, s, m))
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            h = [batch.column(k).to_pylist() for k in range(2, 6)]
            out: dict[str, list] = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for i in range(batch.num_rows):
                body = raw[offsets[i] : offsets[i + 1]]
                whole = Combined(body, memo)
                data = body.tobytes()
                n = whole.units
                row = (n, "plain", None, None, data)
                if data and not whole.marked and h[2][i] % 100 < rate:
                    x, y = sorted((h[0][i] % (n + 1), h[1][i] % (n + 1)))
                    (a, a_points), (b, b_points) = whole.cut(x), whole.cut(y)
                    before, middle, after = data[:a], data[a:b], data[b:]
                    if h[3][i] % 100 < spm:
                        row = (n, "spm", a_points, b_points - a_points, b"".join((s, after, p, before, m, middle)))
                    else:
                        row = (n, "psm", a_points, b_points - a_points, b"".join((p, before, s, after, m, middle)))
                for name, value in zip(out, row):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["form"], pa.string()), pa.array(out["prefix_chars"], pa.int64()), pa.array(out["middle_chars"], pa.int64()), pa.array(out["output"], pa.binary()).cast(pa.string())],
                names=[key, *out],
            )

    fields = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(a, b) for a, b in fields.items()])
    rows = docs.select(F.col(key), F.col(text).alias("body"), *[h.alias(f"draw{k}") for k, h in enumerate(draws(key, seed))])
    return rows.mapInArrow(tidy(run), schema)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """Column: the text, from output and form alone. Texts that are not plain hold no marker, so each marker stands once."""
    p, s, m = markers
    o = F.col(output)
    first, middle = F.substring_index(o, m, 1), F.substring_index(o, m, -1)
    psm = F.concat(F.substring(F.substring_index(first, s, 1), len(p) + 1, 1 << 30), middle, F.substring_index(first, s, -1))
    spm = F.concat(F.substring_index(first, p, -1), middle, F.substring(F.substring_index(first, p, 1), len(s) + 1, 1 << 30))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)
