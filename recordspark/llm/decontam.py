"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters that stands in a document with at most k edits shares at least
m - q + 1 - k q character q-grams with it, all on k + 1 neighbouring diagonals (document place
minus item place). Shared q-grams are counted in overlapping bands of diagonals; bands that reach
the bound are verified by a banded alignment of the whole item. q is 8 for items for which the bound stays
positive at the full edit budget, 5 or the item's length for shorter ones. q-grams that many items
have are left out where the bound, lowered by them, still tells enough. Documents stream past the item
index, texts are never shuffled; items come in blocks of bounded size, one pass for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import prepare, tidy

#: Longest q-grams, those of short items, share of an item's characters that may be edited, characters in a block of items.
Q, SHORT_Q, EDIT_SHARE, BLOCK_CHARS = 8, 5, 0.1, 4_000_000
#: A q-gram with more places than this in a block of items is frequent; what an item's bound must keep without its frequent ones.
FREQUENT, KEEP_BOUND = 64, 8
#: Text places hashed, and shared places held, at a time.
WINDOW, HELD = 1_000_000, 1_000_000
_OUTSIDE = np.uint32(0xFFFFFFFF)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, as many as the text has; white space is a blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    out[(out >= 9) & (out <= 13)] = 32
    return out


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """One number per place: q characters, at most eight, each folded to a byte (equal q-grams stay equal)."""
    folded = (points ^ (points >> 8) * np.uint32(29) ^ (points >> 16)).astype(np.uint8)
    places = len(folded) - q + 1
    if places <= 0:
        return np.zeros(0, np.uint64)
    if q == 8:
        return np.ndarray((places,), "<u8", folded, strides=(1,)).copy()
    folded = np.concatenate((folded, np.zeros(8 - q, np.uint8)))
    return np.ndarray((places,), "<u8", folded, strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, fixed_end: int | None = None, most: int | None = None) -> tuple[int, int]:
    """Fewest edits that turn the item into a stretch of text, and where that stretch ends.

    Only diagonals low..high count; the stretch may begin on any of them, or only at fixed_end's
    diagonal if given. Of equal results the first end is taken. The least cost never falls from one
    character to the next, so once it exceeds most the search ends with that cost.
    """
    width = high - low + 1
    step = np.arange(width)
    cost = np.zeros(width, np.int64)
    if fixed_end is not None:
        cost[:] = len(item) + 1
        cost[fixed_end - low] = 0
        cost = np.minimum.accumulate(cost - step) + step
    at = np.arange(low, high + 1)
    padded = np.concatenate((np.full(max(0, -low), _OUTSIDE), text[max(0, low) : max(0, high + len(item))]))
    padded = np.concatenate((padded, np.full(max(0, width + len(item) - len(padded)), _OUTSIDE)))
    for i, c in enumerate(item):
        best = cost + (padded[i : i + width] != c)
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(best - step) + step
        if most is not None and i % 8 == 7 and cost.min() > most:
            break
    k = int(np.argmin(cost))
    return int(cost[k]), int(at[k]) + len(item)


def gram_size(m: int, edit_share: float) -> int:
    """The q of an item of m characters: the longest of 8 and 5 whose bound is positive at the full budget, else as long as fits."""
    k = int(edit_share * m)
    return next((q for q in (Q, SHORT_Q) if m - q + 1 - k * q > 0), max(1, m // (k + 1)))


def _word(c: int) -> bool:
    return chr(c).isalnum()


class ItemIndex:
    """A block of items, sorted into one q-gram index for each q."""

    def __init__(self, items: list[tuple[int, str]], edit_share: float = EDIT_SHARE):
        kept = [(k, code_points(t)) for k, t in items if t]
        self.ids = [k for k, _ in kept]
        self.points = [p for _, p in kept]
        self.edits = np.array([int(edit_share * len(p)) for p in self.points], np.int64)
        sizes = np.array([gram_size(len(p), edit_share) for p in self.points], np.int64)
        self.indexes = [GramIndex(self, np.flatnonzero(sizes == q), int(q)) for q in np.unique(sizes)]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item number, edits, start, end, shared q-grams) of every item found in a text, best stretch each."""
        points = [code_points(t) for t in texts]
        return sorted(hit for index in self.indexes for hit in index.search(points)) if points else []


class GramIndex:
    """Places of every q-gram of some items of one q, with a bit table in front."""

    BITS = 22

    def __init__(self, whole: ItemIndex, numbers: np.ndarray, q: int):
        self.q, self.numbers, self.points = q, numbers, [whole.points[k] for k in numbers]
        self.edits = whole.edits[numbers]
        self.longest = max(len(p) for p in self.points)
        grams = [qgrams(p, q) for p in self.points]
        self.bound = np.array([len(g) for g in grams], np.int64) - self.edits * q
        every = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        frequent = count[inverse] > FREQUENT
        lost = np.bincount(item[frequent], minlength=len(grams))
        able = self.bound - lost >= KEEP_BOUND
        self.bound = np.where(able, self.bound - lost, self.bound)
        used = ~(frequent & able[item])
        order = np.flatnonzero(used)[np.argsort(every[used], kind="stable")]
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self._hash(self.keys)] = True

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def _meetings(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, key) wherever a q-gram of a text is one of the items'."""
        sizes = np.array([len(p) for p in points])
        gap = np.zeros(1, "<u4")
        flat = np.concatenate([x for p in points for x in (p, gap)])
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        found = [(np.zeros(0, np.int64),) * 2]
        for s in range(0, len(flat), WINDOW):
            grams = qgrams(flat[s : s + WINDOW + self.q - 1], self.q)
            at = np.flatnonzero(self.bits[self._hash(grams)])
            key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
            same = self.keys[key] == grams[at]
            found.append((at[same] + s, key[same]))
        at, key = (np.concatenate(x) for x in zip(*found))
        doc = np.searchsorted(begin, at, side="right") - 1
        inside = at + self.q <= begin[doc] + sizes[doc]
        return doc[inside], (at - begin[doc])[inside], key[inside]

    def _entries(self, doc: np.ndarray, at: np.ndarray, key: np.ndarray, low: int, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(code of text, item and strip; place in the item) of all meetings, about HELD at a time."""
        n = self.count[key]
        upto = np.cumsum(n)
        cut = 0
        while cut < len(n):
            stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + HELD, side="right")))
            k = n[cut:stop]
            nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            entry = np.repeat(self.first[key[cut:stop]], k) + nth
            item, place = self.item[entry].astype(np.int64), self.place[entry].astype(np.int64)
            strip = (np.repeat(at[cut:stop], k) - place) // (self.edits[item] + 1) - low
            yield (np.repeat(doc[cut:stop], k) * len(self.points) + item) * span + strip, place
            cut = stop

    def search(self, points: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
        if not len(self.keys):
            return []
        doc, at, key = self._meetings(points)
        if not len(doc):
            return []
        low, span = -self.longest - 2, max(len(p) for p in points) + self.longest + 4
        seen, shared = self._strips(code for code, _ in self._entries(doc, at, key, low, span))
        # a band is two strips wide: strip b with strip b + 1; they lie side by side in seen
        total = shared.copy()
        total[:-1] += np.where(seen[1:] == seen[:-1] + 1, shared[1:], 0)
        good = total >= self.bound[seen // span % len(self.points)]
        if not good.any():
            return []
        bands, total = seen[good], total[good]
        # repeated text meets the same place of an item again and again: places count once in a strip
        strips = np.unique(np.concatenate((bands, bands + 1)))
        width = self.longest + 1
        near = np.isin(doc, bands // span // len(self.points))
        once = [np.zeros(0, np.int64)]
        for code, place in self._entries(doc[near], at[near], key[near], low, span):
            which = np.minimum(np.searchsorted(strips, code), len(strips) - 1)
            own = strips[which] == code
            once.append(np.unique(which[own] * width + place[own]))
        strip, count = np.unique(np.unique(np.concatenate(once)) // width, return_counts=True)
        places = self._of(strips[strip], count, bands) + self._of(strips[strip], count, bands + 1)
        bound = self.bound[bands // span % len(self.points)]
        best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
        for c, count in zip(bands[places >= bound].tolist(), total[places >= bound].tolist()):
            d, i = divmod(c // span, len(self.points))
            if (d, i) not in best or best[d, i][2]:
                hit = self._verify(points[d], i, (c % span + low) * (int(self.edits[i]) + 1))
                if hit and ((d, i) not in best or hit[0] < best[d, i][2]):
                    best[d, i] = (d, int(self.numbers[i]), *hit, count)
        return list(best.values())

    @staticmethod
    def _strips(codes: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes and how often each occurs."""
        seen, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for code in codes:
            own, count = np.unique(code, return_counts=True)
            if len(seen):
                own, place = np.unique(np.concatenate((seen, own)), return_inverse=True)
                count = np.bincount(place, weights=np.concatenate((shared, count)), minlength=len(own)).astype(np.int64)
            seen, shared = own, count
        return seen, shared

    @staticmethod
    def _of(sorted_codes: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
        return np.where(sorted_codes[at] == wanted, values[at], 0)

    def _verify(self, text: np.ndarray, i: int, a: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item in the band that begins at diagonal a, if within its budget."""
        item, k = self.points[i], int(self.edits[i])
        part = text[max(0, a) : max(0, a + 2 * (k + 1)) + len(item)].tobytes()
        exact = part.find(item.tobytes())
        while exact >= 0 and exact % 4:
            exact = part.find(item.tobytes(), exact + 1)
        if exact >= 0:
            start = max(0, a) + exact // 4
            end = start + len(item)
            within = (start and _word(text[start - 1]) and _word(text[start])) or (end < len(text) and _word(text[end]) and _word(text[end - 1]))
            return None if len(item) < Q and within else (0, start, end)
        if not k:
            return None
        edits, end = banded_edits(item, text, a - k, a + 2 * (k + 1) - 1 + k, most=k)
        if edits > k:
            return None
        start = end - banded_edits(item[::-1], text[:end][::-1], -k - 1, k + 1, fixed_end=0)[1]
        return edits, max(0, start), end


_INDEX: dict[str, ItemIndex] = {}


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> list:
    """Broadcasts of (name, items), each of about block_chars characters at most, by hash of the item."""
    items = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    spark = benchmark.sparkSession
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        found = sorted(((r["k"], r["t"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, found))


def _index(block, edit_share: float) -> ItemIndex:
    name, items = block.value
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = ItemIndex(items, edit_share)
    return _INDEX[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """One row per document row and item found in it: key, item_id, edits, start, end, shared_qgrams.

    start and end are code points of the document. Case and kinds of white space do not count. An
    item has edit_share of its characters as budget; one of less than 8 characters must stand there
    as it is, not within a longer word. Empty and null items never match, nor do null texts; an item
    without id is reported with a null item_id. Repeated rows give repeated rows, equal items one row
    each; empty tables give none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(key, F.col(text).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    out = None
    for block in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block, edit_share)
            for batch in batches:
                found = index.search([t or "" for t in batch.column(1).to_pylist()])
                columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([index.ids[f[1]] for f in found], pa.int64())]
                columns += [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", "edits", "start", "end", "shared_qgrams"])

        part = rows.mapInArrow(tidy(run), f"`{key}` {kind}, item_id long, edits long, start long, end long, shared_qgrams long")
        out = part if out is None else out.unionAll(part)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """The documents in which no item is found, with all their columns; texts only pass through.

    What is found is as in find_leaks: null texts stay, repeated rows stay or go together, an empty
    benchmark removes nothing.
    """
    prepare(docs.sparkSession)
    columns = docs.columns
    for block in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block, edit_share)
            for batch in batches:
                found = {f[0] for f in index.search([t or "" for t in batch.column(columns.index(text)).to_pylist()])}
                yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
