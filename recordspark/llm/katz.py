"""Katz backoff over words: Good-Turing discounts and exactly normalised backoff weights.

    P(w2 | w1) = d(c12) c12 / c1            if the pair was seen,
                 alpha(w1) P(w2)            otherwise,
    P(w)       = d(c) c / N, or the mass that discounts leave for a word never seen.

Documents become blocks of a few million tokens: a local vocabulary of 64-bit word hashes and the
tokens as local numbers. Counts live in tables partitioned by hash. A block sends each part its
distinct words (then pairs) with its training counts; the part sums them and sends the sums back,
in the block's order. So one token is shuffled once per block it is distinct in, whatever its
frequency, counting and look-up share that exchange, and nothing is broadcast that grows with the
vocabulary. Contexts with more than their part's share of all tokens are spread over all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import mix, pack, prepare, text_buffer, unpack, word_hashes, written

#: Counts up to this are discounted.
K = 5
#: Tokens of a block, and of all blocks for each part of the count tables.
BLOCK_TOKENS, PART_TOKENS = 1_500_000, 3_000_000
#: The end of a text, a token like any other, and what stands before its first token.
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0..d_K from counts of counts n[1..K+1], by Katz's formula over Good-Turing estimates.

    If the plain estimates (r + 1) n[r + 1] / n[r] make it unsound (an empty n[r], or a d outside
    0..1), all n[r] are smoothed first: a line through log n[r] over log r, falling faster than 1 / r.
    With one n[r] or none above zero there is no line: half a count is taken off each.
    """
    d, r = np.ones(K + 1), np.arange(1, K + 2)
    n = n[1 : K + 2].astype(float)
    if not (n > 0).all() or not _katz(n, d):
        some = n > 0
        if some.sum() < 2:
            d[1:] = 1 - 0.5 / r[:K]
            return d
        x, y = np.log(r[some]), np.log(n[some])
        slope = min(float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()), -1.1)
        _katz(r.astype(float) ** slope, d)
    return d


def _katz(n: np.ndarray, d: np.ndarray) -> bool:
    """Sets d[1..K] from n[1..K+1] if the formula is sound."""
    r = np.arange(1, K + 1)
    common = (K + 1) * n[K] / n[0]
    own = (r + 1) * n[1:] / (r * n[:-1])
    x = (own - common) / (1 - common) if common < 1 else np.zeros(K)
    sound = bool((x > 0).all() and (x <= 1).all())
    if sound:
        d[1:] = x
    return sound


@dataclass(frozen=True)
class Unigrams:
    """n_tokens N and n_types V of the training text, discounts and the scale that leaves some mass for new words."""

    total: int
    types: int
    d: np.ndarray
    scale: float
    unseen: float

    @classmethod
    def fit(cls, total: int, types: int, n: np.ndarray) -> Unigrams:
        if not total:
            return cls(0, 0, np.ones(K + 1), 1.0, 1.0)
        d = discounts(n)
        left = float((np.arange(1, K + 1) * n[1 : K + 1] * (1 - d[1:])).sum() / total)
        if left < 1 / (total + 1):
            return cls(total, types, d, (1 - 1 / (total + 1)) / (1 - left), 1 / (total + 1))
        return cls(total, types, d, 1.0, left)

    def p(self, c: np.ndarray) -> np.ndarray:
        known = self.scale * self.d[np.minimum(c, K) * (c <= K)] * c / max(self.total, 1)
        return np.where(c > 0, known, self.unseen)


def make_blocks(docs: DataFrame, text: str, key: str, held: str) -> DataFrame:
    """One row per block: block, n_tokens, ids, sizes, held, vocab, counts (training), stream."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(held).alias("held"), F.col(text).alias("t"))
    names = ["block", "n_tokens", "ids", "known", "sizes", "held", "vocab", "counts", "stream"]

    def block(number: int, parts: list) -> pa.RecordBatch:
        ids, valid, held, sizes, h = (np.concatenate(x) for x in zip(*parts))
        vocab, inverse = np.unique(h, return_inverse=True)
        order = np.argsort(-np.bincount(inverse, minlength=len(vocab)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        stream = rank[inverse]
        counts = np.bincount(stream[np.repeat(~held, sizes)], minlength=len(vocab)).astype("<u4")
        blobs = [ids.astype("<i8"), valid.astype(np.uint8), sizes.astype("<u4"), held.astype(np.uint8), vocab[order], counts, stream]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(h)], pa.int64()), *[pa.array([pack(x)], pa.binary()) for x in blobs]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, first = word_hashes(*text_buffer(batch.column(2)))
            sizes = np.diff(first) + 1
            column = batch.column(0)
            parts.append((column.fill_null(0).to_numpy(), np.asarray(column.is_valid()), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes, np.insert(h, first[1:], END)))
            size += int(sizes.sum())
            if size >= BLOCK_TOKENS:
                yield block(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield block(number, parts)

    return written(rows.mapInArrow(run, "block long, n_tokens long, " + ", ".join(f"{x} binary" for x in names[2:])), "katz-blocks")


def _row(names: list[str], **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], pa.int64() if n in ("part", "block") else pa.binary()) for n in names], names=names)


_REPLY = ["part", "block", "a", "b", "c"]
_REPLY_SCHEMA = "part long, block long, a binary, b binary, c binary"


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[: K + 2].astype("<i8")


def count_words(blocks: DataFrame, parts: int) -> DataFrame:
    """Replies (part, block, a: training counts of the block's words of that part) and, with a null block, each part's totals."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, vocab, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                vocab, counts = unpack(vocab, "<u8"), unpack(counts, "<u4")
                part = (vocab % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part).tolist():
                    own = part == p
                    yield _row(_REPLY, part=p, block=number, a=pack(vocab[own]), b=pack(counts[own]))

    def answer(group: pa.Table) -> pa.Table:
        words = [unpack(x, "<u8") for x in group["a"].to_pylist()]
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unpack(x, "<u4") for x in group["b"].to_pylist()]), minlength=len(every)).astype(np.int64)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        out = [_row(_REPLY, part=group["part"][0].as_py(), block=b, a=pack(total[at].astype("<i8"))) for b, at in zip(group["block"].to_pylist(), np.split(place, cuts))]
        sums = np.concatenate(([total.sum(), (total > 0).sum()], _counts_of_counts(total)))
        out.append(_row(_REPLY, part=group["part"][0].as_py(), a=sums.astype("<i8").tobytes()))
        return pa.Table.from_batches(out)

    asked = blocks.select("block", "vocab", "counts").mapInArrow(ask, _REPLY_SCHEMA)
    return written(asked.groupBy("part").applyInArrow(answer, _REPLY_SCHEMA), "katz-words")


class Block:
    """A block's tokens with the training count of each of its words."""

    def __init__(self, row: pa.Table, replies: list[tuple[int, bytes]], parts: int):
        get = lambda n, kind: unpack(row[n][0].as_py(), kind)
        self.ids, self.valid, self.sizes, self.held = get("ids", "<i8"), get("known", "u1").astype(bool), get("sizes", "<u4").astype(np.int64), get("held", "u1").astype(bool)
        self.vocab, self.stream = get("vocab", "<u8"), get("stream", "<u4").astype(np.int64)
        self.count = np.zeros(len(self.vocab), np.int64)
        part = (self.vocab % np.uint64(parts)).astype(np.int64)
        for p, blob in replies:
            self.count[part == p] = unpack(blob, "<i8")
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as (first, second) local numbers, -1 for the start; each token's pair; training counts."""
        before = np.empty(len(self.stream), np.int64)
        before[1:] = self.stream[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = -1
        width = np.int64(len(self.vocab))
        code, place = np.unique((before + 1) * width + self.stream, return_inverse=True)
        counts = np.bincount(place[~self.held[self.of]], minlength=len(code))
        return code // width - 1, code % width, place, counts


def _context_parts(context: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    spread = np.where(hot, mix(context * np.uint64(3) + word), mix(context))
    return (spread % np.uint64(parts)).astype(np.int64)


def _ask_pairs(block: Block, uni: Unigrams, parts: int, n_train_docs: int):
    """The block's distinct pairs in part order: (part bounds, order, contexts, hot flags, first, second, place, counts)."""
    first, second, place, counts = block.pairs()
    context = np.where(first < 0, START, block.vocab[np.maximum(first, 0)])
    c1 = np.where(first < 0, n_train_docs, block.count[np.maximum(first, 0)])
    hot = c1 > max(uni.total // parts, 1)
    part = _context_parts(context, block.vocab[second], hot, parts)
    order = np.lexsort((block.vocab[second], context, part))
    return np.searchsorted(part[order], np.arange(parts + 1)), order, context, c1, hot, first, second, place, counts


def count_pairs(blocks: DataFrame, words: DataFrame, uni: Unigrams, parts: int, n_train_docs: int) -> DataFrame:
    """Replies (part, block, a: pair counts, b: per context of the request S_1..S_K and Q, c: none); null block: totals and hot contexts.

    S_r: tokens after the context in pairs of count r. Q: unigram mass of the words seen after it.
    """

    def ask(_key, own: pa.Table, replies: pa.Table) -> Iterator[pa.RecordBatch]:
        block = Block(own, list(zip(replies["part"].to_pylist(), replies["a"].to_pylist())), parts)
        bounds, order, context, _, hot, _, second, _, counts = _ask_pairs(block, uni, parts, n_train_docs)
        for p in range(parts):
            at = order[bounds[p] : bounds[p + 1]]
            if not len(at):
                continue
            heads, runs = _runs(context[at])
            used, local = np.unique(second[at], return_inverse=True)
            a = pack(heads), _join(pack(runs.astype("<u4")), pack(hot[at][np.cumsum(runs) - runs].astype("u1")))
            b = pack(block.vocab[used]), pack(block.count[used].astype("<i8"))
            c = pack(local.astype("<u4")), pack(counts[at].astype("<u4"))
            yield _row(_REPLY, part=p, block=own["block"][0].as_py(), a=_join(*a), b=_join(*b), c=_join(*c))

    def asked_group(key, own: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({n: pa.array([], pa.int64() if n in ("part", "block") else pa.binary()) for n in _REPLY})
        return pa.Table.from_batches(list(ask(key, own, replies)))

    def answer(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        w1, w2, c2, c12, heads, hot = [], [], [], [], [], []
        for a, b, c in zip(*(group[n].to_pylist() for n in "abc")):
            (h, runs), (used, cu), (local, cc) = _split(a), _split(b), _split(c)
            runs, flags = _split(runs)
            h, runs, used, cu, local, cc = unpack(h, "<u8"), unpack(runs, "<u4"), unpack(used, "<u8"), unpack(cu, "<i8"), unpack(local, "<u4"), unpack(cc, "<u4")
            w1.append(np.repeat(h, runs)), w2.append(used[local]), c2.append(cu[local]), c12.append(cc), heads.append(h)
            hot.append(h[unpack(flags, "u1") > 0])
        cuts = np.cumsum([len(x) for x in w1])[:-1]
        w1, w2, c2, c12 = np.concatenate(w1), np.concatenate(w2), np.concatenate(c2), np.concatenate(c12).astype(np.int64)
        order = np.lexsort((w2, w1))
        s1, s2 = w1[order], w2[order]
        new = np.ones(len(order), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        pair = np.cumsum(new) - 1
        total = np.bincount(pair, weights=c12[order], minlength=pair[-1] + 1).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = pair
        every, of = np.unique(s1[new], return_inverse=True)
        sums = np.stack([np.bincount(of, weights=total * (total == r), minlength=len(every)) for r in range(1, K + 1)]).astype("<i8")
        q = np.bincount(of, weights=uni.p(c2[order][new]) * (total > 0), minlength=len(every))
        out = []
        for b, at, h in zip(group["block"].to_pylist(), np.split(place, cuts), heads):
            k = np.searchsorted(every, h)
            out.append(_row(_REPLY, part=part, block=b, a=pack(total[at].astype("<i8")), b=_join(pack(sums[:, k].ravel()), pack(q[k]))))
        big = np.searchsorted(every, np.unique(np.concatenate(hot)))
        out.append(_row(_REPLY, part=part, a=_counts_of_counts(total).tobytes(), b=_join(every[big].tobytes(), sums[:, big].astype("<i8").tobytes()), c=q[big].tobytes()))
        return pa.Table.from_batches(out)

    replies = words.where("block is not null").select("part", "block", "a")
    asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda key, own, r: asked_group(key, own, r), _REPLY_SCHEMA)
    return written(asked.groupBy("part").applyInArrow(answer, _REPLY_SCHEMA), "katz-pairs")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    start = np.flatnonzero(new)
    return sorted_values[start], np.diff(np.append(start, len(sorted_values)))


def _join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _split(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:8], "little")
    return x[8 : 8 + n], x[8 + n :]


def score_documents(docs: DataFrame, held: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held names a boolean column: rows that the model does not learn from. Tokens are words, lower-cased
    in A-Z, and one end per text; a null text has the end only. base_score is the add-one unigram
    log10 probability; score is the backoff model's. Words never seen in training share one
    unseen class, as in base_score. Without training rows every score is 0. Repeated rows are
    learned as often as they stand there; null ids stay; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    blocks = make_blocks(docs, text, key, held)
    n_docs_held = docs.agg(F.count(F.when(~F.col(held), 1)).alias("n"), F.count("*")).first()
    n_train_docs = int(n_docs_held[0])
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = max(1, -(-tokens // PART_TOKENS))
    words = count_words(blocks, parts)
    sums = np.zeros(K + 4, np.int64)
    for r in words.where("block is null").select("a").collect():  # one row per part
        sums += np.frombuffer(r["a"], "<i8")
    uni = Unigrams.fit(int(sums[0]), int(sums[1]), sums[2:])
    pairs = count_pairs(blocks, words, uni, parts, n_train_docs)
    n2, spread = np.zeros(K + 2, np.int64), {}
    for r in pairs.where("block is null").orderBy("part").collect():  # one row per part, frequent contexts only
        n2 += np.frombuffer(r["a"], "<i8")
        heads, s = _split(r["b"])
        heads, s, q = np.frombuffer(heads, "<u8"), np.frombuffer(s, "<i8").reshape(K, -1), np.frombuffer(r["c"], "<f8")
        for k, h in enumerate(heads.tolist()):
            have = spread.setdefault(h, [np.zeros(K, np.int64), 0.0])
            have[0] = have[0] + s[:, k]
            have[1] += float(q[k])
    d2 = discounts(n2)

    def score(own: pa.Table, replies: pa.Table) -> pa.Table:
        names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(own):
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})
        kind, part, a, b = (replies[n].to_pylist() for n in ("kind", "part", "a", "b"))
        block = Block(own, [(p, x) for k, p, x in zip(kind, part, a) if k == 1], parts)
        bounds, order, context, c1, hot, _, second, place, _ = _ask_pairs(block, uni, parts, n_train_docs)
        c12, alpha, scale = np.zeros(len(order), np.int64), np.ones(len(order)), np.ones(len(order))
        for k, p, x, y in zip(kind, part, a, b):
            if k != 2:
                continue
            at = order[bounds[p] : bounds[p + 1]]
            c12[at] = unpack(x, "<i8")  # 64 bits: frequent pairs of a very large corpus pass 2^32; their empty byte planes pack away
            heads, runs = _runs(context[at])
            s, q = _split(y)
            s, q = unpack(s, "<i8").copy().reshape(K, -1), unpack(q, "<f8").copy()
            start = np.cumsum(runs) - runs
            for i in np.flatnonzero(hot[at][start]).tolist():
                s[:, i], q[i] = spread[int(heads[i])]
            n1 = c1[at][start].astype(float)
            lost = ((1 - d2[1:])[:, None] * s).sum(axis=0)
            left = np.where(n1 > 0, lost / np.maximum(n1, 1), 1.0)
            tight = (n1 > 0) & (left * (n1 + 1) < 1e-9)
            left = np.where(tight, 1 / (n1 + 1), left)
            alpha[at] = np.repeat(np.where(n1 > 0, left / np.maximum(1 - q, 1e-300), 1.0), runs)
            scale[at] = np.repeat(np.where(tight, n1 / (n1 + 1), 1.0), runs)
        seen = scale * d2[np.minimum(c12, K) * (c12 <= K)] * c12 / np.maximum(c1, 1)
        p2 = uni.p(block.count)
        log = np.log10(np.where(c12 > 0, seen, alpha * p2[second]))
        base = np.log10((block.count + 1) / (uni.total + uni.types + 1))
        n = len(block.sizes)
        add = lambda w: np.bincount(block.of, weights=w, minlength=n)
        known = add((block.count > 0)[block.stream]).astype(np.int64)
        columns = [pa.array(block.ids, pa.int64(), mask=~block.valid), pa.array(block.held), pa.array(block.sizes), pa.array(known), pa.array(np.full(n, uni.total, np.int64)), pa.array(add(base[block.stream])), pa.array(add(log[place]))]
        return pa.table(columns, names=names)

    replies = words.where("block is not null").select("block", F.lit(1).alias("kind"), "part", "a", "b").unionAll(pairs.where("block is not null").select("block", F.lit(2).alias("kind"), "part", "a", "b"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
