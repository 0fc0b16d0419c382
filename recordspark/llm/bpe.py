"""BPE encoding and decoding with public tokenizer files.

Most texts are encoded run by run. A run is a stretch of letters with the space before it, or
what stands between two such; the pre-tokenizers in use always cut there, so the ids of a text are
the ids of its runs in order. Texts with letters outside Latin-1, control tokens or an apostrophe
before a first letter, where that cut may fail, are cut at single spaces or not at all. Each worker
keeps the ids of runs it has seen in a bounded table and asks the tokenizers library for new ones.

Long texts go by tree concatenation: a text is halved until each piece is small, the pieces are
dealt to all tasks and encoded there, and neighbours are joined pairwise. At each join a window of
tokens around it is encoded again, and grows until it holds, on each side, a token that the
piece's own encoding has at the same place. Up to such a token one side is right, and from it on
the other: in BPE a sequence of tokens is the encoding of its text if every two neighbours are the
encoding of theirs, and after splicing each two neighbours stand together in one of the encodings.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import CHUNK, OTHER_VALUES, VALUES, fresh, mix, powers, prepare, tidy

#: Letters of Latin-1 but for the signs that double as letters, which are foreign here.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
FOREIGN = re.compile("[^\x00-\x84\x86-\x9f\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xff]")
APOSTROPHE = re.compile(f"(?<![{LETTER}])'(?=[{LETTER}])")
#: White space that ends in another blank than the space: its last blank may stand alone before a letter.
BLANKS = re.compile(f"\\s[^\\S ](?=[{LETTER}])")
#: Runs that a worker remembers in each of two generations, and the longest of them in bytes.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of letters in the UTF-8 of Latin-1: A-Z, a-z, and after 0xC3 all but the signs of times and division.
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: Texts above this many code points are cut into halves.
PIECE_CHARS = 32_768


def run_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where runs begin: a stretch of letters (apostrophes between letters too) with one space before it, and what lies between."""
    letter = np.zeros(len(raw) + 2, bool)  # a blank on either side
    inner = letter[1:-1]
    inner[:] = _ASCII_LETTER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    inner[lead] = inner[lead + 1] = True
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    mark = np.flatnonzero(raw == 39)
    mark = mark[letter[mark] & letter[mark + 2] & ~edge[mark] & ~edge[mark + 1]]
    inner[mark] = True
    first = inner & (~letter[:-2] | edge[:-1])
    space = raw == 32
    opens = np.zeros(len(raw), bool)
    opens[:-1] = space[:-1] & first[1:] & ~edge[1:-1]
    after = ~inner & letter[:-2]
    start = opens | after | edge[:-1]
    start[1:] |= first[1:] & ~opens[:-1]
    start[:1] = True
    return np.flatnonzero(start)


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every run."""
    h1, h2 = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK, side="right")))
        a, b = int(start[k]), int(end[stop - 1])
        up, down = powers(b - a + 1)
        s, e = start[k:stop] - a, end[k:stop] - a
        for out, values in ((h1, VALUES), (h2, OTHER_VALUES)):
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[raw[a:b]] * up[: b - a], out=total[1:])
            out[k:stop] = (total[e] - total[s]) * down[s]
        k = stop
    size = (end - start).astype(np.uint64)
    return mix(h1 + size), h2 ^ size


class Encoder:
    """Ids of whole texts as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        pre = str(self.tokenizer.pre_tokenizer)
        self.keeps_spaces = "Removed" not in pre
        self.known: dict[int, tuple[bytes, int]] = {}
        self.earlier: dict[int, tuple[bytes, int]] = {}
        self.names: list[str] | None = None
        self.control = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        parting = [(k, t.content.encode()) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.parting = parting[0] if parting else None
        #: A space after other white space may belong to one token with it.
        self.unsafe = re.compile(r"\s ")

    def simple(self, text: str) -> bool:
        """Runs may be cut at letters."""
        return not (FOREIGN.search(text) or (self.keeps_spaces and BLANKS.search(text)) or ("'" in text and APOSTROPHE.search(text)) or any(c in text for c in self.control))

    def plain(self, text: str) -> bytes:
        """Ids of a text that is cut at single spaces or not at all."""
        if not self.keeps_spaces:
            parts = [x for x in text.split(" ") if x]
        elif self.unsafe.search(text):
            parts = [text]
        else:
            first, *rest = text.split(" ")
            parts = [x for x in (first, *[" " + x for x in rest]) if x]
        new = list(dict.fromkeys(parts))
        ids = {x: np.array(e.ids, "<u4").tobytes() for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
        return b"".join([ids[x] for x in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None if self.simple(t) else self.plain(t) for t in texts]
        easy = [k for k, x in enumerate(out) if x is None]
        if easy:
            for k, ids in zip(easy, self._by_runs([texts[k].encode() for k in easy])):
                out[k] = ids
        return out

    def _each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each run: many at once with a control token between, which parts texts before anything else happens."""
        if self.parting is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        number, mark = self.parting
        out: list[bytes] = []
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == number)
            assert len(cut) == len(part) - 1
            every, begin = ids.tobytes(), [0, *((cut + 1) * 4).tolist()]
            out += [every[x:y] for x, y in zip(begin, [*(cut * 4).tolist(), len(every)])]
        return out

    def _by_runs(self, texts: list[bytes]) -> list[bytes]:
        """All runs of the texts are hashed together; each distinct one is looked up once and its ids dealt to its places."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start = run_starts(raw, offsets)
        if not len(start):
            return [b""] * len(texts)
        end = np.append(start[1:], len(raw))
        h1, h2 = run_hashes(raw, start, end)
        distinct, first, place = np.unique(h1, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.earlier = {}, self.known
        known, earlier, second = self.known, self.earlier, h2[first].tolist()
        ids: list[bytes | None] = []
        for key, other, have in zip(distinct.tolist(), second, map(known.get, distinct.tolist())):
            if have is None and key in earlier:
                have = known[key] = earlier[key]
            ids.append(have[0] if have is not None and have[1] == other else None)
        new = [k for k, x in enumerate(ids) if x is None]
        whole = raw.tobytes()
        words = [whole[start[f] : end[f]] for f in first[new].tolist()]
        for k, w, own in zip(new, words, self._each(words)):
            ids[k] = own
            if len(w) <= LONGEST:
                known[int(distinct[k])] = (own, second[k])
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.array([len(x) for x in ids]) // 4
        begin = np.cumsum(size) - size
        count = size[place]
        upto = np.concatenate(([0], np.cumsum(count)))
        dealt = flat[np.repeat(begin[place] - upto[:-1], count) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(start, offsets)]
        return [dealt[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each token begins and ends in the text."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, "<u4"), at[:, 0], at[:, 1]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        if self.names is None:
            self.names = [self.tokenizer.id_to_token(k) for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        names = self.names
        return " ".join([names[k] for k in numbers])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


Piece = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def _clean(starts: np.ndarray, ends: np.ndarray, k: int) -> bool:
    """No character is shared by the tokens before and after place k."""
    return k <= 0 or k >= len(starts) or starts[k] >= ends[k - 1]


def _common(a: Piece, shift_a: int, lo_a: int, b: Piece, shift_b: int, hi_b: int, last: bool) -> tuple[int, int] | None:
    """First or last token that a (from token lo_a) and b (up to token hi_b) have at the same place."""
    _, ia, sa, ea = a
    _, ib, sb, eb = b
    at = {(int(ib[k]), int(sb[k]) + shift_b, int(eb[k]) + shift_b): k for k in range(hi_b) if _clean(sb, eb, k + 1) and _clean(sb, eb, k)}
    places = range(lo_a, len(ia))
    for k in reversed(places) if last else places:
        hit = at.get((int(ia[k]), int(sa[k]) + shift_a, int(ea[k]) + shift_a))
        if hit is not None and _clean(sa, ea, k + 1) and _clean(sa, ea, k):
            return k, hit
    return None


def join_pieces(left: Piece, right: Piece, spans, width: int = 16) -> Piece:
    """The encoding of both texts together, from theirs and from windows of growing width."""
    (lt, li, ls, le), (rt, ri, rs, re_) = left, right
    while True:
        a, b = max(0, len(li) - width), min(len(ri), width)
        while not _clean(ls, le, a) and a > 0:
            a -= 1
        while b < len(ri) and not _clean(rs, re_, b):
            b += 1
        begin = int(ls[a]) if a > 0 else 0
        stop = int(rs[b]) if b < len(ri) else len(rt)
        window: Piece = (lt[begin:] + rt[:stop], *spans(lt[begin:] + rt[:stop]))
        _, wi, ws, we = window
        here = len(lt) - begin  # where the right text begins in the window
        keep_l, from_w, upto_w, from_r = 0, 0, len(wi), len(ri)
        agreed = True
        if a > 0:
            hit = _common(left, -begin, a, window, 0, len(wi), last=False)
            agreed = hit is not None
            if hit:
                keep_l, from_w = hit[0] + 1, hit[1] + 1
        if agreed and b < len(ri):
            hit = _common(window, -here, from_w, right, 0, b, last=True)
            agreed = hit is not None
            if hit:
                upto_w, from_r = hit[0] + 1, hit[1] + 1
        if agreed:
            ids = np.concatenate((li[:keep_l], wi[from_w:upto_w], ri[from_r:]))
            starts = np.concatenate((ls[:keep_l], ws[from_w:upto_w] + begin, rs[from_r:] + len(lt)))
            ends = np.concatenate((le[:keep_l], we[from_w:upto_w] + begin, re_[from_r:] + len(lt)))
            return lt + rt, ids, starts, ends
        width *= 2


def join_tree(pieces: list[Piece], spans) -> Piece:
    """Neighbours pairwise, level by level."""
    while len(pieces) > 1:
        pieces = [join_pieces(*pieces[k : k + 2], spans) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False, keep: tuple[str, ...] = (), piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document: key, the columns in keep, n_tokens, ids (binary, unsigned 32-bit little-endian) and, if asked for, decoded.

    A null text is empty and has no ids; repeated rows stay repeated; an empty table gives none.
    path is the tokenizer's file, present on every executor.
    """
    prepare(docs.sparkSession)
    carried = list(dict.fromkeys((key, *keep)))
    body, row_no, count_, no, piece, ids_, at_ = fresh(carried, "body", "row_no", "pieces", "piece_no", "piece", "piece_ids", "piece_at")
    rows = docs.select(*carried, F.coalesce(F.col(text), F.lit("")).alias(body))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carried).schema)
    schema = f"{head}, n_tokens long, ids binary" + ", decoded string" * decoded

    def result(table: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        columns = [table.column(k) for k in range(len(carried))]
        columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        if decoded:
            columns.append(pa.array([encoder(path).decode(x) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[*carried, "n_tokens", "ids", *["decoded"] * decoded])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch, encoder(path).encode(batch.column(len(carried)).to_pylist()))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoder(path).spans(t) for t in batch.column(piece).to_pylist()]
            extra = [pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([np.concatenate(x[1:]).astype("<i8").tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, ids_, at_])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(no)
        pieces = []
        for t, ids, at in zip(group[piece], group[ids_], group[at_]):
            at = np.frombuffer(at, "<i8").reshape(2, -1)
            pieces.append((t, np.frombuffer(ids, "<u4"), at[0], at[1]))
        _, ids, _, _ = join_tree(pieces, encoder(path).spans)
        out = group.iloc[:1][carried].copy()
        out["n_tokens"], out["ids"] = len(ids), [ids.astype("<u4").tobytes()]
        if decoded:
            out["decoded"] = [encoder(path).decode(ids.astype("<u4").tobytes())]
        return out

    size = F.length(body)
    short = rows.where(size <= piece_chars).mapInArrow(tidy(whole), schema)
    halvings = F.ceil(F.log2(size / piece_chars))
    long = rows.where(size > piece_chars).withColumn(row_no, F.monotonically_increasing_id()).withColumn(count_, F.pow(F.lit(2.0), halvings).cast("long"))
    cut = long.withColumn(no, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count_) - 1)))
    bound = lambda k: F.floor(k * F.length(body) / F.col(count_)).cast("int")
    begin, end = bound(F.col(no)), bound(F.col(no) + 1)
    cut = cut.select(*carried, row_no, no, F.substring(F.col(body), begin + 1, end - begin).alias(piece))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: pieces are small but take long
    pieces = cut.repartition(tasks, row_no, no).mapInArrow(tidy(halves), f"{head}, `{row_no}` long, `{no}` long, `{piece}` string, `{ids_}` binary, `{at_}` binary")
    return short.unionByName(pieces.groupBy(row_no).applyInPandas(together, schema))
