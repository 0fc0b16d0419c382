"""Fill-in-the-middle against a plain version; chunks against their contract."""

import hashlib
import random
import re

import numpy as np
import pytest

from recordspark.llm import infill
from recordspark.llm.infill import LEAST, MOST, Combined, Memo, chunk_ends, fill_in_middle, restored

UNITS = re.compile(r"[^\n]*\n|[^\n]+")
MARKS = tuple(x.encode() for x in infill.MARKERS)


def plain(doc_id, text, rate=100):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in infill.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return n, form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def texts():
    rng = random.Random(11)
    line = lambda: "".join(rng.choices("ab é€😀 \r.<P>", k=rng.randrange(90)))
    out = [None, "", "\n", "\n\n", "a", "a\n", "\na", "x<P>y\n", "x<M>", "<S>", "<P", "é\n" * 3000, "z" * 40000]
    out += ["\n".join(line().replace("<P>", "") for _ in range(rng.randrange(200))) for _ in range(60)]
    shared = "\n".join(line().replace("<", "") for _ in range(400))
    out += [f"{k}\n" * k + shared for k in range(20)] + ["q" * k + "<S>" + "r" * 5000 for k in range(8185, 8195)]
    return out


@pytest.mark.parametrize("rate", [100, 40])
def test_like_plain(spark, rate):
    have = list(enumerate(texts())) + [(None, "a\nb"), (5, "a\n"), (5, "a\n")]
    docs = spark.createDataFrame([(k, t, 1, "clash") for k, t in have], "doc_id long, text string, n int, Output string")
    rows = fill_in_middle(docs.select("doc_id", "text", "n"), rate=rate).withColumn("back", restored()).collect()
    key = lambda r: (r[0] is None, r[0], r[5])
    want = sorted([(k, *plain(k, t, rate)) for k, t in have], key=key)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows], key=key) == want
    assert sorted(r.back for r in rows) == sorted(t or "" for _, t in have)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_chunks():
    for text in texts():
        data = (text or "").encode()
        raw = np.frombuffer(data, np.uint8)
        ends = chunk_ends(raw)
        assert (ends or [0])[-1] == len(data)
        sizes = np.diff([0, *ends])
        assert all(LEAST <= s < MOST + 4 for s in sizes[:-1])
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()


def test_shared_passages_share_chunks():
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh \n", k=60000)).encode()
    memo = Memo(MARKS)
    for head in (b"", b"another beginning\n" * 40):
        Combined(np.frombuffer(head + passage, np.uint8), memo)
    assert memo.hits > 30


def test_a_small_cache_changes_nothing_and_content_decides():
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choices("ab\né", k=50000)).encode(), np.uint8)
    big, small = Combined(data, Memo(MARKS)), Combined(data, Memo(MARKS, most=1000))
    assert big.units == small.units and all(big.cut(k) == small.cut(k) for k in range(0, big.units + 1, 7))
    a, b = b"x\n" * 200, b"x\n" * 199 + b"yy"
    memo = Memo(MARKS)
    assert len(memo.of(a).line_bytes) == 200 and len(memo.of(b).line_bytes) == 199


def test_long_text_crosses_hash_blocks():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefgh \n", k=3 << 20))
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = Combined(raw, Memo(MARKS))
    units = UNITS.findall(text)
    assert whole.units == len(units)
    k = len(units) // 2
    assert whole.cut(k) == (len("".join(units[:k])),) * 2


def test_markers_must_differ(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fill_in_middle(docs, markers=("<P>", "<P>x", "<M>"))
