"""Syncmer fingerprints against a plain version, and what makes them useful."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recordspark.llm import syncmers
from recordspark.llm.syncmers import K, PIECE, S, anchors, edited_prints, fingerprints, with_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(words):
    return hashlib.md5(" ".join(words).encode()).hexdigest()[:8]


def plain(text, k=K, s=S):
    w = WORD.findall(text or "")
    out, before = [], 0
    for i in range(len(w) - k + 1):
        runs = [md5(w[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(runs) in (runs[0], runs[-1]):
            out.append(f"{i - before}{md5(w[i : i + k])}")
            before = i
    return out or (["9" + md5(w)] if w else [])


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def texts(n=60, seed=1, most=400):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "a b c d", "a b c d e", "a b c d e f g", "x " * 300, "é€ 😀\x0b" * 50, "word" * 5000]
    return out + [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("k", "s"), [(5, 2), (4, 1), (9, 3)])
def test_pieces(spark, k, s):
    have = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(have)], "doc_id long, text string, words string")
    for r in with_pieces(docs, "text", "out", k, s).collect():
        assert r.out == plain(have[r.doc_id], k, s), have[r.doc_id]
        assert all(x[0] == "9" or int(x[0]) <= k - s for x in r.out)
    with pytest.raises(ValueError):
        with_pieces(docs, "text", "out", 3, 2)


def test_anchors_are_free_of_context(spark):
    rng = random.Random(5)
    passage = " ".join("w%d" % rng.randrange(1000) for _ in range(200))
    docs = spark.createDataFrame([(1, passage), (2, "some other words in front " + passage + " and more behind it"), (2, "one two")], "doc_id long, text string")
    found = [(r.doc_id, r.place, r.hash) for r in anchors(fingerprints(docs)).collect()]
    one, two = {(p, h) for d, p, h in found if d == 1}, {(p - 5, h) for d, p, h in found if d == 2}
    assert len(one) > 50 and one <= two
    assert (2, 0, plain("one two")[0][1:]) in found


def test_shared_places(spark):
    rng = random.Random(6)
    words = lambda n, t: [f"{t}{rng.randrange(10**6)}" for _ in range(n)]
    passage, line = words(120, "p"), words(8, "r")
    texts = {1: words(30, "a") + passage + line * 20, 2: words(50, "b") + passage + words(5, "c") + line * 20, 3: words(90, "d")}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "a long, b long")
    out = syncmers.shared_places(fingerprints(docs), pairs).orderBy(F.desc("n_anchors")).collect()
    top = out[0]
    assert (top.a, top.b, top.shift) == (1, 2, 20) and top.n_anchors > 40 and top.first_place >= 30 and top.last_place <= 150
    assert {(r.a, r.b) for r in out} == {(1, 2)} and sum(r.n_anchors for r in out) < 140


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((key, len(text), edited, "".join(a), "".join(b), round(dice(a, b), 9), round(dice(a, c), 9)))
    return sorted(out, key=str)


def got(docs):
    return sorted([(r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in edited_prints(docs).collect()], key=str)


def test_edited(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET", 700)
    monkeypatch.setattr(syncmers, "TASK", 3000)
    rng = random.Random(8)
    rows = [(rng.randrange(-50, 10**6), t) for t in texts(150, 2, 120)] + [(None, "a null id"), (None, None), (77, "same id"), (77, "same id"), (77, "b")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket_ string")
    assert got(docs) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(3, "only one row here, it follows itself")], [(None, "a b"), (None, None)], [(1, "a b c d e f"), (2, "a b c d e f")]])
def test_small(spark, rows):
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_likeness_tells_edits_from_strangers(spark):
    rng = random.Random(9)
    rows = [(k, " ".join("w%d" % rng.randrange(3000) for _ in range(rng.randint(60, 400)))) for k in range(80)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert min(r[5] for r in out) > 0.5 and max(r[6] for r in out) < 0.05
    assert all(len(r[3]) % PIECE == 0 for r in out)
