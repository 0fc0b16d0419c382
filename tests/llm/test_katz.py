"""Katz backoff against a plain dictionary version, and its sums over the vocabulary."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordspark.llm import katz
from recordspark.llm.katz import K, Unigrams, discounts, score_documents


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Plain:
    def __init__(self, texts):
        self.uni, self.pair, self.ctx = Counter(), Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            for a, b in zip(["<s>", *w], w):
                self.pair[a, b] += 1
                self.ctx[a] += 1
        counts = lambda c: np.array([sum(1 for v in c.values() if v == r) for r in range(K + 2)])
        self.n = sum(self.uni.values())
        self.u = Unigrams.fit(self.n, len(self.uni), counts(self.uni))
        self.d = discounts(counts(self.pair))

    def p1(self, w):
        return float(self.u.p(np.array([self.uni[w]]))[0])

    def own(self, a, b):
        c, n = self.pair[a, b], self.ctx[a]
        return (self.d[c] if c <= K else 1.0) * c / n

    def p(self, a, b):
        if not self.ctx[a]:
            return self.p1(b)
        after = [w for x, w in self.pair if x == a]
        left, scale = 1 - sum(self.own(a, w) for w in after), 1.0
        if left * (self.ctx[a] + 1) < 1e-9:
            left, scale = 1 / (self.ctx[a] + 1), self.ctx[a] / (self.ctx[a] + 1)
        if self.pair[a, b]:
            return scale * self.own(a, b)
        return left / (1 - sum(self.p1(w) for w in after)) * self.p1(b)


@pytest.mark.parametrize("part_tokens", [10**9, 40])
def test_scores_equal_plain_version(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(katz, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 60)
    rng = random.Random(part_tokens)
    vocab = ["the"] * 12 + ["of"] * 6 + ["w%d" % k for k in range(60)] + ["É", "The"]
    rows = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 12))), k % 4 == 0) for k in range(80)]
    rows += [(None, "the of", False), (900, None, False), (901, "", True), (902, "unheard the\tof", True), (7, rows[7][1], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean").withColumn("block", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_documents(docs, "h").collect())
    m = Plain([t for _, t, h in rows if not h])
    want = []
    for k, t, h in rows:
        w = tokens(t)
        base = sum(math.log10((m.uni[x] + 1) / (m.n + len(m.uni) + 1)) for x in w)
        full = sum(math.log10(m.p(a, b)) for a, b in zip(["<s>", *w], w))
        want.append((k or -1, h, len(w), sum(1 for x in w if m.uni[x]), m.n, round(base, 6), round(full, 6)))
    assert got == sorted(want)
    for a in ["<s>", "the", "w3", "unheard"]:
        assert sum(m.p(a, b) for b in [*m.uni, "unheard"]) == pytest.approx(1)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, h boolean")
    assert [r.score for r in score_documents(docs, "h").collect()] == [0.0]
    assert score_documents(docs.limit(0), "h").count() == 0


def test_discounts():
    r = np.arange(1, K + 1)
    n = np.array([0, 1000, 400, 180, 110, 70, 50])  # sound: Katz's formula as it stands
    own, common = (r + 1) * n[2:] / (r * n[1:-1]), (K + 1) * n[K + 1] / n[1]
    assert discounts(n)[1:].tolist() == pytest.approx(((own - common) / (1 - common)).tolist())
    for odd in ([0, 100, 90, 0, 40, 30, 20], [0, 5, 50, 3, 9, 1, 7], [0, 3, 2, 0, 0, 0, 0], [0, 10**6, 1, 1, 1, 1, 1]):
        d = discounts(np.array(odd))
        assert d[0] == 1 and (d[1:] > 0).all() and (d[1:] <= 1).all() and (np.diff(d[1:]) >= 0).all(), odd
    assert discounts(np.zeros(K + 2)).tolist() == discounts(np.array([0, 7, 0, 0, 0, 0, 0])).tolist() == [1, *(1 - 0.5 / r)]
