"""The similarity join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordspark.llm import jaccard
from recordspark.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, words=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, num=90, den=100):
    sets = {i: sets_of(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 4)))
    rows, passage = [], [word() for _ in range(60)]
    for base in range(25):
        text = [word() for _ in range(rng.choice([1, 2, 3, 6, 11, 12, 14, 20, 24, 40, 150, 400]))]
        if base % 4 == 0:
            text = text[:20] + passage
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy + [word()]
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", "\t"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "ONE"), (5005, "é É"), (5006, "é É")]


@pytest.mark.parametrize("seed,most", [(1, None), (2, 0), (3, 30)])
def test_groups_equal_all_pairs(spark, seed, most, monkeypatch):
    if most is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *a: most)
    if seed == 2:
        monkeypatch.setattr(jaccard, "LARGE", 30)
    if seed == 3:
        monkeypatch.setattr(jaccard, "GROUP_ELEMENTS", 500)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in brute(rows).items() if c == i}


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.similar_groups(docs).collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 1, 2)]
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {x: find(x) for x in parent}
