"""Keyword search by one automaton against plain search."""

import random

import pytest

from recordspark.operators import keywords
from recordspark.operators import linkage as L
from recordspark.operators import mining as M
from recordspark.operators.keywords import keyword_scores


def plain_topics(text, taxonomy, k):
    low, score = (text or "").lower(), {}
    for topic, word in taxonomy:
        if word and low.count(word):
            score[topic] = score.get(topic, 0) + low.count(word)
    order = sorted(((n, t) for t, n in score.items()), reverse=True)[:k]
    return [(t, n, i + 1) for i, (n, t) in enumerate(order)] or [(M.DEFAULT_TOPIC, 0, 1)]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_topics_equal_plain(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_CHARS", most)
    rng = random.Random(2)
    taxonomy = [(rng.choice("xyzw"), "".join(rng.choices("abé", k=rng.randint(1, 4)))) for _ in range(40)] + [("x", "aa"), ("y", "aa"), ("z", "")]
    texts = [None, "", "AAAAA", "q"] + ["".join(rng.choices("abÉé ", k=rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "AAAAA")], "doc_id long, text string")
    got = sorted((r.doc_id, r.topic, r.score, r["rank"]) for r in M.topic_scores(docs, spark.createDataFrame(taxonomy, "topic string, keyword string"), 3).collect())
    want = sorted((k, *t) for k, text in [*enumerate(texts), (2, "AAAAA")] for t in plain_topics(text, taxonomy, 3))
    assert got == want
    bare = M.topic_scores(docs, spark.createDataFrame([], "topic string, keyword string"), 3)
    assert {r.topic for r in bare.collect()} == {M.DEFAULT_TOPIC}


def test_a_hundred_thousand_keywords(spark):
    words = spark.range(100_000).selectExpr("concat('k', id, 'x') keyword", "concat('t', id % 7) label")
    docs = spark.range(300).selectExpr("id doc_id", "concat('k', id * 300, 'x k', id * 300, 'x and k', id, 'x, k1000000x') text")
    found = keyword_scores(docs, "text", words, "keyword", "label", "hits")
    for r in found.collect():
        want = {}
        for k, n in ((300 * r.doc_id, 2), (r.doc_id, 1)):
            want[f"t{k % 7}"] = want.get(f"t{k % 7}", 0) + n
        assert {x.label: x.n for x in r.hits} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_noise_equals_plain(spark):
    rng = random.Random(3)
    modes = ["exato", "prefixo", "contem"]
    rules = [(k, "".join(rng.choices("ab c", k=rng.randint(1, 4))).strip() or "a", rng.choice(modes), f"r{k}") for k in range(30)] + [(40, "", "exato", "blank"), (41, "Ab!", "exato", "said"), (None, None, "exato", "null")]
    values = [None, "", "ab", "B", "zz"] + ["".join(rng.choices("ab cd", k=rng.randrange(9))) for _ in range(80)]
    norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())

    def fits(v, text, mode):
        return {"exato": v == text, "prefixo": v.startswith(text), "contem": text in v}[mode]

    want = {}
    for k, v in enumerate(values):
        hits = [(o, r) for o, t, m, r in rules if v is not None and t is not None and fits(norm(v), norm(t), m)]
        if hits:
            want[k] = min(hits)[1]
    got = L.noise_match(spark.createDataFrame(list(enumerate(values)), "value_id long, value string"), spark.createDataFrame(rules, "ord int, text string, mode string, reason string"))
    assert {r.value_id: r.reason for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    every = L.noise_match(spark.createDataFrame([(1, "x"), (2, None)], "value_id long, value string"), spark.createDataFrame([(1, "", "contem", "all")], "ord int, text string, mode string, reason string"))
    assert [(r.value_id, r.reason) for r in every.collect()] == [(1, "all")]


def test_language_of_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "the and the"), (1, "the and the"), (2, None), (3, "ALL RIGHTS RESERVED para")], "doc_id long, text string")
    got = sorted((r.doc_id, r.detected, r.hits) for r in M.detect_language(docs).collect())
    assert got == [(1, "eng", 3), (1, "eng", 3), (2, "", 0), (3, "por", 1)]
