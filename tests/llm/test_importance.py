"""Importance resampling: models against plain counts, exact selection, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recordspark.llm import importance
from recordspark.llm.common import text_buffer


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1e3), 5.0, rng.random()]) for _ in range(3000)] + [1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 50, 1500, 3001, 3002):
        assert importance.kth_largest(df, k, bins=16, small=20) == ranked[k - 1]
    assert importance.kth_largest(df, 0) == math.inf


def test_counts_are_additive_and_repetition_shows():
    def count(texts):
        return np.bincount(importance.ngram_buckets(*text_buffer(pa.array(texts)))[0], minlength=importance.BUCKETS)

    texts = ["a b c, d!", None, "", "x x x x", "é é"]
    assert (count(texts) == sum(count([t]) for t in texts)).all()
    assert count(["x x x x"])[importance.BUCKETS - 1] == 3
    assert count(["a b c d a b c"])[importance.BUCKETS - 3] == 1


def corpus(spark, n=600):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["the", "house", "is", "near", "a", "river"], k=60))
    rows = [(k, good() if k % 4 else "### $$$ " * 40) for k in range(n)] + [(5000, None), (5001, ""), (None, good()), (2, "the house is near a river " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("_text", F.lit(1))
    labels = spark.createDataFrame([(k, 1 if k % 4 else 0, None) for k in range(n // 2)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_resample(spark):
    rows, docs, labels = corpus(spark)
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(rows)
    kept = lambda want: [r.kept for r in got if r.doc_id is not None and 300 <= r.doc_id < 600 and bool(r.doc_id % 4) == want]  # noqa: E731  held-out rows
    assert sum(kept(True)) >= 0.95 * len(kept(True)) and sum(kept(False)) <= 0.1 * len(kept(False))
    left = importance.keep_sampled(docs, labels)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert importance.resample(docs, labels.limit(0)).count() == len(rows)


def test_weights_keys_and_choice_equal_plain_version(spark):
    rows, docs, labels = corpus(spark, 200)
    model = importance.fit_importance(docs, labels)
    raw, target, judged = Counter(), Counter(), []
    grams = lambda t: importance.ngram_buckets(*text_buffer(pa.array([t])))[0].tolist()
    halves = {r.doc_id: r.h for r in labels.select("doc_id", F.expr("pmod(xxhash64('half', doc_id), 2)").alias("h")).collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    for k, t in rows:
        raw.update(grams(t))
        if label.get(k) == 1 and halves[k] == 0:
            target.update(grams(t))
    n_raw, n_target, prior = sum(raw.values()), sum(target.values()), importance.PRIOR_COUNTS

    def mean(t):
        total = 0.0
        for g in grams(t):
            share = (raw[g] + 1) / (n_raw + importance.BUCKETS)
            total += math.log((target[g] + prior * share) / (n_target + prior) / share)
        return total / (len(grams(t)) + importance.SHORT)

    judged = [(mean(t), label[k] == 1) for k, t in rows if k in label and halves[k] == 1]
    middle, spread, line = importance.calibrated(np.array([m for m, _ in judged]), np.array([y for _, y in judged]))
    want = []
    for k, t in rows:
        weight = line[0] + line[1] * max(-importance.WIDEST, min(importance.WIDEST, (mean(t) - middle) / spread))
        want.append((k, weight, float(model.keys(np.array([weight]), np.array([k or 0]))[0])))
    for k_most in (None, 37):
        got = importance.resample(docs, labels, k=k_most).collect()
        n = k_most or round(sum(1 / (1 + math.exp(-w)) for _, w, _ in want))
        least = sorted((x for _, _, x in want), reverse=True)[n - 1]
        plain = sorted((str(k), round(w, 6), round(x, 6), x >= least) for k, w, x in want)
        assert sorted((str(r.doc_id), round(r.log_weight, 6), round(r.sample_key, 6), r.kept) for r in got) == plain


def test_noise_decides_doubtful_rows_only():
    model = importance.Importance(np.zeros(importance.BUCKETS))
    ids = np.arange(20_000)
    weights = np.where(ids % 2 == 0, 0.0, 1.0)
    keys = model.keys(weights, ids)
    # one draw of Gumbel top-1 among two: the heavier wins with probability e / (1 + e)
    won = (keys[1::2] > keys[::2]).mean()
    assert abs(won - math.e / (1 + math.e)) < 0.02
    assert (model.keys(np.where(ids % 2 == 0, -10.0, 10.0), ids)[1::2] > model.keys(np.full(20_000, -10.0), ids)[::2]).mean() > 0.999
