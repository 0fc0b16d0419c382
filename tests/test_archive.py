"""Committed sets and their replay; similarity by matching blocks."""

import random

import pytest
from pyspark.sql import functions as F

from recordspark.functions.sequence import ratio, sequence_ratio
from recordspark.operators import archive as V
from recordspark.operators import learn as A

QUEUE = "rec_id long, state string, isbn string"
ELIGIBLE = "rec_id long, isbn string, changed_at long, created_at timestamp, name string"
JOURNAL = "rec_id long, http_status int, finished_at long"


def tables(spark):
    import datetime

    day = datetime.datetime(2020, 1, 1)
    queue = spark.createDataFrame([(1, "erro", "a"), (2, "aguardando", "b"), (3, "aguardando", "c"), (4, "liberado", "d")], QUEUE)
    eligible = spark.createDataFrame([(1, "a", 9, day, "x"), (2, "B", 9, day, "y"), (5, "e", 1, day, "z")], ELIGIBLE)
    journal = spark.createDataFrame([(1, 500, 3), (1, 400, 2), (2, 400, 1), (3, 201, 1)], JOURNAL)
    return queue, eligible, journal


def test_outputs_are_committed_together(spark, tmp_path):
    root = "file://" + str(tmp_path)
    paths = V.reconcile_and_commit(root, "r1", *tables(spark))
    read = lambda name, schema: sorted(tuple(r) for r in V.read_committed(spark, root, name, schema).collect())
    assert sorted(paths) == ["archived", "queue", "retired"]
    assert [r[0] for r in read("queue", "rec_id long, state string, change string, place long")] == [1, 2, 4, 5]
    assert read("retired", "rec_id long") == [(3,)]
    archived = "rec_id long, http_status int, finished_at long, archived_for string"
    assert sorted(V.read_committed(spark, root, "archived", archived).select("rec_id", "finished_at", "archived_for").collect()) == [(1, 2, "reopened"), (1, 3, "reopened"), (2, 1, "reset")]
    assert V.reconcile_and_commit(root, "r1", *[t.limit(0) for t in tables(spark)]) == paths  # a replay changes nothing
    assert read("retired", "rec_id long") == [(3,)]


def test_a_run_that_fails_leaves_nothing_to_readers(spark, tmp_path):
    root = "file://" + str(tmp_path)
    good = spark.createDataFrame([(1,)], "rec_id long")
    bad = good.select(F.raise_error(F.lit("lost")).cast("long").alias("rec_id"))
    with pytest.raises(Exception, match="lost"):
        V.commit_set(root, "r1", {"a": good, "b": bad})
    assert V.committed(spark, root, "r1") is None and V.read_committed(spark, root, "a", "rec_id long").count() == 0
    V.commit_set(root, "r1", {"a": good, "b": good})
    V.commit_set(root, "r2", {"a": good})
    assert V.read_committed(spark, root, "a", "rec_id long").count() == 2 and V.read_committed(spark, root, "b", "rec_id long").count() == 1


def blocks(a, b):
    """Characters in matching blocks: the longest common block, first in a and then in b, and what lies on either side of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return k + blocks(a[:i], b[:j]) + blocks(a[i + k :], b[j + k :]) if k else 0


def test_sequence_ratio(spark):
    rng = random.Random(6)
    pairs = [("".join(rng.choices("abc ", k=rng.randrange(14))), "".join(rng.choices("abc ", k=rng.randrange(14)))) for _ in range(10_000)]
    for a, b in pairs:
        assert ratio(a, b) == (2 * blocks(a, b) / (len(a) + len(b)) if a or b else 1.0), (a, b)
    df = spark.createDataFrame([*pairs[:50], (None, "a"), (None, None), ("x" * 400, "x" * 300)], "a string, b string")
    assert [r.s for r in df.select("a", "b", sequence_ratio(F.col("a"), F.col("b")).alias("s")).collect()] == [ratio(r.a, r.b) for r in df.collect()]


def test_evaluation_by_blocks(spark):
    schema = "rec_id long, title string, authors array<string>, doi string, year string"
    gold = spark.createDataFrame([(1, "A Casa Verde", ["Ana Luz"], "x", "1990"), (2, "B", [], None, None)], schema)
    pred = spark.createDataFrame([(1, "Casa Verde, A", ["Luz"], "X", "1990")], schema)
    got = {r.rec_id: r.title_sim for r in A.evaluate_extraction(pred, gold, measure="sequence").collect()}
    assert got == {1: ratio("a casa verde", "casa verde a"), 2: 0.0}
    with pytest.raises(ValueError):
        A.evaluate_extraction(pred, gold, measure="other")
