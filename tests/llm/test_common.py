"""Shared helpers: components with hubs, tree-wise sums, tables and settings."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordspark.llm import common


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "CONTRACT", 50)
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5200)] + [(2999, 5100)] + [(rng.randrange(9000, 9300), rng.randrange(9000, 9300)) for _ in range(200)] + [(None, 4), (7, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {x: find(x) for x in parent}
    plan = common.components(spark.createDataFrame([], "a long, b long"))
    assert plan.count() == 0


def test_hot_nodes_are_broadcast(spark):
    ends = spark.createDataFrame([(1, k) for k in range(2000)] + [(k, 1) for k in range(3000, 5000)], "u long, v long")
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    got = sorted(map(tuple, common._with_least(ends, least, 4000).collect()))
    assert got == sorted([(1, k, 0) for k in range(2000)] + [(k, 1, 1) for k in range(3000, 5000)])


def test_sums_are_a_tree(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 100, (23, 64))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "k long, v array<long>").repartition(23, "k")

    def run(batches):
        for batch in batches:
            for v in batch.column(1).to_pylist():
                yield common.sliced(np.array(v), 4)

    assert (common.summed(rows.mapInArrow(run, "slice long, blob binary"), 64) == vectors.sum(axis=0)).all()


def test_written_tables_are_dropped(spark):
    df = common.written(spark.range(5), "t")
    folder = os.path.dirname(df.inputFiles()[0].replace("file://", ""))
    assert os.path.isdir(folder)
    common.drop(df, spark.range(1))
    assert not os.path.isdir(folder)


def test_settings_are_only_lowered(spark):
    common.prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    common.prepare(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Session:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_words_of_buffers():
    column = pa.chunked_array([pa.array(["A b", None]), pa.array(["", "b  a\tB"])])
    h, first = common.word_hashes(*common.text_buffer(column))
    assert first.tolist() == [0, 2, 2, 2, 5] and h[0] == h[3] and h[1] == h[2] == h[4]
