"""Heavy joins, components and the Hamming index against plain versions."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordspark.operators import hamming, joins
from recordspark.operators import linkage as L
from recordspark.operators.graph import components
from recordspark.operators.hamming import filed, near_points
from recordspark.operators.joins import heavy_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [20, 2])
def test_heavy_join_equals_join(spark, how, share):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 1, 2, 2, None, *range(3, 60)]), rng.choice("ab"), k) for k in range(900)]
    right = [(k, c, f"{k}{c}{i}") for k in [None, 1, 2, *range(5, 80)] for c in "abc" for i in range(rng.randint(0, 2))]
    a, b = spark.createDataFrame(left, "k int, c string, hot_ int"), spark.createDataFrame(right, "c2 int, c string, r string").withColumnRenamed("c2", "k")
    got = heavy_join(a, b, ["k", "c"], how, share=share, salts=5)
    want = a.join(b, ["k", "c"], how).select("k", "c", "hot_", "r")
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert heavy_join(a.limit(0), b, ["k", "c"], how).count() == 0
    with pytest.raises(ValueError):
        heavy_join(a, b, ["k", "c"], "full")


def test_one_key_with_half_of_all_rows(spark):
    rows = spark.range(1_000_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    first = rows.groupBy("k").agg(F.min("id").alias("first"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = sorted(r["count"] for r in heavy_join(rows, first, ["k"]).groupBy(F.spark_partition_id()).count().collect())
        state = L.exact_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("k").cast("string").alias("text")))
        lk1 = sorted(r["count"] for r in state.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == sum(lk1) == 1_000_000
    assert tasks[-1] < 2 * tasks[len(tasks) // 2] and lk1[-1] < 2 * lk1[len(lk1) // 2]


def plain_groups(links):
    group = {x: x for e in links for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(group[a], group[b])
            moved |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    return group


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = {0: [], 1: [(k, k + 1) for k in range(25)], 2: [(0, k) for k in range(1, 300)] + [(400, 401)], 3: [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]}[seed]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")
    got = components(df).collect()
    assert {r.node: r.group for r in got} == plain_groups([x for x in links if x[0] != x[1]]) and len(got) == len({r.node for r in got})


def near(points, within=10, ratio=0.82):
    out = {}
    for k, (i, n, s) in enumerate(points):
        for j, m, t in points[:k]:
            d = ((s ^ t) & (2**64 - 1)).bit_count()
            if d <= within and min(n, m) / max(n, m) >= ratio:
                out[min(i, j), max(i, j)] = d
    return out


def flipped(rng, s, most):
    for _ in range(rng.randrange(most + 1)):
        s ^= 1 << rng.randrange(64)
    return s


@pytest.mark.parametrize("part", [1 << 15, 16])
def test_every_near_pair_once(spark, monkeypatch, part):
    monkeypatch.setattr(hamming, "PART", part)
    monkeypatch.setattr(hamming, "STEP", 200)
    rng = random.Random(3)
    signed = lambda s: s - 2**64 if s >= 2**63 else s
    seeds = [rng.getrandbits(64) for _ in range(6)]
    points = [(k, rng.choice([100, 119, 121, 122, 123, 148, 149, 150, 1000]), signed(flipped(rng, rng.choice(seeds), 12))) for k in range(250)]
    df = spark.createDataFrame([*points, (900, None, 5), (901, 5, None)], "id long, n int, sim long")
    got = near_points(df).collect()
    assert len(got) == len({(min(r.x, r.y), max(r.x, r.y)) for r in got})
    assert {(min(r.x, r.y), max(r.x, r.y)): r.distance for r in got} == near(points)
    assert near_points(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_points(df, within=12)


def test_rows_a_point(spark):
    points = spark.range(4000).select("id", F.lit(200).alias("n"), F.xxhash64("id").alias("sim"))
    assert filed(points).count() / 4000 < 40


def test_groups_equal_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sig = L.text_signature(docs).cache()
    rep = {r.text_hash: r.i for r in sig.where("simhash is not null").groupBy("text_hash").agg(F.min("doc_id").alias("i")).collect()}
    pairs = [(r.a, r.b) for r in L.near_duplicate_candidates(sig).collect()]
    group = plain_groups(pairs)
    got = L.near_duplicate_groups(sig).collect()
    hashes = {r.doc_id: r.text_hash for r in sig.collect()}
    assert pairs and len(got) == sig.where("simhash is not null").count()
    for r in got:
        mine = rep[hashes[r.doc_id]]
        assert r.group == group.get(mine, mine) and r.n_links == sum(mine in p for p in pairs)


def test_alike_texts_cost_rows_not_pairs(spark):
    one = "0123456789abcdef"
    sig = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(500).alias("n_words"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("text_hash"), F.lit(one).alias("simhash"))
    got = L.near_duplicate_groups(sig).agg(F.count("*").alias("n"), F.max("group").alias("g"), F.min("n_links").alias("l")).first()
    assert (got.n, got.g, got.l) == (20_000, 0, 19_999)


def test_a_large_group_takes_few_mb(monkeypatch):
    n = 6000
    rows = {"key": np.zeros(n, np.int64), "p": np.zeros(n, np.int32), "q": np.zeros(n, np.int32), "own": np.zeros(n, np.int32), "asks": np.zeros(n, bool), "id": np.arange(n), "n": np.full(n, 500, np.int32), "sim": np.zeros(n, np.int64)}
    rows["sim"][:] = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, n)
    tracemalloc.start()
    found = sum(len(x) for x, _, _ in hamming._meetings(rows | {"g": np.zeros(n, np.int64)}, 10, 0.82))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 0 and most < 16e6


def test_texts_are_signed_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.near_duplicate_groups(L.text_signature(docs))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()


def test_constants():
    assert hamming.CUTS[-1] == 64 and max(b - a for a, b in zip(hamming.CUTS, hamming.CUTS[1:])) <= 12 and joins.SALTS > 1
