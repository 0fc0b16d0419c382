"""Titles that are alike, and the jobs on them, against plain versions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from recordspark.operators import linkage as L
from recordspark.operators import titles

FIELDS = "title string, author string, isbn string, year int, pages int, edition int, volume int"


def _alike(x, y):
    k, n, m = len(set(x) & set(y)), min(len(x), len(y)), max(len(x), len(y))
    return max(k / (n + m - k), k / n * (0.95 if n >= 2 else 0.70))


def _titles(rng, rows):
    words = ["w%d" % k for k in range(60)]
    return [sorted(set(rng.choices(words[: rng.choice([6, 20, 60])], k=rng.randint(1, 9)))) for _ in range(rows)]


def _editions(spark, rng, key, rows):
    def row(k):
        title = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "of"], k=rng.randint(0, 6))) or None
        return k, title, rng.choice(["Luz, Ana", "Ana Luz", "Rui Mar", "", None]), rng.choice([None, None, "9780801026560", "9788527501811"]), rng.choice([2000, 2001, None]), rng.choice([100, 105, 300]), rng.choice([1, 2, None]), rng.choice([1, None])

    return spark.createDataFrame([row(k) for k in range(rows)], f"{key} long, {FIELDS}")


def test_alike_titles_by_pieces(monkeypatch):
    rng = random.Random(1)
    t, c = _titles(rng, 300), _titles(rng, 280)
    want = {(a, b): (_alike(x, y), x == y) for a, x in enumerate(t) for b, y in enumerate(c) if _alike(x, y) >= 0.60}
    for places, bits in ((1 << 21, 1 << 26), (50, 200), (1, 1)):
        monkeypatch.setattr(titles, "PLACES", places)
        monkeypatch.setattr(titles, "BITS", bits)
        got = [(a, b, s, e) for p in titles._alike(pa.array(t), pa.array(c)) for a, b, s, e in zip(*[x.tolist() for x in p])]
        assert len(got) == len(want) and {(a, b): (s, e) for a, b, s, e in got} == want


def test_alike_rows_of_blocks_and_groups(spark, monkeypatch):
    rng = random.Random(2)
    side = lambda key, n: spark.createDataFrame([(" ".join(x), k) for k, x in enumerate(_titles(rng, n) + [["w1", "w2"]] * 40 + [[]])], f"words string, {key} long")
    t, c = side("t_id", 100), side("c_id", 90)
    one = sorted(map(tuple, titles.alike_rows(t, c, "t_id", "c_id").collect()))
    rows = lambda d: [(r[1], r[0].split()) for r in d.collect()]
    assert one == sorted((_alike(x, y), x == y, a, b) for a, x in rows(t) for b, y in rows(c) if x and y and _alike(x, y) >= 0.60)
    monkeypatch.setattr(titles, "BLOCK", 50)
    monkeypatch.setattr(titles, "GROUP", 4)
    assert titles.blocks(141, 4) == 3
    assert sorted(map(tuple, titles.alike_rows(t, c, "t_id", "c_id").collect())) == one


def test_pairs_of_alike_titles_are_not_shuffled(spark):
    """Pairs went to their titles' words, and then to their rows: at 1 GB more than the disk holds."""
    rng = random.Random(3)
    plan = L.score_matches(_editions(spark, rng, "target_id", 50), _editions(spark, rng, "cand_id", 50))._jdf.queryExecution().executedPlan().toString()
    after = plan.split("FlatMapGroupsInArrow")[0]
    assert "Exchange" not in after and "Join" not in after


def test_every_pair_of_rows_is_scored(spark):
    """Not only pairs of classes, whose years, pages and approval were left to the reader."""
    from recordspark.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["lk7_score_matches"](spark, sf)
    assert got.columns == ["target_id", "cand_id", "title_sim", "author_ok", "isbn_exact", "score", "blocked", "approved", "confirmations", "rejections"]
    pairs = {(r.target_id, r.cand_id): r for r in got.collect()}
    same = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.split("text", "\n")[0].alias("title")).where("title rlike '[a-zA-Z]'").collect():
        same.setdefault(r.title, []).append(r.doc_id)
    assert any(len(ids) > 1 for ids in same.values())
    for ids in same.values():
        assert all((a, b) in pairs and "title" in pairs[a, b].confirmations.split("; ") for a in ids for b in ids)
    assert any("year" in r.confirmations and "pages" in r.confirmations for r in pairs.values()) and any("not enough" in r.rejections for r in pairs.values())


def test_best_matches_need_no_pairs_of_kinds(spark):
    """All scored pairs of kinds went through windows over the kinds of targets: shuffled and sorted."""
    rng = random.Random(4)
    t, c = _editions(spark, rng, "target_id", 80), _editions(spark, rng, "cand_id", 80)
    best = L.top_matches(t, c)
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()
    want, top = {}, {}
    for r in L.score_matches(t, c).collect():
        top[r.target_id] = max(top.get(r.target_id, 0.0), r.score)
        if r.approved:
            want[r.target_id] = min(want.get(r.target_id, (0.0, 0, False)), (-r.score, r.cand_id, r.isbn_exact))
    assert want and {r.target_id: (-r.score, r.cand_id, r.isbn_exact, r.top) for r in best.collect()} == {k: (*v, top[k]) for k, v in want.items()}
