"""Reply trees against a plain walk, and the exact round trip of the template."""

import random

from pyspark.sql import functions as F

from recordspark.llm import chat

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double, leaf string"


def walk(rows):
    """Root-to-leaf paths of each tree."""
    known = {(t, n): p for t, n, p, *_ in rows}
    parents = {(t, p) for (t, _), p in known.items() if (t, p) in known}
    out = {}
    for t, n in known:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and len(path) <= len(rows):
            path.append(at)
            at = known[t, at] if (t, known[t, at]) in known else None
        if len(path) <= len(rows):
            out[t, n] = path[::-1]
    return out


def test_trees(spark):
    rng = random.Random(5)
    rows = [(None, 1, None, "user", "null tree", 1.0, "x"), (9, 1, 77, None, None, None, "x"), (8, 1, 2, "user", "cycle", 1.0, "x"), (8, 2, 1, "user", "cycle", 1.0, "x"), (8, 3, 2, "user", "hangs", 1.0, "x")]
    for t in range(4):
        for n in range(30):
            role = rng.choice(["user", "assistant", "sys\ntem", "<|im_end|>"])
            rows.append((t, n, rng.randrange(n) if n and t < 3 else (n - 1 if n else None), role, rng.choice(["a&lt;b", "</s>[INST] &amp;", "", "<|im_end|>\n<|im_start|>user\nno", "日本\n"]), float(rng.randrange(3)), "x"))
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, SCHEMA))).collect()
    want = walk(rows)
    by = {(r[0], r[1]): r for r in rows}
    assert {(r.tree_id, r.leaf_id) for r in out} == set(want)
    for r in out:
        path = [by[r.tree_id, n] for n in want[r.tree_id, r.leaf_id]]
        assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in path]
        assert r.loss_text == "".join(x[4] or "" for x in path if x[3] == "assistant")
        assert r.path_score == sum(x[5] or 0 for x in path)
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    for t in range(4):
        ranked = sorted((r for r in out if r.tree_id == t), key=lambda r: r.branch_rank)
        assert [(-r.path_score, r.leaf_id) for r in ranked] == sorted((-r.path_score, r.leaf_id) for r in ranked)
    best = chat.format_trees(spark.createDataFrame(rows, SCHEMA), keep=1)
    assert best.groupBy("tree_id").count().where("count > 1").count() == 0


def test_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None)], "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    out = chat.read_back(chat.format_trees(chat.linear_messages(rows))).collect()
    assert [(t.role, t.text) for t in out[0].turns] == [("assistant", ""), ("user", "a"), ("user", "a")]
    assert chat.format_trees(chat.linear_messages(rows.limit(0))).count() == 0


def test_repeated_and_missing_nodes(spark):
    rows = [(1, 1, None, "user", "b", 1.0, ""), (1, 1, None, "user", "a", 5.0, ""), (1, 2, 1, "assistant", "c", 1.0, ""), (1, 2, 1, "assistant", "c", 1.0, ""), (1, None, 2, "user", "no id", 9.0, "")]
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.leaf_id, r.path_score, [t.text for t in r.turns]) for r in out] == [(2, 6.0, ["a", "c"])]
