"""Native quality rules against a plain version."""

import random
import re

from pyspark.sql import functions as F

from recordspark.llm.rules import host_rules, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "a b", "a a a", "a a a a", "x\n\nx\n \nx y", "\x0b\x0c\t", "é\u00a0é ## é"]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "#", "é"], k=rng.randint(1, 120))) for _ in range(60)] + ["long words here " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("w", F.lit("clash"))
    for r in measure(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_hosts(spark):
    rng = random.Random(7)
    text = lambda: " ".join("w%d" % rng.randrange(500) for _ in range(60))
    rows = [(k, text() if k % 10 else "x", "good") for k in range(100)]
    rows += [(k, "x", "bad") for k in range(100, 180)] + [(k, text(), "bad") for k in range(180, 190)]
    rows += [(k, text(), None) for k in range(190, 195)] + [(195, "x", "tiny"), (195, "x", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = host_rules(docs).collect()
    assert len(out) == len(rows)
    verdict = {r.host: r.host_verdict for r in out}
    assert verdict["bad"] == "block" and verdict["good"] == "watch"
    assert all(not r.kept for r in out if r.host == "bad")
    assert sum(r.kept for r in out if r.host == "good") == 90
    assert host_rules(docs.limit(0)).count() == 0


def test_key_named_like_an_inner_column(spark):
    docs = spark.createDataFrame([(1, "a b c a b c"), (2, None)], "w long, text string").withColumn("source", F.lit("s"))
    assert {r.w: r.n_repeat_words for r in measure(docs, key="w").collect()} == {1: 6, 2: 0}


def test_a_host_with_a_third_of_all_rows_and_null_hosts(spark):
    rows = [(k, "x", "big" if k % 3 == 0 else None if k % 3 == 1 else f"h{k}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "host_key long, text string, source string")
    out = host_rules(docs, key="host_key")
    assert out.columns[0] == "host_key" and out.count() == 6000 and out.where("host_verdict is null").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "salt_" in plan and "Python" not in plan
