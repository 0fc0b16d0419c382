"""Shift-And masks against fnmatch, and odd URLs."""

import fnmatch
import random

from pyspark.sql import functions as F

from recordspark.llm.urls import HOST_RULES, ShiftAnd, judge_urls, rules_from


def test_globs_equal_fnmatch():
    rng = random.Random(5)
    for _ in range(30):
        globs = ["".join(rng.choices("abb*?", k=rng.randint(0, 40))) for _ in range(7)]
        texts = ["".join(rng.choices("abc", k=rng.randint(0, 45))) for _ in range(60)]
        for g in globs[:4]:
            texts.append("".join("ab" if c == "*" else "c" if c == "?" else c for c in g))
        hit = ShiftAnd(globs).match(texts)
        for t, row in zip(texts, hit):
            assert row.tolist() == [fnmatch.fnmatchcase(t, g) for g in globs], (t, globs)


def test_odd_urls(spark):
    urls = [None, "", "no scheme.net/", "http://", "http://A.Example.NET/en/1?x#y", "http://net/", "http://net", "ftp://x.org/fr/?q", "http://xorg/fr/", "http://a.com#/de/", "http://casino-win.com/", "http://a://b.net/", "http://é.net/"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[4]])), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).orderBy("page_id").collect()]
    none = ("", "", None, "allow")
    assert got[:4] == [none, none, none, none]
    assert got[4] == got[13] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == ("net", "/", "net/", "block")
    assert got[6] == ("net", "", None, "allow")
    assert got[7] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[8][2] is None and got[9] == ("a.com", "", None, "allow")
    assert got[10] == ("casino-win.com", "/", None, "block")
    assert got[11] == ("a:", "//b.net/", None, "allow")
    assert got[12][2:] == ("net/", "block")
    assert judge_urls(pages.limit(0)).count() == 0


def test_ten_thousand_globs_from_a_table(spark):
    rng = random.Random(6)
    host = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 5)))
    globs = sorted({f"*.{host()}.{rng.choice(['com', '*', 'c?m'])}#*{rng.choice(['', '/' + host() + '*'])}" for _ in range(16_000)})[:10_000]
    table = spark.createDataFrame([(f"r{k:05d}", g, rng.choice(["block", "allow"])) for k, g in enumerate(globs)] + [(None, "x", "block")], "name string, glob string, action string")
    rules = rules_from(table)
    assert len(rules) == 10_000
    urls = [f"http://{host()}.{host()}.com/{host()}" for _ in range(60)] + ["http://x.com/"] * 3
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), HOST_RULES, rules).collect()
    for r in got:
        subject = f".{r.host}#{r.path}"
        first = next((x for x in rules if fnmatch.fnmatchcase(subject, x.glob)), None)
        assert (r.word_rule, r.verdict) == ((first.name, first.action) if first else (None, "allow")), subject
