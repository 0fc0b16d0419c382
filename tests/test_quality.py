"""Tokens of a page: what counts as a candidate, a word and a short one, each different token looked at once."""

import pyarrow as pa

from recordspark.operators import quality as Q


def test_tokens_are_judged_once_each(monkeypatch):
    seen, marks = [], Q._marks
    monkeypatch.setattr(Q, "_marks", lambda t: seen.append(t) or marks(t))
    got = Q.token_counts(pa.array(["casa casa a casa", "", "casa (casa) 12"])).to_pylist()
    assert got == [dict(n_tokens=4, n_candidates=3, n_good=3, n_short=1), dict(n_tokens=0, n_candidates=0, n_good=0, n_short=0), dict(n_tokens=3, n_candidates=2, n_good=2, n_short=0)]
    assert sorted(seen) == ["(casa)", "12", "a", "casa"]


def test_odd_tokens(spark):
    c, g, s = Q.CANDIDATE, Q.GOOD, Q.SHORT
    known = {"a": s, "(a)": c, "a1": 0, "ab ": c | s, "abc. ": c | g, "bcdfg": c, "Bcdfga.": c, "«água»": c | g, "l'eau": c | g, "x1y2a": c, "İa": s, "İab": c | g, "KKKKKa": c, "...": 0, "x ya": c | g}
    assert {t: Q._marks(t) for t in known} == known
    pages = spark.createDataFrame([(1, 1, " ".join(known)), (1, 2, None)], "doc_id long, page_no int, text string")
    rows = {r.page_no: (r.n_tokens, r.n_candidates, r.n_good, r.n_short) for r in Q.page_quality(pages).collect()}
    assert rows == {1: (15, 11, 5, 3), 2: (0, 0, 0, 0)}
