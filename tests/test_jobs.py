"""Edge rows of the jobs that the SQL comparison cannot show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.operators import extract as X
from recordspark.operators import fusion as U
from recordspark.operators import learn as A
from recordspark.operators import linkage as L
from recordspark.operators import mining as M
from recordspark.operators import quality as Q
from recordspark.operators import workflow as W
from recordspark.operators.confirm import bag, bags_apart, chain, changes, confirm_duplicates, safe_runs
from recordspark.sources import pages as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "isbn,want",
    [("978-0-306-40615-7", "9780306406157"), ("9780306406158", None), ("0306406152", "9780306406157"), ("080442957X", "9780804429573"), ("X804429570", None), ("9770306406157", None), (None, None), ("", None), ("12", None)],
)
def test_isbn(spark, isbn, want):
    assert one(spark, isbn, T.canonical_isbn) == want


def test_normal_forms(spark):
    assert one(spark, "Ação, über-Größe ñ!", T.normal) == "acao uber gro e n"
    assert one(spark, "Maria da Silva", T.author_key) == "maria silva" == one(spark, "SILVA, Maria", T.author_key)
    assert one(spark, "Madonna", T.author_key) is None


def test_page_quality_edges(spark):
    word = "casa "
    rows = [(1, 1, word * 39), (2, 1, word * 40), (3, 1, word * 19 + "1 " * 30), (4, 1, word * 31 + "a " * 9), (5, 1, None), (6, 1, "xkcdfgh " * 50)]
    got = {r.doc_id: r.score for r in Q.page_quality(spark.createDataFrame(rows, "doc_id long, page_no long, text string")).collect()}
    assert got[1] == 0 and got[2] == 1 and got[3] == 0 and got[5] == 0 and got[6] == 0
    assert got[4] == pytest.approx(1 - (9 / 40 - 0.22))


def test_document_quality_edges(spark):
    def doc(i, good, weak, empty):
        rows = [(i, "texto_bom", 0.9, False)] * good + [(i, "texto_fraco", 0.5, False)] * weak + [(i, "sem_texto", 0.0, False)] * empty
        return [(d, k + 1, c, s, g) for k, (d, c, s, g) in enumerate(rows)]

    rows = doc(1, 8, 0, 2) + doc(2, 7, 0, 3) + doc(3, 9, 1, 0) + doc(4, 8, 1, 0) + doc(5, 0, 0, 1)
    got = {r.doc_id: r.status for r in Q.document_quality(spark.createDataFrame(rows, "doc_id long, page_no int, class string, score double, legible boolean")).collect()}
    assert got == {1: "OCR aprovado", 2: "precisa OCR", 3: "OCR aprovado", 4: "precisa OCR", 5: "precisa OCR"}


def test_pages_numbering(spark):
    docs = spark.createDataFrame([(1, "a\f\f b"), (2, None)], "doc_id long, text string")
    assert [(r.page_no, r.text) for r in P.explode_pages(docs, drop_blank=True).collect()] == [(1, "a"), (2, " b")]
    assert P.explode_pages(docs).where("doc_id = 1").count() == 3


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200)
    sig = L.text_signature(docs).cache()
    got = {(r.a, r.b): r.distance for r in L.near_duplicate_candidates(sig).collect()}
    reps = {}
    for r in sorted(sig.collect(), key=lambda r: r.doc_id):
        if r.simhash:
            reps.setdefault(r.text_hash, r)
    want = {}
    rows = sorted(reps.values(), key=lambda r: r.doc_id)
    for k, y in enumerate(rows):
        for x in rows[:k]:
            apart = (int(x.simhash, 16) ^ int(y.simhash, 16)).bit_count()
            if min(x.n_words, y.n_words) / max(x.n_words, y.n_words) >= 0.82 and apart <= 10:
                want[x.doc_id, y.doc_id] = apart
    assert got == want


def test_no_cross_join_in_plans(spark):
    from recordspark.plans import QUERIES

    for name in ("lk3_near_duplicate_candidates", "lk7_score_matches", "lk12_publisher_city_lookup", "mi4_issue_summary", "wf3_reconcile_queue"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_consensus_and_margins(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "a"), (3, "b"), (3, "b"), (4, "a"), (5, " ")]
    got = {r.target_id: r.value for r in L.listing_consensus(spark.createDataFrame(rows, "target_id long, city string"), ["city"]).collect()}
    assert got == {1: "a", 2: "a"}
    rows = [(1, 1, 1.0, 1.0, "a"), (1, 2, 0.9, 0.9, "b"), (2, 1, 0.8, 0.8, "a"), (3, 1, 1.0, 1.0, "a"), (3, 2, 0.95, 1.0, "b"), (4, 1, 1.0, 1.0, "a"), (4, 2, 1.0, 1.0, "a")]
    pairs = spark.createDataFrame([(*r, r[0] == 3, r[1] == 1) for r in rows], "rec_id long, cand_id long, title_sim double, author_sim double, meta string, same_doi boolean, type_ok boolean")
    accepted = lambda profile: {r.rec_id: r.accepted for r in L.match_with_margin(pairs, profile).collect()}
    assert accepted("books") == {1: True, 2: True, 3: False, 4: True}
    assert accepted("articles") == {1: True, 2: True, 3: True, 4: False}
    assert accepted("academic") == {1: True, 2: True, 3: True, 4: True}


def test_articles_cap_and_dedupe(spark):
    pages = [(1, k, f"Great Title {k}\nBy Ann Lee\nbody {k}") for k in range(1, 12)] + [(2, 1, "Same Title\nBy Ann Lee"), (2, 2, "same title\nBy ANN LEE"), (3, 1, "By Nobody Here")]
    got = M.segment_articles(spark.createDataFrame(pages, "issue_id long, page_no long, text string"))
    assert sorted(r.position for r in got.where("issue_id = 1").collect()) == [0, 1, 2, 5, 7, 8, 9, 10]
    assert got.where("issue_id = 2").count() == 1 and got.where("issue_id = 3").count() == 0
    over = got.where("issue_id = 2").withColumn("title", F.lit("given"))
    assert M.segment_articles(spark.createDataFrame(pages, "issue_id long, page_no long, text string"), over).where("title = 'given'").count() == 1


def test_language_ties(spark):
    docs = spark.createDataFrame([(1, "para und"), (2, "xx"), (3, None), (4, "the the para")], "doc_id long, text string")
    assert {r.doc_id: r.detected for r in M.detect_language(docs).collect()} == {1: "por", 2: "", 3: "", 4: "eng"}


def test_title_and_revisions(spark):
    rows = [(1, "Roses Roses", None), (2, "Main: Sub, 3rd edition", None), (3, None, None), (4, "The Long Road by Ana Luz", None), (5, "Ana Luz - Road 12", "Ana Luz")]
    got = {r.rec_id: (r.main, r.subtitle, r.edition, r.key_words) for r in X.split_title(spark.createDataFrame(rows, "rec_id long, title string, author string")).collect()}
    assert got[1] == ("Roses", None, None, "Roses") and got[2] == ("Main", "Sub", 3, "Main") and got[3][:3] == (None, None, None)
    assert got[4][0] == "The Long Road" and got[4][3] == "Long Road" and got[5][0] == "Road"
    rec = spark.createDataFrame([(1, "f", "h1", "t", "c", "p"), (2, "g", "h9", "t", "c", "p"), (3, "k", "h1", "t", "c", "p"), (4, "m", "h4", "t", "c", "p")], "rec_id long, file string, hash string, title string, conflicts string, pending string")
    rev = spark.createDataFrame([("f", "h1", "A", True, None, None), ("g", "h2", "B", True, None, None), ("m", "h4", "", False, None, "only")], "file string, hash string, title string, approved boolean, conflicts string, pending string")
    got = {r.rec_id: (r.title, r.conflicts, r.pending, r.how) for r in U.apply_revisions(rec, rev).collect()}
    assert got == {1: ("A", "", "", "file and hash"), 2: ("t", "c", "p", "hash differs"), 3: ("A", "", "", "hash"), 4: ("t", "c", "only", "file and hash")}


def test_queue_is_idempotent(spark):
    q = spark.createDataFrame([(1, "liberado", "a"), (2, "erro", "a"), (3, "aguardando", "a")], "rec_id long, state string, isbn string")
    e = spark.createDataFrame([(1, "b", 5, "2020-01-01", "x"), (2, "a", 5, "2020-01-01", "x"), (4, "a", 5, "2020-01-02", "y"), (5, "a", 5, "2020-01-02", "x")], "rec_id long, isbn string, changed_at long, created_at string, name string").withColumn("created_at", F.to_timestamp("created_at"))
    j = spark.createDataFrame([(2, 500, 3)], "rec_id long, http_status int, finished_at long")
    first = W.reconcile_queue(q, e, j)
    got = {r.rec_id: (r.state, r.change, r.place) for r in first.collect()}
    assert got == {1: ("liberado", "kept", None), 2: ("aguardando", "reopened", None), 3: ("retirado", "retired", None), 4: ("aguardando", "new", 2), 5: ("aguardando", "new", 1)}
    again = first.select("rec_id", "state").join(e.select("rec_id", "isbn"), "rec_id")
    assert {r.change for r in W.reconcile_queue(again, e, j).where("state <> 'retirado'").collect()} == {"kept"}


def test_learned_tables(spark):
    rows = spark.createDataFrame([("Casa A", "X"), ("casa a!", "X"), ("B", "Y"), ("K", "Z")], "publisher string, city string")
    known = spark.createDataFrame([("k", "Q")], "key string, city string")
    assert sorted(map(tuple, A.learn_publisher_city(rows, known).collect())) == [("casa a", "X", 2, "media"), ("k", "Q", 1, "conhecida")]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_changes_equal_plain():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.choices("abcd", k=rng.randint(0, 14))
        b = rng.choices("abcd", k=rng.randint(0, 14)) if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        want = len(a) + len(b) - 2 * common(a, b)
        x, y = (np.array([ord(w) for w in t], np.int64) for t in (a, b))
        for most in {want, want + 3, max(0, want - 1)}:
            assert changes(x, y, most) == (want if most >= want else -1), (a, b, most)


def test_runs_of_a_chain():
    at = lambda *runs: [np.array(x) for x in zip(*runs)]
    assert chain(*at((0, 0, 5), (8, 20, 2), (12, 9, 6), (40, 18, 1))) == [(0, 0, 5), (12, 9, 6), (40, 18, 1)]
    assert chain(*at((0, 0, 5), (9, 7, 3))) == [(0, 0, 5), (10, 8, 2)]  # eight words, so the second starts at the ninth of b
    assert safe_runs([2, 2, 9, 0], [3, 1, 4]) == [False, False, False] and safe_runs([0, 2, 0], [3, 3]) == [True, True]
    assert safe_runs([1, 3, 0], [1, 9]) == [False, True]


def test_parts_of_long_texts_equal_plain(spark):
    rng, texts, pairs = random.Random(5), {}, []
    for k in range(60):
        words = ["w%d" % rng.randrange(rng.choice([6, 40, 400])) for _ in range(rng.randint(20, 150))]
        other = [w if rng.random() > 0.06 else "w%d" % rng.randrange(400) for w in words if rng.random() > 0.04]
        if k % 3 == 0:  # a moved passage
            i, j = sorted(rng.sample(range(len(other)), 2))
            other = other[:i] + other[j:] + other[i:j] if k % 2 else other[:i] + other[j:] + other[: j - i] + other[i:j]
        texts[2 * k], texts[2 * k + 1] = words, other
        pairs.append((2 * k, 2 * k + 1))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [(900, None), (901, "")], "doc_id long, text string")
    p = spark.createDataFrame([*pairs, (900, 901), (900, 1)], "a long, b long")
    got = {(r.a, r.b): r.ratio for r in confirm_duplicates(p, docs, least=0.5, part=8).collect()}
    want = {(a, b): 2 * common(texts[a], texts[b]) / (len(texts[a]) + len(texts[b])) for a, b in pairs}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.5}) and len(got) > 40


def test_bags_never_say_more_than_changes():
    rng = np.random.default_rng(4)
    for n in (0, 3, 40, 700):
        x = rng.integers(-(1 << 62), 1 << 62, 30)[rng.integers(0, 30, n)]
        for m in (0, 1, n // 8, n):
            y = np.delete(x, rng.integers(0, n, m)) if n else x
            y = np.insert(y, len(y) // 2, rng.integers(-(1 << 62), 1 << 62, m))
            assert bags_apart(bag(x, len(x)), bag(y, len(y))) <= changes(x, y, len(x) + len(y))


def test_confirmed_pairs_are_found_once(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:k] + [f"x{k}"] * (k % 3) + words[k + k % 2 :]) for k in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    pairs = [(a, b) for b in range(30) for a in range(b)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = confirm_duplicates(spark.createDataFrame(pairs, "a long, b long").mapInArrow(count, "a long, b long"), docs)
    rows = {r.b: (r.a, r.ratio) for r in got.collect()}
    split = [np.array([hash(w) for w in t.split()]) for t in texts]
    want = {}
    for a, b in pairs:
        n = len(split[a]) + len(split[b])
        r = (n - changes(split[a], split[b], n)) / n
        if r >= 0.94 and (b not in want or r > want[b][1]):
            want[b] = a, r
    assert rows == want and len(want) > 20
    assert seen.value == len(pairs)


def test_confirm_duplicates_equals_plain(spark):
    base = ["w%d" % k for k in range(200)]
    texts = {1: base, 2: base, 3: [*base[:-5], "x", "y", "z", "u", "v"], 4: base[::-1], 5: base[:150], 6: [*base[:50], "new", *base[50:]]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [(7, None), (8, "")], "doc_id long, text string")
    pairs = [(1, 2), (1, 3), (2, 3), (1, 4), (1, 5), (3, 6), (7, 8)]
    got = {r.b: (r.a, round(r.ratio, 9), r.verdict) for r in confirm_duplicates(spark.createDataFrame(pairs, "a long, b long"), docs).collect()}
    ratio = lambda a, b: round(2 * common(texts[a], texts[b]) / (len(texts[a]) + len(texts[b])), 9)
    assert got == {2: (1, 1.0, "confirmed"), 3: (1, ratio(1, 3), "review"), 6: (3, ratio(3, 6), "review")}


def test_isbns_set_apart_by_blanks(spark):
    texts = ["ref 972 662 905 5 end", "9 7 2 6 6 2 9 0 5 5", "978 972 662 905 4", "12 345 678"]
    lines = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "doc_id long, page_no int, text string")
    got = {r.doc_id: r.isbn13 for r in X.extract_isbns(lines).collect()}
    plain = lambda d, s: sum(int(c) * w for c, w in zip(d, s))
    assert plain("9726629055", range(10, 0, -1)) % 11 == 0 and plain("9789726629054", [1, 3] * 7) % 10 == 0
    assert got == {0: "9789726629054", 1: "9789726629054", 2: "9789726629054"}


def test_long_texts_are_compared_whole(spark):
    base = ["w%d" % k for k in range(40_000)]
    other = [*base[:11_000], *["x%d" % k for k in range(1_500)], *base[12_500:]]  # differs outside of start, middle and end
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base * 2))], "doc_id long, text string")
    sig = {r.doc_id: r for r in L.text_signature(docs).collect()}
    assert [sig[k].n_words for k in (1, 2, 3)] == [40_000, 40_000, 80_000]
    assert len({sig[k].text_hash for k in (1, 2, 3)}) == 3
    got = confirm_duplicates(spark.createDataFrame([(1, 2)], "a long, b long"), docs).collect()
    assert [(r.a, r.b, r.verdict) for r in got] == [(1, 2, "review")] and got[0].ratio == pytest.approx(38_500 / 40_000)


def test_one_title_many_copies_costs_no_pairs(spark):
    rows = [(k, "Same Title", "Ana Luz", None) for k in range(3000)] + [(9001, "Other", "Ana Luz", None), (9002, "other!", "Luz, Ana; Rui", None)]
    t = spark.createDataFrame(rows, "rec_id long, title string, author string, isbn string")
    assert sorted((r.rec_id, r.other_id, r["class"]) for r in L.link_by_title_author(t, t).collect()) == [(9001, 9002, "titulo_autor"), (9002, 9001, "titulo_autor")]


def test_prefix_filter_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 5))), "Ana", None, 2000, 100, 1, 1) for k in range(60)]
    side = lambda name: spark.createDataFrame(rows, f"{name} long, title string, author string, isbn string, year int, pages int, edition int, volume int")
    got = {(r.target_id, r.cand_id) for r in L.score_matches(side("target_id"), side("cand_id")).collect()}

    def alike(a, b):
        x, y = set(a.split()), set(b.split())
        c, least = len(x & y), min(len(x), len(y))
        return max(c / len(x | y), c / least * (0.95 if least >= 2 else 0.70)) >= 0.60

    assert got == {(a[0], b[0]) for a in rows for b in rows if alike(a[1], b[1])}


def test_classes_say_what_pairs_say(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "of"]
    isbns = [None, None, "9780801026560", "9788527501811"]

    def row(k):
        return k, " ".join(rng.choices(words, k=rng.randint(0, 6))) or None, rng.choice(["Luz, Ana", "Ana Luz", "", None]), rng.choice(isbns), rng.choice([2000, 2001, None]), rng.choice([100, 105, 300]), rng.choice([1, 2, None]), rng.choice([1, None])

    fields = "title string, author string, isbn string, year int, pages int, edition int, volume int"
    t = spark.createDataFrame([row(k) for k in range(60)], f"target_id long, {fields}")
    c = spark.createDataFrame([row(k) for k in range(60)], f"cand_id long, {fields}")
    want = {(r.target_id, r.cand_id): (r.title_sim, r.author_ok, r.score, r.blocked, r.approved) for r in L.score_matches(t, c).collect()}
    got, parts = {}, {}
    for r in L.score_classes(t, c).collect():
        parts.setdefault(r.part, []).append(r)
    side = lambda part, k: {of: [r for r in parts[part] if r.of == of] for of in {r.of for r in parts[part]}}
    ts, cs = side("target", "target_id"), side("candidate", "cand_id")
    assert sorted(r.target_id for r in parts["target"]) == sorted(r.cand_id for r in parts["candidate"]) == list(range(60))
    for p in parts["pair"]:
        for x in ts[p.target_id]:
            for y in cs[p.cand_id]:
                year, close = x.year is not None and x.year == y.year, abs(x.pages - y.pages) / max(x.pages, y.pages) <= 0.12
                score = (p.score_both if close else p.score_year) if year else p.score_pages if close else p.score
                assert (x.target_id, y.cand_id) not in got
                got[x.target_id, y.cand_id] = (p.title_sim, p.author_ok, score, p.blocked, p.able and score >= 0.68)
    got |= {(r.target_id, r.cand_id): (r.title_sim, r.author_ok, r.score, r.blocked, r.able) for r in parts["isbn"]}
    assert got == want


def test_classes_of_copies_cost_no_pairs(spark):
    t = spark.range(20_000).selectExpr("id target_id", "'Same Title Here' title", "'Luz, Ana' author", "cast(null as string) isbn", "2000 + cast(id % 20 as int) year", "100 pages", "1 edition", "1 volume")
    got = {(r.part, r.n) for r in L.score_classes(t, t.withColumnRenamed("target_id", "cand_id")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert got == {("pair", 1), ("target", 20_000), ("candidate", 20_000)}
