"""Edge rows of the review jobs and of the fused and dispatched records."""

from recordspark.operators import alerts as A
from recordspark.operators import classify as C
from recordspark.operators import fusion as U
from recordspark.operators import review as R
from recordspark.operators import workflow as W


def test_alerts_and_convergence(spark):
    rows = [(1, "A song that went on and on to the", "Ann Lee", "House"), (2, "Ann Lee", "ann LEE", "Ann Lee"), (3, None, None, None), (4, "Life by Ann Lee", "Ann Lee", ""), (5, "x.PDF", "", "")]
    got = {r.rec_id: r.alerts for r in A.plausibility_alerts(spark.createDataFrame(rows, "rec_id long, title string, author string, publisher string")).collect()}
    assert got == {1: "cut off", 2: "author in title; publisher is author", 3: "", 4: "author in title", 5: "layout file"}
    noise = spark.createDataFrame([(3, "title", "stamp"), (5, "author", "scanner")], "rec_id long, field string, reason string")
    got = {r.rec_id: r.alerts for r in A.plausibility_alerts(spark.createDataFrame(rows, "rec_id long, title string, author string, publisher string"), noise).collect()}
    assert got[3] == "title noise: stamp" and got[5] == "author noise: scanner; layout file"
    rows = [(1, "livro", 0, False, "cip", "isbn", False, "", "1999"), (2, "livro", 0, False, "cip", "isbn", False, "", "19"), (3, "livro", 0, False, "cip", "isbn", True, None, None)]
    schema = "rec_id long, type string, n_conflicts int, derived boolean, title_origin string, author_origin string, isbn_confirmed boolean, publisher string, year string"
    got = {r.rec_id: (r.reason, r.year, r.publisher) for r in R.convergence(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("ok", "1999", "[s.n.]"), 2: ("no support", "19", ""), 3: ("ok", "[s.d.]", "[s.n.]")}


def test_authorities(spark):
    rows = [(1, "Maria da Silva; Rui", None), (2, "Press House and João Reis", "Edited by João Reis"), (3, "ana de souza y J MCDONALD Junior", "Tradução: Ana Souza"), (4, "reis, joão", None), (5, None, None)]
    known = spark.createDataFrame([("Silva, Maria",)], "authority string")
    got = sorted((r.rec_id, r.position, r.name, r.how, r.role) for r in R.link_author_authority(spark.createDataFrame(rows, "rec_id long, author string, credits string"), known).collect())
    assert got == [
        (1, 0, "Silva, Maria", "authority", "Autor"), (1, 1, "Rui", "unmatched", "Autor"), (2, 0, "Press House", "institution", "Colaborador"), (2, 1, "Reis, João", "rule", "Editor"),
        (3, 0, "De Souza, Ana", "rule", "Tradutor"), (3, 1, "McDonald Junior, J.", "rule", "Autor"), (4, 0, "Reis, João", "rule", "Autor"),
    ]


def test_authorities_are_dealt_and_read_once(spark):
    rows = spark.createDataFrame([(k, "Ana Luz; Rui Reis", "Edited by Rui Reis") for k in range(40)], "rec_id long, author string, credits string").coalesce(1)
    found = R.link_author_authority(rows, spark.createDataFrame([("Luz, Ana",)], "authority string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " in plan and "Filter (size(" not in plan and "Filter ((size(" not in plan
    assert sorted({(r.position, r.name, r.role) for r in found.collect()}) == [(0, "Luz, Ana", "Colaborador"), (1, "Reis, Rui", "Editor")] and found.count() == 80


def test_dispatch_limit_is_global(spark):
    rows = [("a", 1, False)] * 3 + [("a", 1, True)] + [("b", 2, False)] * 4 + [("c", 3, False)] * 2
    got = {r.queue: (r.available, r.uncertain, r.selected) for r in W.plan_dispatch(spark.createDataFrame(rows, "queue string, ord int, uncertain boolean"), 5).collect()}
    assert got == {"a": (3, 1, 3), "b": (4, 0, 2), "c": (2, 0, 0)}


def test_fusion_prefers_rank_then_value(spark):
    e = spark.createDataFrame([(1, "livro", "title", "b", "z"), (1, "livro", "title", "a", " "), (1, "livro", "title", "c", "y"), (2, "livro", "title", "x", "v")], "rec_id long, type string, field string, source string, value string")
    p = spark.createDataFrame([("livro", "title", "a", 1), ("livro", "title", "b", 2), ("livro", "title", "c", 2)], "type string, field string, source string, rank int")
    assert [(r.rec_id, r.value, r.source) for r in U.fuse_fields(e, p).collect()] == [(1, "y", "c")]


def test_packets_of_items_chosen_before(spark):
    records = spark.createDataFrame([(k, k != 2) for k in range(1, 6)], "rec_id long, open boolean")
    causes = spark.createDataFrame([(1, "isbn", "x"), (3, "isbn", "y"), (3, "year", "z")], "rec_id long, field string, causes string")
    conflicts = spark.createDataFrame([(1, "title")], "rec_id long, field string")
    pages = spark.createDataFrame([(3, 2), (3, 1), (4, 1), (5, 9)], "rec_id long, page_no int")
    against = spark.createDataFrame([(4, "whole issue"), (1, "")], "rec_id long, contradictions string")
    chosen = R.review_packets(records, causes, conflicts, 3).localCheckpoint()
    got = R.full_packets(records, causes, conflicts, pages, against, chosen=chosen)
    assert sorted(got.collect()) == sorted(R.full_packets(records, causes, conflicts, pages, against, 3).collect())
    assert sorted((r.rec_id, r.gaps, r.pages, r.action) for r in got.collect()) == [(1, "isbn: x", "", "decide"), (3, "isbn: y | year: z", "1, 2", "complete"), (4, "", "1", "check type")]


def test_type_rules_are_tested_once(spark):
    pages = spark.createDataFrame([(1, 1, "Manual de Metodologia"), (2, 1, "Regimento interno da igreja"), (3, 1, None)], "doc_id long, page_no int, text string")
    files = spark.createDataFrame([(k, "f.pdf", "", None, False, True, True, 50) for k in (1, 2, 3)], "doc_id long, name string, producer string, periodical string, approved boolean, isbn_confirmed boolean, external boolean, n_pages int")
    found = C.classify_document(pages, files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("main contents") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "apostila", 4, False), (2, "livro", 24, True), (3, "livro", None, False)]
