"""Known rows of each job: what goes in and what must come out."""

import json

import pytest
from pyspark.sql import functions as F

from recordspark.operators import cards as N
from recordspark.operators import classify as C
from recordspark.operators import cover as V
from recordspark.operators import extract as X
from recordspark.operators import fusion as U
from recordspark.operators import generic as D
from recordspark.operators import linkage as L
from recordspark.operators import mining as M
from recordspark.operators import quality as Q
from recordspark.operators import review as R
from recordspark.sources import pages as P
from recordspark.sources import payloads as S


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_legible_indexes_are_not_weak(spark):
    names = "\n".join(f"Sobrenome, Nome Completo, {n}, {n + 10}n3, {n + 20}" for n in range(1, 40))
    dotted = "SUMÁRIO\n" + "\n".join(f"Capítulo completo com palavras legíveis {n}........................................ {n + 10}" for n in range(1, 12))
    links = "\n".join(f"{n}:1–{n + 3} [<<], [ << ]" for n in range(1, 12)) + "\nGênesis\nÊxodo"
    refs = lambda dash: "\n".join(f"{n}:3{dash}7 {100 + n}{dash}{110 + n}n2, {n}" for n in range(1, 12)) + "\nOLD TESTAMENT"
    only_dash = "\n".join(f"{n} — {n + 40}" for n in range(1, 12))
    prose = "\n".join("xkcd fghj qwrt zxcv bnmp" for _ in range(12))
    pages = [names, dotted, links, refs("-"), refs("–"), refs("—"), only_dash, prose, None, "short"]
    got = {r.page_no: r["class"] for r in Q.page_class(rows(spark, [(1, k, t) for k, t in enumerate(pages)], "doc_id long, page_no int, text string")).collect()}
    assert [got[k] for k in range(7)] == ["texto_bom"] * 7
    assert got[7] == "texto_bom" or got[7] == "texto_fraco"
    assert got[8] == "sem_texto" and got[9] == "texto_curto"
    again = Q.page_class(rows(spark, [(None, 1, names), (1, 1, names), (1, 1, names)], "doc_id long, page_no int, text string"))
    assert again.count() == 3


@pytest.mark.parametrize(
    "line,link,reference",
    [("1, 2-3 [<<]", True, False), ("12 [<<] x", False, False), ("[<<]", False, False), ("3:16 120", False, True), ("3:16-18 120, 133", False, True), ("3.16,18 — 20", False, True), ("12-34", False, True), ("12–34,5 20", False, False), ("12", False, False), ("1234 5", False, False), ("5 12n3-14", False, True), ("5 a", False, False)],
)
def test_lines_by_pieces(spark, line, link, reference):
    r = rows(spark, [(line,)], "x string").select(Q._is_link(F.col("x")).alias("l"), Q._is_reference(F.col("x")).alias("r")).first()
    assert (r.l, r.r) == (link, reference)


def test_provenance(spark):
    texts = ["Machine Translated by Google\nUM CREDO", "lt.PDF\n<- Previous First Next ->\ntexto", "Verdadeiros\n©1999 por Andre", "Cópia digital não comercial", "http://s.org/a\nhttps://S.org/b\nhttp://s.org/c", "http://s.org/a\nhttp://s.org/b\nhttp://s.org/c\nISBN 1", "http://s.org/a\nhttp://s.org/b", "baixado do Scribd", None]
    got = Q.provenance_flags(rows(spark, [(k, t, "i") for k, t in enumerate(texts)], "doc_id long, text string, isbn string"), isbn="isbn").orderBy("doc_id").collect()
    assert [r.machine_translated for r in got] == [True] + [False] * 8
    assert [r.site_capture for r in got] == [False, True, False, False, True, False, False, False, False]
    assert [r.isbn for r in got] == [None, None, "i", None, None, "i", "i", "i", "i"] and got[7].shared_copy


def test_printed_page_numbers(spark):
    pages = [(1, k, f"texto\n{k + 8}") for k in range(1, 5)] + [(2, k, f"livro.indd {k if k < 3 else k + 1}\nx") for k in range(1, 5)] + [(3, k, "1998") for k in range(1, 5)] + [(4, k, f"t\n{k}") for k in range(1, 5)]
    got = {r.doc_id: (r.gap_from, r.gap_to, r.late_start, r.partial) for r in Q.page_sequence_gaps(Q.printed_numbers(rows(spark, pages, "doc_id long, page_no int, text string"))).collect()}
    assert got == {1: (None, None, True, True), 2: (2, 4, False, True), 4: (None, None, False, False)}


def test_classification_numbers(spark):
    codes = {"CDU 27-1": "230", "CDU 22": "220", "CDU 27(091)": "270", "CDU 27-4": "240", "CDU 27": "230", "CDU 27-23": "220", "CDU 28": "297", "CDU 29": "290", "CDU 2": "200", "CDU 27-31": "241", "CDU 27 . 36": "248", "CDU 37": None, "27-1": None, "": None}
    got = X.map_classification(rows(spark, [(k, "", c) for k, c in enumerate(codes)] + [(99, "813", "CDU 22")], "rec_id long, ddc string, original string")).orderBy("rec_id").collect()
    assert [r.ddc for r in got] == [*codes.values(), "813"]
    assert [r.suggested for r in got] == [v is not None for v in codes.values()] + [False] and got[0].original == "CDU 27-1"
    found = X.extract_classification(rows(spark, [(1, "ficha\nC D D – 230.1"), (2, "nada"), (3, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.label, r.code) for r in found] == [(1, "CDD", "230.1")]


def test_person_lines(spark):
    lines = {"Maria de Souza": 35, "Dr. Ana Luz": 135, "Ana Luz 1999": -100, "ana@x.org": -100, "www.site.org": -100, "Editora Vida Nova": -25, "Luz": -15, "Edited by Ana": -30, "ISBN 12": -100, "": -100, "LUZ": -75}
    got = {r.line: r.s for r in rows(spark, [(x,) for x in lines], "line string").select("line", X.person_score(F.col("line")).alias("s")).collect()}
    assert got == lines


def test_isbns_of_volumes(spark):
    text = "ISBN 978-0-8010-2632-4 (tela: v. 1)\nISBN 978-0-8010-2655-3 (tela: v. 2)\nISBN 978-0-8010-2656-0 (tela: v. 3)"
    pages = rows(spark, [(1, 1, text), (2, 1, "ISBN 978-0-8010-2656-0\n1. Teologia"), (3, 1, "12345")], "doc_id long, page_no int, text string")
    found = X.extract_isbns(pages)
    assert [(r.isbn13, r.volume, r.format) for r in found.where("doc_id = 1").orderBy("line_no").collect()] == [("9780801026324", "1", "capa dura"), ("9780801026553", "2", "capa dura"), ("9780801026560", "3", "capa dura")]
    assert [r.isbn13 for r in found.where("doc_id = 2").collect()] == ["9780801026560"]
    files = rows(spark, [(1, "3", 2006), (3, None, 1960), (4, None, 2000)], "doc_id long, file_volume string, year int")
    got = {r.doc_id: (r.isbn13, r.reason) for r in X.choose_isbn(found.withColumn("origin", F.lit("page")), files).collect()}
    assert got == {1: ("9780801026560", "volume"), 3: (None, "none: before 1970"), 4: (None, "none: not found")}


def test_matches_are_blocked_and_explained(spark):
    fields = "title string, author string, isbn string, year int, pages int, edition int, volume int"
    t = rows(spark, [(1, "Dogmática", "Barth, Karl", "9788527501811", None, None, 2, 3), (2, "História dos Batistas", "Mesquita, Antônio", None, None, None, None, None), (3, "Crítica Textual do Novo Testamento", "Paroschi, Wilson", "9788527501811", None, 100, None, None)], f"target_id long, {fields}")
    c = rows(spark, [(1, "Dogmática", "Karl Barth", "9780801026560", None, None, 1, 2), (2, "História dos Metodistas", "João Outro", None, None, None, None, None), (3, "Crítica Textual", "Wilson Paroschi", "8527501813", 1993, 112, None, None)], f"cand_id long, {fields}")
    got = {(r.target_id, r.cand_id): r for r in L.score_matches(t, c).collect()}
    assert not got[1, 1].approved and got[1, 1].rejections == "other isbn; other edition; other volume"
    assert not got[2, 2].approved and got[2, 2].rejections == "other title; author not found; not enough"
    one = got[3, 3]
    assert one.approved and one.score >= 1.0 and one.confirmations.startswith("isbn; ") and "pages" in one.confirmations


def test_language_phrases(spark):
    docs = rows(spark, [(1, "All rights reserved"), (2, "Tous  droits réservés"), (3, "tous droits"), (4, "não e para"), (5, "und der die")], "doc_id long, text string")
    got = {r.doc_id: (r.detected, r.hits) for r in M.detect_language(docs).collect()}
    assert got == {1: ("eng", 1), 2: ("", 0), 3: ("fre", 1), 4: ("por", 2), 5: ("", 0)}


def test_academic_packages(spark):
    data = [(1, "doi 10.1234/ab Resumo: x", "documento", None, 10), (2, "doi 10.1234/ab", "livro", None, 10), (3, "10.1234/ab abstract", "livro", None, 101), (4, "texto", "livro", "978", 0), (5, "resumo palavras-chave ISSN 1234-5678", "apostila", None, 0)]
    got = {r.doc_id: (r.becomes_article, r.consult) for r in M.type_signals(rows(spark, data, "doc_id long, text string, type string, isbn string, n_pages int")).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, True)}


def test_document_types(spark):
    texts = {1: ("Aula 1 - a\nAula 2 - b\nAula 3 - c\nAula 4 - d", "x.pdf", "apostila", 8), 2: ("Tese apresentada ao curso", "x.pdf", "tese", 5), 3: ("um livro comum", "x.pdf", "livro", None), 4: ("Manual de metodologia", "x.pdf", "apostila", 4), 5: ("curso de grego", "apostila_1.pdf", "apostila", 2), 6: ("Regimento interno da igreja", "x.pdf", "documento", 24), 7: ("Regimento interno da igreja ISBN 1", "x.pdf", "livro", None)}
    pages = rows(spark, [(k, 1, t[0]) for k, t in texts.items()] + [(8, k, "slide") for k in range(1, 6)], "doc_id long, page_no int, text string")
    files = rows(spark, [(k, t[1], None, None, False, False, False, 1) for k, t in texts.items()] + [(8, "a.pdf", "PowerPoint", None, False, False, False, 5)], "doc_id long, name string, producer string, periodical string, approved boolean, isbn_confirmed boolean, external boolean, n_pages int")
    got = {r.doc_id: (r.type, r.rule) for r in C.classify_document(pages, files).collect()}
    assert got == {k: (t[2], t[3]) for k, t in texts.items()} | {8: ("apresentação", 12)}


def test_cards_by_signs(spark):
    texts = {
        1: ["", "S586c Silva, Ana de\nA casa do rio / Ana de Silva. - São José\ndos Campos : Mar Alto, 2011.\n214 p.\nISBN 978-85-7742-123-4\nCDD 869.3"],
        2: ["Editora: Mar\nISBN: 85 7742 123 X\n300 pp.\n2001"],
        3: ["ISBN 9788577421234\n12 p.\nCDU: 22\n1999"],  # four signs, none of them a name or a house
        4: ["Luz, Eva\n1980", None, "Luz, Eva;\nEditora: Sul\n1980, 1985\n30 p."],
        5: ["um texto"] * 10 + ["Editora: Mar\nISBN: 857742123X\n300 p.\n2001"],  # beyond the tenth page
    }
    pages = rows(spark, [(k, n, t) for k, ts in texts.items() for n, t in enumerate(ts, 1)], "doc_id long, page_no int, text string")
    got = {r[0]: tuple(r[1:]) for r in N.cards_by_signs(pages).collect()}
    assert got == {
        1: (2, 8, "A casa do rio", "Silva, Ana de", "São José dos Campos", "Mar Alto", "2011", 214, "9788577421234", "CDD 869.3"),
        2: (1, 4, None, None, None, "Mar", "2001", 300, "857742123X", None),
        4: (3, 4, None, "Luz, Eva", None, "Sul", "1985", 30, None, None),
    }
    assert N.cards_by_signs(pages.limit(0)).count() == 0


def test_generic_documents(spark):
    texts = {
        1: ("Estudo da casa\nAutor: Ana Luz\nhttp://a.org/2011/x.", "f.pdf", False, ("documento", "Estudo da casa", "Ana Luz", "2011", "http://a.org/2011/x", "alta")),
        2: ("Estudo\nwww.a.org,www.b.org", "f.pdf", False, ("documento", "Estudo", "", "", "www.a.org www.b.org", "media")),
        3: ("curso de grego", "minha apostila.doc", True, ("apostila", "curso de grego", "", "", "", "baixa")),
        4: ("Questionário\nAutor: Eva", "f.pdf", False, ("arquivo inválido", "Questionário", "", "", "", "descarte")),
        5: ("Estudo\nFonte: x\nISBN 1", "f.pdf", True, None),
        6: ("um texto comum", "f.pdf", False, None),
        7: ("Carta\nAutora: Eva Sol\n3 de março de 1999", None, None, ("documento", "Carta", "Eva Sol", "1999", "", "alta")),
        8: (None, "resumo.pdf", False, ("arquivo inválido", "", "", "", "", "descarte")),
        9: ("", "f.pdf", True, None),
    }
    texts[7] = (texts[7][0] + "\nFonte: casa", *texts[7][1:])
    pages = rows(spark, [(k, 1, t[0]) for k, t in texts.items()], "doc_id long, page_no int, text string")
    files = rows(spark, [(k, t[1], t[2]) for k, t in texts.items()], "doc_id long, name string, word boolean")
    got = {r.doc_id: tuple(r[1:]) for r in D.generic_documents(pages, files).collect()}
    assert got == {k: t[3] for k, t in texts.items() if t[3]}
    assert D.generic_documents(pages.limit(0), files).count() == 0


def test_generic_titles_are_whole_lines(spark):
    texts = {1: "Autor: Eva Sol\nCarta 19.37.233.111", 2: "Autor: Eva Sol\n 1 casa 1 ", 3: "TÍTULO: A casa\nFonte: b", 4: "Estudo\nhttp://é-\nó.org"}
    pages = rows(spark, [(k, 1, t) for k, t in texts.items()], "doc_id long, page_no int, text string")
    got = {r.doc_id: (r.title, r.sources) for r in D.generic_documents(pages, pages.selectExpr("doc_id", "'f.pdf' name", "false word")).collect()}
    assert got == {1: ("Carta 19.37.233.111", ""), 2: ("1 casa 1", ""), 3: ("A casa", ""), 4: ("Estudo", "http://é-ó.org")}


def test_cover_titles(spark):
    b = lambda c, text, left, top, w, h, area, mean, author: (c, text, author, left, top, w, h, area, mean)
    data = [
        b(1, "DO AUTOR CAMPEÃO DE VENDAS ANA LUZ", 80, 80, 540, 50, 27000, 28, "Ana Luz"), b(1, "Tornando-se um", 120, 210, 400, 55, 22000, 42, "Ana Luz"), b(1, "LÍDER", 95, 270, 550, 115, 63250, 96, "Ana Luz"),
        b(1, "TODOS PODEM CONSEGUIR", 135, 390, 475, 55, 26125, 40, "Ana Luz"), b(1, "ANA LUZ", 160, 720, 400, 60, 24000, 44, "Ana Luz"), b(2, "HERMAN REIS", 80, 100, 570, 110, 62700, 90, "Herman Reis"), b(2, "DOGMÁTICA REFORMADA", 130, 310, 490, 80, 39200, 62, "Herman Reis"), b(3, "1998", 1, 1, 9, 9, 81, 9, None),
    ]
    blocks = rows(spark, data, "cover_id long, text string, author string, left int, top int, width int, height int, area int, mean_height int")
    assert {r.cover_id: r.title for r in V.cover_title(blocks).collect()} == {1: "Tornando-se um LÍDER TODOS PODEM CONSEGUIR", 2: "DOGMÁTICA REFORMADA"}
    known = rows(spark, [("Dogmática Reformada",)], "name string")
    assert V.cover_title(blocks, known).where("cover_id = 2").count() == 0


def test_titles_are_fused(spark):
    schema = "rec_id long, title string, title_origin string, api_title string, api_subtitle string, api_author string, exact_isbn boolean, by_title_author boolean, national boolean, trade_high boolean, trade_isbn boolean, cover_visual string, cover_title string, pdf_title string, copyright_title string, first_page_title string, file_title string"
    r = lambda k, title, origin, api, exact=False, **more: (k, title, origin, api, "sub", None, exact, more.get("by", False), False, False, False, more.get("visual"), more.get("cover"), more.get("pdf"), None, None, more.get("file"))
    data = [r(1, "Se Líder", "card", "Lead", False), r(2, "Se Líder", "card", "Be a Leader", True), r(3, "A Casa Verde", "card", "A casa verde!", False), r(4, "", "card", "A Casa", False), r(5, "", "card", "", pdf="Casa Verde", file="A Casa Verde do Monte"), r(6, "x.indd", "card", "", visual="A Casa Azul"), r(7, None, None, None)]
    got = {x.rec_id: (x.title, x.origin, x.original_title, x.from_other_language) for x in U.fuse_title(rows(spark, data, schema)).collect()}
    assert got[1] == ("Se Líder", "card", "Lead", False) and got[2] == ("Be a Leader", "exact isbn", "", False) and got[3] == ("A casa verde!", "api", "", False)
    assert got[4] == ("A Casa", "api, other language?", "", True) and got[5] == ("A Casa Verde do Monte", "pdf metadata, completed by file name", "", False)
    assert got[6] == ("A Casa Azul", "visual title", "", False) and got[7] == ("", "", "", False)


def test_payloads(spark):
    marc = '<z:r xmlns:z="u"><z:record><record xmlns="m"><controlfield tag="001">12345</controlfield><datafield tag="020"><subfield code="a">9781620135143</subfield></datafield><datafield tag="100"><subfield code="a">Mulli, Charles</subfield></datafield><datafield tag="245"><subfield code="a">Diamonds</subfield><subfield code="b">a testimony</subfield></datafield><datafield tag="264"><subfield code="a">New York</subfield><subfield code="b">Example Press</subfield><subfield code="c">2015</subfield></datafield><datafield tag="300"><subfield code="a">240 pages</subfield></datafield></record></z:record></z:r>'
    dc = '<s:r xmlns:s="u"><o:dc xmlns:o="v" xmlns:dc="w"><dc:identifier>http://c/ark:/1/cb1</dc:identifier><dc:identifier>ISBN 2070363732</dc:identifier><dc:title>La Promesse / R. Gary</dc:title><dc:creator>Gary, Romain (1914-1980). Auteur du texte</dc:creator><dc:publisher>Gallimard (Paris)</dc:publisher><dc:date>1973</dc:date><dc:format>370 p. ; 18 cm</dc:format></o:dc></s:r>'
    archive = json.dumps({"response": {"docs": [{"identifier": "a", "isbn": ["9780801026560"], "title": "T", "creator": ["A", "A"]}, {"identifier": "b", "isbn": "9780801026577", "title": "wrong"}]}})
    data = [(1, "marcxml", "978-1-62013-514-3", marc), (2, "dublin_core", "2-07-036373-2", dc), (3, "internet_archive", "9780801026560", archive), (4, "marcxml", "9780801026560", marc), (5, "tei", None, "<broken"), (6, "crossref", None, "{bad"), (7, "cbl", None, None), (8, "unknown", None, "{}")]
    got = {r.query_id: r for r in S.normalise_payloads(rows(spark, data, "query_id long, source string, isbn string, payload string")).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].title, got[1].subtitle, got[1].authors, got[1].publisher, got[1].pages, got[1].place, got[1].identifier) == ("Diamonds", "a testimony", ["Mulli, Charles"], "Example Press", "240", "New York", "12345")
    assert (got[2].title, got[2].authors, got[2].publisher, got[2].place, got[2].pages, got[2].isbn) == ("La Promesse", ["Gary, Romain"], "Gallimard", "Paris", "370", "9782070363735")
    assert (got[3].authors, got[3].identifier) == (["A"], "a")


def test_sharded_store(spark, tmp_path):
    one = {"hash_sha256": "ab12", "arquivo_origem": "f", "campos": {"titulo": "T", "autores": [{"nome": "A", "desc": "Autor"}]}, "fontes": ["x"], "id_remoto": 7}
    (tmp_path / "in" / "ab").mkdir(parents=True)
    (tmp_path / "in" / "ab" / "ab12.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "in" / "bad.json").write_text("{broken")
    (tmp_path / "in" / "none.json").write_text(json.dumps({"campos": {"titulo": "no hash"}}))
    good, bad = S.read_sharded_records(spark, str(tmp_path / "in"))
    assert [(r.hash_sha256, r.campos.titulo, r.campos.autores[0].nome, r.id_remoto) for r in good.collect()] == [("ab12", "T", "A", 7)]
    assert sorted(r.reason for r in bad.collect()) == ["no hash", "no json"]
    S.write_sharded_records(good.drop("file"), str(tmp_path / "out"))
    again, none = S.read_sharded_records(spark, str(tmp_path / "out"), one_per_file=False)
    assert again.select("hash_sha256", "campos.titulo").collect() == [("ab12", "T")] and none.count() == 0
    assert "prefix=ab" in again.first().file
    with pytest.raises(ValueError):
        S.write_sharded_records(good.drop("file").withColumn("hash_sha256", F.lit(None).cast("string")), str(tmp_path / "no"))


def test_periodicals(spark):
    texts = {1: "a\nHerald\nb", 2: "the herald of dawn", 3: "Herald vol. 3", 4: "The Nation Review here, ISSN 1111-2222", 5: "nation  review", 6: None}
    table = rows(spark, [("Herald", "herald", None), ("Nation Review", "Nation Review", "2222-3333"), ("Echo", "echo", "1111-2222")], "periodical string, alias string, issn string")
    got = {r.doc_id: r.periodical for r in R.identify_periodical(rows(spark, list(texts.items()), "doc_id long, text string"), table).collect()}
    assert got == {1: "Herald", 3: "Herald", 4: "Echo", 5: "Nation Review"}


def test_card_fields_are_whole(spark):
    long = "A" + "b" * 120
    pages = rows(spark, [(1, 1, f"{long}\nSecond Line\nTitle: The Road\nPublisher: House\nYear: 99")], "doc_id long, page_no int, text string")
    got = {(r.field, r.source): r.value for r in X.catalog_card_fields(pages).collect()}
    assert got["title", "labelled sheet"] == "The Road" and got["publisher", "labelled sheet"] == "House"
    assert got["title", "first pages"] == "Second Line" and ("year", "labelled sheet") not in got


def test_record_links_and_meta(spark):
    html = """<head><meta content='A 1999 title' name='citation_title'></head><a href='/r/10'>x</a><a href="/r/9/">y</a><a href="/r/10">z</a><a href="/about">n</a>"""
    pages = rows(spark, [(1, html), (2, None)], "page_id long, html string")
    assert [(r.place, r.link, r.number) for r in P.record_links(pages).collect()] == [(1, "/r/9", 9), (2, "/r/10", 10)]
    r = P.html_record_metadata(pages).where("page_id = 1").first()
    assert (r.title, r.year) == ("A 1999 title", 1999)
