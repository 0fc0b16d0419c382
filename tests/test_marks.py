"""Known pages for the forms of lines, and the classes of a line."""

from recordspark.operators import classify as C
from recordspark.operators import marks as K

#: A first page, its type and the number of the rule.
PAGES = [
    ("Revista Sol, v. 3, n. 4, 2001\nO presente estudo\nResumo: y", "artigo", 7),
    ("Acta Nova 12/3 (1999)\nSilva, Ana. A Casa Velha. Porto: Mar\n— Rui Reis", "artigo", 7),
    ("3\nA casa e o rio\nAna Luz\n1. Introdução\nprofessor da Faculdade Sul", "artigo", 18),
    ("LAB | sessão\nConferência Norte 2019", "apostila", 14),
    ("Caderno Igreja\nmódulo 1", "apostila", 14),
    ("Tema: fé\nsermão", "sermão", 15),
    ("Obtenção do título de mestre", "trabalho acadêmico", 16),
    ("Tese\napresentada", "tese", 5),
    ("Por Ana Luz | 3 meses atrás", "artigo", 18),
    ("Abstract\nISSN 1234-5678\n2001 12(3): 45", "artigo", 18),
    ("Uma casa comum em 1999", "livro", None),
]


def test_types(spark):
    pages = spark.createDataFrame([(k, 1, p[0]) for k, p in enumerate(PAGES)], "doc_id long, page_no int, text string")
    files = spark.createDataFrame([(k, "x.pdf", None, None, False, False, False, 1) for k in range(len(PAGES))], "doc_id long, name string, producer string, periodical string, approved boolean, isbn_confirmed boolean, external boolean, n_pages int")
    got = {r.doc_id: (r.type, r.rule) for r in C.classify_document(pages, files).collect()}
    assert got == {k: (t, n) for k, (_, t, n) in enumerate(PAGES)}


def test_classes(spark):
    df = spark.createDataFrame([("por ana | 3 meses atras\n\nvol. iv, n. 12 (1999) - 2000!",)], "t string")
    assert df.select(K.line_classes("t")).first()[0] == "bx|NUK\n\nv.R,i.N(Y)hY~"
    assert len({w for ws in K.WORDS.values() for w in ws}) == sum(map(len, K.WORDS.values()))
