"""Known lines of credit pages: years of editions by classes of words, values by labels."""

import pytest
from pyspark.sql import functions as F

from recordspark.operators import credits as C
from recordspark.operators import extract as X

#: Lines, and the year of this edition that they give.
EDITIONS = [
    ("Copyright da tradução © Casa Nova 2003", 2003),
    ("Primeira edição em português: 1999", 1999),
    ("1.ª edição – 1987", 1987),
    ("First printing 1971", 1971),
    ("Ebook edition published 2012", 2012),
    ("Publicação digital: 2015", 2015),
    ("Edición en castellano © 1998", 1998),
    ("2nd edition © House", None),
    ("2nd edition ©\n2004 House", 2004),
    ("Entered according to Act of Congress, in the year 1884, by A. B.", 1884),
    ("London: Hodder and Stoughton, 1901", 1901),
    ("First edition: 2099", None),
    ("He was born in London in 1901", None),
    ("A first edition\nof nothing", None),
    ("Primeira edição: 1990\nCopyright da tradução © 1991", 1991),
]


def test_edition_years(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(EDITIONS)], "k int, t string").withColumn("ls", F.split("t", "\n"))
    got = {r.k: r.y for r in df.select("k", C.edition_year("ls", 2026).alias("y")).collect()}
    assert got == {k: y for k, (_, y) in enumerate(EDITIONS)}


@pytest.mark.parametrize(
    "lines,field,value",
    [
        ("Título original: The Long Road", "original_title", "The Long Road"),
        ("Originally published in English as\nThe Long Road © 1980", "original_title", "The Long Road"),
        ("Tradução: Rui de Souza", "translator", "Rui de Souza"),
        ("Tradução de Maria Luz; revisão de Ana", "translator", "Maria Luz"),
        ("a tradução foi feita", "translator", None),
        ("This book was Published by House of Words, Boston", "publisher", "House of Words"),
        ("Copyright © 2001 Editora Nova", "publisher", "Editora Nova"),
        ("© Ediciones Sol, 1987", "publisher", "Ediciones Sol"),
        ("Editora Mar Azul.", "publisher", "Editora Mar Azul"),
        ("Editora: nada", "publisher", None),
        ("Todos os direitos reservados por Casa Norte, 2003", "publisher", "Casa Norte"),
        ("This is the 3rd edition of it", "edition", "3rd edition"),
        ("12ª Edição revista", "edition", "12ª Edição"),
    ],
)
def test_credit_lines(spark, lines, field, value):
    pages = spark.createDataFrame([(1, 1, lines + "\nISBN 1"), (2, 1, None)], "doc_id long, page_no int, text string")
    got = {r.field: r.value for r in X.catalog_card_fields(pages).where("source = 'copyright'").collect()}
    assert got.get(field) == value
