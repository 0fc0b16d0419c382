"""Cataloguing cards without a header, known by how many of nine signs a page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that make a page a card, and the pages looked at.
LEAST_SIGNS, FIRST_PAGES = 4, 10

_NAME = r"\p{Lu}[\p{L}'’-]+, \p{Lu}[\p{L}'’. -]{1,60}?"
_HEADING = rf"(?m)^[ \t]*(?:[A-Z][0-9]{{2,5}}[a-z]?[ \t]+)?({_NAME})(?:, [0-9]{{4}}-[0-9]{{0,4}})?[.;]?[ \t]*$"
#: Place, house and year at the beginning of what follows a dash.
_STATEMENT = r"^\s*([^:;]{2,90}):[ \t]*([^,;:\n]{2,80}),[ \t]*\[?((?:19|20)[0-9]{2})\b"
#: Title and responsibility at the end of what stands before it.
_CREDIT = r"([^\n/]{2,300})[ \t]/[ \t]+([^\n/.]{3,150})[. \t\n]*$"
_CODE = r"\b(CDD|CDU)[ :.-]*([0-9][0-9.]*)"


def _tidy(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def cards_by_signs(pages: DataFrame, least: int = LEAST_SIGNS) -> DataFrame:
    """doc_id, page_no, n_signs, title, author, city, publisher, year, n_pages, isbn, class of the first card among the first ten pages.

    Nine signs: a publisher's label, an ISBN with its label, a number of pages, a CDD or CDU code, a line `Surname, Names`, a year, a
    publication statement (`- place: house, year`, the place perhaps over two lines), and a title and a
    responsibility (`title / names`) before it. A page is a card with `least` of them, one being a name, a house or a statement. The statement
    goes before the label, the heading before the responsibility; without a statement the latest year of the page counts.
    What a card lacks is null. Null texts show no sign; documents without a card, and an empty table, give no rows; of repeated
    pages the least row is taken.
    """
    text = F.coalesce("text", F.lit(""))
    found = lambda p, k: F.nullif(_tidy(F.regexp_extract("t", p, k)), F.lit(""))
    p = pages.where(F.col("page_no") <= FIRST_PAGES).select("doc_id", "page_no", text.alias("t"), F.split(text, r"(?:^|[\s.])[-–—]").alias("parts"))
    place = F.filter(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.element_at("parts", k + 1).rlike(_STATEMENT))
    p = p.withColumn("at", F.when(F.size("parts") > 1, F.get(place, F.lit(0))))
    p = p.withColumns({"after": F.when(F.col("at").isNotNull(), F.element_at("parts", F.col("at") + 1)), "before": F.when(F.col("at").isNotNull(), F.element_at("parts", F.col("at")))})
    of = lambda c, pattern, k: F.nullif(_tidy(F.regexp_extract(c, pattern, k)), F.lit(""))
    isbn = F.upper(F.regexp_replace(F.regexp_extract("t", r"(?i)\bisbn[: \t-]*([0-9][0-9Xx -]{8,16}[0-9Xx])", 1), "[^0-9Xx]", ""))
    last_year = F.array_max(F.regexp_extract_all("t", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))
    p = p.select(
        "doc_id", "page_no", found(r"(?im)^[ \t]*(?:editora|editorial|publisher)[ \t]*:[ \t]*([^\n]{2,80})$", 1).alias("house"), F.when(F.length(isbn).isin(10, 13), isbn).alias("isbn"),
        F.regexp_extract("t", r"(?i)\b([0-9]{1,5}) ?pp?\b", 1).alias("n"), F.nullif(F.concat_ws(" ", found(_CODE, 1), found(_CODE, 2)), F.lit("")).alias("class"), found(_HEADING, 1).alias("heading"),
        F.coalesce(of("after", _STATEMENT, 3), last_year).alias("year"), of("after", _STATEMENT, 1).alias("city"), of("after", _STATEMENT, 2).alias("stated"), of("before", _CREDIT, 1).alias("title"), of("before", _CREDIT, 2).alias("credit"),
    ).withColumn("n_pages", F.nullif("n", F.lit("")).cast("int"))
    signs = ("house", "isbn", "n_pages", "class", "heading", "year", "stated", "title", "credit")
    p = p.withColumn("n_signs", sum((F.col(c).isNotNull().cast("int") for c in signs), F.lit(0)))
    cards = p.where((F.col("n_signs") >= least) & F.coalesce("heading", "house", "stated").isNotNull())
    fields = ("page_no", "n_signs", "title", F.coalesce("heading", "credit").alias("author"), "city", F.coalesce("stated", "house").alias("publisher"), "year", "n_pages", "isbn", "class")
    return cards.groupBy("doc_id").agg(F.min(F.struct(*fields)).alias("card")).select("doc_id", "card.*")
