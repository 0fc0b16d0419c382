"""Studies, handouts and web documents without a card: what their first and last pages say of them, and how far to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.operators.scopes import document_scopes

#: Months of dates written out, words of files to throw away, marks of published books and labels of documents, in plain form. Fixed values.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
DISCARDED = ("resumo", "questionario")
BOOK_MARKS = r"\b(?:isbn|copyright|tradutor)\b|[©℗]|dados (?:internacionais )?de catalogacao|ficha catalografica|(?:editora|publisher|publicado por)\s*:"
DOCUMENT_MARKS = r"\b(?:fonte|autor)\s*:|publicado em [0-9]|blogspot\.|geocities\.|artigos?_print\.php|\bcurso de\b"

_ADDRESS = r"(?i)(?:https?://|www\.)[^\s<>()]+"
_YEAR = r"(?:19|20)[0-9]{2}"


def addresses(x: Column) -> Column:
    """Distinct web addresses in order: a word cut by a hyphen at the end of a line is whole again, a comma before the next address ends one, closing signs go."""
    whole = F.regexp_replace(F.regexp_replace(x, r"([\p{L}0-9_])-[ \t]*\n\s*([\p{L}0-9_])", "$1-$2"), r"(?i),(https?://|www\.)", " $1")
    return F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(_ADDRESS), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:)\]}]+$", "")))


def _label(scope: str, names: str) -> Column:
    """What follows a label on its line, 3 to 120 characters; empty without one."""
    return F.trim(F.regexp_extract(scope, rf"(?imu)^[ \t]*(?:{names})[ \t]*:[ \t]*([^\n]{{3,120}})$", 1))


def generic_documents(pages: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, kind, title, author, year, sources (addresses, parted by blanks), confidence; a row for each document that is of this kind.

    pages: doc_id, page_no, text; files: doc_id, name, word (made by a word processor). A summary or questionnaire, by its
    file name or title, is `arquivo inválido` with confidence `descarte`. Otherwise a title, no mark of a published book and
    one of word origin, a document's label or an address make a documento, or an apostila if the file name says so: `alta` with
    an author and an address or a year, `media` with an address or an author, `baixa` without. title: what a label gives,
    else the first line of 4 to 120 characters on page 1 that has a letter and is no address or label. year: of a publication
    note, of a date written out on a line of the first three pages, or in the path of the first address. Null texts and names are
    empty; a document without pages, or an empty table, gives no rows; repeated file rows give repeated rows.
    """
    name = T.plain(F.regexp_replace(F.coalesce("name", F.lit("")), r"\.[^.]*$", ""))
    d = document_scopes(pages).join(files.select("doc_id", name.alias("stem"), F.coalesce("word", F.lit(False)).alias("word")), "doc_id")
    line = F.filter(F.transform(F.split("page1", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(4, 120) & x.rlike(r"\p{L}") & ~x.rlike(r"(?i)^(?:https?://|www\.)") & ~x.rlike(r"^[^\s:]+[ \t]*:"))
    labelled = _label("page1", "t[ií]tulo|title")
    d = d.withColumn("title", F.when(labelled != "", labelled).otherwise(F.coalesce(F.get(line, F.lit(0)), F.lit(""))))
    d = d.withColumns({"author": _label("edges", "autora?|author|por"), "urls": addresses(F.col("edges")), "low": T.plain(F.col("edges"))})
    noted = F.regexp_extract("low", rf"publicado\s+em\s+[0-9]{{1,2}}/[0-9]{{1,2}}/({_YEAR})", 1)
    spelt = F.regexp_extract(T.plain(F.col("first3")), rf"(?m)^[ \t]*[0-9]{{1,2}} de (?:{'|'.join(MONTHS)}) de ({_YEAR})[ \t]*$", 1)
    path = F.regexp_extract(F.coalesce(F.get("urls", F.lit(0)), F.lit("")), rf"/({_YEAR})/", 1)
    year = F.coalesce(*(F.when(x != "", x) for x in (noted, spelt, path)))
    bad = F.concat_ws(" ", "stem", T.plain(F.col("title"))).rlike(rf"(?:^|[^a-z0-9])(?:{'|'.join(DISCARDED)})(?:[^a-z0-9]|$)")
    published = T.plain(F.concat_ws("\n", "first10", "last3")).rlike(BOOK_MARKS)
    linked, signed = F.size("urls") > 0, F.col("author") != ""
    ours = ~published & (F.col("title") != "") & (F.col("word") | linked | F.col("low").rlike(DOCUMENT_MARKS))
    level = F.when(signed & (linked | year.isNotNull()), "alta").when(linked | signed, "media").otherwise("baixa")
    handout = F.col("stem").rlike("(?:^|[^a-z0-9])apostila(?:[^a-z0-9]|$)")
    kind = F.when(bad, "arquivo inválido").when(handout, "apostila").otherwise("documento")
    return d.where(bad | ours).select("doc_id", kind.alias("kind"), "title", F.when(bad, "").otherwise(F.col("author")).alias("author"), F.coalesce(year, F.lit("")).alias("year"), F.array_join("urls", " ").alias("sources"), F.when(bad, "descarte").otherwise(level).alias("confidence"))
