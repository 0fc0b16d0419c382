"""Lines of a page as rows of word classes, one letter or sign for each word, number or sign of the line.

Forms of headings, bylines, numberings and citations are then short patterns of such letters, the same for every language
whose words are in the table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of words in plain form; words of no class are x. Fixed values.
WORDS = {
    "d": ("este", "esta", "presente", "this", "present"),
    "a": ("artigo", "ensaio", "estudo", "article", "essay", "study", "paper"),
    "o": ("objetivo", "aim"),
    "r": ("resumo", "abstract"),
    "T": ("texto",),
    "t": ("tema", "proposito"),
    "s": ("sermao", "predicacao", "mensaje"),
    "D": ("dissertacao", "dissertation"),
    "E": ("tese", "thesis"),
    "M": ("monografia",),
    "p": ("apresentada", "apresentado", "submitted", "presented"),
    "F": ("conclusao",),
    "g": ("curso",),
    "G": ("obtencao",),
    "l": ("titulo", "grau"),
    "q": ("discente",),
    "u": ("disciplina", "docente"),
    "c": ("faculdade", "universidade"),
    "C": ("seminario", "instituto"),
    "k": ("doutor", "professor"),
    "v": ("vol", "volume", "ano"),
    "i": ("n", "no", "numero", "issue"),
    "j": ("revista", "journal"),
    "I": ("issn",),
    "n": ("introducao",),
    "b": ("by", "por"),
    "A": ("imprimir",),
    "B": ("fechar",),
    "U": ("minuto", "minutos", "hora", "horas", "dia", "dias", "semana", "semanas", "mes", "meses", "anos"),
    "K": ("atras",),
    "L": ("lab",),
    "f": ("conferencia",),
    "e": ("plano",),
    "m": ("aula",),
    "H": ("apostilado",),
    "y": ("ensino",),
    "w": ("caderno",),
    "z": ("igreja",),
    "Q": ("modulo", "discipulado", "aulas"),
    "W": ("unidade",),
    "J": ("tematica",),
    "S": ("ementa",),
}
TOKEN = r"[a-z]+|[0-9]+|[^a-z0-9\s]"
#: Signs that stand for themselves; dashes are h, all other signs ~.
SIGNS = (":", ".", ",", "(", ")", "|", "/")

#: Forms, for regular expressions over lines of classes. Y is a year, N a number of up to three digits, P a longer one, R a Roman numeral.
NUMBERING = r"x[^\nY]*[NR][/(,.i]+N[^\nY]*Y"
DECLARED = r"da|ox{0,2}d?a"
ABSTRACT = r"(?m)^r(?::|$)"
RANGE = r"[NPY]h[NPY]"
CITED = r"(?m)^[a-zA-Z],[^\n.]+\.[^\n.]{2,}\.[^\n]*:"
SIGNATURE = r"(?m)^h[a-zA-Z]{2,6}$"
LABELLED_TEXT = r"(?m)^[tT]:"
SERMON = r"(?m)s|^T:N?x"
OPENING = r"^(?:N?\n)?[^\n]{2,}\n[^\n]{1,12}\n"
INTRODUCTION = r"(?m)^N\.n"
AFFILIATION = r"k[^\n]{0,30}\n?[^\n]{0,30}[cC]"
NUMBER = r"v[NR]|i[./]?N|I"
ISSUE = r"I[:.h]?[NPY]|v[NR][,/h]?i\.?N"
CITATION = r"YN\(N\):N"
BYLINE_AGO = r"(?m)^b[^\n]*\|NUK$"


def _class(token: Column) -> Column:
    known = [w for ws in WORDS.values() for w in ws]
    letter = F.coalesce(*[F.when(token.isin(*ws), c) for c, ws in WORDS.items()])
    number = F.when(token.rlike("^(19|20)[0-9]{2}$"), "Y").when(F.length(token) <= 3, "N").otherwise("P")
    sign = F.when(token.isin("-", "–", "—"), "h").when(token.isin(*SIGNS), token).otherwise("~")
    return F.when(token.isin(*known), letter).when(token.rlike("^[ivxlcdm]{2,}$"), "R").when(token.rlike("^[a-z]"), "x").when(token.rlike("^[0-9]"), number).otherwise(sign)


def line_classes(plain: str) -> Column:
    """Column: the lines of a column of plain text as classes."""
    return F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), _class), "")), "\n")
