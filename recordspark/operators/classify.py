"""Document types by an ordered table of rules over the parts of a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.operators import marks as K
from recordspark.operators.scopes import all_true, document_scopes

SCOPES = ("name", "producer", "periodical", "page1", "first3", "first10", "first12", "last3", "head")


@dataclass(frozen=True)
class TypeRule:
    """Type of a document in which all of (scope, pattern) and none of the others hold, patterns occur often enough, and the pages with text are lo..hi.

    Patterns are for plain text: lower case without accents, lines kept; of a scope that ends in _c, for its lines as word classes (marks.py). number: the row of the survey's table.
    """

    number: int
    type: str
    all_of: tuple[tuple[str, str], ...]
    none_of: tuple[tuple[str, str], ...] = ()
    counts: tuple[tuple[str, str, int], ...] = ()
    pages: tuple[int, int] | None = None
    short_share: float = 0.0


_LINE = r"(?m)^[ \t]*"
_BOOK = ("first10", r"\bisbn\b|ficha catalografica|dados (?:internacionais )?de catalogacao|(?:editora|editorial|publisher)\s*:|(?:publicado|published) (?:por|by)")
_SIGNALS = ("first10", r"\bisbn\b|\bcopyright\b|[©℗]|dados (?:internacionais )?de catalogacao|ficha catalografica|(?:editora|publisher)\s*:")
_MANUAL = ("page1", r"\bmanual de\b")
_HANDED = r".{0,180}?\b(?:apresentad[ao]|submitted|presented)\b"
_DEGREES = (("dissertação", r"(?s)\b(?:dissertacao|dissertation)\b"), ("tese", r"(?s)\b(?:tese|thesis)\b"), ("trabalho acadêmico", r"(?s)\b(?:trabalho de conclusao de curso|monografia)\b"))
_ARTICLE = ("first3_c", K.DECLARED)
_ABSTRACT = K.ABSTRACT
_NUMBERED = ("page1_c", K.NUMBERING)
_SCHOOL = r"\b(?:faculdade|seminario|instituto teologico)\b"
_MINISTRY = ("head", r"ministerio|departamento|congregacao|igreja|paroquia|pastoral|diacono|pequenos? grupos?|celula|escola biblica|\bebd\b")
_HOUSE = ("first10", r"\bisbn\b|(?:editora|publisher)\s*:")


def _handed_in(number: int) -> list[TypeRule]:
    """A work's name near `presented`; on a manual's cover only if it stands in the first three pages."""
    out = []
    for kind, word in _DEGREES:
        out.append(TypeRule(number, kind, (("first12", word + _HANDED),), (_MANUAL,)))
        out.append(TypeRule(number, kind, (_MANUAL, ("first3", word + _HANDED))))
    return out


#: First match wins. Words of the rules are fixed values; rules about single works, persons or houses are the caller's.
TYPE_RULES = (
    TypeRule(1, "apostila", (("name", r"\baula\s*0?[0-9]+\b"), ("last3", _LINE + "checklist da aula")), (_BOOK,), (("first10", _LINE + r">?[ ]*reflexao\b", 2),)),
    TypeRule(2, "apostila", (("name", "apostila"), ("first10", r"\b(?:treinamento|diacono|disciplina|curso|aulas?|manual|conceito e missao)\b"))),
    TypeRule(3, "documento", (("first10", r"(?s)\be-?book\b.{0,100}\bdisponibilizado\b"), ("first10", r"\btotalmente gratuito\b"), ("first10", r"\b(?:doacao|paypal|qr ?code)\b"))),
    TypeRule(4, "apostila", (_MANUAL, ("page1", r"\b(?:metodologia|normatizacao)\b"))),
    *_handed_in(5),
    TypeRule(6, "revista", (("periodical", "."), ("first10", _LINE + r"(?:sumario|contents)[ \t]*$")), (), (("first10", _LINE + r"[^\n]{5,100}?[ ]+(?:\.{2,}[ ]*)?[0-9]{1,4}[ ]*$", 3),)),
    TypeRule(6, "revista", (("periodical", "."), ("first10", r"\b(?:vol(?:ume)?|ano)\s*[ivxlcdm0-9]+|\bn[.o°]\s*[0-9]+|\bissue\s*[0-9]+"), ("first10", r"\b(?:19|20)[0-9]{2}\b")), (_ARTICLE, ("first3_c", _ABSTRACT)), (), (6, 1_000_000)),
    TypeRule(7, "artigo", (_NUMBERED, _ARTICLE, ("page1_c", _ABSTRACT))),
    TypeRule(7, "artigo", (_NUMBERED, _ARTICLE, ("page1_c", K.RANGE))),
    TypeRule(7, "artigo", (("periodical", "."), _ARTICLE, ("page1_c", _ABSTRACT))),
    TypeRule(7, "artigo", (_NUMBERED, ("page1_c", K.CITED), ("page1_c", K.SIGNATURE)), (), (), (1, 5)),
    TypeRule(8, "apostila", (("first10", r"(?s)\bapostila\b.{0,240}?\b(?:professor|prof\.)\s*:"),)),
    TypeRule(8, "apostila", (("first10", "programa de discipulado"), ("first10", "pequenos? grupos?"), ("first10", "ministerio|convencao|igreja"))),
    TypeRule(8, "apostila", (), (), (("first10", _LINE + r"aula(?: pratica)? [0-9]+[ ]*[-–—]", 4),)),
    TypeRule(8, "apostila", (("first10", _LINE + r"codigo[ ]*:[ ]*$"), ("first10", _LINE + r"disciplina[ ]*:[ ]*$"), ("first10", "escola de discipulos"))),
    TypeRule(9, "documento", (("first10", r"\bvoluntarios?\b"), ("first10", r"\b(?:igreja|ministerio)\b"))),
    TypeRule(9, "documento", (("first10", "testimonies were excerpted"), ("first10", r"\bthis site\b"), ("first10", r"\bmain contents\b|\breferences\b"))),
    TypeRule(10, "revista", (("first10", r"\brevista do aluno\b"), ("first10", "publicacao e distribuicao"), ("first10", r"\b(?:licao|indice|curso)\b"))),
    TypeRule(11, "apostila", (("first10", "dados de catalogacao interna da publicacao"), ("first10", r"\b(?:disciplina|curso|esta apostila)\b"))),
    TypeRule(12, "documento", (("producer", "powerpoint|impress|keynote"),), (), (), (4, 1_000_000), 0.60),
    TypeRule(13, "documento", (("first10", _LINE + r"(?:a )?(?:research report|relatorio de pesquisa) (?:by|por) [^\n|]{3,80}$"),)),
    TypeRule(13, "documento", (("first10", _LINE + r"manual institucional[ ]*$"),)),
    TypeRule(14, "apostila", (("first10_c", r"(?m)^L\|"), ("first10_c", "fx{0,2}Y"))),
    TypeRule(14, "apostila", (("first10_c", "exmH"),)),
    TypeRule(14, "apostila", (("first10_c", "wz"), ("first10_c", "[Qm]"))),
    TypeRule(14, "apostila", (("first10_c", "WJ[N~x]"), ("first10_c", "exy"), ("first10_c", "[cC]"))),
    TypeRule(14, "apostila", (("first10_c", "exy"), ("first10_c", "S"), ("first10_c", "[cC]")), (), (("first10_c", "WN", 2),)),
    TypeRule(15, "sermão", (("first10_c", K.LABELLED_TEXT), ("first10_c", K.SERMON))),
    TypeRule(15, "sermão", (("first10", "transcricao"), ("first10", "video"), ("first10_c", "s"))),
    TypeRule(16, "dissertação", (("first10_c", "Dp"),)),
    TypeRule(16, "tese", (("first10_c", "Ep"),)),
    TypeRule(16, "trabalho acadêmico", (("first10_c", "Fxg|Mp|Gxl"),)),
    TypeRule(16, "trabalho acadêmico", (("first10_c", "(?m)^q:"),)),
    TypeRule(16, "trabalho acadêmico", (("first10_c", "c"), ("first10_c", "u:"))),
    TypeRule(17, "apostila", (("first10", _SCHOOL), ("first10", r"\b(?:medio teologia|plano de ensino|ementa)\b"))),
    TypeRule(17, "apostila", (("first10", _SCHOOL), ("name", r"\b(?:medio teologia|plano de ensino|ementa)\b"))),
    TypeRule(18, "artigo", (("page1_c", K.OPENING), ("page1_c", K.INTRODUCTION), ("first10_c", K.AFFILIATION))),
    TypeRule(18, "artigo", (("first10_c", r"A\|B"),)),
    TypeRule(18, "artigo", (("first10", "_print[.]php"),)),
    TypeRule(18, "artigo", (("first10_c", "(?m)^a$"), ("first3", "https?://"))),
    TypeRule(18, "artigo", (("first10_c", K.BYLINE_AGO),)),
    TypeRule(18, "artigo", (("first10_c", "j"), ("first10_c", "r"), ("first10_c", K.NUMBER))),
    TypeRule(18, "artigo", (("first10_c", "(?m)^r$"), ("first10_c", "I"), ("first10_c", K.CITATION))),
    TypeRule(19, "revista", (("first10", r"\b(?:revista|magazine|journal|periodico|boletim)\b"), ("first10_c", K.ISSUE))),
    TypeRule(20, "documento", (("first10", r"(?s)este livro.{0,500}?uso pessoal"), ("first10", r"(?s)nao e permitida a revenda|proibid[ao].{0,120}?revenda"), ("first10", r"consentimento (?:expresso )?do autor|proprietario dos direitos")), (_BOOK, ("page1", _LINE + r"(?:por|autor)\s*:")), (), (2, 80)),
    TypeRule(21, "trecho", (("page1", r"^\s*(?:capitulo\s+)?[0-9]{1,2}\s*\n\s*[a-z][a-z0-9 ,:'–—-]{5,100}(?:\n|$)"),), (_SIGNALS,), (), (2, 30)),
    TypeRule(22, "livro", (("first10", r"permissao do autor (?:pr\.? ?)?[a-z]"),)),
    TypeRule(23, "arquivo inválido", (("page1", r"^\s*(?:resumo|questionario)\b"),), (_SIGNALS,)),
    TypeRule(23, "apostila", (("producer", "word|writer"), ("first3", r"\b(?:aula|licao|estudo)\b")), (_SIGNALS,)),
    TypeRule(23, "documento", (("producer", "word|writer"),), (_SIGNALS,)),
    TypeRule(23, "documento", (("edges", r"https?://|www\."), ("page1", _LINE + r"(?:por|autor|titulo|data)\s*:")), (_SIGNALS,)),
    TypeRule(24, "documento", (("head", r"manual (?:de|para|do|da)\s"), _MINISTRY), (_HOUSE,)),
    TypeRule(24, "apostila", (("head", "serie de estudos|roteiro de estudos?|material de discipulado|caderno de estudos?"), _MINISTRY), (_HOUSE,)),
    TypeRule(24, "apostila", (("head", r"\bapostila\b"), _MINISTRY), (_HOUSE,)),
    TypeRule(24, "documento", (("head", r"regimento interno|estatuto d[ao]\s|diretrizes d[ao]\s"), _MINISTRY), (_HOUSE,)),
)


def classify_document(pages: DataFrame, files: DataFrame, rules: tuple[TypeRule, ...] = TYPE_RULES, default: str = "livro") -> DataFrame:
    """doc_id, type, rule (number of the table's row, null for the default), forced.

    pages: doc_id, page_no, text; files: doc_id, name, producer, periodical (a known one, or null), approved (a human
    decided the type), isbn_confirmed, external (title, author and publisher were found elsewhere), n_pages. The
    first rule that holds decides. Then, unless approved, a presentation's producer forces apresentação, and
    a general documento with a confirmed ISBN, 40 pages and external data becomes livro.
    """
    blank = lambda c: T.plain(F.coalesce(c, F.lit("")))
    d = document_scopes(pages).join(files, "doc_id")
    d = d.withColumn("head", F.substring("first10", 1, 2500)).withColumns({s: blank(s) for s in (*SCOPES, "edges")})
    d = d.withColumns({f"{s}_c": K.line_classes(s) for s in ("page1", "first3", "first10")})
    place = F.lit(len(rules))
    for k, r in reversed(list(enumerate(rules))):
        tests = [F.col(s).rlike(p) for s, p in r.all_of] + [~F.col(s).rlike(p) for s, p in r.none_of] + [F.regexp_count(s, F.lit(p)) >= n for s, p, n in r.counts]
        if r.pages:
            tests.append(F.col("n_text").between(*r.pages))
        if r.short_share:
            tests.append(F.col("short_share") >= r.short_share)
        place = F.when(all_true(tests), k).otherwise(place)
    # the place of the first rule is found once; its type and number are read from it
    d = d.select("doc_id", "producer", "approved", "isbn_confirmed", "external", "n_pages", place.alias("place"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), "place")
    d = d.withColumns({"found": of([*[r.type for r in rules], default]), "rule": of([*[r.number for r in rules], None]).cast("int")})
    open_ = ~F.coalesce("approved", F.lit(False))
    shown = open_ & F.col("producer").rlike("powerpoint|impress|keynote")
    book = open_ & (F.col("found") == "documento") & F.col("rule").isin(23, 24) & F.coalesce(F.col("isbn_confirmed") & F.col("external") & (F.col("n_pages") >= 40), F.lit(False))
    forced = F.when(shown, "apresentação").when(book, "livro")
    return d.select("doc_id", F.coalesce(forced, "found").alias("type"), "rule", forced.isNotNull().alias("forced"))
