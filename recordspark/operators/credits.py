"""What the lines of a credit page say: editions and their years by classes of words, names and titles by labels.

A line is read in two ways. As a row of word classes: each word, number or sign becomes one letter (edition,
ordinal, year, place and so on), and a form is a short pattern of such letters, whatever the language. And as label and
value: the value stands after a label, or on the next line where nothing does, and ends at a sign that can't belong to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.functions import text as T

#: Classes of words in plain form. Fixed values. Years are Y, other numbers of one or two digits N, a colon K, the rest x.
WORD_CLASSES = {
    "E": ("edicao", "edicion", "edition"),
    "P": ("impressao", "impresion", "printing"),
    "O": ("primeira", "primera", "first", "premiere"),
    "B": ("ebook", "digital", "eletronica", "electronica"),
    "U": ("publicacao", "publicacion", "publication", "publicado", "published"),
    "C": ("©", "copyright"),
    "T": ("traducao", "traduccion", "translation", "traduction"),
    "A": ("congress",),
    "L": ("london", "edinburgh", "boston", "york", "oxford", "cambridge", "philadelphia"),
}
TOKEN = "[a-z]+|[0-9]+|©|:"
#: Forms that date this edition, best first; the last class of each is its year.
EDITION_FORMS = (
    ("translation", "C[^Y]{0,3}T[^Y]{0,15}Y"),
    ("first edition", "OE[^Y]{0,4}Y"),
    ("numbered edition", "N[^Y]?E[^Y]{0,2}Y"),
    ("printing", "[ON][^Y]?P[^Y]{0,2}Y"),
    ("digital edition", "B[^Y]{0,3}[EU][^Y]{0,3}Y"),
    ("edition on the net", "[EU][^Y]{0,3}B[^Y]{0,3}Y"),
    ("edition and rights", "E[^Y]{0,6}C[^Y]?Y"),
    ("act of congress", "A[^Y]{0,8}Y"),
    ("imprint", "LK[^Y]{1,8}Y"),
)
HAS_YEAR = "(^|[^0-9])(1[5-9]|20)[0-9][0-9]([^0-9]|$)"


def word_class(token: Column) -> Column:
    known = [F.when(token.isin(*words), letter) for letter, words in WORD_CLASSES.items()]
    return F.coalesce(*known, F.when(token.rlike("^(1[5-9]|20)[0-9]{2}$"), "Y"), F.when(token.rlike("^[0-9]{1,2}$"), "N"), F.when(token == ":", "K"), F.lit("x"))


def dated_unit(line: Column, following: Column) -> Column:
    """A line, or the line with the one after it where it has no year itself."""
    return F.when(line.rlike(HAS_YEAR), line).otherwise(F.concat_ws(" ", line, following))


def form_year(units: Column, latest: int) -> Column:
    """Column: the year of the best form in an array of dated_unit(), at most `latest`; null without one."""
    tokens = F.transform(F.filter(units, lambda u: u.rlike(HAS_YEAR)), lambda u: F.regexp_extract_all(T.plain(u), F.lit(TOKEN), F.lit(0)))
    read = F.transform(tokens, lambda ts: F.struct(ts.alias("ts"), F.array_join(F.transform(ts, word_class), "").alias("c")))

    def years(read: Column, form: str) -> Column:
        # the prefix up to the end of the form is as long as the number of its last token
        of = F.transform(read, lambda r: F.try_element_at(r.ts, F.nullif(F.length(F.regexp_extract(r.c, "^.*?" + form, 0)), F.lit(0))).cast("int"))
        return F.filter(of, lambda y: y <= latest)

    # an array of one, so that all forms share what was read
    best = F.transform(F.array(read), lambda r: F.get(F.flatten(F.array(*[years(r, f) for _, f in EDITION_FORMS])), F.lit(0)))
    return F.get(best, F.lit(0))


def edition_year(lines: str, latest: int) -> Column:
    """Column: the year of the best form in an array of lines, at most `latest`; null without one. A form may go on to the next line where its own has no year."""
    return form_year(F.transform(lines, lambda x, i: dated_unit(x, F.get(lines, i + 1))), latest)


@dataclass(frozen=True)
class Labelled:
    """A field, the labels before its value (plain words), the signs that end the value, its shortest and longest length and shape; whether the label must begin the line."""

    field: str
    labels: tuple[str, ...]
    stops: str
    size: tuple[int, int]
    shape: str = "."
    begins: bool = True


PERSON = r"^\p{Lu}[\p{L}'.-]*,?(?: (?:(?:de|da|do|das|dos|del|van|von|e)|\p{Lu}[\p{L}'.-]*,?)){1,5}$"
CAPITAL = r"^[\p{Lu}0-9]"
#: Labels of credit pages. Fixed values.
CREDIT_LABELS = (
    Labelled("original_title", ("titulo original", "titulo del original", "titre original", "original title", "originally published as", "originally published in english as"), "©", (3, 80)),
    Labelled("edition_title", ("edicion en castellano", "edicao em portugues", "edition francaise"), "©", (3, 80)),
    Labelled("translator", ("traducao", "traducao de", "traducao por", "traduccion", "traduccion de", "traduccion por", "tradutor", "tradutora", "traduit par", "translated by"), "©,;.", (3, 50), PERSON),
    Labelled("publisher", ("publicado por", "publicado no brasil por", "published by", "publie par", "reservados por"), "©,.", (2, 75), CAPITAL, begins=False),
)
#: Words that a publishing house's name begins with. Fixed values.
HOUSE_WORDS = ("editora", "editorial", "edicoes", "ediciones", "publicacoes", "casa publicadora")
ORDINAL = "[0-9]{1,2} ?(?:ª|º|a|o|st|nd|rd|th)?[.]? ?"


def raw_line(line: Column) -> Column:
    """The trimmed line if its plain form has the same length, else the plain form: places in one are places in the other."""
    x = F.trim(line, F.lit(" \t\r"))
    return F.when(F.length(T.plain(x)) == F.length(x), x).otherwise(T.plain(x))


def after_prefix(line: Column, prefix: str) -> Column:
    """What follows the prefix (a pattern of the plain line with one group), null without it."""
    head = F.regexp_extract(T.plain(line), prefix, 1)
    return F.when(head != "", F.substring(line, F.length(head) + 1, F.length(line)))


def _value(x: Column, stops: str) -> Column:
    return F.rtrim(F.trim(F.regexp_extract(F.ltrim(x, F.lit(" \t:–—-")), f"^[^{stops}]*", 0)), F.lit(" .,;:"))


def _first(values: Column, size: tuple[int, int], shape: str) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & F.length(v).between(*size) & v.rlike(shape)), F.lit(0))


def labelled_value(lines: str, rule: Labelled) -> Column:
    """Column: the first fitting value after one of the rule's labels in an array of lines."""
    names = "|".join(sorted(rule.labels, key=len, reverse=True))
    prefix = f"^({'' if rule.begins else '(?:.*?[^a-z0-9])?'}(?:{names}))(?:[^a-z0-9]|$)"

    def one(x: Column, i: Column) -> Column:
        rest = after_prefix(raw_line(x), prefix)
        following = F.when(F.trim(rest, F.lit(" \t:–—-")) == "", raw_line(F.get(lines, i + 1))).otherwise(rest)
        return F.when(rest.isNotNull(), _value(following, rule.stops))

    return _first(F.transform(lines, one), rule.size, rule.shape)


def rights_holder(lines: str) -> Column:
    """Column: the first publishing house beside © or copyright and a year, after the year or before it."""
    house = f"^(?:{'|'.join(HOUSE_WORDS)})(?:[^a-z]|$)"
    signs = F.lit(" \t:;,.–—-©")

    def one(x: Column) -> Column:
        raw = raw_line(x)
        rest = after_prefix(raw, "^(.*?(?:©|copyright).*?(?:©|[^a-z])(?:1[5-9]|20)[0-9]{2})(?:[^0-9]|$)")
        before = F.regexp_extract(after_prefix(raw, "^(.*(?:©|copyright))"), "^(.*?)[ ,]*(?:1[5-9]|20)[0-9]{2}", 1)
        parts = F.array(F.ltrim(rest, signs), F.ltrim(before, signs))
        return F.get(F.filter(F.transform(parts, lambda p: _value(p, "©,;.")), lambda p: T.plain(p).rlike(house)), F.lit(0))

    return _first(F.transform(lines, one), (4, 75), CAPITAL)


def house_line(lines: str) -> Column:
    """Column: the first line that is a publishing house's name and nothing else."""
    house = f"^(?:{'|'.join(HOUSE_WORDS)}) "
    return _first(F.transform(lines, lambda x: F.when(T.plain(raw_line(x)).rlike(house) & ~x.rlike("[©:]"), F.rtrim(raw_line(x), F.lit(" .,;:")))), (5, 60), CAPITAL)


def numbered_edition(lines: str) -> Column:
    """Column: the first `2nd edition` or the like, as it stands."""
    words = "|".join(WORD_CLASSES["E"])
    prefix = f"^((?:.*?[^a-z0-9])?){ORDINAL}(?:{words})(?:[^a-z]|$)"

    def one(x: Column) -> Column:
        low = T.plain(raw_line(x))
        there = low.rlike(prefix)
        at = F.length(F.regexp_extract(low, prefix, 1))
        return F.when(there, F.substring(raw_line(x), at + 1, F.length(F.regexp_extract(F.substring(low, at + 1, F.length(low)), f"^{ORDINAL}(?:{words})", 0))))

    return _first(F.transform(lines, one), (6, 40), ".")


def credit_rows(ls: str, ls3: str, source: str = "copyright") -> Column:
    """Column: an array of field, source, value, rank of the lines of credit pages and of the first three pages; value is null where a reader finds nothing."""
    found = [(r.field, labelled_value(ls, r), 1) for r in CREDIT_LABELS]
    found += [("publisher", rights_holder(ls), 2), ("publisher", house_line(ls), 3), ("edition", numbered_edition(ls), 1), ("edition", numbered_edition(ls3), 2)]
    return F.array(*[F.struct(F.lit(f).alias("field"), F.lit(source).alias("source"), v.alias("value"), F.lit(rank).alias("rank")) for f, v, rank in found])
