"""Column expressions shared by the jobs: normal forms, token sets, check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their base letters, in the same order.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASES = "aaaaaaceeeeiiiinooooouuuuyy"


def plain(x: Column) -> Column:
    """Lower case without accents; letters without a base form stay."""
    return F.translate(F.lower(x), ACCENTS, BASES)


def words(x: Column) -> Column:
    """Runs of a-z and 0-9 of the plain form, in order; other letters part words."""
    return F.regexp_extract_all(plain(x), F.lit("[a-z0-9]+"), F.lit(0))


def normal(x: Column) -> Column:
    """The words joined by single blanks."""
    return F.array_join(words(x), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays taken as sets; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the word sets, or how much of the smaller set is in the larger one (x 0.95, or 0.70 for one word)."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(sa), F.size(sb))
    covered = F.size(F.array_intersect(sa, sb)) / F.greatest(F.lit(1), least) * F.when(least >= 2, 0.95).otherwise(0.70)
    return F.when(least > 0, F.greatest(jaccard(sa, sb), covered)).otherwise(0.0)


def author_overlap(a: Column, b: Column) -> Column:
    """Common words of more than one letter over the smaller set."""
    long = lambda x: F.array_distinct(F.filter(x, lambda w: F.length(w) > 1))
    sa, sb = long(a), long(b)
    least = F.least(F.size(sa), F.size(sb))
    return F.when(least > 0, F.size(F.array_intersect(sa, sb)) / F.greatest(F.lit(1), least)).otherwise(0.0)


#: Words that do not make an author key.
PARTICLES = ("da", "das", "de", "del", "do", "dos", "e", "van", "von")


def author_key(x: Column) -> Column:
    """Sorted distinct words without particles; null if fewer than two."""
    key = F.array_sort(F.array_distinct(F.filter(words(x), lambda w: ~w.isin(*PARTICLES))))
    return F.when(F.size(key) >= 2, F.array_join(key, " "))


def author_keys(x: Column) -> Column:
    """Author keys of all co-authors, parted by `;`, `&`, `e`, `y` or `and`."""
    parts = F.split(F.coalesce(x, F.lit("")), r"(?i)\s*;\s*|\s+(?:&|e|y|and)\s+")
    return F.array_distinct(F.array_compact(F.transform(parts, author_key)))


def main_title(x: Column) -> Column:
    """What stands before the first colon, or dash between blanks; all of it if nothing does."""
    first = F.trim(F.get(F.split(x, r"\s*:\s+|\s+[–—-]\s+", 2), F.lit(0)))
    return F.when(first == "", x).otherwise(first)


def _weighted(x: Column, weight) -> Column:
    """Sum of digit times weight(place from 0); X counts 10."""
    value = lambda c, i: F.when(c == "X", 10).otherwise(c.try_cast("int")) * weight(i)
    return F.aggregate(F.transform(F.split(x, ""), value), F.lit(0), lambda t, v: t + v)


def isbn13_check(first12: Column) -> Column:
    """Check digit of twelve digits: weights 1 and 3 in turn."""
    total = _weighted(F.substring(first12, 1, 12), lambda i: F.when(i % 2 == 0, 1).otherwise(3))
    return ((10 - total % 10) % 10).cast("string")


def canonical_isbn(x: Column) -> Column:
    """ISBN-13 of a valid ISBN-13 (978 or 979) or ISBN-10 (X as last digit only); null otherwise."""
    raw = F.upper(F.regexp_replace(x, "[^0-9Xx]", ""))
    full = F.when(raw.rlike("^97[89][0-9]{10}$") & (isbn13_check(raw) == F.substring(raw, 13, 1)), raw)
    base = F.concat(F.lit("978"), F.substring(raw, 1, 9))
    short = F.when(raw.rlike("^[0-9]{9}[0-9X]$") & (_weighted(raw, lambda i: 10 - i) % 11 == 0), F.concat(base, isbn13_check(base)))
    return F.coalesce(full, short)
