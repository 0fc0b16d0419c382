"""Text quality: pages, documents, gates, versions, page numbers, provenance."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of page and document quality.
MIN_PAGE_CHARS, PAGE_SCORE, MIN_COVERAGE, MAX_WEAK = 150, 0.78, 0.80, 0.05
VOWELS = "aeiouáàâãéêíóôõúü"
CONSONANT_RUN = "[bcdfghjklmnpqrstvwxyz]{5}"


#: Marks of a token: a candidate has three signs and a letter, a short one is one or two letters, a good one is word-like.
CANDIDATE, GOOD, SHORT = 1, 2, 4
_TOKENS = re.compile(r"[^ \t\n\x0b\f\r]+").findall
_ENDS = "\x85\u2028\u2029"  #: line ends that are no blanks; what is asked of a token's end may stand before one
_EDGE = ".,;:()[]«»\"'"
#: Marks kept by a worker; texts say the same words again and again.
KEPT = 200_000


def _marks(token: str) -> int:
    end = token[-1] if len(token) > 1 and token[-1] in _ENDS else ""
    body = token[: len(token) - len(end)]
    short = SHORT if len(body) <= 2 and body.isalpha() else 0
    if len(token) <= 2 or not any(map(str.isalpha, token)):
        return short
    s = (body.strip(_EDGE) + end).lower()
    like = len(s) >= 3 and sum(map(str.isalpha, s)) / len(s) > 0.7 and not _VOWELS.isdisjoint(s) and not _RUN.search(s)
    return CANDIDATE | (GOOD if like else 0) | short


_VOWELS, _RUN = frozenset(VOWELS), re.compile(CONSONANT_RUN)


def token_counts(texts: pa.Array) -> pa.Array:
    """Tokens, candidates, word-like (at least three signs without the punctuation around, more than 70 % of them letters, a vowel, no run of five consonants) and short ones of each text."""
    marks: dict[str, int] = {}
    rows = []
    for text in texts:
        tokens = _TOKENS(text.as_py())
        found = [0] * 8
        for token, n in Counter(tokens).items():
            mark = marks.get(token)
            if mark is None:
                if len(marks) >= KEPT:
                    marks.clear()
                mark = marks[token] = _marks(token)
            found[mark] += n
        rows.append((len(tokens), *(sum(n for m, n in enumerate(found) if m & kind) for kind in (CANDIDATE, GOOD, SHORT))))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(4)], names=["n_tokens", "n_candidates", "n_good", "n_short"])


def _measured(pages: DataFrame) -> DataFrame:
    """Pages with their text, lines, and the counts and score of page_quality; one projection after the other, no join."""
    t = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    counts = F.arrow_udf(token_counts, "n_tokens int, n_candidates int, n_good int, n_short int")
    t = t.select("doc_id", "page_no", "text", counts("text").alias("k")).select("doc_id", "page_no", "text", "k.*")
    penalty = F.greatest(F.lit(0.0), F.col("n_short") / F.col("n_tokens") - 0.22)
    score = F.when((F.col("n_tokens") >= 40) & (F.col("n_candidates") >= 20), F.greatest(F.lit(0.0), F.col("n_good") / F.col("n_candidates") - penalty)).otherwise(0.0)
    return t.withColumn("score", score)


def page_quality(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, n_tokens, n_candidates, n_good, n_short, score (0 to 1, not rounded) of every page.

    Pages under 40 tokens or 20 candidate words score 0; more than 22 % tokens of one or two letters lower the score.
    """
    return _measured(pages).drop("text")


#: Dashes that page numbers and references are written with; all count as the plain hyphen.
DASHES = "‐‑‒–—―"


def _leader(line: Column) -> Column:
    """What stands between a line's words and the page number at its end, the number being digits and at most one letter: dots, gap or nothing."""
    number = F.regexp_extract(line, "[0-9]+[A-Za-z]?$", 0)
    head = F.substring(line, F.lit(1), F.length(line) - F.length(number))
    words = F.rtrim(head)
    dots, gap = F.endswith(words, F.lit("...")), F.length(head) - F.length(words) >= 3
    return F.when(number == "", "nothing").when(dots, "dots").when(gap, "gap").otherwise("nothing")


def _is_link(line: Column) -> Column:
    """A number reference of digits, blanks and punctuation, then only link marks `[<<]`, commas between them."""
    parts = F.split(line, r"\[\s*<<\s*\]")
    first, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return (F.size(parts) > 1) & (first != "") & (F.translate(first, "0123456789 \t.,;:()-" + DASHES, "") == "") & F.forall(rest, lambda p: F.trim(p).isin("", ","))


def _is_reference(line: Column) -> Column:
    """Chapter (and verses) on the left, page numbers on the right, apart by a blank or a dash.

    The line is cut at its blanks, each side at dashes and commas; every piece is tested by itself.
    """
    tidy = F.regexp_replace(F.regexp_replace(F.translate(line, DASHES, "-" * len(DASHES)), r"\s*([-,])\s*", "$1"), r"\s+", " ")
    sides = F.split(tidy, " ")
    pieces = lambda x: F.split(x, "[-,]")
    marks = lambda x: F.regexp_replace(x, "[^-,]", "")
    page = lambda p: p.rlike("^[0-9]{1,4}(n[0-9]+)?$")
    chapter = lambda p: p.rlike("^[0-9]{1,3}([:.][0-9]{1,3})?$")
    small = lambda p: p.rlike("^[0-9]{1,3}$")
    with_verse = lambda p: p.rlike("[:.]")
    left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    head, tail = F.get(pieces(left), F.lit(0)), F.get(pieces(left), F.lit(1))
    joined = marks(left)
    apart = (F.size(sides) == 2) & chapter(head) & ((joined == "") | ((joined == "-") & small(tail)) | ((joined == ",") & with_verse(head) & small(tail))) & F.forall(pieces(right), page)
    rest = F.slice(pieces(left), F.lit(2), F.greatest(F.size(pieces(left)) - 1, F.lit(0)))
    dashed = (F.size(sides) == 1) & chapter(head) & (F.startswith(joined, F.lit("-")) | (F.startswith(joined, F.lit(",-")) & with_verse(head) & small(tail))) & F.forall(rest, page)
    return F.coalesce(apart | dashed, F.lit(False))


def page_class(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, n_chars, score, legible, class: texto_bom, texto_fraco, texto_curto or sem_texto.

    Contents pages, reference indexes and clean short pages count as legible whatever their score.
    Every row gives a row: null ids and repeated pages stay as they are.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = _measured(pages).withColumn("lines", lines)
    p = p.withColumn("leaders", F.transform("lines", _leader))
    kind = lambda *names: F.size(F.filter("leaders", lambda x: x.isin(*names)))
    digits_first = F.filter("lines", lambda x: x.rlike(r"^[\d\s.,;:()\-" + DASHES + "]"))
    p = p.withColumn("numbered", digits_first).select(
        "doc_id", "page_no", "score", F.length("text").alias("length"), F.size("lines").alias("n_lines"),
        F.length(F.regexp_replace("text", r"\s+", "")).alias("n_chars"),
        F.size(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0))).alias("n_words"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).alias("letters"),
        (F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))).alias("broken"),
        kind("dots").alias("dotted"), kind("dots", "gap").alias("indexed"),
        F.size(F.filter("numbered", _is_link)).alias("linked"), F.size(F.filter("numbered", _is_reference)).alias("referred"),
        F.exists("lines", lambda x: F.lower(x).isin("sumario", "sumário", "indice", "índice")).alias("headed"),
    )
    sound = F.col("broken") / F.greatest(F.lit(1), F.col("length")) < 0.002
    clean = (F.col("n_chars") > 0) & (F.col("letters") / F.greatest(F.lit(1), F.col("n_chars")) >= 0.30) & sound
    contents = F.col("headed") & (F.col("indexed") >= 5) & sound
    of_lines = lambda n, least, share: (F.col(n) >= least) & (F.col(n) / F.greatest(F.lit(1), F.col("n_lines")) >= share)
    index = (F.col("n_lines") >= 6) & sound & (of_lines("linked", 8, 0.55) | of_lines("dotted", 4, 0.35) | of_lines("referred", 8, 0.55))
    short = (F.col("n_chars") >= MIN_PAGE_CHARS) & (F.col("n_words") >= 8) & (F.col("n_lines") >= 3) & clean
    p = p.withColumn("index", index).withColumn("legible", contents | F.col("index") | ((F.col("n_words") >= 25) & clean) | short)
    rated = (F.col("n_chars") >= MIN_PAGE_CHARS) | F.col("index")
    kind_of = F.when(rated & ((F.col("score") >= PAGE_SCORE) | F.col("legible")), "texto_bom").when(rated, "texto_fraco").when(F.col("n_chars") > 0, "texto_curto").otherwise("sem_texto")
    return p.select("doc_id", "page_no", "n_chars", "score", "legible", kind_of.alias("class"))


def document_quality(classes: DataFrame, neutral: str | None = None) -> DataFrame:
    """Roll-up of page_class: coverage, weak share, median, status and reasons, page numbers by class.

    neutral: a boolean column for visually blank pages, which leave the coverage.
    """
    blank = F.col(neutral) if neutral else F.lit(False)
    rated = F.col("class").isin("texto_bom", "texto_fraco")
    value = F.when(F.col("legible"), F.greatest("score", F.lit(PAGE_SCORE))).otherwise(F.col("score"))
    pages_of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("class") == kind, F.col("page_no"))))
    d = classes.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.count_if(blank & (F.col("class") == "sem_texto")).alias("n_blank"),
        F.count_if(F.col("class") != "sem_texto").alias("n_searchable"), F.count_if(rated).alias("n_rated"), F.count_if(F.col("class") == "texto_bom").alias("n_good"),
        F.coalesce(F.median(F.when(rated, value)), F.lit(0.0)).alias("median_score"),
        pages_of("texto_fraco").alias("weak_pages"), pages_of("texto_curto").alias("short_pages"),
    )
    d = d.withColumn("coverage", F.col("n_searchable") / F.greatest(F.lit(1), F.col("n_pages") - F.col("n_blank")))
    d = d.withColumn("weak_share", F.when(F.col("n_rated") > 0, (F.col("n_rated") - F.col("n_good")) / F.col("n_rated")).otherwise(1.0))
    one_weak = (F.col("n_rated") >= 10) & (F.col("n_rated") - F.col("n_good") == 1) & (F.col("coverage") >= 0.95) & (F.col("median_score") >= 0.85)
    reasons = F.array_compact(F.array(
        F.when(F.col("coverage") < MIN_COVERAGE, "cobertura"), F.when((F.col("weak_share") > MAX_WEAK) & ~one_weak, "texto fraco"), F.when(F.col("median_score") < PAGE_SCORE, "mediana"),
    ))
    d = d.withColumn("reasons", F.array_join(reasons, "; "))
    return d.withColumn("status", F.when(F.col("reasons") == "", "OCR aprovado").otherwise("precisa OCR"))


def min_text_gate(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_words (three letters or more), usable."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}{3,}"), F.lit(0)))
    return docs.select("doc_id", n.alias("n_words")).withColumn("usable", F.col("n_words") >= least)


def accept_new_version(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document of both: accepted, and the first reason if not (pages differ, too few words, more broken signs).

    Rows: doc_id, n_pages, n_words, n_broken.
    """
    o, n = old.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "doc_id"]), new
    j = n.join(o, "doc_id")
    reason = F.when(F.col("n_pages") != F.col("old_n_pages"), "pages differ").when(F.col("n_words") < F.greatest(F.lit(100.0), 0.75 * F.col("old_n_words")), "too few words").when(F.col("n_broken") > F.col("old_n_broken"), "more broken signs")
    return j.select("doc_id", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"))


def printed_numbers(pages: DataFrame) -> DataFrame:
    """doc_id, sheet, printed, stamped of the pages on which a page number is found.

    A layout tool's stamp (`name.indd 12`, the last on the page) comes first; else the last line
    that is only a number among the first and last four lines. Years on the first four sheets and
    numbers far beyond the number of pages are no page numbers.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    stamp = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)\.indd\s+([0-9]{1,4})\b"), F.lit(1))
    ls = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    p = pages.select("doc_id", F.col("page_no").alias("sheet"), stamp.alias("stamp"), ls.alias("ls")).join(n, "doc_id")
    edge = F.concat(F.slice("ls", F.lit(1), F.lit(4)), F.slice("ls", F.greatest(F.size("ls") - 3, F.lit(1)), F.lit(4)))
    alone = F.transform(F.filter(edge, lambda x: x.rlike("^[0-9]{1,4}$")), lambda x: x.cast("int"))
    far = lambda v: ((F.col("sheet") <= 4) & (v.between(1450, 2099) | (v > F.greatest(F.lit(50), F.col("n"))))) | (v > F.greatest(F.col("n") * 2, F.lit(2000)))
    p = p.withColumn("alone", F.filter(alone, lambda v: ~far(v)))
    stamped = F.size("stamp") > 0
    printed = F.when(stamped, F.element_at("stamp", -1).cast("int")).when(F.size("alone") > 0, F.element_at("alone", -1))
    return p.select("doc_id", "sheet", printed.alias("printed"), stamped.alias("stamped")).where("printed is not null")


def page_sequence_gaps(numbers: DataFrame) -> DataFrame:
    """Documents with page numbers (doc_id, sheet, printed, stamped): n_seen, gap_from, gap_to, late_start, partial.

    gap: the first jump above one between neighbours that a layout tool stamped. late_start: the first
    number above one, at least 5, stands on one of the first 4 sheets and is 4 or more ahead of
    it. Fewer than 3 numbers tell nothing.
    """
    order = Window.partitionBy("doc_id").orderBy("sheet")
    d = numbers.withColumn("before", F.lag("printed").over(order)).withColumn("both", F.col("stamped") & F.lag("stamped").over(order))
    jump = F.when(F.col("both") & (F.col("printed") - F.col("before") > 1), F.struct("sheet", "before", "printed"))
    useful = F.when(F.col("printed") > 1, F.struct("sheet", "printed"))
    d = d.groupBy("doc_id").agg(F.count("*").alias("n_seen"), F.min(jump).alias("gap"), F.min(useful).alias("first"))
    late = F.coalesce((F.col("first.sheet") <= 4) & (F.col("first.printed") >= 5) & (F.col("first.printed") - F.col("first.sheet") >= 4), F.lit(False))
    out = d.where("n_seen >= 3").select("doc_id", "n_seen", F.col("gap.before").alias("gap_from"), F.col("gap.printed").alias("gap_to"), late.alias("late_start"))
    return out.withColumn("partial", F.col("gap_from").isNotNull() | F.col("late_start"))


def pagination_check(records: DataFrame, editions: DataFrame) -> DataFrame:
    """File pages against edition pages: ok, shorter (over 25 % missing) as reflowed, double_page (ratio 1.65 to 2.15) or conflict."""
    j = records.join(editions, "rec_id")
    ratio = F.col("edition_pages") / F.col("file_pages")
    verdict = F.when(F.col("file_pages") >= 0.75 * F.col("edition_pages"), "ok").when(F.col("reflowable"), "reflowed").when(ratio.between(1.65, 2.15), "double_page").otherwise("conflict")
    return j.select("rec_id", "file_pages", "edition_pages", verdict.alias("verdict"))


#: Literal marks of where a file comes from, by kind. Fixed values.
PROVENANCE_MARKS = {
    "machine_translated": r"machine\s+translated\s+by\s+google|traduzido\s+automaticamente\s+pelo\s+google",
    "site_navigation": r"<-\s*previous\s+first\s+next\s*->|previous\s*\|\s*first\s*\|\s*next",
    "shared_copy": r"scribd\.com|baixado\s+(?:do|em)\s+scribd",
    "non_commercial": r"c[oó]pia\s+(?:digital\s+)?n[aã]o\s+comercial|non[- ]commercial\s+(?:digital\s+)?copy",
}
#: What a published book says of itself. Fixed values.
PUBLISHING_SIGNALS = r"\bisbn\b|\bcopyright\b|[©℗]|dados\s+(?:internacionais\s+)?de\s+cataloga[çc][aã]o|ficha\s+catalogr[aá]fica"


def provenance_flags(docs: DataFrame, isbn: str | None = None) -> DataFrame:
    """doc_id, machine_translated, site_capture, shared_copy, non_commercial, derived; with isbn: what of it stays.

    A site capture has a site's navigation line, or three lines that are only a URL of one host and no
    publishing signals. Derived copies (machine translations, captures, non-commercial copies) do not
    keep the ISBN of their source.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    flags = docs.select("doc_id", *([F.col(isbn).alias("isbn")] if isbn else []), *[text.rlike(rule).alias(name) for name, rule in PROVENANCE_MARKS.items()], text.rlike(PUBLISHING_SIGNALS).alias("signals"), F.split(text, "\n").alias("ls"))
    hosts = F.filter(F.transform("ls", lambda x: F.regexp_extract(F.trim(x), r"^https?://([^/\s]+)\S*$", 1)), lambda h: h != "")
    flags = flags.withColumn("hosts", F.sort_array(hosts)).drop("ls")
    three = F.exists(F.transform("hosts", lambda h, i: h == F.get("hosts", i + 2)), lambda x: F.coalesce(x, F.lit(False)))
    out = flags.withColumn("site_capture", F.col("site_navigation") | (three & ~F.col("signals")))
    out = out.withColumn("derived", F.col("machine_translated") | F.col("site_capture") | F.col("non_commercial"))
    kept = [F.when(~F.col("derived"), F.col("isbn")).alias("isbn")] if isbn else []
    return out.select("doc_id", "machine_translated", "site_capture", "shared_copy", "non_commercial", "derived", *kept)
