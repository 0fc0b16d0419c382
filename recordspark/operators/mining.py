"""Corpus mining: language, topics, articles, issues, document types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.operators.keywords import keyword_scores

#: Stop words and phrases by language, in the order that decides ties. Fixed values.
LANGUAGE_WORDS = {
    "por": "não são também português edição tradução direitos para uma que com por dos das".split(),
    "spa": "edición traducción derechos reservados español para una que con por los las del".split(),
    "fre": ["tous droits", *"traduction français édition pour une dans avec des les du par".split()],
    "eng": ["all rights reserved", "published by", "translated by", *"the and with for from this".split()],
}
DEFAULT_TOPIC = "fé e vida cristã"


def detect_language(docs: DataFrame, profiles: dict[str, list[str]] = LANGUAGE_WORDS) -> DataFrame:
    """doc_id, detected, hits: the language with most stop words and phrases (ties: first listed), empty without any.

    Counted inside the row: words in any list are kept first, and each language counts its own among these; a phrase
    is looked for as it stands, its words parted by one blank. A caller's profiles may add languages. Nothing is shuffled.
    """
    low, edge = F.lower(F.coalesce("text", F.lit(""))), r"[\p{L}\p{N}_]"
    every = sorted({w for ws in profiles.values() for w in ws if " " not in w})
    among = lambda words: lambda x: x.isin(words)
    kept = docs.select("doc_id", low.alias("low_"), F.filter(F.regexp_extract_all(low, F.lit(edge + "+"), F.lit(0)), among(every)).alias("stop_"))
    counts = []
    for rank, (name, ws) in enumerate(profiles.items()):
        single = [w for w in ws if " " not in w]
        hits = F.size(F.filter("stop_", among(single))) if single else F.lit(0)
        phrases = (F.regexp_count("low_", F.lit(rf"(?<!{edge}){w}(?!{edge})")) for w in ws if " " in w)
        counts.append(F.struct((-sum(phrases, hits)).cast("long").alias("less"), F.lit(rank).alias("rank"), F.lit(name).alias("name")))
    best = kept.select("doc_id", F.array_min(F.array(*counts)).alias("m"))
    return best.select("doc_id", F.when(F.col("m.less") < 0, F.col("m.name")).otherwise("").alias("detected"), (-F.col("m.less")).alias("hits"))


def language_confusion(detected: DataFrame, given: DataFrame) -> DataFrame:
    """Documents by given and detected language."""
    return given.join(detected, "doc_id").groupBy("lang", "detected").agg(F.count("*").alias("n"))


def topic_scores(texts: DataFrame, taxonomy: DataFrame, k: int = 5, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, topic, score, rank: the k topics with most non-overlapping keyword occurrences (ties: later topic name first).

    taxonomy: topic, keyword. All keywords are looked for in one pass over each text (see keywords.py), and ranked inside the
    row; nothing is shuffled, and each row of texts has its own topics. Texts without any keyword get the default topic with score 0.
    """
    body = texts.select(*keys, F.lower(F.coalesce(text, F.lit(""))).alias("low_"))
    scored = keyword_scores(body, "low_", taxonomy, "keyword", "topic", "found_").drop("low_")
    order = F.sort_array(F.transform("found_", lambda x: F.struct(x.n.alias("score"), x.label.alias("topic"))), asc=False)
    none = F.array(F.struct(F.lit(0).cast("long").alias("score"), F.lit(DEFAULT_TOPIC).alias("topic")))
    top = scored.select(*keys, F.posexplode(F.when(F.size("found_") == 0, none).otherwise(F.slice(order, 1, k))).alias("place_", "top_"))
    return top.select(*keys, "top_.topic", "top_.score", (F.col("place_") + 1).alias("rank"))


#: A byline's author: two to five capitalised words or initials.
AUTHOR_RULE = r"^[\p{Lu}][\p{L}'.-]*( [\p{Lu}][\p{L}'.#0-9-]*){1,4}$"


def segment_articles(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """issue_id, page_no, position, title, author, body of the articles of every issue.

    A `by Name` line among the first 45 non-blank lines of a page opens an article; its title is
    the nearest acceptable of the five lines before. A (title, author) counts once per issue, the
    body is the page with the next one, and of more than nine articles the positions 0, 1, 2, n/2
    and the last four stay. overrides: rows that replace detection for their issues.
    """
    order = Window.partitionBy("issue_id").orderBy("page_no")
    p = pages.withColumn("next", F.lead("text").over(order))
    body = F.concat_ws("\n", "text", "next")
    ls = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = p.select("issue_id", "page_no", body.alias("body"), F.slice(ls, 1, 45).alias("ls"))
    at = F.expr("filter(sequence(0, size(ls) - 1), i -> size(ls) > 0 and lower(ls[i]) like 'by %')")
    b = p.select("issue_id", "page_no", "body", "ls", F.explode(at).alias("i"))
    author = F.trim(F.expr("substring(ls[i], 4)"))
    before = F.expr("reverse(filter(slice(ls, greatest(i - 4, 1), i - greatest(i - 5, 0)), x -> length(x) between 4 and 90 and not lower(x) like 'by %' and x rlike '[\\\\p{L}]{3}'))")
    a = b.select("issue_id", "page_no", "i", "body", author.alias("author"), F.get(before, F.lit(0)).alias("title"))
    a = a.where(F.col("title").isNotNull() & F.col("author").rlike(AUTHOR_RULE))
    first = F.row_number().over(Window.partitionBy("issue_id", F.lower("title"), F.lower("author")).orderBy("page_no", "i"))
    a = a.withColumn("rn", first).where("rn = 1")
    w = Window.partitionBy("issue_id")
    a = a.withColumn("n", F.count("*").over(w)).withColumn("position", F.row_number().over(w.orderBy("page_no", "i")) - 1)
    keep = (F.col("n") <= 9) | (F.col("position") <= 2) | (F.col("position") == F.floor(F.col("n") / 2)) | (F.col("position") >= F.col("n") - 4)
    a = a.where(keep).select("issue_id", "page_no", "position", "title", "author", "body")
    if overrides is not None:
        a = a.join(overrides.select("issue_id").distinct(), "issue_id", "left_anti").unionByName(overrides.select(a.columns))
    return a


def issue_summary(articles: DataFrame, topics: DataFrame, decisions: DataFrame, cautions: DataFrame | None = None, n: int = 8) -> DataFrame:
    """Per issue: n_articles, topics and authors in order of first appearance (n at most), decisions (7 at most), cautions, potential.

    topics: issue_id, page_no, topic, rank of every article's page; decisions: topic, decision; cautions: topic, ord, caution, careful. potential is
    `high, with caution` where a topic's caution says careful, else `high`.
    """
    def ordered(rows: DataFrame, value: str, most: int, name: str) -> DataFrame:
        firsts = rows.groupBy("issue_id", value).agg(F.min(F.struct("page_no", "rank")).alias("at"))
        top = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("issue_id").orderBy("at", value))).where(F.col("rn") <= most)
        return top.groupBy("issue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", value))), lambda x: x[value]), "; ").alias(name))

    t = topics.join(articles.select("issue_id", "page_no").distinct(), ["issue_id", "page_no"])
    d = t.join(decisions, "topic").select("issue_id", "decision", "page_no", "rank")
    who = articles.select("issue_id", "author", "page_no", F.col("position").alias("rank"))
    out = articles.groupBy("issue_id").agg(F.count("*").alias("n_articles"))
    for rows, value, most, name in ((t, "topic", n, "topics"), (d, "decision", 7, "decisions"), (who, "author", n, "authors")):
        out = out.join(ordered(rows, value, most, name), "issue_id", "left")
    if cautions is not None:
        c = t.select("issue_id", "topic").distinct().join(cautions, "topic")
        c = c.groupBy("issue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("ord", "caution"))), lambda x: x.caution), "; ").alias("cautions"), F.max("careful").alias("careful"))
        out = out.join(c, "issue_id", "left").withColumn("cautions", F.coalesce("cautions", F.lit(""))).withColumn("potential", F.when(F.col("careful"), "high, with caution").otherwise("high")).drop("careful")
    return out


DEFAULT_DECISION = "examinar o testemunho e seu contexto"


def author_topics(articles: DataFrame, topics: DataFrame, decisions: DataFrame, n: int = 4) -> DataFrame:
    """author, topics, decision: the first n distinct topics of an author's articles, in (issue, page, rank) order, and what the first one suggests."""
    t = articles.select("issue_id", "page_no", "author").join(topics, ["issue_id", "page_no"])
    f = t.groupBy("author", "topic").agg(F.min(F.struct("issue_id", "page_no", "rank")).alias("at"))
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("author").orderBy("at", "topic"))).where(F.col("rn") <= n)
    g = f.groupBy("author").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "topic"))), lambda x: x.topic), "; ").alias("topics"), F.min_by("topic", "rn").alias("topic"))
    return g.join(decisions, "topic", "left").select("author", "topics", F.coalesce("decision", F.lit(DEFAULT_DECISION)).alias("decision"))


def topic_index(articles: DataFrame, topics: DataFrame, decisions: DataFrame) -> DataFrame:
    """kind (topic or decision), term, issue_id, people, n_articles: the inverted index, one row for each issue a term is found in.

    people: the authors of its articles there, in page order; an issue has nine articles at most, so rows stay small.
    """
    t = articles.select("issue_id", "page_no", "position", "author").join(topics.select("issue_id", "page_no", "topic"), ["issue_id", "page_no"])
    rows = t.select(F.lit("topic").alias("kind"), F.col("topic").alias("term"), "issue_id", "position", "author").unionByName(t.join(decisions, "topic").select(F.lit("decision").alias("kind"), F.col("decision").alias("term"), "issue_id", "position", "author")).distinct()
    g = rows.groupBy("kind", "term", "issue_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("position", "author"))), lambda x: x.author)).alias("who"), F.count("*").alias("n_articles"))
    return g.select("kind", "term", "issue_id", F.array_join("who", "; ").alias("people"), "n_articles")


def topic_index_totals(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, n_issues, n_people, n_articles."""
    t = articles.join(topics.select("issue_id", "page_no", "topic"), ["issue_id", "page_no"])
    return t.groupBy("topic").agg(F.countDistinct("issue_id").alias("n_issues"), F.countDistinct("author").alias("n_people"), F.count("*").alias("n_articles"))


def mining_progress(issues: DataFrame, texts: DataFrame, summaries: DataFrame) -> DataFrame:
    """issue_id, year, month, name, state (done, waiting, no text)."""
    j = issues.join(texts.select("issue_id", F.lit(True).alias("has_text")).distinct(), "issue_id", "left").join(summaries.select("issue_id", F.lit(True).alias("done")).distinct(), "issue_id", "left")
    state = F.when(F.col("done"), "done").when(F.col("has_text"), "waiting").otherwise("no text")
    return j.select("issue_id", "year", "month", "name", state.alias("state"))


def progress_totals(progress: DataFrame) -> DataFrame:
    """n by state, with the last done and the next waiting issue in (year, month, name) order."""
    at = F.struct("year", "month", "name", "issue_id")
    return progress.agg(
        F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("state") == "waiting").alias("n_waiting"), F.count_if(F.col("state") == "no text").alias("n_no_text"),
        F.max(F.when(F.col("state") == "done", at))["issue_id"].alias("last_done"), F.min(F.when(F.col("state") == "waiting", at))["issue_id"].alias("next_waiting"),
    )


#: Signals of a kind of material, in plain form; and what makes a package of an article. Fixed values.
TYPE_SIGNALS = (
    ("livro", r"\b(?:isbn|ficha catalografica|cdd|cdu|copyright)\b"),
    ("revista/artigo", r"\b(?:revista|magazine|journal|periodico|boletim)\b"),
    ("artigo/acadêmico", r"\b(?:resumo|abstract|palavras-chave|keywords)\b"),
    ("tese/dissertação", r"\b(?:tese|dissertacao|monografia|orientador|banca examinadora)\b"),
    ("documento/apostila", r"\b(?:plano de aula|aula\s+[0-9]+|licao\s+[0-9]+|slides?|powerpoint)\b"),
    ("documento/sermão", r"\b(?:sermao|pregacao|estudo biblico|celula)\b"),
)
ACADEMIC_SIGNALS = (
    ("doi", r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]"),
    ("abstract", r"\b(?:abstract|resumo)\b"),
    ("keywords", r"\b(?:keywords?|palavras[ -]chave)\b"),
    ("references", r"\b(?:references|referencias bibliograficas|bibliografia)\b"),
    ("issn", r"\bissn\s*[0-9]{4}\s*[- ]?\s*[0-9]{3}[0-9x]\b"),
)
ACADEMIC_TYPES, JOURNAL_TYPES, DOCUMENT_TYPES = ("artigo", "tese", "dissertação", "trabalho acadêmico"), ("revista", "periódico", "boletim", "jornal"), ("documento", "apostila", "sermão", "trecho", "apresentação", "opúsculo")


def type_signals(docs: DataFrame) -> DataFrame:
    """doc_id, signals, contradictions, academic (signals of an article), consult, becomes_article.

    docs: doc_id, text, type, isbn, n_pages (0: unknown). An article's package is a DOI with an abstract, keywords,
    references or an ISSN, of at most 100 pages; documents and handouts are worth a look at three signals.
    """
    low = T.plain(F.coalesce("text", F.lit("")))
    said = lambda rules, text: F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in rules]))
    d = docs.select("doc_id", F.coalesce("type", F.lit("livro")).alias("type"), "isbn", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), low.alias("low"))
    d = d.select("*", said(TYPE_SIGNALS, F.col("low")).alias("s"), said(ACADEMIC_SIGNALS, F.col("low")).alias("a"))
    d = d.withColumn("s", F.when((F.size("s") == 0) & (F.coalesce("isbn", F.lit("")) != ""), F.array(F.lit("livro"))).otherwise(F.col("s")))
    has = lambda word: F.exists("s", lambda x: F.contains(x, F.lit(word)))
    against = F.array_compact(F.array(
        F.when((F.col("type") == "livro") & (has("documento") | has("artigo") | has("tese")), "book with signs of other material"),
        F.when(F.col("type").isin(*DOCUMENT_TYPES) & F.array_contains("s", "livro"), "document with signs of a published book"),
        F.when(F.col("type").isin(*JOURNAL_TYPES) & has("artigo"), "whole issue or single article"),
    ))
    package = F.array_contains("a", "doi") & (F.size("a") >= 2) & (F.col("n_pages") <= 100)
    many = F.col("type").isin("documento", "apostila") & (F.size("a") >= 3)
    return d.select("doc_id", F.array_join("s", "; ").alias("signals"), F.array_join(against, "; ").alias("contradictions"), F.array_join("a", "; ").alias("academic"), (F.col("type").isin(*ACADEMIC_TYPES) | package | many).alias("consult"), package.alias("becomes_article"))


def issue_records(files: DataFrame, periods: DataFrame, organisation: str, first_year: int = 1952, least_words: int = 50) -> DataFrame:
    """file_id, code, title, date, month, year, volume, estimated, author, notes, skip from names like `Name-1993-05-v41.pdf` or `Name-1993-05-06.pdf`.

    files: file_id, name, n_pages, n_words; periods: ord, first_year, last_year, holder (editors). Without a volume it is the year minus
    first_year, marked estimated. The editor of the year is the author, else the organisation. Skipped: names without year and month (no pattern),
    months that are none (invalid), files with less than least_words words (too little text).
    """
    get = lambda rule: F.nullif(F.regexp_extract("name", rule, 1), F.lit(""))
    by_year = periods.select("ord", "holder", F.explode(F.sequence("first_year", "last_year")).alias("year")).groupBy("year").agg(F.min_by("holder", "ord").alias("editor"))
    f = files.select("file_id", "n_pages", "n_words", get(r"^([A-Za-z]+)-").alias("series"), get(r"-((?:1[5-9]|20)[0-9]{2})-").cast("int").alias("year"), get(r"-[0-9]{4}-([0-9]{2})").cast("int").alias("month"), get(r"-[0-9]{4}-[0-9]{2}-([0-9]{2})(?:-|\.|$)").cast("int").alias("month2"), get(r"-v([0-9]+)").cast("int").alias("given"), get(r"-n([0-9]+)").alias("number"))
    bad = ~F.col("month").between(1, 12) | F.coalesce(~F.col("month2").between(1, 12), F.lit(False))
    skip = F.when(F.col("series").isNull() | F.col("year").isNull() | F.col("month").isNull(), "no pattern").when(bad, "invalid").when(F.col("n_words") < least_words, "too little text")
    f = f.withColumn("skip", F.coalesce(skip, F.lit(""))).withColumn("volume", F.coalesce("given", F.col("year") - first_year)).join(by_year, "year", "left")
    ok = F.col("skip") == ""
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    months = F.concat_ws("/", two("month"), two("month2"))
    code = F.concat_ws("-", "series", F.col("year").cast("string"), two("month"), two("month2"))
    notes = F.concat_ws(" ", F.concat(F.lit("v."), F.col("volume").cast("string"), F.when(F.col("given").isNull(), " (estimated)").otherwise("")), F.concat(months, F.lit("/"), F.col("year").cast("string")), F.concat(F.lit("n."), "number"), F.when(F.col("n_pages") > 0, F.concat(F.col("n_pages").cast("string"), F.lit(" p."))), F.concat(F.lit("Editor: "), "editor", F.lit(".")))
    only = lambda c: F.when(ok, c)
    return f.select("file_id", only(code).alias("code"), only(F.concat("series", F.lit(", "), months, F.lit("/"), F.col("year").cast("string"))).alias("title"), only(F.concat(two("month"), F.lit("/"), F.col("year").cast("string"))).alias("date"), "month", "year", "volume", F.col("given").isNull().alias("estimated"), only(F.coalesce("editor", F.lit(organisation))).alias("author"), only(notes).alias("notes"), "skip")


def skip_counts(records: DataFrame) -> DataFrame:
    """skip, n of the files that gave no record."""
    return records.where("skip <> ''").groupBy("skip").agg(F.count("*").alias("n"))
