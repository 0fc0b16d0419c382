"""Lookup tables learned from what recurs, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.functions.sequence import sequence_ratio


def learn_publisher_city(records: DataFrame, known: DataFrame) -> DataFrame:
    """key, city, n, confidence: the most frequent city of a publisher seen twice or more (ties: first by name).

    A known entry (key, city) wins and gets its publisher's total; confidence is alta from 3 on.
    """
    c = records.select(T.normal(F.col("publisher")).alias("key"), "city").where("key <> '' and city is not null and city <> ''").groupBy("key", "city").count()
    t = c.groupBy("key").agg(F.sum("count").alias("total"), F.min_by(F.struct("city", "count"), F.struct(-F.col("count"), "city")).alias("m"))
    j = t.select("key", F.col("m.city").alias("city"), F.col("m.count").alias("n"), "total").join(known.select("key", F.col("city").alias("known")), "key", "full")
    level = F.when(F.col("known").isNotNull(), "conhecida").when(F.col("n") >= 3, "alta").otherwise("media")
    out = j.where("known is not null or n >= 2")
    return out.select("key", F.coalesce("known", "city").alias("city"), F.coalesce(F.when(F.col("known").isNotNull(), F.col("total")).otherwise(F.col("n")), F.lit(0)).alias("n"), level.alias("confidence"))


#: Words of a periodical's name. Fixed values.
PERIODICAL_WORDS = r"\b(?:revista|journal|magazine|periodico|theologica|theology|ciberteologia)\b"


def learn_periodicals(records: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """key, name, n of periodical-looking names seen twice or more in articles and magazines that are not known yet; name: the first spelling by alphabet.

    records: type, periodical; known: key.
    """
    r = records.where(F.col("type").isin("artigo", "revista")).select(T.normal(F.col("periodical")).alias("key"), F.trim(F.regexp_replace("periodical", r"\s+", " ")).alias("name"))
    n = r.where(F.col("key").rlike(PERIODICAL_WORDS)).groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(known.select("key"), "key", "left_anti")


def learn_corrections(auto: DataFrame, reviewed: DataFrame, fields: list[str], least: int = 3) -> DataFrame:
    """field, wrong, n_items, n_forms, last_seen, recommended: values that reviewers replaced.

    Rows: hash, the fields, and seen_at (reviewed). Empty or equal values (in normal form) count as no correction.
    """
    melt = lambda d, v, *more: d.select("hash", *more, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(v)) for f in fields])).alias("x")).select("hash", *more, "x.*")
    j = melt(auto, "old").join(melt(reviewed, "new", "seen_at"), ["hash", "field"]).where("trim(old) <> '' and trim(new) <> ''")
    j = j.withColumn("wrong", T.normal(F.col("old"))).where(F.col("wrong") != T.normal(F.col("new")))
    g = j.groupBy("field", "wrong").agg(F.countDistinct("hash").alias("n_items"), F.countDistinct("new").alias("n_forms"), F.max("seen_at").alias("last_seen"))
    return g.withColumn("recommended", F.col("n_items") >= least)


def learn_noise(decisions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Marked noise (text, mode) whose normal form is not in the dictionary yet, once each."""
    d = decisions.select(T.normal(F.col("text")).alias("key"), "mode").where("key <> ''").distinct()
    return d.join(dictionary.select(T.normal(F.col("text")).alias("key"), "mode").distinct(), ["key", "mode"], "left_anti")


def state_summary(items: DataFrame) -> DataFrame:
    """state, n, bytes."""
    return items.groupBy("state").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def evaluate_extraction(pred: DataFrame, gold: DataFrame, measure: str = "edits") -> DataFrame:
    """rec_id, title_sim, surname_recall, doi_ok, year_ok, title_passed, authors_passed, passed (0.90 and 0.80): gold rows without a prediction score 0.

    Rows: rec_id, title, authors (array), doi, year. title_sim of the normal forms: 1 - edit distance / longer length (edits), or by
    matching blocks (sequence, see functions/sequence.py). A surname (an
    author's last word) is found if it stands anywhere in the predicted names; without gold authors recall is 1.
    """
    p = pred.select("rec_id", F.lit(True).alias("has"), *[F.col(c).alias(f"p_{c}") for c in ("title", "authors", "doi", "year")])
    j = gold.join(p, "rec_id", "left")
    norm = lambda c: T.normal(F.coalesce(c, F.lit("")))
    longer = F.greatest(F.length(norm("title")), F.length(norm("p_title")), F.lit(1))
    if measure not in ("edits", "sequence"):
        raise ValueError("measure must be edits or sequence")
    sim = sequence_ratio(norm("title"), norm("p_title")) if measure == "sequence" else 1 - F.levenshtein(norm("title"), norm("p_title")) / longer
    names = T.normal(F.array_join(F.coalesce("p_authors", F.array().cast("array<string>")), " "))
    surnames = F.filter(F.transform("authors", lambda a: F.element_at(T.words(a), -1)), lambda w: w.isNotNull())
    recall = F.when(F.size(surnames) > 0, F.size(F.filter(surnames, lambda w: F.contains(names, w))) / F.size(surnames)).otherwise(1.0)
    has = F.coalesce("has", F.lit(False))
    j = j.select("rec_id", F.when(has, sim).otherwise(0.0).alias("title_sim"), F.when(has, recall).otherwise(0.0).alias("surname_recall"), (has & (norm("doi") == norm("p_doi"))).alias("doi_ok"), (has & F.coalesce(F.col("year").eqNullSafe(F.col("p_year")), F.lit(False))).alias("year_ok"))
    return j.withColumn("title_passed", F.col("title_sim") >= 0.90).withColumn("authors_passed", F.col("surname_recall") >= 0.80).withColumn("passed", F.col("title_passed") & F.col("authors_passed"))


def evaluation_totals(evaluated: DataFrame) -> DataFrame:
    """One row: n, mean title_sim and surname_recall, and how many rows are right in each respect."""
    return evaluated.agg(F.count("*").alias("n"), F.round(F.avg("title_sim"), 6).alias("title_sim"), F.round(F.avg("surname_recall"), 6).alias("surname_recall"), *[F.count_if(c).alias(f"n_{c}") for c in ("doi_ok", "year_ok", "title_passed", "authors_passed", "passed")])


#: Spellings and standard names of languages. Fixed values.
LANGUAGE_NAMES = {"portugues": "Português", "português": "Português", "ingles": "Inglês", "inglês": "Inglês", "espanhol": "Espanhol", "castelhano": "Espanhol", "frances": "Francês", "francês": "Francês", "alemao": "Alemão", "alemão": "Alemão"}


def language_name_profile(records: DataFrame, names: dict[str, str] = LANGUAGE_NAMES) -> DataFrame:
    """language, n, n_other: records by standard name, and how many spelled it otherwise."""
    given = F.trim(F.regexp_replace("language", r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    r = records.select(given.alias("given"), F.coalesce(table[F.lower(given)], given).alias("language"))
    return r.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("given") != F.col("language")).alias("n_other"))
