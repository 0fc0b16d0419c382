"""Parts of a document that rules look at: file name, first and last pages, card and credit text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T

#: Headers of a cataloguing card, and how much of the text after one belongs to it. Fixed values.
CARD_HEADER = r"dados (?:internacionais )?de catalogacao|ficha catalografica|cataloging[ -]*in[ -]*publication|catalogacao na (?:fonte|publicacao)"
CARD_CHARS = 2600
#: What a credit page says, in plain form. Fixed values.
CREDIT_WORDS = r"\bcopyright\b|©|\bisbn\b|all rights reserved|todos os direitos|catalogacao"


def document_scopes(pages: DataFrame) -> DataFrame:
    """doc_id, n_text, short_share, page1, first3, first10, first12, last3, edges, credit, card.

    Each document is one row: pages are numbered within it first, and at most the first twelve and
    last three are gathered, so a long document costs no more than a short one. card: what follows
    the first cataloguing header; credit: the pages of these that speak of rights. Null texts are empty.
    """
    w = Window.partitionBy("doc_id")
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text)
    # pages are counted where they meet: counts joined to them from the side would be a table so small that one task got all texts
    p = pages.where("doc_id is not null").select("doc_id", "page_no", text.alias("text"), (trimmed != "").alias("filled"), ((F.length(trimmed) < 700) | (F.length(F.regexp_replace(trimmed, r"\s+", " ")) < 700)).alias("short"))
    p = p.select("doc_id", "page_no", "text", F.count("*").over(w).alias("n"), F.count_if("filled").over(w).alias("n_text"), F.count_if(F.col("filled") & F.col("short")).over(w).alias("n_short"))
    p = p.where("page_no <= 12 or page_no > n - 3")
    got = p.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("n_text").alias("n_text"), F.first("n_short").alias("n_short"), F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("ps"))
    of = lambda test: F.array_join(F.transform(F.filter("ps", test), lambda x: x.text), "\n")
    upto = lambda k: of(lambda x: x.page_no <= k)
    last = of(lambda x: x.page_no > F.col("n") - 3)
    share = F.when(F.col("n_text") > 0, F.col("n_short") / F.col("n_text")).otherwise(0.0)
    d = got.select(
        "doc_id", "n_text", share.alias("short_share"), upto(1).alias("page1"), upto(3).alias("first3"), upto(10).alias("first10"), upto(12).alias("first12"),
        last.alias("last3"), F.concat(upto(3), F.lit("\n"), last).alias("edges"), of(lambda x: T.plain(x.text).rlike(CREDIT_WORDS)).alias("credit"),
    )
    low = T.plain(F.col("first12"))
    header = F.regexp_extract(low, CARD_HEADER, 0)
    card = F.when(header != "", F.expr("substring(first12, instr(low_, head_) + length(head_), " + str(CARD_CHARS) + ")")).otherwise("")
    return d.withColumn("low_", low).withColumn("head_", header).withColumn("card", card).drop("low_", "head_")


def plain_scopes(scopes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return scopes.withColumns({n: T.plain(F.coalesce(n, F.lit(""))) for n in names})


def all_true(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
