"""Documents to pages and lines, and web pages to record metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_pages(docs: DataFrame, sep: str = "\f", drop_blank: bool = False) -> DataFrame:
    """doc_id, page_no (from 1), text; blank pages are dropped before numbering if asked for."""
    parts = F.split(F.coalesce("text", F.lit("")), sep)
    if drop_blank:
        parts = F.filter(parts, lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")


def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1, over non-blank lines), line."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def lines_as_pages(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, page_no, text: every n lines are a page; one row per page without a shuffle. (No sequence is empty; outer spares a test of its size on lines cut once more.)"""
    cut = docs.withColumn("ls", F.split(F.coalesce("text", F.lit("")), "\n"))
    at = F.explode_outer(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / n).cast("int")))
    cut = cut.select("doc_id", "ls", at.alias("p"))
    return cut.select("doc_id", (F.col("p") + 1).alias("page_no"), F.array_join(F.slice("ls", F.col("p") * n + 1, F.lit(n)), "\n").alias("text"))


def select_edge_pages(pages: DataFrame, first: int = 30, last: int = 12) -> DataFrame:
    """The first and last pages of every document with their true numbers, none twice."""
    n = F.max("page_no").over(Window.partitionBy("doc_id"))
    return pages.withColumn("n", n).where((F.col("page_no") <= first) | (F.col("page_no") > F.col("n") - last)).drop("n")


def _meta(*names: str) -> Column:
    """Content of the first meta tag with one of the names, whatever the order of its attributes and the kind of its quotes."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    value = lambda tag, rule: F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\b(?:{rule})\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"])
    own = lambda name: F.get(F.filter(F.transform(F.filter(tags, lambda t: F.lower(value(t, "name|property")) == name), lambda t: F.trim(value(t, "content"))), lambda v: v != ""), F.lit(0))
    return F.coalesce(*[own(n) for n in names])


def html_record_metadata(pages: DataFrame) -> DataFrame:
    """page_id, title (meta, og, title tag), pdf_url, year (meta, else title), safe_name, n_links."""
    title = F.coalesce(_meta("citation_title"), _meta("og:title"), F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit("")))
    year = F.nullif(F.regexp_extract(F.coalesce(_meta("citation_date", "citation_publication_date", "dc.date"), F.lit("")), r"((?:1[5-9]|20)[0-9]{2})", 1), F.lit(""))
    p = pages.select("page_id", title.alias("title"), _meta("citation_pdf_url").alias("pdf_url"), year.alias("meta_year"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""href=["']([^"'#]+)["']"""), F.lit(1)))).alias("n_links"))
    year = F.coalesce("meta_year", F.nullif(F.regexp_extract("title", r"\b((?:1[5-9]|20)[0-9]{2})\b", 1), F.lit(""))).try_cast("int")
    safe = F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), r"[^A-Za-z0-9]+", "_"), 1, 80)
    return p.select("page_id", "title", "pdf_url", year.alias("year"), safe.alias("safe_name"), "n_links")


def record_links(pages: DataFrame) -> DataFrame:
    """page_id, place (from 1), link, number: the distinct links of a page that end in a number, sorted by it and then by the link."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"""href=["']([^"'#?]*[0-9])/?["']"""), F.lit(1)))
    keyed = F.transform(links, lambda x: F.struct(F.regexp_extract(x, "([0-9]{1,18})$", 1).cast("long").alias("number"), x.alias("link")))
    return pages.select("page_id", F.posexplode(F.array_sort(keyed)).alias("pos", "x")).select("page_id", (F.col("pos") + 1).alias("place"), "x.link", "x.number")


def labelled_fields(texts: DataFrame, spec: dict[str, str], key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, field, value) for each `Label: value` that a pattern of the spec finds; empty values give no row."""
    pairs = [F.struct(F.lit(f).alias("field"), F.trim(F.regexp_extract(text, rule, 1)).alias("value")) for f, rule in spec.items()]
    return texts.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.field", "x.value").where("value <> ''")


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "record_url") -> DataFrame:
    """Upsert: the new row of a key, else the old one (within a side the latest by updated_at)."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("side"), F.desc("updated_at"), "status"))
    return both.withColumn("rn", rank).where("rn = 1").drop("rn", "side")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Rows and bytes by status."""
    return manifest.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def catalogue_report(catalogue: DataFrame, path: str | None = None) -> DataFrame:
    """Catalogue rows in (state, file) order; written as `;`-separated CSV if a path is given."""
    out = catalogue.orderBy("state", "file")
    if path:
        out.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    return out
