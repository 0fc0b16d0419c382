"""Data fusion: which value of a field survives, and where it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.operators.alerts import plausible_title, title_alerts


def fuse_fields(evidence: DataFrame, priority: DataFrame) -> DataFrame:
    """rec_id, field, value, source: the value of the source with the best rank for the record's type (ties: smallest value).

    evidence: rec_id, type, field, source, value; priority: type, field, source, rank. Empty values and sources without a rank are left out.
    """
    e = evidence.where("value is not null and trim(value) <> ''").join(priority, ["type", "field", "source"])
    best = e.groupBy("rec_id", "field").agg(F.min(F.struct("rank", "value", "source")).alias("m"))
    return best.select("rec_id", "field", "m.value", "m.source")


def merge_catalog_cards(header: DataFrame, signals: DataFrame, simple: DataFrame, fields: list[str]) -> DataFrame:
    """rec_id and fields: per field the first non-empty value of the card with header, the card found by signals, the simple card.

    The title ends at its first `/`, an author in front of it goes (the signals' author first), and an implausible title is dropped.
    """
    empty = lambda t, f: F.nullif(F.trim(F.col(f"{t}.{f}")), F.lit(""))
    j = header.alias("a").join(signals.alias("b"), "rec_id", "full").join(simple.alias("c"), "rec_id", "full")
    out = j.select("rec_id", *[F.coalesce(*[empty(t, f) for t in "abc"]).alias(f) for f in fields], F.coalesce(empty("b", "author"), *[empty(t, "author") for t in "ac"]).alias("strong"))
    strip = lambda x: F.trim(x, F.lit(" .,:;-"))
    title = strip(F.substring_index("title", "/", 1))
    out = out.withColumn("title", title).withColumn("who", T.normal(F.col("strong")))
    ws = F.split("title", r"\s+")
    n = F.size(F.split("who", " "))
    rest = strip(F.array_join(F.slice(ws, n + 1, F.size(ws)), " "))
    cut = F.when((F.col("who") != "") & F.startswith(F.concat(T.normal(F.col("title")), F.lit(" ")), F.concat("who", F.lit(" "))), rest).otherwise(F.col("title"))
    out = out.withColumn("title", cut)
    return out.select("rec_id", *[F.when(plausible_title(F.col("title")), F.col("title")).alias("title") if f == "title" else F.col(f) for f in fields])


def reconcile_listings(primary: DataFrame, secondary: DataFrame, local: DataFrame) -> DataFrame:
    """rec_id, year, pages, alerts: the newest approved primary package wins, the secondary fills blanks.

    Packages: rec_id, approved, at, year, pages; local: rec_id, year, pages. Alerts: ano_divergente,
    paginas_divergentes (off by more than 5 and 20 %).
    """
    def newest(d: DataFrame, p: str) -> DataFrame:
        m = d.where("approved").groupBy("rec_id").agg(F.max(F.struct("seen_at", "year", "pages")).alias("m"))
        return m.select("rec_id", F.col("m.year").alias(f"{p}year"), F.col("m.pages").alias(f"{p}pages"))

    j = local.join(newest(primary, "p_"), "rec_id", "left").join(newest(secondary, "s_"), "rec_id", "left")
    year, pages = F.coalesce("p_year", "s_year"), F.coalesce("p_pages", "s_pages")
    alerts = F.array_join(F.array_compact(F.array(F.when(year != F.col("year"), "ano_divergente"), F.when(F.abs(pages - F.col("pages")) > F.greatest(F.lit(5.0), 0.2 * F.col("pages")), "paginas_divergentes"))), "; ")
    return j.select("rec_id", F.coalesce(year, "year").alias("year"), F.coalesce(pages, "pages").alias("pages"), alerts.alias("alerts"))


def consolidate_sources(prepared: DataFrame, sent: DataFrame, revised: DataFrame) -> DataFrame:
    """One row per hash: prepared fields, remote id of sent ones (title only if not prepared), approved revisions on top.

    prepared: hash, title, city; sent: hash, title, remote_id; revised: hash, approved, title, city.
    """
    s = sent.select("hash", F.col("title").alias("s_title"), "remote_id")
    r = revised.where("approved").select("hash", F.nullif("title", F.lit("")).alias("r_title"), F.nullif("city", F.lit("")).alias("r_city"), F.lit(True).alias("has_r"))
    j = prepared.withColumn("has_p", F.lit(True)).join(s, "hash", "full").join(r, "hash", "full")
    tags = F.array_join(F.array_compact(F.array(F.when(F.col("has_p"), "preparado"), F.when(F.col("remote_id").isNotNull(), "enviado"), F.when(F.col("has_r"), "revisado"))), ", ")
    return j.select("hash", F.coalesce("r_title", "title", "s_title").alias("title"), F.coalesce("r_city", "city").alias("city"), "remote_id", tags.alias("sources"))


def apply_revisions(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """rec_id, title, conflicts, pending, how: the revision of the same file and hash, else of the same hash; a file whose stored hash differs gets none.

    records: rec_id, file, hash, title, conflicts, pending; revisions: file, hash, title, approved, conflicts, pending.
    An approved revision clears conflicts and pending notes; another replaces those that it has itself.
    """
    fields = ("title", "approved", "conflicts", "pending")
    by_name = revisions.groupBy("file").agg(F.min(F.struct("hash", *fields)).alias("n"))
    by_hash = revisions.groupBy("hash").agg(F.min(F.struct("file", *fields)).alias("h"))
    j = records.join(by_name, "file", "left").join(by_hash, "hash", "left")
    same = F.col("n.hash") == F.col("hash")
    how = F.when(same, "file and hash").when(F.col("n").isNotNull(), "hash differs").when(F.col("h").isNotNull(), "hash").otherwise("none")
    value = lambda f: F.when(same, F.col(f"n.{f}")).when(F.col("n").isNull(), F.col(f"h.{f}"))
    approved = F.coalesce(value("approved"), F.lit(False))
    notes = lambda f: F.when(approved, "").otherwise(F.coalesce(value(f), F.col(f))).alias(f)
    return j.select("rec_id", F.coalesce(F.nullif(value("title"), F.lit("")), "title").alias("title"), notes("conflicts"), notes("pending"), how.alias("how"))


def merge_dictionary(local: DataFrame, remote: DataFrame, key: str = "key") -> DataFrame:
    """Local rows and the remote rows of keys not there yet, with a flag for those."""
    add = remote.join(local.select(key), key, "left_anti").withColumn("added", F.lit(True))
    return local.withColumn("added", F.lit(False)).unionByName(add)


def rejection_log(candidates: DataFrame, unresolved: DataFrame, most: int = 30) -> DataFrame:
    """rec_id, source, cand_id, reason, n: why consulted candidates were not used; the report shows at most 30 per record.

    candidates: rec_id, cand_id, source, approved, motives (of the rejection, may be empty), confidence, has_metadata, isbn_differs, score
    (0: not scored); unresolved: rec_id, source, n_found of sources whose candidates gave no safe choice. All
    reasons of a candidate are named; candidates come by source order and score, unresolved sources last.
    """
    motive = F.coalesce(F.nullif("motives", F.lit("")), F.lit("not approved"))
    said = F.array_compact(F.array(
        F.when(~F.col("approved"), motive), F.when(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("alta")) != "alta", F.concat(F.lit("confidence "), "confidence")), F.when(F.col("isbn_differs"), "different isbn"),
        F.when((F.col("score") > 0) & (F.col("score") < 0.72), "low score"), F.when(~F.col("has_metadata"), "no metadata"),
    ))
    c = candidates.select("rec_id", "source", "cand_id", F.array_join(said, "; ").alias("reason"), F.lit(0).alias("late"), (-F.col("score")).alias("order")).where("reason <> ''")
    u = unresolved.where("n_found > 0").select("rec_id", "source", F.lit(None).cast("long").alias("cand_id"), F.concat(F.col("n_found").cast("string"), F.lit(" candidates without a safe choice")).alias("reason"), F.lit(1).alias("late"), F.lit(0.0).alias("order"))
    w = Window.partitionBy("rec_id").orderBy("late", "source", "order", "cand_id")
    return c.unionByName(u).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("rec_id", "source", "cand_id", "reason", "n")


#: Weights of fields that a source fills.
COMPLETENESS = {"title": 5, "authors": 4, "publisher": 3, "year": 2, "pages": 2, "subjects": 1, "place": 1}


def rank_isbn_sources(candidates: DataFrame, bonus: dict[str, int]) -> DataFrame:
    """isbn, source, weight: the most complete source of an ISBN, with a bonus by source (ties: first by name)."""
    filled = [F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), w).otherwise(0) for f, w in COMPLETENESS.items() if f in candidates.columns]
    extra = F.coalesce(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv])[F.col("source")], F.lit(0))
    c = candidates.withColumn("weight", sum(filled, F.lit(0)) + extra)
    return c.groupBy("isbn").agg(F.min(F.struct((-F.col("weight")).alias("w"), "source")).alias("m")).select("isbn", "m.source", (-F.col("m.w")).alias("weight"))


#: Words that tell nothing of a title, and origins that a longer file name may complete. Fixed values.
WEAK_WORDS = "a as o os um uma uns umas de da das do dos e em no na nos nas por para com sem ao aos the of and for in to by with el la los las un una del y".split()
COMPLETED = ("cover", "first page", "pdf metadata", "cover over ocr")
PROSE = ("paragraph", "continued", "cut off", "sentence", "rights notice")


def strong_words(x: Column) -> Column:
    """Words of more than two letters that are no filler and no number."""
    return F.filter(T.words(F.coalesce(x, F.lit(""))), lambda w: (F.length(w) > 2) & ~w.isin(*WEAK_WORDS) & ~w.rlike("^[0-9]+$"))


def title_alike(a: Column, b: Column) -> Column:
    """The larger of the share of common words (three letters or more) and 1 - edit distance / longer length, of normal forms."""
    na, nb = T.normal(F.coalesce(a, F.lit(""))), T.normal(F.coalesce(b, F.lit("")))
    long = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: F.length(w) > 2))
    edits = 1 - F.levenshtein(na, nb) / F.greatest(F.length(na), F.length(nb))
    return F.when((na == "") | (nb == ""), 0.0).otherwise(F.greatest(T.jaccard(long(na), long(nb)), edits))


def fuse_title(records: DataFrame) -> DataFrame:
    """rec_id, title, origin, subtitle, original_title, from_other_language: which of a record's titles it gets, and where it came from.

    records: rec_id, title, title_origin (local), api_title, api_subtitle, api_author, exact_isbn, by_title_author,
    national (agency by exact ISBN), trade_high, trade_isbn (a trade listing of high confidence, with confirmed ISBN),
    cover_visual, cover_title, pdf_title, copyright_title, first_page_title, file_title.
    The external title wins with an exact ISBN, or if it is alike (0.68) or the local one is defective and
    its source is sure; else it is kept as the original title. Then come cover, PDF metadata, copyright line and
    first page where the local title is missing or implausible; a longer file name with 75 % of the
    strong words completes a weak origin; prose gives way to the file name.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    names = ("title", "title_origin", "api_title", "api_subtitle", "api_author", "cover_visual", "cover_title", "pdf_title", "copyright_title", "first_page_title", "file_title")
    r = records.select("rec_id", *[blank(c).alias(c) for c in names], *[flag(c).alias(c) for c in ("exact_isbn", "by_title_author", "national", "trade_high", "trade_isbn")])
    ok = {c: plausible_title(F.col(c)) for c in ("title", "api_title", "cover_visual", "cover_title", "file_title")}
    r = r.withColumns({f"ok_{c}": v for c, v in ok.items()})
    rules = dict(title_alerts(F.col("title"), F.col("api_author")))
    r = r.withColumns({"alike": title_alike(F.col("title"), F.col("api_title")) >= 0.68, "repeats": F.coalesce(rules["author in title"], F.lit(False)), "faulty": (F.col("title_origin") == "file name") | ~F.col("ok_title")})
    asked = (F.col("api_title") != "") & ((F.col("title") != "") | F.col("exact_isbn"))
    external = (
        F.when(F.col("exact_isbn") & F.col("ok_api_title"), "exact isbn").when(F.col("by_title_author") & (F.col("alike") | F.col("faulty")) & F.col("ok_api_title"), "title and author")
        .when(F.col("national") & ~F.col("ok_title") & F.col("ok_api_title"), "national agency").when(F.col("trade_high") & F.col("faulty") & F.col("ok_api_title"), "trade listing").when(F.col("alike") | (F.col("trade_isbn") & F.col("repeats")), "api")
    )
    r = r.withColumn("take", F.when(asked, external))
    took = F.col("take").isNotNull()
    r = r.select("*", F.when(took, F.col("api_title")).otherwise(F.col("title")).alias("t1"), F.coalesce("take", "title_origin").alias("o1"), F.when(took, F.col("api_subtitle")).otherwise("").alias("subtitle"), F.when(asked & ~took, F.col("api_title")).otherwise("").alias("original"))
    good1 = F.when(took, F.col("ok_api_title")).otherwise(F.col("ok_title"))
    step2 = (
        F.when((F.col("cover_visual") != "") & F.col("ok_cover_visual") & ~good1, F.struct(F.col("cover_visual").alias("t"), F.lit("visual title").alias("o")))
        .when((F.col("t1") != "") & F.col("ok_cover_title") & ~good1, F.struct(F.col("cover_title").alias("t"), F.lit("cover over ocr").alias("o")))
        .when((F.col("t1") == "") & (F.col("pdf_title") != ""), F.struct(F.col("pdf_title").alias("t"), F.lit("pdf metadata").alias("o")))
        .when((F.col("t1") == "") & (F.col("cover_title") != ""), F.struct(F.col("cover_title").alias("t"), F.lit("cover").alias("o")))
        .otherwise(F.struct(F.col("t1").alias("t"), F.col("o1").alias("o")))
    )
    r = r.withColumn("s2", step2)
    short = F.size(F.split(F.col("s2.t"), r"\s+")) < 2
    pick = lambda c, o: F.struct(F.col(c).alias("t"), F.lit(o).alias("o"))
    step3 = F.when(((F.col("s2.t") == "") | short) & (F.col("copyright_title") != ""), pick("copyright_title", "copyright line")).when((F.col("s2.t") == "") & (F.col("first_page_title") != ""), pick("first_page_title", "first page")).when((F.col("s2.t") == "") & (F.col("api_title") != ""), pick("api_title", "api, other language?")).otherwise(F.col("s2"))
    r = r.withColumn("s3", step3)
    foreign = (F.col("s3.o") == "api, other language?") & ~F.col("exact_isbn")
    have, wide = strong_words(F.col("s3.t")), strong_words(F.col("file_title"))
    held = F.size(F.filter(have, lambda w: F.array_contains(wide, w)))
    longer = (F.size(have) >= 2) & (F.size(wide) > F.size(have)) & (held >= 2) & (held / F.greatest(F.lit(1), F.size(have)) >= 0.75)
    complete = F.col("s3.o").isin(*COMPLETED) & F.col("ok_file_title") & longer
    prose = dict(title_alerts(F.col("s3.t"), F.lit("")))
    is_prose = F.lit(False)
    for name in PROSE:
        is_prose = is_prose | F.coalesce(prose[name], F.lit(False))
    final = F.when(complete, F.struct(F.col("file_title").alias("t"), F.concat(F.col("s3.o"), F.lit(", completed by file name")).alias("o"))).when(is_prose & F.col("ok_file_title"), pick("file_title", "file name over prose")).otherwise(F.col("s3"))
    r = r.withColumn("s4", final).withColumn("foreign", foreign)
    return r.select("rec_id", F.col("s4.t").alias("title"), F.when(F.col("s4.t") == "", "").otherwise(F.col("s4.o")).alias("origin"), "subtitle", F.when(F.col("s3.o") == "api, other language?", "").otherwise(F.col("original")).alias("original_title"), F.col("foreign").alias("from_other_language"))
