"""Joins and record linkage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions import text as T
from recordspark.functions.tables import new_path, written
from recordspark.operators.graph import components
from recordspark.operators.hamming import near_points
from recordspark.operators.joins import heavy_join
from recordspark.operators.keywords import first_rule
from recordspark.operators.titles import POSSIBLE, alike_rows

try:
    from _md5 import md5  # Python's own: half the time of OpenSSL's on a few words
except ImportError:
    from hashlib import md5

#: Near duplicates: word ratio, Hamming distance, shortest text with a signature.
WORD_RATIO, MAX_HAMMING, LEAST_WORDS = 0.82, 10, 120
NGRAM = 5


def exact_duplicates(items: DataFrame, content: str = "text", order: str = "doc_id") -> DataFrame:
    """doc_id, hash, state (registrado or duplicado) and the first registered id of the same content.

    The first of each hash comes from an aggregation with partial minima and goes back by a heavy join: a
    content with very many copies is never gathered in one task.
    """
    h = items.select(F.col(order), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("hash"))
    first = h.groupBy("hash").agg(F.min(order).alias("duplicate_of"))
    j = heavy_join(h, first, ["hash"])
    own = F.col("duplicate_of") == F.col(order)
    return j.select(order, "hash", F.when(own, "registrado").otherwise("duplicado").alias("state"), F.when(~own, F.col("duplicate_of")).alias("duplicate_of"))


def text_signature(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, text_hash, simhash (16 hex digits, null under 120 words) of the whole word stream.

    Each 5-word shingle is hashed (first 64 bits of MD5); a bit is set if it is so in at least half of
    them. One pass over Arrow batches, without a shuffle; texts are taken from a batch one at a time, and shingles are hashed a block at a time.
    """
    words = T.words(F.coalesce("text", F.lit("")))
    w = docs.select("doc_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("body"))
    w = w.select("doc_id", "n_words", F.sha2("body", 256).alias("text_hash"), F.when(F.col("n_words") >= LEAST_WORDS, F.col("body")).alias("body"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("body")
            signs = [_simhash(body[k].as_buffer()) if body[k].is_valid else None for k in range(len(body))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(signs, pa.string())], names=["doc_id", "n_words", "text_hash", "simhash"])

    kind = w.schema["doc_id"].dataType.simpleString()
    return w.mapInArrow(sign, f"doc_id {kind}, n_words int, text_hash string, simhash string")


def _simhash(body: bytes | pa.Buffer, block: int = 10_000) -> str:
    """body: the words with single blanks between them, in UTF-8."""
    text = memoryview(body)
    ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == ord(" ")), len(text))
    starts = np.append(0, ends[:-1] + 1)
    ones, n = np.zeros(64, np.int64), len(ends) - NGRAM + 1
    for k in range(0, n, block):
        stop = min(k + block, n)
        raw = b"".join([md5(text[i:j]).digest() for i, j in zip(starts[k:stop].tolist(), ends[k + NGRAM - 1 : stop + NGRAM - 1].tolist())])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16)[:, :8], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones >= n)).tobytes().hex()


def _text_points(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different texts (id: their smallest, point, n, sim), and the points they share: a SimHash and a number of words, named by the smallest id."""
    s = signatures.where("simhash is not null").groupBy("text_hash").agg(F.min("doc_id").alias("id"), F.first("n_words").alias("n"), F.first("simhash").alias("sim"))
    half = lambda a: F.conv(F.substring("sim", a, 8), 16, 10).cast("long")
    s = s.select("text_hash", "id", "n", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("sim"))
    s = written(s, new_path(s.sparkSession, "signatures"))  # read several times, and signing is the costly part
    points = s.groupBy("sim", "n").agg(F.min("id").alias("point"), F.count("*").alias("c"))
    return s, points


def near_duplicate_candidates(signatures: DataFrame) -> DataFrame:
    """Pairs (a < b) of different texts with a word ratio of at least 0.82 and a SimHash distance of at most 10.

    Equal texts are one representative (the smallest id), and texts with the same SimHash and length one point of the
    Hamming index, which finds every pair of points (see hamming.near_points); nothing is capped and no
    cross join is made. The pairs of c texts that are all alike are c squared: near_duplicate_groups() doesn't list them.
    """
    texts, points = _text_points(signatures)
    pairs = near_points(points.select(F.col("point").alias("id"), "n", "sim"), MAX_HAMMING, WORD_RATIO)
    shared = points.where("c > 1").select("sim", "n", "point")
    several = texts.join(shared, ["sim", "n"]).select("point", "id")
    member = lambda of, name: several.select(F.col("point").alias(of), F.col("id").alias(name))
    across = pairs.join(member("x", "p"), "x", "left").join(member("y", "q"), "y", "left").select(F.coalesce("p", "x").alias("p"), F.coalesce("q", "y").alias("q"), "distance")
    inside = member("x", "p").join(member("x", "q"), "x").where("p < q").select("p", "q", F.lit(0).alias("distance"))
    return across.unionAll(inside).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def near_duplicate_groups(signatures: DataFrame) -> DataFrame:
    """doc_id, group, n_links: the smallest id reachable by links of near_duplicate_candidates, and the number of different texts linked with.

    Equal texts are in one group and count as one text. Links are counted between points and kept as stars, so a
    group of c texts costs c rows. Texts without a SimHash are left out.
    """
    spark = signatures.sparkSession
    signed = written(signatures.where("simhash is not null"), new_path(spark, "signed"))  # read three times
    texts, points = _text_points(signed)
    pairs = near_points(points.select(F.col("point").alias("id"), "n", "sim"), MAX_HAMMING, WORD_RATIO)
    pairs = written(pairs, new_path(spark, "near-points"))
    c = points.select(F.col("point").alias("y"), "c")
    ends = pairs.select("x", "y").unionAll(pairs.selectExpr("y x", "x y"))
    linked = heavy_join(ends, c, ["y"]).groupBy("x").agg(F.sum("c").alias("linked"))
    groups = components(pairs, "x", "y").select(F.col("node").alias("x"), F.col("group"))
    known = points.select("sim", "n", F.col("point").alias("x"), "c").join(linked, "x", "left").join(groups, "x", "left")
    known = known.select("sim", "n", F.coalesce("group", "x").alias("group"), (F.col("c") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    by_text = heavy_join(texts, known, ["sim", "n"]).select("text_hash", "group", "n_links")
    return heavy_join(signed.select("doc_id", "text_hash"), by_text, ["text_hash"]).select("doc_id", "group", "n_links")


def link_by_identifier(pending: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Pending rows (rec_id, isbn) with the first confirmed row (source_order, remote_id) of the same canonical ISBN, never themselves.

    Of each ISBN only the first two confirmed rows meet pending ones, as a row can be its own match once.
    """
    p = pending.select("rec_id", T.canonical_isbn(F.col("isbn")).alias("isbn13")).where("isbn13 is not null")
    c = confirmed.select(F.col("rec_id").alias("c_rec"), T.canonical_isbn(F.col("isbn")).alias("isbn13"), "remote_id", "source_order").where("isbn13 is not null")
    row = F.struct("source_order", "c_rec", "remote_id")
    first = c.groupBy("isbn13").agg(F.min(row).alias("one"))
    second = heavy_join(c, first, ["isbn13"]).where("c_rec <> one.c_rec").groupBy("isbn13").agg(F.min(row).alias("two"))
    j = heavy_join(p, first.join(second, "isbn13", "left"), ["isbn13"])
    j = j.withColumn("m", F.when(F.col("one.c_rec") != F.col("rec_id"), F.col("one")).otherwise(F.col("two"))).where("m is not null")
    return j.select("rec_id", "isbn13", F.col("m.c_rec").alias("linked_rec"), F.col("m.remote_id").alias("remote_id"))


def _first_two(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(f"{prefix}n"), F.min("o_id").alias(f"{prefix}lo"), F.max("o_id").alias(f"{prefix}hi"))


def link_by_title_author(a: DataFrame, b: DataFrame) -> DataFrame:
    """rec_id, other_id, class of rows whose normal title has exactly one match in b (never itself, ISBN not different).

    Rows: rec_id, title, author, isbn. class: isbn (the same), titulo_autor (an author with the same
    words) or aproximado. Matches are counted by title, and by title and ISBN, before anything is
    joined: a title with k copies costs k rows, not k squared, and a frequent title goes to no single task. Ids are unique within a and b.
    """
    norm = lambda d, p: d.select(F.col("rec_id").alias(f"{p}id"), T.normal(F.col("title")).alias("t"), T.author_keys(F.col("author")).alias(f"{p}authors"), T.canonical_isbn(F.col("isbn")).alias(f"{p}isbn")).where("t <> ''")
    keep = lambda d: written(d, new_path(a.sparkSession, "titles"))
    x, o = keep(norm(a, "")), keep(norm(b, "o_"))
    every = _first_two(o, ["t"], "e_")
    open_ = _first_two(o.where("o_isbn is null"), ["t"], "n_")
    same = _first_two(o.where("o_isbn is not null").withColumnRenamed("o_isbn", "isbn"), ["t", "isbn"], "s_")
    j = heavy_join(keep(heavy_join(x, every.join(open_, "t", "left"), ["t"])), same, ["t", "isbn"], "left")
    pick = lambda f, c: F.when(F.col("isbn").isNull(), F.col(f"e_{c}")).otherwise(f(F.col(f"n_{c}"), F.col(f"s_{c}")))
    plus = lambda u, v: F.coalesce(u, F.lit(0)) + F.coalesce(v, F.lit(0))
    j = j.select("id", "authors", "isbn", pick(plus, "n").alias("n"), pick(F.least, "lo").alias("lo"), pick(F.greatest, "hi").alias("hi"))
    own = (F.col("lo") == F.col("id")) | (F.col("hi") == F.col("id"))
    other = F.when(F.col("n") == 1, F.when(~own, F.col("lo"))).when((F.col("n") == 2) & own, F.when(F.col("lo") == F.col("id"), F.col("hi")).otherwise(F.col("lo")))
    one = heavy_join(keep(j.withColumn("o_id", other).where("o_id is not null")), o.select("o_id", "o_authors", "o_isbn"), ["o_id"])
    kind = F.when(F.col("isbn") == F.col("o_isbn"), "isbn").when(F.arrays_overlap("authors", "o_authors"), "titulo_autor").otherwise("aproximado")
    return one.select(F.col("id").alias("rec_id"), F.col("o_id").alias("other_id"), kind.alias("class"))


#: A pair needs this title similarity, and this score, to be approved.
SIMILAR = 0.68


def _editions(rows: DataFrame, key: str, p: str) -> DataFrame:
    """key, the set of main title words and its name, surname, author, isbn, year, pages, edition, volume, all but the key with the prefix p."""
    surname = F.when(F.contains("author", F.lit(",")), F.substring_index("author", ",", 1)).otherwise(F.element_at(F.split(F.trim("author"), r"\s+"), -1))
    fields = [F.col(c).alias(f"{p}{c}") for c in ("year", "pages", "edition", "volume")]
    d = rows.select(F.col(key), F.array_sort(F.array_distinct(T.words(T.main_title(F.col("title"))))).alias(f"{p}w"), T.normal(surname).alias(f"{p}surname"), T.normal(F.col("author")).alias(f"{p}author"), T.canonical_isbn(F.col("isbn")).alias(f"{p}isbn"), *fields)
    return d.withColumn(f"{p}set", F.xxhash64(F.concat_ws(" ", f"{p}w")))


def _title_pairs(t: DataFrame, c: DataFrame) -> DataFrame:
    """t_set, c_set, title_sim of the different titles of both sides that reach 0.60. However often a title occurs, it is one row here."""
    sets = lambda d, p: written(d.select(F.concat_ws(" ", f"{p}w").alias("words"), f"{p}set").dropDuplicates([f"{p}set"]), new_path(d.sparkSession, "titles"))
    return alike_rows(sets(t, "t_"), sets(c, "c_"), "t_set", "c_set").select("t_set", "c_set", "title_sim")


def _both_editions(targets: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' editions as tables, since they are read several times; has_isbn of both."""
    keep = lambda d, p: written(d.withColumn(f"{p}has_isbn", F.col(f"{p}isbn").isNotNull()), new_path(d.sparkSession, "editions"))
    return keep(_editions(targets, "target_id", "t_"), "t_"), keep(_editions(candidates, "cand_id", "c_"), "c_")


def _agree(x: str) -> Column:
    return F.coalesce(F.col(f"t_{x}") == F.col(f"c_{x}"), F.lit(False))


def _differ(x: str) -> Column:
    return F.coalesce(F.col(f"t_{x}") != F.col(f"c_{x}"), F.lit(False))


def _flag(x: Column, value: float) -> Column:
    return F.when(x, value).otherwise(0.0)


def _author_ok() -> Column:
    return F.coalesce((F.col("t_surname") != "") & F.contains("c_author", F.col("t_surname")), F.lit(False))


def _close() -> Column:
    return F.coalesce(F.abs(F.col("t_pages") - F.col("c_pages")) / F.greatest("t_pages", "c_pages") <= 0.12, F.lit(False))


def _points(year: Column, close: Column) -> Column:
    return 0.52 * F.col("title_sim") + _flag(F.col("author_ok"), 0.38) + _flag(F.col("title_sim") >= 0.90, 0.04) + _flag(year, 0.08) + _flag(close, 0.06) + 0.03 * (_agree("edition").cast("int") + _agree("volume").cast("int"))


def _score(points: Column) -> Column:
    return F.round(F.least(F.lit(1.15), points), 3)


def _scored(j: DataFrame) -> DataFrame:
    """Pairs with t_ and c_ columns and title_sim, and: isbn_exact, author_ok, close, no_author, other_isbn, other_edition, other_volume, score, blocked, approved."""
    j = j.withColumns({"isbn_exact": _agree("isbn"), "author_ok": _author_ok(), "close": _close(), "no_author": F.coalesce("t_surname", F.lit("")) == "", **{f"other_{x}": _differ(x) for x in ("isbn", "edition", "volume")}})
    points = _points(_agree("year"), F.col("close"))
    points = F.when(F.col("isbn_exact"), F.greatest(F.lit(1.0), points)).otherwise(points)
    j = j.withColumn("score", _score(points)).withColumn("blocked", F.col("other_isbn") | F.col("other_edition") | F.col("other_volume"))
    ok = ~F.col("blocked") & (F.col("isbn_exact") | ((F.col("title_sim") >= SIMILAR) & (F.col("author_ok") | F.col("no_author")) & (F.col("score") >= SIMILAR)))
    return j.withColumn("approved", ok)


def _said(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, parted by `; `: looked up by the rules' bits, as there are far more pairs than combinations."""
    texts = ["; ".join(m for k, (_, m) in enumerate(rules) if at >> k & 1) for at in range(1 << len(rules))]
    bits = sum((r.cast("int") * (1 << k) for k, (r, _) in enumerate(rules)), F.lit(0))
    return F.get(F.array(*[F.lit(x) for x in texts]), bits)


def _by_isbn(t: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs with the same ISBN and their similarity."""
    j = t.join(c, F.col("t_isbn") == F.col("c_isbn"))
    return j.withColumn("title_sim", F.coalesce(T.title_similarity(F.col("t_w"), F.col("c_w")), F.lit(0.0)))


def score_matches(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored pairs that share an ISBN or have a title similarity of at least 0.60.

    Rows: id (target_id, cand_id), title, author, isbn, year, pages, edition, volume. Returns target_id,
    cand_id, title_sim, author_ok, isbn_exact, score, blocked, approved, confirmations, rejections (lists of reasons).
    The rows of a title are compared as one, and pairs of rows are made where titles meet (see alike_rows): no pair is shuffled.
    """
    t, c = _both_editions(targets, candidates)
    row = lambda d, k, p, *more: d.select(F.concat_ws(" ", f"{p}w").alias("words"), k, *more, *[f"{p}{x}" for x in ("isbn", "year", "pages", "edition", "volume")])
    by_title = alike_rows(row(t, "target_id", "t_", "t_surname"), row(c, "cand_id", "c_", "c_author"), "target_id", "cand_id").withColumn("untitled", F.lit(False))
    by_isbn = _by_isbn(t, c).where(F.col("title_sim") < POSSIBLE).withColumns({"equal": F.col("t_set") == F.col("c_set"), "untitled": F.coalesce(F.size("c_w"), F.lit(0)) < 1})
    j = _scored(by_title.unionByName(by_isbn.select(by_title.columns)))
    similar, wanting = F.col("title_sim") >= SIMILAR, ~F.col("author_ok") & ~F.col("no_author")
    has_author, untitled = F.coalesce("c_author", F.lit("")) != "", F.col("untitled")
    confirmations = _said((F.col("isbn_exact"), "isbn"), (F.col("equal"), "title"), (~F.col("equal") & similar, "title cut or other subtitle"), (F.col("author_ok"), "author"), (_agree("edition"), "edition"), (_agree("volume"), "volume"), (_agree("year"), "year"), (F.col("close"), "pages"))
    weak = ~F.col("approved") & ~F.col("blocked")
    rejections = _said((~similar & ~untitled, "other title"), (~similar & untitled, "no title"), (wanting & has_author, "author not found"), (wanting & ~has_author, "no author"), (weak, "not enough"), (F.col("other_isbn"), "other isbn"), (F.col("other_edition"), "other edition"), (F.col("other_volume"), "other volume"))
    return j.select("target_id", "cand_id", "title_sim", "author_ok", "isbn_exact", "score", "blocked", "approved", confirmations.alias("confirmations"), rejections.alias("rejections"))


def score_classes(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """What score_matches() says, between classes: part, of, target_id, cand_id, title_sim, author_ok, score, score_year, score_pages, score_both, blocked, able, confirmations, rejections, year, pages.

    Rows as in score_matches(). A class holds the rows of a side that a score tells apart by year and pages only: the same title words, surname
    (candidates: author), edition, volume, and an ISBN or none; its smallest id stands for it. part `pair`: two classes with a title similarity of at
    least 0.60; score: where neither year nor pages agree, score_year, score_pages, score_both: where one or both do. A pair of rows is approved if it is able and its score reaches 0.68;
    two ISBNs are taken as different. part `isbn`: two rows with the same ISBN, which goes before the pair of their classes; score is theirs, able says approved.
    parts `target` and `candidate`: each row with its class (of), year and pages. Copies cost a row each, and no pairs.
    """
    t, c = _both_editions(targets, candidates)
    t_same, c_same = ("t_set", "t_surname", "t_edition", "t_volume", "t_has_isbn"), ("c_set", "c_author", "c_edition", "c_volume", "c_has_isbn")
    keep = lambda d: written(d, new_path(targets.sparkSession, "title-classes"))
    tk, ck = keep(t.groupBy(*t_same).agg(F.min("target_id").alias("target_id"))), keep(c.groupBy(*c_same).agg(F.min("cand_id").alias("cand_id")))
    j = _title_pairs(t, c).join(tk, "t_set").join(ck, "c_set")
    j = j.withColumns({"author_ok": _author_ok(), "no_author": F.coalesce("t_surname", F.lit("")) == "", "blocked": (F.col("t_has_isbn") & F.col("c_has_isbn")) | _differ("edition") | _differ("volume")})
    j = j.withColumns({"able": ~F.col("blocked") & (F.col("title_sim") >= SIMILAR) & (F.col("author_ok") | F.col("no_author")), "isbn_exact": F.lit(False), "untitled": F.lit(False), "other_isbn": F.col("t_has_isbn") & F.col("c_has_isbn")})
    scores = {n: _score(_points(F.lit(y), F.lit(p))) for n, y, p in (("score", False, False), ("score_year", True, False), ("score_pages", False, True), ("score_both", True, True))}
    j = j.withColumns({**scores, "part": F.lit("pair"), "same_year": F.lit(False), "close": F.lit(False)})
    i = _scored(_by_isbn(t, c)).withColumns({"able": F.col("approved"), "untitled": F.coalesce(F.size("c_w") == 0, F.lit(False)), "other_isbn": F.lit(False), "same_year": _agree("year"), "part": F.lit("isbn")})
    i = i.withColumns({n: F.lit(None).cast("double") for n in ("score_year", "score_pages", "score_both")})
    said = lambda *rules: F.array_join(F.array_compact(F.array(*[F.when(r, m) for r, m in rules])), "; ")
    equal, other_title, wanting = F.col("t_set") == F.col("c_set"), F.col("title_sim") < SIMILAR, ~F.col("author_ok") & ~F.col("no_author")
    has_author = F.coalesce("c_author", F.lit("")) != ""
    confirmations = said((F.col("isbn_exact"), "isbn"), (equal, "title"), (~equal & ~other_title, "title cut or other subtitle"), (F.col("author_ok"), "author"), (_agree("edition"), "edition"), (_agree("volume"), "volume"), (F.col("same_year"), "year"), (F.col("close"), "pages"))
    rejections = said((other_title & ~F.col("untitled"), "other title"), (other_title & F.col("untitled"), "no title"), (wanting & has_author, "author not found"), (wanting & ~has_author, "no author"), (F.col("other_isbn"), "other isbn"), (_differ("edition"), "other edition"), (_differ("volume"), "other volume"))
    none = lambda d, n: F.lit(None).cast(d.schema[n].dataType).alias(n)
    told = lambda d: d.select("part", none(t, "target_id").alias("of"), "target_id", "cand_id", "title_sim", "author_ok", *scores, "blocked", "able", confirmations.alias("confirmations"), rejections.alias("rejections"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("pages"))
    rows = told(j).unionByName(told(i))

    def members(d: DataFrame, classes: DataFrame, k: str, p: str, same: tuple, name: str) -> DataFrame:
        key = F.md5(F.to_json(F.struct(*same)))
        m = d.select(F.lit(name).alias("part"), k, key.alias("key"), F.col(f"{p}year").cast("int").alias("year"), F.col(f"{p}pages").cast("int").alias("pages"))
        return heavy_join(m, classes.select(key.alias("key"), F.col(k).alias("of")), ["key"]).drop("key")

    rows = rows.unionByName(members(t, tk, "target_id", "t_", t_same, "target"), allowMissingColumns=True)
    return rows.unionByName(members(c, ck, "cand_id", "c_", c_same, "candidate"), allowMissingColumns=True)


def top_matches(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """target_id, cand_id, score, isbn_exact, top: the highest approved candidate of each target (ties: smallest id) and its highest score of all.

    What best_match() needs of score_matches(), without its pairs: rows that no score tells apart are one kind, kinds are scored
    where their titles meet, and only the best candidate of each kind of target and score goes on. Pairs with the same ISBN are scored by themselves.
    """
    t, c = _both_editions(targets, candidates)
    same = lambda p, who: (f"{p}set", f"{p}{who}", *[f"{p}{x}" for x in ("edition", "volume", "has_isbn", "year", "pages")])
    of_kind = F.md5(F.to_json(F.struct(*same("t_", "surname"))))
    kinds = lambda d, p, who, **ids: written(d.groupBy(*same(p, who)).agg(F.first(F.concat_ws(" ", f"{p}w")).alias("words"), *[F.min(x).alias(n) for n, x in ids.items()]), new_path(d.sparkSession, "kinds"))
    tk, ck = kinds(t, "t_", "surname", kind="target_id"), kinds(c, "c_", "author", cand_id="cand_id")
    j = alike_rows(tk.drop("t_set"), ck.drop("c_set"), "kind", "cand_id")
    j = j.withColumns({"author_ok": _author_ok(), "no_author": F.coalesce("t_surname", F.lit("")) == "", "blocked": (F.col("t_has_isbn") & F.col("c_has_isbn")) | _differ("edition") | _differ("volume")})
    j = j.withColumn("score", _score(_points(_agree("year"), _close())))
    able = ~F.col("blocked") & (F.col("title_sim") >= SIMILAR) & (F.col("author_ok") | F.col("no_author")) & (F.col("score") >= SIMILAR)
    by_score = j.groupBy("kind", "score").agg(F.min(F.when(able, F.col("cand_id"))).alias("cand_id"))
    best = lambda on, exact: F.min(F.when(on, F.struct((-F.col("score")).alias("less"), F.col("cand_id"), F.lit(exact).alias("isbn_exact")))).alias("best")
    by_kind = by_score.groupBy("kind").agg(best(F.col("cand_id").isNotNull(), False), F.max("score").alias("top"))
    by_kind = tk.select("kind", of_kind.alias("key")).join(by_kind, "kind").drop("kind")
    found = heavy_join(t.select("target_id", of_kind.alias("key")), by_kind, ["key"]).drop("key")
    exact = _scored(_by_isbn(t, c)).groupBy("target_id").agg(best(F.col("approved"), True), F.max("score").alias("top"))
    every = found.unionByName(exact).groupBy("target_id").agg(F.min("best").alias("m"), F.max("top").alias("top")).where("m is not null")
    return every.select("target_id", F.col("m.cand_id").alias("cand_id"), (-F.col("m.less")).alias("score"), F.col("m.isbn_exact").alias("isbn_exact"), "top")


def best_match(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """target_id, cand_id, score, reliable: the highest approved candidate of each target (ties: smallest id).

    reliable: no other candidate scores higher; a target with a confirmed ISBN is matched by it; and
    without the ISBN, the candidate names the edition and the volume if the target does. Rows as in score_matches(), targets with isbn_confirmed.
    """
    best = top_matches(targets, candidates)
    j = best.join(targets.select("target_id", F.col("isbn").isNotNull().alias("has_isbn"), "isbn_confirmed", F.col("edition").alias("t_edition"), F.col("volume").alias("t_volume")), "target_id")
    j = j.join(candidates.select("cand_id", "edition", "volume"), "cand_id")
    named = lambda f: F.col(f"t_{f}").isNull() | F.col(f).isNotNull()
    reliable = (F.col("score") >= F.col("top")) & ~(F.col("has_isbn") & F.col("isbn_confirmed") & ~F.col("isbn_exact")) & (F.col("isbn_exact") | (named("edition") & named("volume")))
    return j.select("target_id", "cand_id", "score", reliable.alias("reliable"))


def listing_consensus(listings: DataFrame, fields: list[str], least: int = 2, share: float = 0.60) -> DataFrame:
    """(target_id, field, value, votes, n): the most frequent value of a field with enough votes and share (ties: smallest)."""
    long = listings.select("target_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("target_id", "x.field", "x.value").where("value is not null and trim(value) <> ''")
    votes = long.groupBy("target_id", "field", "value").agg(F.count("*").alias("votes"))
    n = votes.groupBy("target_id", "field").agg(F.sum("votes").alias("n"), F.min_by(F.struct("value", "votes"), F.struct(-F.col("votes"), "value")).alias("top"))
    return n.where((F.col("top.votes") >= least) & (F.col("top.votes") >= share * F.col("n"))).select("target_id", "field", F.col("top.value").alias("value"), F.col("top.votes").alias("votes"), "n")


def choose_listings(listings: DataFrame, facets: DataFrame) -> DataFrame:
    """target_id, listing_id, basis, n_listings, author, publisher, year, pages, confidence, score: what the listings of a target agree on.

    listings: target_id, listing_id, title_ok, isbn_exact, blocked, author_ok, has_author, author, publisher, year, pages, score;
    facets: target_id, value, quantity (publishers and how often the whole search had them). The group
    is the listings with the exact ISBN (not blocked); else those whose author is the target's; else those of the
    author that most have, if two and 60 % do (a target without author takes all of them then). Blanks of the best listing are filled
    by consensus; a facet counts if its quantity fits the group's size. alta: by ISBN, or two listings.
    """
    m = listings.where("title_ok or isbn_exact").withColumn("key", T.normal(F.coalesce("author", F.lit(""))))
    votes = m.where("key <> ''").groupBy("target_id", "key").agg(F.count("*").alias("v"))
    most = votes.groupBy("target_id").agg(F.sum("v").alias("all"), F.min_by(F.struct("key", "v"), F.struct(-F.col("v"), "key")).alias("top"))
    most = most.where("top.v >= 2 and top.v >= 0.60 * all").select("target_id", F.col("top.key").alias("agreed"))
    any_ = m.groupBy("target_id").agg(F.max(F.col("isbn_exact") & ~F.col("blocked")).alias("any_isbn"), F.max("author_ok").alias("any_author"), F.max("has_author").alias("asked"))
    j = m.join(any_, "target_id").join(most, "target_id", "left")
    agreed = F.col("agreed").isNotNull()
    keep = F.when(F.col("any_isbn"), F.col("isbn_exact") & ~F.col("blocked")).when(F.col("asked") & F.col("any_author"), F.col("author_ok")).when(F.col("asked"), agreed & (F.col("key") == F.col("agreed"))).otherwise(agreed)
    basis = F.when(F.col("any_isbn"), "isbn").when(F.col("asked") & F.col("any_author"), "author").otherwise("consensus")
    j = j.where(keep).withColumn("basis", basis)
    g = j.groupBy("target_id", "basis").agg(F.count("*").alias("n_listings"), F.first("agreed").alias("agreed"), F.min_by(F.struct("listing_id", "author", "publisher", "year", "pages", "score"), F.struct(-F.col("score"), "listing_id")).alias("m"))
    seen = listing_consensus(j.select("target_id", "year", "pages"), ["year", "pages"]).groupBy("target_id").pivot("field", ["year", "pages"]).agg(F.first("value"))
    seen = seen.select("target_id", F.col("year").alias("c_year"), F.col("pages").alias("c_pages"))
    fits = facets.join(g.select("target_id", "n_listings"), "target_id").where("quantity >= 2 and quantity >= 0.60 * n_listings and quantity <= greatest(n_listings + 1, 1.20 * n_listings)")
    house = fits.groupBy("target_id").agg(F.min_by("value", F.struct(-F.col("quantity"), "value")).alias("house"))
    out = g.join(seen, "target_id", "left").join(house, "target_id", "left")
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    sure = (F.col("basis") == "isbn") | (F.col("n_listings") >= 2)
    return out.select("target_id", "m.listing_id", "basis", "n_listings", F.coalesce("agreed", T.normal(F.col("m.author"))).alias("author"), F.coalesce(blank("m.publisher"), "house").alias("publisher"), F.coalesce(blank("m.year"), "c_year").alias("year"), F.coalesce(blank("m.pages"), "c_pages").alias("pages"), F.when(sure, "alta").otherwise("auxiliar").alias("confidence"), F.col("m.score").alias("score"))


def disambiguate_editions(pairs: DataFrame) -> DataFrame:
    """One candidate is taken; of several the best by points (year 5, title 4, pages 3) if it has 4 and leads by 2.

    Rows: rec_id, cand_id, same_year, title_jaccard, pages_off. Returns rec_id, cand_id or null, reason.
    """
    flag = lambda x, v: F.when(x, v).otherwise(0)
    p = pairs.withColumn("points", flag(F.col("same_year"), 5) + flag(F.col("title_jaccard") >= 0.55, 4) + flag(F.col("pages_off") <= 5, 3))
    w = Window.partitionBy("rec_id").orderBy(F.desc("points"), "cand_id")
    p = p.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("points").over(w)).where("rn = 1")
    clear = (F.col("points") >= 4) & (F.col("points") >= F.col("second") + 2)
    return p.select("rec_id", F.when(F.col("second").isNull() | clear, F.col("cand_id")).alias("cand_id"), F.when(F.col("second").isNull(), "only record").when(clear, "told apart").otherwise("several records").alias("reason"))


#: Weights and thresholds of matching with a margin, by kind of source.
PROFILES = {
    "books": dict(w_title=0.68, w_author=0.32, title=0.72, author=0.66, score=0.76, margin=0.08),
    "catalogue": dict(w_title=0.68, w_author=0.32, title=0.72, author=0.66, score=0.0, margin=0.08),
    "articles": dict(w_title=0.75, w_author=0.25, title=0.80, author=0.55, score=0.0, margin=0.06),
    "academic": dict(w_title=0.72, w_author=0.28, title=0.80, author=0.60, score=0.0, margin=0.06),
}


def match_with_margin(pairs: DataFrame, profile: str) -> DataFrame:
    """rec_id, cand_id, score, accepted: the best pair of a record if it meets the profile and leads the next by the margin.

    Rows: rec_id, cand_id, title_sim, author_sim, same_doi, type_ok, meta. A sole candidate needs no margin, nor
    (books) one whose rival has the same metadata. Articles with the same DOI need nothing else;
    academic works of another type do not count.
    """
    p = PROFILES[profile]
    doi = F.coalesce("same_doi", F.lit(False)) if profile == "articles" else F.lit(False)
    fits = F.coalesce("type_ok", F.lit(False)) if profile == "academic" else F.lit(True)
    score = p["w_title"] * F.col("title_sim") + p["w_author"] * F.col("author_sim")
    s = pairs.withColumn("doi", doi).withColumn("score", F.when(F.col("doi"), 1.0).otherwise(score))
    s = s.where(fits & (F.col("doi") | ((F.col("title_sim") >= p["title"]) & (F.col("author_sim") >= p["author"]) & (F.col("score") >= p["score"]))))
    w = Window.partitionBy("rec_id").orderBy(F.desc("score"), "cand_id")
    s = s.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("rival", F.lead("meta").over(w)).where("rn = 1")
    equal = F.coalesce(F.col("rival") == F.col("meta"), F.lit(False)) if profile == "books" else F.lit(False)
    accepted = F.col("next").isNull() | (F.col("score") - F.col("next") >= p["margin"]) | equal | F.col("doi")
    return s.select("rec_id", "cand_id", "score", accepted.alias("accepted"))


#: Common places of publication, and beginnings of place names. Fixed values.
CITIES = "sao paulo|rio de janeiro|curitiba|belo horizonte|brasilia|goiania|campinas|santos|recife|salvador|fortaleza|porto alegre|belem|londrina|niteroi|petropolis|vicosa|wheaton|grand rapids|nashville|chicago|new york|london|oxford|cambridge|leicester|downers grove|philadelphia|boston|miami|barcelona|madrid|viladecavalls|buenos aires|bogota|lisboa|paris|geneva|genebra".split("|")
CITY_BEGINNINGS = "sao|santo|santa|new|rio|belo|grand|downers|buenos|porto".split("|")
GENERIC_HOUSES = ("editora", "editorial", "edicoes", "publicacoes", "ltda", "brasil")


def looks_like_city(x: Column) -> Column:
    n = T.normal(x)
    return F.coalesce(n.isin(*CITIES) | (F.substring_index(n, " ", 1).isin(*CITY_BEGINNINGS) & F.contains(n, F.lit(" ")) & ~n.rlike("[0-9]")), F.lit(False))


def publisher_city_lookup(records: DataFrame, table: DataFrame) -> DataFrame:
    """rec_id, publisher, city, how: own, swapped, publisher (by its normal form), similar (two strong words, Jaccard 0.72, best) or none.

    Rows: rec_id, publisher, city; table: publisher, city. A place in the publisher's field changes
    places with a publisher in the city's, or moves there if that is empty. A city already known
    stays. Two names that alike share one of the first strong words, rarest first, so only those meet.
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    house, city = blank("publisher"), blank("city")
    turned = looks_like_city(house) & (city.isNull() | ~looks_like_city(city))
    r = records.select("rec_id", F.when(turned, city).otherwise(house).alias("publisher"), F.when(turned, house).otherwise(city).alias("own"), turned.alias("turned"))
    strong = lambda x: F.array_distinct(F.filter(x, lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_HOUSES)))
    r = r.withColumn("key", F.coalesce(T.normal(F.col("publisher")), F.lit("")))
    t = table.groupBy(T.normal(F.col("publisher")).alias("key")).agg(F.min("city").alias("found")).where("key <> ''")
    j = r.join(t, "key", "left")
    open_ = j.where("found is null and own is null").select("rec_id", strong(F.split("key", " ")).alias("w")).where(F.size("w") >= 2)
    known = t.select(F.col("key").alias("tkey"), F.col("found").alias("city2"), F.array_distinct(F.filter(F.split("key", " "), lambda w: F.length(w) > 2)).alias("tw"))
    held = known.select("tkey", "city2", "tw", F.explode("tw").alias("tok"))
    often = held.groupBy("tok").agg(F.count("*").alias("often"))
    asked = open_.select("rec_id", "w", F.explode("w").alias("tok")).join(often, "tok")
    rank = F.row_number().over(Window.partitionBy("rec_id").orderBy("often", "tok"))
    left = F.size("w") - F.ceil(0.72 * F.size("w") - 1e-9) + 1
    pairs = asked.withColumn("rank", rank).where(F.col("rank") <= left).join(held, "tok").select("rec_id", "tkey", "city2", T.jaccard(F.col("w"), F.col("tw")).alias("sim"))
    near = pairs.where("sim >= 0.72").groupBy("rec_id").agg(F.min_by("city2", F.struct(-F.col("sim"), "tkey")).alias("city2"))
    out = j.join(near, "rec_id", "left")
    how = F.when(F.col("turned"), "swapped").when(F.col("own").isNotNull(), "own").when(F.col("found").isNotNull(), "publisher").when(F.col("city2").isNotNull(), "similar").otherwise("none")
    return out.select("rec_id", "publisher", F.coalesce("own", "found", "city2").alias("city"), how.alias("how"))


def noise_match(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value_id, reason of the first dictionary row (ord) that a value equals, starts with or contains.

    dictionary: ord, text, mode (exato, prefixo, contem), reason. All its texts are looked for in one
    pass over each value (see keywords.py), however many there are.
    """
    v = values.select("value_id", T.normal(F.col("value")).alias("v"))
    return first_rule(v, "value_id", "v", dictionary.withColumn("text", T.normal(F.col("text"))))


def repair_truncated_names(names: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, name, repaired: a last word of one or two letters grows to the only most frequent longer form (twice or more) in the text."""
    n = names.select("doc_id", "name", F.element_at(F.split("name", " "), -1).alias("last")).where(F.length("last").between(1, 2))
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("form"))
    two = lambda c: F.lower(F.substring(c, 1, 1))
    j = n.withColumn("k", two("last")).join(w.groupBy("doc_id", "form").count().where("count >= 2").withColumn("k", two("form")), ["doc_id", "k"])
    j = j.where(F.lower("form").startswith(F.lower("last")))
    o = Window.partitionBy("doc_id", "name").orderBy(F.desc("count"), "form")
    j = j.withColumn("rn", F.row_number().over(o)).withColumn("nxt", F.lead("count").over(o)).where("rn = 1 and count > coalesce(nxt, 0)")
    return j.select("doc_id", "name", F.concat(F.expr("substring(name, 1, length(name) - length(last))"), "form").alias("repaired"))


def find_existing_issue(new: DataFrame, held: DataFrame) -> DataFrame:
    """new_id, held_id, how: same target, else same year and name, else same year and number (first by id)."""
    joins = []
    for rank, (how, keys) in enumerate([("target", ["target"]), ("name", ["year", "name"]), ("number", ["year", "number"])]):
        first = held.groupBy(*keys).agg(F.min("held_id").alias("held_id"))  # one row per key: no pairs of copies
        joins.append(new.join(first, keys).select("new_id", "held_id", F.lit(how).alias("how"), F.lit(rank).alias("rank")))
    every = joins[0].unionAll(joins[1]).unionAll(joins[2])
    return every.groupBy("new_id").agg(F.min(F.struct("rank", "held_id", "how")).alias("m")).select("new_id", "m.held_id", "m.how")


def cooperative_lookup(items: DataFrame, shared: DataFrame) -> DataFrame:
    """Items with what the shared store has for their hash (one row per hash there); a hash that very many items have is no single task's work."""
    j = heavy_join(items, shared, ["hash"], "left")
    return j.select("hash", *[c for c in j.columns if c != "hash"])


def period_lookup(issues: DataFrame, periods: DataFrame) -> DataFrame:
    """issue_id, year, holder: the first listed period (ord) that holds the year; null in gaps.

    Years are few: periods are spread to (year, holder) rows first, so the join is an equi-join.
    """
    by_year = periods.select("ord", "holder", F.explode(F.sequence("first_year", "last_year")).alias("year"))
    by_year = by_year.groupBy("year").agg(F.min_by("holder", "ord").alias("holder"))
    return issues.join(by_year, "year", "left").select("issue_id", "year", "holder")
