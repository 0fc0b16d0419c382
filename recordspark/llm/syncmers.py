"""Document fingerprints from closed syncmers, in DataFrame functions only.

Letters of a text are its words. Of every k words in a row, the k-mer is an anchor if the least (by hash) of
the runs of s words inside it stands at its first or its last place. That depends on the k words alone, so equal
passages have equal anchors wherever they stand, and of any k - s k-mers in a row at least one is an anchor. A
fingerprint writes every anchor as one digit, the words since the anchor before, and eight hex digits of its hash: two
fingerprints agree at an anchor where both the k-mer and its distance from the anchor before agree,
which needs no common numbering of places. Fingerprints grow with the text; nothing is sampled.

Texts are shuffled once, for following() only; anchors are found row by row, about 150 bytes of heap for a word
of the longest text of a task.

Nulls and ties: a null or blank text has no anchor and an empty fingerprint; two of these are alike (1). A text whose
words hold no anchor (fewer than k, or a few more) is one anchor as a whole, marked by the digit 9. A tie of least runs counts
for either place. Repeated rows stay, with equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.llm.common import WORD, fresh

#: Words of an anchor, and of the runs that are compared inside it.
K, S = 5, 2
#: Characters of one anchor in a fingerprint: distance and hash.
PIECE = 9
#: Bytes of text in one bucket of neighbouring ids and in one task; so many buckets at least and at most (their bounds come to the driver).
BUCKET, TASK, FEW, MANY = 1 << 20, 8 << 20, 16, 1 << 16


def with_pieces(rows: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """rows and the column out: the text's anchors in order, as pieces of a fingerprint."""
    if not 1 <= s < k - 1 or k - s > 8:
        raise ValueError("1 <= s < k - 1 and k - s <= 8, as a distance is one digit below 9")
    w, h, p = fresh([*rows.columns, out], "words", "runs", "places")
    run = "x" if s == 1 else f"concat_ws(' ', x, {', '.join(f'get({w}, i + {j})' for j in range(1, s))})"
    a = rows.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    b = a.withColumn(h, F.expr(f"transform(slice({w}, 1, greatest(size({w}) - {s - 1}, 0)), (x, i) -> left(md5({run}), 8))"))
    last = k - s
    inner = ", ".join(f"get({h}, i + {j})" for j in range(1, last))
    inner = f"least({inner})" if last > 2 else inner
    c = b.withColumn(p, F.expr(f"filter(sequence(0, greatest(size({h}) - {last + 1}, 0)), i -> size({h}) > {last} and least(get({h}, i), get({h}, i + {last})) <= {inner})"))
    anchors = f"transform({p}, (x, j) -> concat(cast(x - coalesce(get({p}, j - 1), 0) as string), left(md5(concat_ws(' ', slice({w}, x + 1, {k}))), 8)))"
    whole = f"array(concat('9', left(md5(concat_ws(' ', {w})), 8)))"
    return c.withColumn(out, F.expr(f"case when size({p}) > 0 then {anchors} when size({w}) > 0 then {whole} else array() end")).drop(w, h, p)


def fingerprint(pieces: str) -> Column:
    return F.array_join(pieces, "")


def pieces_of(fingerprints: str) -> Column:
    """The pieces of a fingerprint column."""
    return F.regexp_extract_all(F.col(fingerprints), F.lit(f".{{{PIECE}}}"), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """Twice the common pieces over the pieces of both, each different piece once: 0 to 1; two without any are alike."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """key and fingerprint of every row; other columns are ignored."""
    (inner,) = fresh([key], "body")
    rows = with_pieces(docs.select(F.col(key), F.col(text).alias(inner)), inner, "pieces_", k, s)
    return rows.select(key, fingerprint("pieces_").alias("fingerprint"))


def anchors(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, place (number of the anchor's first word, from 0), hash: a row for each anchor, to be matched by joins."""
    parts = prints.select(F.col(key), pieces_of("fingerprint").alias("pieces_"))
    gaps = parts.select(key, F.expr("transform(pieces_, x -> struct(if(left(x, 1) = '9', 0, cast(left(x, 1) as long)) as gap, substring(x, 2) as hash))").alias("parts_"))
    window = Window.partitionBy(key, "row_").orderBy("n_").rowsBetween(Window.unboundedPreceding, 0)
    rows = gaps.withColumn("row_", F.monotonically_increasing_id()).select(key, "row_", F.posexplode("parts_").alias("n_", "part_"))
    return rows.select(key, F.sum("part_.gap").over(window).alias("place"), F.col("part_.hash").alias("hash"))


def shared_places(prints: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """a, b, shift, n_anchors, first_place, last_place: what the documents of a pair (a, b) have in common, by the shift of places from a to b.

    Only anchors that stand once in both documents count, so a repeated line makes no squares; they meet by pair and
    hash, and one shift is one common passage, or several in step. Pairs without a common anchor give no rows.
    """
    found = anchors(prints, key).groupBy(key, "hash").agg(F.count("*").alias("n_"), F.min("place").alias("place")).where("n_ = 1")
    side = lambda name: found.select(F.col(key).alias(name), "hash", F.col("place").alias(f"place_{name}"))
    met = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "hash"])
    shifts = met.groupBy("a", "b", (F.col("place_b") - F.col("place_a")).alias("shift"))
    return shifts.agg(F.count("*").alias("n_anchors"), F.min("place_a").alias("first_place"), F.max("place_a").alias("last_place"))


def _numbers(values: list, kind: str = "bigint") -> Column:
    """A constant array; Spark folds the text, so that the plan has one literal."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


def _bounds(docs: DataFrame, key: str, text: str) -> tuple[list[int], int]:
    """Upper bounds of the buckets but the last, and the number of tasks: at most MANY numbers come to the driver."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(MANY, max(FEW, -(-size // BUCKET)))
    shares = _numbers([i / buckets for i in range(1, buckets)], "double")
    found = docs.agg(F.percentile_approx(key, shares, 20 * buckets).alias("b")).first()["b"] or []
    return sorted(set(found)), min(buckets, max(1, -(-size // TASK)))


def _bucket(key: str, bounds: list[int]) -> Column:
    """Number of bounds below the id, looked up in two steps; null ids come first."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(_numbers(bounds[step - 1 :: step]), lambda b: b < F.col(key)))
    fine = F.size(F.filter(F.slice(_numbers(bounds), coarse * step + 1, F.lit(step)), lambda b: b < F.col(key)))
    return F.when(F.col(key).isNull(), 0).otherwise(coarse * step + fine)


def following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty), pieces, next_text, next_pieces: every row beside the next one by descending whole-number id.

    After the last row comes the first; null ids come last; rows with the same id go by descending text, so a lone row
    follows itself. Ids are cut into buckets of about a megabyte of text at quantiles of the ids. Each bucket gets a second copy of the first
    row of the bucket that follows it, so every row finds its successor inside its bucket: texts are
    shuffled once, and no task sees more than its buckets. Rows that share one id stay in one bucket.
    """
    rows = docs.select(F.col(key).cast("long").alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    bounds, tasks = _bounds(rows, "id_", "text_")
    rows = rows.withColumn("bucket_", _bucket("id_", bounds))
    heads = sorted((r["bucket_"], r["id_"]) for r in rows.groupBy("bucket_").agg(F.max("id_").alias("id_")).collect())  # at most MANY pairs
    if not heads:
        heads = [(0, None)]
    above = [heads[(k + 1) % len(heads)][0] for k in range(len(heads))]
    to = docs.sparkSession.createDataFrame([(i, b) for (_, i), b in zip(heads, above)], "head_ long, to_ int")
    copies = rows.join(F.broadcast(to), F.col("id_").eqNullSafe(F.col("head_"))).select("id_", "text_", F.col("to_").alias("bucket_"), F.lit(1).alias("copy_"))
    dealt = rows.select("id_", "text_", "bucket_", F.lit(0).alias("copy_")).unionAll(copies).repartition(tasks, "bucket_")
    window = Window.partitionBy("bucket_").orderBy("copy_", F.desc_nulls_last("id_"), F.desc("text_"))
    own = with_pieces(dealt, "text_", "pieces_")
    beside = own.withColumn("next_text", F.lead("text_").over(window)).withColumn("next_pieces", F.lead("pieces_").over(window))
    return beside.where("copy_ = 0").select(F.col("id_").alias(key), F.col("text_").alias("text"), F.col("pieces_").alias("pieces"), "next_text", "next_pieces")


def edited_prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose last third is the next row's beginning, and how alike they are.

    key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its last
    floor(n_chars / 3) code points replaced by the first as many (or all) of the next text.
    """
    rows = following(docs, key, text).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))")
    edited = rows.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), third)))
    out = with_pieces(edited, "edited", "edited_pieces")
    return out.select(
        key, "n_chars", "edited", fingerprint("pieces").alias("fingerprint"), fingerprint("edited_pieces").alias("edited_fingerprint"),
        likeness("pieces", "edited_pieces").alias("near_edited"), likeness("pieces", "next_pieces").alias("near_next"),
    )
