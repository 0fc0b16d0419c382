"""Title of a cover from the boxes of its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.functions import text as T

#: Phrases of blurbs, in plain form, and words that lift a line. Fixed values.
BLURBS = "do autor|da autora|from the author|campeao de vendas|best ?seller|prefacio de|foreword by|nova edicao|edicao revista|inclui|com comentarios"
LIFTS = "todos podem|everyone can|como|how to|guia|manual|principios|steps?|passos?"


def cover_title(blocks: DataFrame, known_authors: DataFrame | None = None) -> DataFrame:
    """cover_id, title, main, n_lines, score: the largest plausible block with its neighbours that are near, aligned and tall enough, from top to bottom.

    blocks: cover_id, text, author (known, may be null), left, top, width, height, area, mean_height. No blurb, number or year,
    line of more than twelve words, or line with all of the author's words is plausible, nor one that is
    a name of known_authors (name). Score: area (one fifth more for a subtitle's words, 15 % for one word) + 800 * mean height.
    Near: at most 2.4 times the larger height (or the median one) away; aligned: centres within 45 % of the
    larger width; tall: 35 % of the main block's height, at least 8. Ties go to the upper, then the left block.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    plain = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    b = blocks.select("cover_id", text.alias("text"), T.normal(text).alias("n"), F.array_distinct(F.filter(T.words(F.coalesce("author", F.lit(""))), lambda w: F.length(w) > 2)).alias("aw"), *[F.col(c).cast("double").alias(c) for c in ("left", "top", "width", "height", "area", "mean_height")])
    words = F.filter(F.split("n", " "), lambda w: w != "")
    named = (F.size("aw") > 0) & (F.size(F.array_except("aw", words)) == 0)
    b = b.where((F.col("n") != "") & ~plain(F.col("n")).rlike(f" (?:{BLURBS}) ") & ~F.col("n").rlike("^(?:(?:19|20)[0-9]{2}|[0-9]{1,3})$") & (F.size(words) <= 12) & ~named)
    if known_authors is not None:
        b = b.join(known_authors.select(T.normal(F.col("name")).alias("n")).where("n <> ''").distinct(), "n", "left_anti")
    one = (F.size(words) == 1) & (F.length("n") >= 4)
    bonus = 1.0 + F.when(plain(F.col("n")).rlike(f" (?:{LIFTS}) "), 0.20).otherwise(0.0) + F.when(one, 0.15).otherwise(0.0)
    b = b.withColumn("score", F.col("area") * bonus + F.col("mean_height") * 800)
    key = F.struct(-F.col("score"), "top", "left", "text")
    m = b.groupBy("cover_id").agg(F.min_by(F.struct("text", "left", "top", "width", "height", "mean_height", "score"), key).alias("m"), F.element_at(F.sort_array(F.collect_list("mean_height")), F.floor(F.count("*") / 2).cast("int") + 1).alias("median"))
    j = b.join(m, "cover_id")
    end = lambda x: F.col(f"{x}top") + F.col(f"{x}height")
    away = F.least(F.abs(end("") - F.col("m.top")), F.abs(F.col("top") - end("m.")))
    middle = lambda x: F.col(f"{x}left") + F.col(f"{x}width") / 2
    near = away <= F.greatest("m.height", "height", "median") * 2.4
    aligned = F.abs(middle("") - middle("m.")) <= F.greatest(F.col("m.width"), F.col("width"), F.lit(1.0)) * 0.45
    tall = F.col("mean_height") >= F.greatest(F.lit(8.0), F.col("m.mean_height") * 0.35)
    own = (F.col("text") == F.col("m.text")) & (F.col("top") == F.col("m.top")) & (F.col("left") == F.col("m.left"))
    g = j.where(own | (near & aligned & tall)).groupBy("cover_id").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("top", "left", "text"))).alias("g"))
    strip = lambda x: F.trim(x, F.lit(" .,:;·•-"))
    joined = strip(F.array_join(F.transform("g", lambda x: x.text), " "))
    fits = F.size(F.filter(T.words(joined), lambda w: w != "")) <= 12
    return g.select("cover_id", F.when(fits, joined).otherwise(strip(F.col("m.text"))).alias("title"), F.col("m.text").alias("main"), F.size("g").alias("n_lines"), F.round("m.score", 2).alias("score"))
