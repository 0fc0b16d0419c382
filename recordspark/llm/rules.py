"""Quality rules with host-level verdicts, in DataFrame functions only.

Documents are measured row by row; rule failures are summed by host (partial sums first, so a
host with a third of all rows costs one row per task), host rates are shrunk by a beta prior that
is fitted to all hosts by moments, and the host's verdict goes back to its documents by a join of
narrow rows: texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import WORD, fresh, written
from recordspark.operators.joins import heavy_join

#: Symbols that count against a text.
SYMBOLS = "[#*$%&|<>]"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Words are runs without blanks; a null text has none. n_repeat_words counts the words that lie
    in a three-word window found twice or more in the text. Windows are compared by 64-bit hash:
    sorted with their places, equal neighbours are repeats, so the work is n log n in the words of
    one text. Null hosts form one group, reported as null. Repeated rows stay repeated.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    w, lines, s, p = fresh([key, "host"], "w", "lines", "s", "p")
    a = docs.select(
        F.col(key), F.col(host).alias("host"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias(w),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias(lines),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    b = a.select(
        key, "host", "n_symbols", "n_upper",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(f"sort_array(transform(slice({w}, 1, greatest(size({w}) - 2, 0)), (x, i) -> struct(xxhash64(x, {w}[i + 1], {w}[i + 2]) h, i)))").alias(s),
    )
    c = b.withColumn(p, F.expr(f"sort_array(transform(filter({s}, (x, k) -> get({s}, k - 1).h <=> x.h or get({s}, k + 1).h <=> x.h), x -> x.i))"))
    covered = F.expr(f"aggregate(transform({p}, (x, k) -> least(3, coalesce(get({p}, k + 1) - x, 3))), 0L, (t, x) -> t + x)")
    d = c.withColumn("n_repeat_words", covered).drop(s, p)
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def failures() -> Column:
    """How many of the document rules fail; all are ratios of whole numbers."""
    rules = [
        "10 * n_symbols > n_words",
        "10 * n_dup_lines > 3 * n_lines",
        "2 * n_upper > word_chars",
        "word_chars < 2 * n_words",
        "word_chars > 20 * n_words",
    ]
    return sum((F.expr(f"cast({r} as int)") for r in rules), F.lit(0)).cast("long")


def host_verdicts(measured: DataFrame, block_above: float = 0.5, trust_below: float = 0.02) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate, host_verdict (trust, watch or block).

    host_rate = (failed + a) / (docs + a + b), where a + b is the strength at which a beta prior
    with the overall rate as mean has the variance seen between hosts (docs-weighted, less what
    sampling alone makes), kept within 1 and 10^6. With one host, or none failing, the prior is the
    overall rate at full strength.
    """
    failed = (F.col("base_failed") | (F.col("n_failures") > 0)).cast("long")
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    total = hosts.agg(F.sum("n_docs").alias("t_docs"), F.sum("n_failed").alias("t_failed"), F.count("*").alias("t_hosts"))
    mean = F.col("t_failed") / F.col("t_docs")
    with_mean = hosts.crossJoin(F.broadcast(total)).withColumn("mean", mean)  # one row
    spread = with_mean.agg(
        (F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.col("mean"), 2)) / F.max("t_docs")).alias("between"),
        (F.max("t_hosts") * F.max("mean") * (1 - F.max("mean")) / F.max("t_docs")).alias("chance"),
    )
    pure = F.col("mean") * (1 - F.col("mean"))
    extra = F.col("between") - F.col("chance")
    strength = F.when(extra > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), pure / extra - 1))).otherwise(1e6)
    rate = (F.col("n_failed") + F.col("mean") * strength) / (F.col("n_docs") + strength)
    out = with_mean.crossJoin(F.broadcast(spread)).withColumn("host_rate", rate)
    verdict = F.when(F.col("host_rate") > block_above, "block").when(F.col("host_rate") <= trust_below, "trust").otherwise("watch")
    return out.select("host", "n_docs", "n_failed", "host_rate", verdict.alias("host_verdict"))


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """All measures, n_failures, host_verdict and kept for every document.

    Verdicts go back by a heavy join: the rows of a frequent host are dealt over tasks. Kept: the base rule holds, the host is not blocked, and no document rule fails (one may on a
    trusted host). An empty table gives no rows; columns other than the three are ignored.
    """
    measured = written(measure(docs, key, text, host).withColumn("n_failures", failures()), "rules")
    (by,) = fresh(measured.columns, "host_key")
    name = F.when(F.col("host").isNull(), "").otherwise(F.concat(F.lit("="), F.col("host")))  # null hosts are one group
    hosts = host_verdicts(measured).select(name.alias(by), "host_rate", "host_verdict")
    out = heavy_join(measured.withColumn(by, name), hosts, [by], "left").drop(by)
    allowed = F.when(F.col("host_verdict") == "trust", 1).otherwise(0)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") != "block") & (F.col("n_failures") <= allowed))
