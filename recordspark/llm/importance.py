"""Quality classifier by importance resampling: hashed n-gram models of target and raw text.

A document's n-gram weight is the mean, over its hashed n-grams, of log(target share / raw share).
The raw model counts all documents; the target model is fitted to at most FIT_ROWS labelled rows.
Besides one- and two-token n-grams there are marks for a token that returns after one or two
places and for a trigram that the text already had, so repetition has its own buckets. n-grams of
one text are far from independent, so the weight is calibrated: a logistic line, fitted to labelled
rows that the target model has not seen, maps it to log odds of being wanted, and these are the
importance weights. Documents are sampled without replacement by Gumbel top-k: log weight /
temperature + Gumbel noise, the k largest stay. At temperature 1 that is sampling by the weights
themselves: clear cases stay or go, doubtful ones are drawn. The k-th largest key is found exactly
from histograms, never by a global sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import TOKENS, fresh, mix, prepare, sliced, summed, text_buffer, tidy, word_hashes, written

#: Labelled rows that the target model, and as many again that the calibration, is fitted to at most.
FIT_ROWS = 20_000
BUCKETS = 1 << 16
#: Marks: repeat after one place, after two, trigram seen before, trigram new.
MARKS = 4
#: Pseudo-counts of the raw model that the target model starts from.
PRIOR_COUNTS = 2 * BUCKETS
SLICES = 16
#: n-grams that a short text is thought to have besides its own, all of weight 0; spreads from the median beyond which weights are cut.
SHORT, WIDEST = 20, 30.0


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram and mark."""
    h, first = word_hashes(raw, offsets, lower=False, classes=TOKENS)
    n = len(h)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = np.uint64(BUCKETS - MARKS)
    out, at = [h % size], [doc]
    for step in (1, 2):
        if n > step:
            same = doc[step:] == doc[:-step]
            if step == 1:
                out.append(mix(h[:-1] * np.uint64(3) + h[1:])[same] % size)
                at.append(doc[:-1][same])
            again = same & (h[step:] == h[:-step])
            out.append(np.full(again.sum(), BUCKETS - step, np.uint64))
            at.append(doc[:-step][again])
    if n > 2:
        inside = doc[2:] == doc[:-2]
        own = doc[:-2][inside]
        tri = mix(mix(h[:-2] * np.uint64(5) + h[1:-1]) + h[2:])[inside] ^ mix(own.astype(np.uint64))
        new = np.zeros(len(tri), bool)
        new[np.unique(tri, return_index=True)[1]] = True
        out.append(np.where(new, np.uint64(BUCKETS - 4), np.uint64(BUCKETS - 3)))
        at.append(own)
    return np.concatenate(out).astype(np.int64), np.concatenate(at)


def count_buckets(texts: DataFrame) -> np.ndarray:
    """n-gram counts over all rows of one text column; every batch adds to its task's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(ngram_buckets(*text_buffer(batch.column(0)))[0], minlength=BUCKETS)
        yield sliced(total, SLICES)

    return summed(texts.mapInArrow(tidy(run), "slice long, blob binary"), BUCKETS)


@dataclass(frozen=True)
class Importance:
    """ratio: log(target share / raw share) by bucket; middle, spread: of the mean ratios of labelled rows; line: calibration in them."""

    ratio: np.ndarray
    middle: float = 0.0
    spread: float = 1.0
    line: tuple[float, float] = (0.0, 1.0)
    temperature: float = 1.0
    seed: int = 17

    def means(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, doc = ngram_buckets(raw, offsets)
        texts = len(offsets) - 1
        n = np.bincount(doc, minlength=texts)[:texts]
        return np.bincount(doc, weights=self.ratio[bucket], minlength=texts)[:texts] / (n + SHORT)

    def log_weights(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = np.clip((self.means(raw, offsets) - self.middle) / self.spread, -WIDEST, WIDEST)
        return self.line[0] + self.line[1] * x

    def keys(self, weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
        u = ((mix(ids.astype(np.int64).view(np.uint64) ^ mix(np.array([self.seed], np.uint64))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        return weights / self.temperature - np.log(-np.log(u))


def calibrated(means: np.ndarray, wanted: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[float, float, tuple[float, float]]:
    """Median, spread and logistic line of the means; targets are drawn in by one row of each class, as if none were sure."""
    middle = float(np.median(means))
    spread = float(np.median(np.abs(means - middle))) or 1.0
    x = np.stack((np.ones(len(means)), np.clip((means - middle) / spread, -WIDEST, WIDEST)), axis=1)
    order = np.lexsort((wanted, x[:, 1]))  # a fixed order, so that runs agree
    x, wanted = x[order], wanted[order]
    good, bad = int(wanted.sum()), int((~wanted).sum())
    y = np.where(wanted, (good + 1) / (good + 2), 1 / (bad + 2))
    penalty, w = np.diag([1e-9, ridge]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.clip(np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return middle, spread, (float(w[0]), float(w[1]))


def fit_importance(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", wanted: int = 1, fit_rows: int = FIT_ROWS, temperature: float = 1.0) -> Importance:
    """The model from all documents and at most 2 * fit_rows labelled ones, chosen by hash of their ids.

    Half of the labelled rows make the target model, the other half the calibration; both halves are
    told apart by hash. Without labelled rows of the wanted class, or without text, all n-gram weights
    are 0; without calibration rows of both classes the log weight is the log odds among all labels. A document
    with several labels counts as wanted if any is.
    """
    prepare(docs.sparkSession)
    best = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) == wanted).cast("int")).alias("_y"))
    good, every = best.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count("*")).first()
    half = F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2))
    first = lambda rows: rows.orderBy(F.xxhash64(key), key).limit(fit_rows)
    raw = count_buckets(docs.select(text)).astype(float)
    target = count_buckets(docs.join(F.broadcast(first(best.where((half == 0) & (F.col("_y") == 1)).select(key))), key, "left_semi").select(text)).astype(float)
    share = (raw + 1) / (raw.sum() + BUCKETS)
    ratio = np.log((target + PRIOR_COUNTS * share) / (target.sum() + PRIOR_COUNTS) / share)
    plain = Importance(ratio)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plain.means(*text_buffer(batch.column(0)))), batch.column(1)], names=["m", "y"])

    judged = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(first(best.where(half == 1))), key).select("_text", "_y")
    rows = judged.mapInArrow(tidy(measure), "m double, y int").collect()  # fit_rows labels at most
    y = np.array([r["y"] for r in rows], bool)
    if y.all() or not y.any():
        return Importance(ratio, line=(math.log((good + 1) / (every - good + 1)), 0.0), temperature=temperature)
    return Importance(ratio, *calibrated(np.array([r["m"] for r in rows]), y), temperature)


def weigh(docs: DataFrame, model: Importance, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), above: float | None = None) -> DataFrame:
    """keep columns, log_weight and sample_key of every row; with above, keep columns of rows whose key reaches it."""
    prepare(docs.sparkSession)
    id_name, text_name = fresh(list(keep), "id", "body")
    rows = docs.select(*keep, F.col(key).cast("long").alias(id_name), F.col(text).alias(text_name))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = model.log_weights(*text_buffer(batch.column(n + 1)))
            keys = model.keys(weights, batch.column(n).fill_null(0).to_numpy(zero_copy_only=False))
            if above is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(weights), pa.array(keys)], names=[*keep, "log_weight", "sample_key"])
            else:
                yield batch.select(list(range(n))).filter(pa.array(keys >= above))

    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n]]
    return rows.mapInArrow(tidy(run), ", ".join(head + ["log_weight double", "sample_key double"] * (above is None)))


def kth_largest(values: DataFrame, k: int, bins: int = 4096, small: int = 10_000) -> float:
    """The k-th largest of one double column, exactly: histograms of 4096 bins close in on it."""
    name = values.columns[0]
    low, high = values.agg(F.min(name), F.max(name)).first()
    if k <= 0 or low is None:
        return math.inf
    left = k
    while high > low:
        inside = values.where((F.col(name) >= low) & (F.col(name) <= high))
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)).alias("b")
        counts = sorted(inside.groupBy(place).agg(F.count("*"), F.min(name), F.max(name)).collect(), reverse=True)
        for _, count, a, b in counts:
            if left <= count:
                low, high = a, b
                break
            left -= count
        else:
            return low
        if count <= small:
            found = values.where((F.col(name) >= low) & (F.col(name) <= high)).collect()
            return sorted((r[0] for r in found), reverse=True)[left - 1]
    return low


def sample_threshold(docs: DataFrame, model: Importance, text: str = "text", key: str = "doc_id", k: int | None = None) -> tuple[DataFrame, float]:
    """All rows' weights as a written table, and the least key that stays.

    k: how many documents to draw; None draws as many as are expected to be wanted, the sum of
    the probabilities that the log weights stand for. Rows whose key equals the k-th largest all stay.
    """
    scored = written(weigh(docs, model, text, key, keep=(key,)), "importance")
    if k is None:
        expected = scored.agg(F.coalesce(F.sum(1 / (1 + F.exp(-F.col("log_weight")))), F.lit(0.0))).first()[0]
        k = round(expected)
    return scored, kth_largest(scored.select("sample_key"), k)


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", k: int | None = None, temperature: float = 1.0) -> DataFrame:
    """One row per document: key, log_weight, sample_key, kept.

    Null or empty texts have no n-grams and the weight of a mean of 0; repeated rows have equal keys and
    stay or go together; a null id draws the noise of id 0; an empty table gives no rows; other columns are ignored.
    """
    model = fit_importance(docs, labels, text, key, temperature=temperature)
    scored, least = sample_threshold(docs, model, text, key, k)
    return scored.withColumn("kept", F.col("sample_key") >= least)


def keep_sampled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", k: int | None = None, temperature: float = 1.0) -> DataFrame:
    """The documents that the sampling keeps, with all their columns: no join, texts pass through the scoring.

    Nulls, ties, repeated rows and empty tables are as in resample: null ids and null texts are sampled too.
    """
    model = fit_importance(docs, labels, text, key, temperature=temperature)
    _, least = sample_threshold(docs, model, text, key, k)
    return weigh(docs, model, text, key, keep=tuple(docs.columns), above=least)
