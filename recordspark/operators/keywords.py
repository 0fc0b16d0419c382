"""Many keywords looked for in many texts at once, by an Aho-Corasick automaton in each worker.

The keywords, not the automaton, go to the workers, each of which builds it once. Their characters are counted before
they are broadcast: beyond MOST_CHARS the list is cut into blocks that fit, and texts are read once for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of keywords (and some 16 for each) in one broadcast block.
MOST_CHARS = 16 << 20

_BUILT: dict[int, ahocorasick.Automaton] = {}


def _automaton(words: Broadcast) -> ahocorasick.Automaton:
    """Of the list of (keyword, value) pairs; a worker keeps the last one it built."""
    key = words._jbroadcast.id() if words._jbroadcast is not None else id(words.value)
    if key not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for number, (word, _) in enumerate(words.value):
            a.add_word(word, number)
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _blocks(table: DataFrame, word: str) -> Iterator[DataFrame]:
    """table in parts whose keywords fit a broadcast, all rows of a keyword in one."""
    size = table.agg(F.sum(F.length(word) + 16)).first()[0] or 0
    parts = -(-size // MOST_CHARS)
    for k in range(parts):
        yield table.where(F.pmod(F.xxhash64(word), F.lit(parts)) == k) if parts > 1 else table


def occurrences(a: ahocorasick.Automaton, words: list, text: str) -> dict[int, int]:
    """How often each keyword (by number) stands in the text: its own leftmost occurrences that don't overlap."""
    count: dict[int, int] = {}
    free: dict[int, int] = {}
    if not len(a):
        return count
    for last, number in a.iter(text):
        start = last + 1 - len(words[number][0])
        if start >= free.get(number, 0):
            count[number] = count.get(number, 0) + 1
            free[number] = last + 1
    return count


def keyword_scores(texts: DataFrame, text: str, table: DataFrame, word: str, label: str, out: str) -> DataFrame:
    """texts and the column out: array of (label, n), the occurrences of a label's keywords added up, labels with none left out.

    table: (word, label) rows; a keyword may have several labels, an empty one counts for nothing. A null text has
    no occurrence. Row by row: nothing is shuffled, and repeated rows have their own counts.
    """
    found = texts.withColumn(out, F.expr("cast(array() as array<struct<label: string, n: bigint>>)"))
    for part in _blocks(table.where(F.length(word) > 0), word):
        rows = part.groupBy(word).agg(F.collect_list(label).alias("labels")).collect()  # one broadcast block
        found = _scored(found, text, texts.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows]), out)
    return found


def _scored(texts: DataFrame, text: str, words: Broadcast, out: str) -> DataFrame:
    at, to = texts.columns.index(text), texts.columns.index(out)
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, known = _automaton(words), words.value
            lists = []
            for body, before in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist()):
                score = {x["label"]: x["n"] for x in before}
                for number, n in occurrences(a, known, body or "").items():
                    for label in known[number][1]:
                        score[label] = score.get(label, 0) + n
                lists.append([{"label": x, "n": n} for x, n in score.items()])
            cols = list(batch.columns)
            cols[to] = pa.array(lists, pa.list_(pa.struct([("label", pa.string()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.mapInArrow(run, texts.schema)


def first_rule(values: DataFrame, key: str, value: str, rules: DataFrame) -> DataFrame:
    """key and reason of the first rule (ord) that a value equals, starts with or contains.

    rules: ord, text, mode (exato, prefixo, contem), reason. An empty text equals an empty value and is in, and at the
    beginning of, every one. A null value fits no rule; rows with the same key count together.
    """
    sc = values.sparkSession.sparkContext
    kind = values.schema[key].dataType.simpleString()
    r = rules.where("text is not null and mode in ('exato', 'prefixo', 'contem')").select("ord", "text", "mode", "reason")
    v = values.select(key, value).where(F.col(value).isNotNull())
    found = []
    for part in _blocks(r.where(F.length("text") > 0), "text"):
        rows = part.groupBy("text").agg(F.collect_list(F.struct("ord", "mode", "reason")).alias("rules")).collect()  # one broadcast block
        words = sc.broadcast([(x["text"], [(y["ord"], y["mode"], y["reason"]) for y in x["rules"]]) for x in rows])
        found.append(v.mapInArrow(_ruled(words, key), f"{key} {kind}, ord long, reason string"))
    empty = r.where(F.length("text") == 0).groupBy((F.col("mode") == "exato").alias("exact")).agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), "reason")).alias("m")).collect()  # two rows at most
    for x in empty:
        fits = F.length(value) == 0 if x["exact"] else F.lit(True)
        found.append(v.where(fits).select(key, F.lit(x["m"]["ord"]).cast("long").alias("ord"), F.lit(x["m"]["reason"]).alias("reason")))
    if not found:
        return v.limit(0).select(key, F.lit(None).cast("string").alias("reason"))
    return reduce(DataFrame.unionAll, found).groupBy(key).agg(F.min_by("reason", "ord").alias("reason"))


def _ruled(words: Broadcast, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, known = _automaton(words), words.value
            rows, ords, reasons = [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                best = None
                for last, number in a.iter(body) if len(a) else ():
                    text, rules = known[number]
                    first = last + 1 == len(text)
                    for rule in rules:
                        fits = rule[1] == "contem" or first and (rule[1] == "prefixo" or last + 1 == len(body))
                        if fits and (best is None or rule[0] < best[0]):
                            best = rule
                if best is not None:
                    rows.append(k), ords.append(best[0]), reasons.append(best[2])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ords, pa.int64()), pa.array(reasons, pa.string())], names=[key, "ord", "reason"])

    return run
