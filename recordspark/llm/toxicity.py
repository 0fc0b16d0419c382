"""Toxicity: a lexicon, misspellings by a Levenshtein automaton over its trie, and context windows.

Terms come from a seed list and from labelled rows: words and word beginnings that are far more
frequent in toxic than in clean rows. A word that is no term is run through the product of the
trie with the Levenshtein automaton of one edit (two neighbours that changed places count as one);
states are made when first met and kept, so most words die after two or three table look-ups. Digits
belong to words, so `id1ot` is one edit from a term; the letters beside them are looked up as well.
Every hit is weighed by the words around it: within quotation marks or beside a reporting word it
counts less, addressed to someone it counts more. Reporting and addressing words are a short English list
and, for any language, what stands far more often beside hits in clean or in toxic labelled rows.
A logistic model over a few sums turns that into a score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import drop, fresh, prepare, tidy, written

#: Labelled rows that terms, contexts and weights are learned from, at most; what is learned has no bound of its own.
FIT_ROWS = 20_000
SEED_TERMS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = frozenset("called calls phrase quote quoted said says term word words wrote writes".split())
ADDRESS = frozenset("you your you're u ur".split())
QUOTES = frozenset("\"'“”„‘’«»`")
#: A quotation of several words, of any length within one line; an open mark is looked after once, so the search is linear.
QUOTATION = re.compile("\"[^\"\n]+\"|[“„][^“”\n]+[“”]|«[^«»\n]+»|»[^«»\n]+«")
#: Words on either side of a hit that tell its context; weights of quoted and addressed hits.
WINDOW, QUOTED, ADDRESSED = 5, 0.25, 1.5
STEMS = (4, 5, 6)
#: Edits for terms of this length on; shorter terms must match exactly.
EDITS, FUZZY_FROM = 1, 5
#: A word beside hits in this many rows of one class tells a context if it is this much more frequent there than in the other.
CONTEXT_ROWS, CONTEXT_LIFT = 5, 4.0
#: A near form seen in clean rows is innocent unless it is this much more frequent in toxic ones.
NEAR_LIFT = 2.0
#: Words hold a letter; starting only where no word goes on keeps long numbers linear.
WORD = re.compile(r"(?<![^\W_])\d*+[^\W\d_][^\W_]*")
LETTERS = re.compile(r"[^\W\d_]+")
REMEMBERED = 150_000
FEATURES = 6


class FuzzyTrie:
    """Words within EDITS of a term: the trie intersected with the Levenshtein automaton, made lazily deterministic.

    A state maps nodes to costs. With swaps, neighbours that changed places are one edit (optimal
    string alignment): (node, c) waits for c, the first of the two, to arrive at node.
    """

    def __init__(self, terms: list[str], edits: int = EDITS, swaps: bool = False):
        self.edits, self.swaps, self.children, self.ends = edits, swaps, [{}], [None]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = term
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.content: list[dict] = [{}]
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._number(self._skips({0: 0}))

    def _skips(self, state: dict) -> dict:
        todo = [node for node in state if isinstance(node, int)]
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                cost = state[node] + 1
                if cost <= self.edits and cost < state.get(child, self.edits + 1):
                    state[child] = cost
                    todo.append(child)
        return state

    def _number(self, state: dict) -> int:
        key = frozenset(state.items())
        if key not in self.states:
            self.states[key] = len(self.content)
            self.content.append(state)
            self.moves.append({})
        return self.states[key]

    def _move(self, number: int, c: str) -> int:
        out: dict = {}
        for node, cost in self.content[number].items():
            if not isinstance(node, int):
                if node[1] == c and cost < out.get(node[0], self.edits + 1):
                    out[node[0]] = cost
                continue
            if self.swaps and cost < self.edits:
                for ch, child in self.children[node].items():
                    if ch != c and c in self.children[child]:
                        both = self.children[child][c], ch
                        out[both] = min(cost + 1, out.get(both, self.edits))
            options = [(child, cost + (ch != c)) for ch, child in self.children[node].items()]
            for child, total in (*options, (node, cost + 1)):
                if total <= self.edits and total < out.get(child, self.edits + 1):
                    out[child] = total
        self.moves[number][c] = to = self._number(self._skips(out))
        return to

    def match(self, word: str) -> str | None:
        """The closest term within reach (ties: alphabetically first), else None."""
        state = self.start
        for c in word:
            moves = self.moves[state]
            state = moves[c] if c in moves else self._move(state, c)
            if not state:
                return None
        found = [(cost, self.ends[node]) for node, cost in self.content[state].items() if isinstance(node, int) and self.ends[node]]
        return min(found)[1] if found else None


def pieces(word: str) -> list[str]:
    """The runs of letters of a word with digits; none of a word without."""
    return LETTERS.findall(word) if any(c.isdecimal() for c in word) else []


def vocabulary(text: str | None) -> set[str]:
    """The distinct words of a text and the pieces of those with digits."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*map(pieces, words))


def tallied(tally: Counter) -> Iterator[pa.RecordBatch]:
    """Counts of (kind, term, y) as batches."""
    items = list(tally.items())
    for a in range(0, len(items), 20_000):
        part = items[a : a + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in part], pa.string()), pa.array([x[0][1] for x in part], pa.string()), pa.array([x[0][2] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["kind", "term", "y", "n"])


@dataclass
class Toxicity:
    """terms and stems with their weights; innocent: near forms as frequent in clean text; weights of the features; swaps as in FuzzyTrie; context words."""

    terms: dict[str, float]
    stems: dict[str, float]
    innocent: frozenset[str]
    weights: np.ndarray
    swaps: bool = False
    reporting: frozenset[str] = REPORTING
    address: frozenset[str] = ADDRESS
    _known: dict = field(default_factory=dict, repr=False, compare=False)
    _trie: FuzzyTrie | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_trie": None}

    def look(self, word: str) -> tuple[str, float, bool] | None:
        """Term, weight and whether it is misspelled; of a stem and a near term the one with more weight (the stem on a tie)."""
        if word in self.terms:
            return word, self.terms[word], False
        stem = next((word[:k] for k in reversed(STEMS) if word[:k] in self.stems and len(word) >= k), None)
        begins = (stem + "*", self.stems[stem], False) if stem else None
        if len(word) >= FUZZY_FROM - 1 and word not in self.innocent:
            if self._trie is None:
                self._trie = FuzzyTrie([t for t in self.terms if len(t) >= FUZZY_FROM], swaps=self.swaps)
            near = self._trie.match(word)
            if near and (begins is None or self.terms[near] > begins[1]):
                return near, self.terms[near], True
        return begins

    def found(self, word: str) -> list[tuple[str, float, bool]]:
        """What a word counts as: itself, or, if it has digits, first the terms that its letters spell."""
        whole = self.look(word)
        parts = pieces(word)
        if parts and word not in self.terms:
            hits = [x for x in map(self.look, parts) if x]
            right = [x for x in hits if not x[2]]
            if right or not whole:
                return right or hits
        return [whole] if whole else []

    def places(self, words: list[str]) -> list[int]:
        """Where the words that count stand."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known = self._known
        for w in set(words):
            if w not in known:
                known[w] = self.found(w)
        return [k for k, w in enumerate(words) if known[w]]

    def hits(self, text: str) -> tuple[list[tuple[int, str, float, bool, float]], int]:
        """(place, term, weight, misspelled, context factor) of every hit, and the number of words."""
        low, out = text.lower(), []
        words = WORD.findall(low)
        places = self.places(words)
        if places:
            spans = [m.span() for m in WORD.finditer(low)]
            quotations = [m.span() for m in QUOTATION.finditer(low)]
            starts = [a for a, _ in quotations]
        for k in places:
            around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            a, b = spans[k]
            q = bisect_right(starts, a) - 1
            quoted = (q >= 0 and b <= quotations[q][1]) or (a and low[a - 1] in QUOTES and b < len(low) and low[b] in QUOTES)
            factor = QUOTED if quoted or not self.reporting.isdisjoint(around) else ADDRESSED if not self.address.isdisjoint(around) else 1.0
            out.extend((k, *x, factor) for x in self._known[words[k]])
        return out, len(words)

    def features(self, text: str | None) -> tuple[np.ndarray, list[str]]:
        hits, n = self.hits(text or "")
        total = sum(w * f for _, _, w, bad, f in hits if not bad)
        fuzzy = sum(w * f for _, _, w, bad, f in hits if bad)
        terms = sorted({h[1] for h in hits})
        strongest = max((h[2] * h[4] for h in hits), default=0.0)
        x = [1.0, np.log1p(total), np.log1p(1000 * total / (n + 20)), np.log1p(fuzzy), np.log1p(len(terms)), strongest]
        return np.array(x), terms

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def _labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int) -> DataFrame:
    best = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    chosen = best.orderBy(F.xxhash64(key), key).limit(rows)
    return docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text", "_y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Toxicity:
    """Terms and weights from at most fit_rows rows of labels, chosen by hash of their ids.

    The chosen rows are written once. Counting terms is one aggregation with partial sums, counting near forms of the
    chosen terms and the words beside hits another. What reaches the driver is bounded by the labelled
    rows: words that a hundredth of the toxic ones have, words that recur beside hits, and FEATURES numbers per row. Without labelled rows of both
    classes the seed terms are used with fixed weights.
    """
    prepare(docs.sparkSession)
    rows = written(_labelled(docs, labels, text, key, label, fit_rows), "toxicity-labelled")
    model = Toxicity({t: 1.0 for t in SEED_TERMS}, {}, frozenset(), np.array([-2.0, 2.0, 0.0, 0.5, 0.0, 0.0]), swaps=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = vocabulary(body)
                found = {("w", w) for w in words if len(w) >= 4} | {("s", w[:k]) for w in words for k in STEMS if len(w) > k and not w[:k].isdecimal()}
                tally["", "", y] += 1
                tally.update((k, w, y) for k, w in found)
        yield from tallied(tally)

    def classes(f) -> DataFrame:
        return rows.mapInArrow(tidy(f), "kind string, term string, y long, n long").groupBy("kind", "term").agg(
            F.coalesce(F.sum(F.expr("if(y = 1, n, 0)")), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.expr("if(y = 1, 0, n)")), F.lit(0)).alias("good")
        )

    counted = written(classes(count).where("bad >= 3 or kind = ''"), "toxicity-terms")
    n = counted.where("kind = ''").first()
    if n is None or not n["bad"] or not n["good"]:
        drop(rows, counted)
        return model
    lift = (F.col("bad") / n["bad"]) / ((F.col("good") + 0.5) / n["good"])
    least = max(3, round(0.01 * n["bad"]))
    for r in counted.where(f"kind <> '' and bad >= {least}").withColumn("lift", lift).where("lift >= 4").collect():
        (model.terms if r["kind"] == "w" else model.stems)[r["term"]] = float(min(1.0, np.log(r["lift"]) / 6))
    drop(counted)

    def count_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in vocabulary(body):
                    hit = model.look(w) if w not in model.terms else None
                    if hit and hit[2]:
                        tally["n", w, y] += 1
                words = WORD.findall((body or "").lower())
                places = [k for k in model.places(words) if words[k] in model.terms]
                beside = {w for k in places for w in words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW] if w not in model.terms}
                tally.update(("c", w, y) for w in beside)
                tally["hit", "", y] += bool(places)
        yield from tallied(tally)

    beside = written(classes(count_near), "toxicity-contexts")
    hit = beside.where("kind = 'hit'").first()
    hit_lift = ((F.col("bad") + 0.5) / (hit["bad"] + 0.5)) / ((F.col("good") + 0.5) / (hit["good"] + 0.5))
    words = beside.where(f"kind = 'c' and greatest(good, bad) >= {CONTEXT_ROWS}").withColumn("lift", hit_lift)
    model.reporting |= {r["term"] for r in words.where(f"good >= {CONTEXT_ROWS} and lift <= 1 / {CONTEXT_LIFT}").collect()}
    model.address |= {r["term"] for r in words.where(f"bad >= {CONTEXT_ROWS} and lift >= {CONTEXT_LIFT}").collect()}
    model.innocent = frozenset(r["term"] for r in beside.where("kind = 'n' and good > 0").where(lift < NEAR_LIFT).collect())
    model._known.clear()
    drop(beside)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [model.features(t)[0].tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    data = rows.mapInArrow(tidy(measure), "x array<double>, y int").collect()  # fit_rows labels at most
    drop(rows)
    model.weights = logistic(np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; rows in a fixed order so that runs agree."""
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", keep: tuple[str, ...] = ("doc_id",), below: float | None = None) -> DataFrame:
    """keep columns, score, n_terms and terms (distinct, sorted) of every row; with below, keep columns of rows that score less.

    Null and empty texts score as texts without hits; repeated rows score alike; an empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias(fresh(list(keep), "body")[0]))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, terms = [], [], []
            for body in batch.column(n).to_pylist():
                x, found = model.features(body)
                scores.append(model.score(x))
                counts.append(len(found))
                terms.append(found)
            if below is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=[*keep, "score", "n_terms", "terms"])
            else:
                yield batch.select(list(range(n))).filter(pa.array(np.array(scores, float) < below))

    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n]]
    return rows.mapInArrow(tidy(run), ", ".join(head + ["score double", "n_terms long", "terms array<string>"] * (below is None)))


def keep_clean(docs: DataFrame, labels: DataFrame, below: float = 0.5) -> DataFrame:
    """The documents that score less, with all their columns.

    Null and empty texts score as texts without hits and stay unless that alone reaches the bound;
    null ids stay like others; an empty table gives no rows; without labels the seed terms decide.
    """
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model, keep=tuple(docs.columns), below=below)
