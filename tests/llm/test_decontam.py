"""Decontamination against a full edit-distance search."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from recordspark.llm import decontam
from recordspark.llm.decontam import ItemIndex, banded_edits, code_points, find_leaks, remove_leaks


def best_edits(item, text):
    """Fewest edits of the item against any stretch of the text."""
    a, t = code_points(item), code_points(text)
    row = np.zeros(len(t) + 1, int)
    for c in a:
        new = row.copy()
        new[0] = row[0] + 1
        for j, x in enumerate(t):
            new[j + 1] = min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, "~"), lambda: out.insert(k, "~"), lambda: out.pop(k)])()
    return "".join(out)


def test_equals_full_search(spark):
    rng = random.Random(7)
    words = ["the", "tion", "and", "ble", "er", "Éa", "on", "re"]
    text = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))
    items = [(k, text(rng.choice([5, 10, 20]))) for k in range(8)] + [(90, None), (91, ""), (92, "short"), (93, text(9)), (94, "the ble ert er"), (95, "onre and tion the ble erer")]
    docs = [(k, text(rng.choice([1, 20, 60]))) for k in range(20)]
    for k, t in items[:8]:
        for edits in (0, 1, len(t) // 12, len(t) // 9, len(t) // 6):
            docs.append((100 + len(docs), text(5) + "\n" + edited(rng, t, edits).upper().lower() + " " + text(8)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, "A Short, one"), (904, "shorty"), (905, "xx the bl ert er"), (906, "the onre and tio the ble ere")]
    budget = {k: len(t) // 10 for k, t in items if t}
    want = {(d, k, e) for d, t in docs for k, i in items if k in budget and (e := best_edits(i, t or "")) <= budget[k]} - {(904, 92, 0)}
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in rows} == want
    assert len([r for r in rows if r.doc_id == 902 and r.item_id == 0]) == 2
    full = dict(docs)
    for r in rows:
        assert best_edits(dict(items)[r.item_id], full[r.doc_id][r.start : r.end]) == r.edits
    leaky = {d for d, _, _ in want}
    left = remove_leaks(table, bench)
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in leaky)
    assert find_leaks(table, bench.limit(0)).count() == 0 and find_leaks(table.limit(0), bench).count() == 0


def test_band_at_edges():
    a = code_points("abcdefghij")
    assert banded_edits(a, code_points("abcdefghij"), -2, 2) == (0, 10)
    assert banded_edits(a, code_points("xxabcdefghi"), 0, 4)[0] == 1


def test_texts_without_hits():
    index = ItemIndex([(1, "the quick brown fox jumps over the lazy dog again and again")])
    assert index.search(["nothing here at all to see in this text", "", "x"]) == index.search([""]) == index.search([]) == []


def test_frequent_grams_and_short_items(monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 40])))) for k in range(60)] + [(100, "-" * 60), (101, "a-" * 30)]
    texts = ["-" * 500, "a-" * 200, "x" * 50, *(" ".join(word() for _ in range(80)) for _ in range(15))]
    texts += [edited(rng, t, len(t) // 12) + " end" for _, t in items]
    plain = ItemIndex(items).search(texts)
    monkeypatch.setattr(decontam, "FREQUENT", 1)
    monkeypatch.setattr(decontam, "KEEP_BOUND", 1)
    monkeypatch.setattr(decontam, "HELD", 50)
    monkeypatch.setattr(decontam, "WINDOW", 37)
    index = ItemIndex(items)
    got = index.search(texts)
    assert {h[:3] for h in got} == {h[:3] for h in plain}
    found = {(h[0], index.ids[h[1]]): h for h in got}
    for d, t in enumerate(texts):
        for k, i in items:
            if len(i) >= 8:
                e = best_edits(i, t)
                assert ((d, k) in found) == (e <= len(i) // 10) and ((d, k) not in found or found[d, k][2] == e), (d, i)
            else:
                assert ((d, k) in found) == bool(re.search(rf"(?<![a-z0-9]){re.escape(i)}(?![a-z0-9])", t)), (t, i)


def test_null_item_id(spark):
    text = "a passage that is long enough to be found in a document"
    bench = spark.createDataFrame([(None, text), (-1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x " + text), (5, text)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.item_id is None) for r in find_leaks(docs, bench).collect()) == [(0, False), (0, True), (5, False), (5, True)]
