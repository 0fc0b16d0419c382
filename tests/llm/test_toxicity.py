"""Toxicity: the automaton against edit distances, contexts, and held-out accuracy."""

import math
import random

from pyspark.sql import functions as F

from recordspark.llm.toxicity import SEED_TERMS, FuzzyTrie, Toxicity, fit_toxicity, score_toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    for reach in (0, 1, 2):
        terms = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(12)})
        trie = FuzzyTrie(terms, reach)
        for _ in range(600):
            word = "".join(rng.choices("abcd", k=rng.randint(0, 7)))
            near = min((edits(word, t), t) for t in terms)
            assert trie.match(word) == (near[1] if near[0] <= reach else None), (word, terms)


def test_context():
    m = Toxicity({t: 1.0 for t in SEED_TERMS}, {}, frozenset(), None)
    factor = lambda t: [h[4] for h in m.hits(t)[0]]
    assert factor("what an idiot he is") == [1.0]
    assert factor("you idiot") == [1.5]
    assert factor('they wrote "idiot" there') == [0.25] == factor("the word idiot")
    assert factor('on the sign: "such a big idiot lives here", and then idiot') == [0.25, 1.0]
    assert factor("«ein idiot war er» idiot") == [0.25, 1.0] == factor("„ein idiot war er“ idiot")
    german = Toxicity({"idiot": 1.0}, {}, frozenset(), None, reporting=frozenset(["sagte"]), address=frozenset(["du"]))
    assert [h[4] for t in ("er sagte idiot", "du idiot", "idiot") for h in german.hits(t)[0]] == [0.25, 1.5, 1.0]
    assert [h[1:4] for h in m.hits("such an idoit, idiott")[0]] == [("idiot", 1.0, True)]


def test_held_out(spark):
    rng = random.Random(4)
    words = ["the", "river", "runs", "by", "old", "mill", "and", "field"]

    def text(bad):
        out = rng.choices(words, k=40)
        for _ in range(3 * bad):
            out[rng.randrange(40)] = rng.choice([*SEED_TERMS, "gröbling"])
        return " ".join(out)

    rows = [(k, text(k % 3 == 0)) for k in range(600)] + [(900, None), (901, ""), (902, "the"), (902, "the"), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_y", F.lit(0))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(4, None)], "doc_id long, toxic int")
    got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(got) == len(rows)
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and 300 <= r.doc_id < 600) >= 290
    assert all(0 <= r.score < 0.5 for r in got if r.doc_id in (900, 901, 902))
    assert score_toxicity(docs.limit(0), fit_toxicity(docs, labels.limit(0))).count() == 0


def test_swaps_equal_optimal_alignment():
    def aligned(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(5)
    for reach in (0, 1, 2):
        terms = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(12)})
        trie = FuzzyTrie(terms, reach, swaps=True)
        for _ in range(600):
            word = "".join(rng.choices("abcd", k=rng.randint(0, 7)))
            near = min((aligned(word, t), t) for t in terms)
            assert trie.match(word) == (near[1] if near[0] <= reach else None), (word, terms)


def test_common_misspellings_count():
    m = Toxicity({t: 1.0 for t in SEED_TERMS}, {}, frozenset(), None, swaps=True)
    for word, term in [("id1ot", "idiot"), ("1diot", "idiot"), ("m0ron", "moron"), ("stup1d", "stupid"), ("diot", "idiot"), ("xdiot", "idiot"), ("idoit", "idiot")]:
        assert [h[1:4] for h in m.hits(f"such an {word} here")[0]] == [(term, 1.0, True)], word
    assert [h[1:4] for h in m.hits("idiot2024 99moron")[0]] == [("idiot", 1.0, False), ("moron", 1.0, False)]
    assert m.hits("in 2024 of 12345 and b2b") == ([], 4)


def test_innocence_is_judged_by_lift(spark):
    bad = ["you idiott scum grobling"] * 40 + ["you grobing clown"] * 40
    clean = ["the river runs by"] * 76 + ["he wrote idiott once", "he wrote grobing once", "a closer look", "a closer mill"]
    rows = [(k, t, int(k < 80)) for k, t in enumerate([*bad, *clean])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert "idiott" not in m.innocent and "closer" in m.innocent


def test_learned_model_equals_plain_version(spark):
    rng = random.Random(8)
    words = ["fluss", "mühle", "wiese", "stein", "garten", "wolke"]
    rows = []
    for k in range(400):
        body = rng.choices(words, k=20)
        if k % 4 == 0:
            body[5:5] = ["du", rng.choice(["grobian", "grobjan", "lump", "lumpen", "idiot"])]
        elif k % 10 == 1:
            body[5:5] = ["sagte", rng.choice(["grobian", "idiot"])]
        rows.append((k, " ".join(body), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    m = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    sets = [(set(t.split()), y) for _, t, y in rows]
    bad, good = sum(y for _, y in sets), sum(1 - y for _, y in sets)

    def lift(has):
        b, g = sum(1 for s, y in sets if y and has(s)), sum(1 for s, y in sets if not y and has(s))
        return b, g, b / bad / ((g + 0.5) / good)

    every = {w for s, _ in sets for w in s}
    terms = {w: lift(lambda s, w=w: w in s) for w in every if len(w) >= 4}
    terms = {w: min(1.0, math.log(x) / 6) for w, (b, _, x) in terms.items() if b >= 3 and x >= 4}
    stems = {w[:k] for w in every for k in (4, 5, 6) if len(w) > k}
    stems = {p: lift(lambda s, p=p: any(w.startswith(p) and len(w) > len(p) for w in s)) for p in stems}
    stems = {p: min(1.0, math.log(x) / 6) for p, (b, _, x) in stems.items() if b >= 3 and x >= 4}
    assert {t: round(w, 9) for t, w in m.terms.items()} == {t: round(w, 9) for t, w in ({t: 1.0 for t in SEED_TERMS} | terms).items()}
    assert {t: round(w, 9) for t, w in m.stems.items()} == {t: round(w, 9) for t, w in stems.items()}
    assert "sagte" in m.reporting and "du" in m.address and not {"fluss", "stein"} & (m.reporting | m.address)
    factor = {t: m.hits(t)[0][0][4] for t in ("er sagte idiot", "du idiot")}
    assert factor == {"er sagte idiot": 0.25, "du idiot": 1.5}
    for _, t, _ in rows[:40]:
        hits = [(x, f) for k, w in enumerate(t.split()) for x in m.found(w) for f in [0.25 if m.reporting & set(t.split()[max(0, k - 5) : k + 6]) - {w} else 1.5 if m.address & set(t.split()[max(0, k - 5) : k + 6]) - {w} else 1.0]]
        exact, fuzzy = (sum(x[1] * f for x, f in hits if x[2] == bad) for bad in (False, True))
        want = [1, math.log1p(exact), math.log1p(1000 * exact / (len(t.split()) + 20)), math.log1p(fuzzy), math.log1p(len({x[0] for x, _ in hits})), max([x[1] * f for x, f in hits], default=0)]
        x = m.features(t)[0].tolist()
        assert [round(v, 9) for v in x] == [round(v, 9) for v in want]
        assert m.score(m.features(t)[0]) == 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(x, m.weights))))))


def test_long_quotations_and_better_supported_hits():
    m = Toxicity({t: 1.0 for t in SEED_TERMS}, {"stupi": 0.2, "idio": 2.0}, frozenset(), None)
    factor = lambda t: [h[4] for h in m.hits(t)[0]]
    filler = "and so it went on " * 200
    assert factor(f'a sign: "{filler} idiot {filler}" then idiot') == [0.25, 1.0]
    assert factor(f'an open " mark {filler} idiot\n{filler}"') == [1.0]
    assert m.look("stupld") is not None and m.look("stupild") == ("stupid", 1.0, True)
    assert m.look("idiott") == ("idio*", 2.0, False)
