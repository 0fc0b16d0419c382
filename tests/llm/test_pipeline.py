"""The pipeline's stages keep clean documents, drop planted ones and pass columns on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordspark.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(8)
    words = ["the", "river", "runs", "past", "old", "mills", "and", "fields", "of", "wheat"] + ["word%d" % k for k in range(300)]
    text = lambda n=120: " ".join(rng.choices(words, k=n))
    passage = text(40)
    docs = {k: text() for k in range(160)}
    for k in range(160, 180):
        docs[k] = " ".join(w + rng.choice(["###", "$$$"]) for w in text().split())
    for k in range(180, 200):
        docs[k] = " ".join(rng.choice([w, w, w, "idiot", "moron"]) for w in text().split())
    docs[200], docs[201] = docs[3], " ".join([*docs[4].split()[:-1], "other"])
    docs[202] = docs[5][:300] + " " + passage + " " + docs[6][:300]
    where = tmp_path_factory.mktemp("corpus")
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    save([(k, t, "en", f"s{k % 3}", len(t)) for k, t in docs.items()] + [(300, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(k, int(not 160 <= k < 180), int(180 <= k < 200)) for k in range(0, 200, 2)], "doc_id long, quality int, toxic int", "labels")
    save([(1, passage)], "item_id long, text string", "benchmark")
    return str(where), docs


def test_run(spark, corpus):
    where, docs = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    want = set(range(160))
    assert len(want - set(got)) <= 2 and set(got) - want <= {300}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for k, r in got.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(docs.get(k, ""), add_special_tokens=False).ids


def test_stages_return_documents(spark, corpus):
    where, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), where).count() == 0


def test_run_is_the_stages_in_turn(spark, corpus):
    where, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = {r.doc_id for r in stage(spark, spark.createDataFrame(kept, docs.schema), where).collect()}
        kept = [r for r in kept if r["doc_id"] in out]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, where).collect()) == sorted(r["doc_id"] for r in kept)


def test_odd_rows_and_columns(spark, corpus):
    where, texts = corpus
    long = " ".join(texts[k] for k in range(0, 150)) * 12  # over a million characters
    rows = [(None, texts[7], None, None, None), (400, None, None, None, None), (401, "", "en", "s", 0), (402, long, "en", "s", len(long)), (403, "\x00 \ud7ff 漢字", "zh", None, 1), (7, texts[7], "en", "s", 1), (7, texts[7], "en", "s", 1)]
    clash = {"id": F.lit("x"), "t": F.lit(1), "body": F.lit("y"), "_y": F.lit(2), "_text": F.lit("z"), "gone": F.lit(3), "n": F.lit(4), "node": F.lit(5), "component": F.lit(6), "known": F.lit(None).cast("string")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns, name
        if name not in ("quality classifier",):  # which draws
            got = [r.doc_id for r in out.collect()]
            assert {400, 401, 402, 403} <= set(got) and got.count(7) == 2, name
            assert got.count(None) == 1, name
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()}
    assert len(last) == 6 and last[400].n_tokens == last[401].n_tokens == 0 and last[402].n_tokens > 100_000


def test_without_labels_and_benchmark(spark, corpus, tmp_path):
    where, texts = corpus
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet").where("doc_id between 100 and 199")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["benchmark decontamination"](spark, docs, str(tmp_path)).count() == 100
    left = {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert left == set(range(100, 180))  # the seed terms alone
    assert stages["quality classifier"](spark, docs, str(tmp_path)).count() > 0
    corpus_pipeline.run(spark, str(tmp_path)).collect()
