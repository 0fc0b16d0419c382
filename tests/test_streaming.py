"""Streams give what the batch gives."""

import json

from recordspark.streaming.journal import ingest_landing, journal_state


def test_journal_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id rec_id", "event_type state", "ts", "event_id")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = journal_state(stream).writeStream.outputMode("complete").format("memory").queryName("journal").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("journal").collect())) == sorted(map(tuple, journal_state(events).collect()))


def test_landing_registers_each_content_once(spark, tmp_path):
    for d in ("in", "cat"):
        (tmp_path / d).mkdir()
    put = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"file": f, "content": c}) + "\n" for f, c in rows))
    run = lambda: ingest_landing(spark, str(tmp_path / "in"), "file string, content string", str(tmp_path / "cat"), str(tmp_path / "cp")).awaitTermination(120)
    put(1, [("a", "one"), ("b", "one"), ("c", "two")])
    run()
    put(2, [("d", "two"), ("e", "three")])
    (tmp_path / "in" / "3.json").write_text("not json\n")
    run()
    put(4, [("f", None)])
    run()
    every = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "cat")).collect()
    assert sorted((r.file or "", r.hash) for r in every if r.state == "erro") == [("", None), ("f", None)]  # no row is lost
    rows = [r for r in every if r.state != "erro"]
    assert {r.file: r.state for r in rows} == {"a": "registrado", "b": "duplicado", "c": "registrado", "d": "duplicado", "e": "registrado"}


def test_landing_is_seeded_once_and_reads_no_catalogue(spark, tmp_path):
    for d in ("in", "cat"):
        (tmp_path / d).mkdir()
    earlier = spark.createDataFrame([("old", __import__("hashlib").sha256(b"one").hexdigest(), "registrado"), ("bad", None, "erro")], "file string, hash string, state string")
    earlier.write.parquet(str(tmp_path / "cat" / "before"))
    put = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"file": f, "content": c}) + "\n" for f, c in rows))
    plans, given = [], []

    def sink(out):
        given.append({r.file: r.state for r in out.collect()})

    def run():
        q = ingest_landing(spark, str(tmp_path / "in"), "file string, content string", str(tmp_path / "cat"), str(tmp_path / "cp"), sink)
        q.awaitTermination(120)
        plans.append(q._jsq.explainInternal(True) if hasattr(q._jsq, "explainInternal") else "")

    put(1, [("a", "one"), ("c", "two"), ("b", "two"), ("d", "two"), ("x", None), ("y", None)])
    run()
    put(2, [("e", "two"), ("f", "three")])
    run()
    seen = {k: v for g in given for k, v in g.items()}
    assert seen == {"a": "duplicado", "b": "registrado", "c": "duplicado", "d": "duplicado", "x": "erro", "y": "erro", "e": "duplicado", "f": "registrado"}
    assert not any("/cat" in p for p in plans)
