"""Streams: the attempt journal and the landing folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def journal_state(attempts: DataFrame, watermark: str | None = None) -> DataFrame:
    """rec_id, state (of the latest attempt by ts, then event_id), n_attempts; for batches and, in update mode, streams.

    Without a watermark the state store keeps every record for ever; with one, records that see no
    attempt for longer than it are still kept, but late attempts are dropped.
    """
    if watermark and attempts.isStreaming:
        attempts = attempts.withWatermark("ts", watermark)
    return attempts.groupBy("rec_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_attempts"))


def register_batch(batch: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(file, hash, state) of new files: known hashes, and all but the first of a hash within the batch, are duplicates.

    A row without content, or one that could not be read (a non-null _corrupt_record), is registered in
    state erro without a hash: no row is lost.
    """
    bad = F.col("content").isNull()
    if "_corrupt_record" in batch.columns:
        bad = bad | F.col("_corrupt_record").isNotNull()
    h = batch.select("file", F.when(~bad, F.sha2("content", 256)).alias("hash"))
    first = h.where("hash is not null").groupBy("hash").agg(F.min("file").alias("first"))
    j = h.join(first, "hash", "left").join(catalogue.where("hash is not null").select("hash", F.lit(True).alias("known")).distinct(), "hash", "left")
    state = F.when(F.col("hash").isNull(), "erro").when(F.coalesce("known", F.lit(False)) | ~F.col("first").eqNullSafe(F.col("file")), "duplicado").otherwise("registrado")
    return j.select("file", "hash", state.alias("state"))


def _first_seen(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows (file, known) of one content: the first by name is registered, unless the content was seen before; one name is held at a time."""
    seen, held = state.exists, None
    out = lambda files, what: pd.DataFrame({"file": files, "hash": None if key[0].startswith("!") else key[0], "state": what})
    waiting: list[pd.DataFrame] = []
    for part in rows:
        if key[0].startswith("!"):
            yield out(part["file"], "erro")
            continue
        seen = seen or bool(part["known"].any())
        files = sorted(part.loc[~part["known"], "file"], key=lambda f: (f is None, f))
        if not files:
            continue
        if held is None:
            held, files = files[0], files[1:]
        elif (files[0] is None, files[0]) < (held is None, held):
            held, files = files[0], [held, *files[1:]]
        if files:
            yield out(files, "duplicado")
    if key[0].startswith("!"):
        return
    if held is not None:
        waiting.append(out([held], "duplicado" if seen else "registrado"))
    if not state.exists:
        state.update((True,))
    yield from waiting


def landing_states(landing: DataFrame, known: DataFrame) -> DataFrame:
    """file, hash, state of landed rows (file, content, perhaps _corrupt_record), streams or batches of streams.

    State is kept by content hash, so nothing is read again: known (hash) is a second stream that is there with the first
    batch. Contents are hashed before rows are grouped, so only names and hashes are shuffled. A row without content, or one that
    could not be read, is registered in state erro without a hash, each for itself.
    """
    bad = F.col("content").isNull()
    if "_corrupt_record" in landing.columns:
        bad = bad | F.col("_corrupt_record").isNotNull()
    alone = F.concat(F.lit("!"), F.xxhash64(*landing.columns).cast("string"))
    rows = landing.select("file", F.when(bad, alone).otherwise(F.sha2("content", 256)).alias("hash"), F.lit(False).alias("known"))
    seeds = known.where("hash is not null").select(F.lit(None).cast("string").alias("file"), "hash", F.lit(True).alias("known"))
    return rows.unionByName(seeds).groupBy("hash").applyInPandasWithState(_first_seen, "file string, hash string, state string", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_landing(spark: SparkSession, path: str, schema: str, catalogue: str, checkpoint: str, sink: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Takes new files of (file, content) rows from a folder into the catalogue table (parquet at a path), once each.

    The hashes that the catalogue has when the stream first starts are written once beside the checkpoint and seed the
    state; from then on the state alone tells what is known, and no batch reads the catalogue. The checkpoint makes it resume; a
    batch that is repeated after a failure writes the same folder again, so the catalogue gets each batch once.
    """
    seed = checkpoint.rstrip("/") + "-seed"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{seed}/_SUCCESS")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        held = spark.read.schema("file string, hash string, state string").option("recursiveFileLookup", True).parquet(catalogue)
        held.where("hash is not null").select("hash").distinct().write.mode("overwrite").parquet(seed)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{catalogue}/batch-{number}")
        if sink:
            sink(spark.read.schema(batch.schema).parquet(f"{catalogue}/batch-{number}"))

    stream = spark.readStream.schema(schema + ", _corrupt_record string").option("maxFilesPerTrigger", 100).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    states = landing_states(stream, spark.readStream.schema("hash string").parquet(seed))
    return states.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
