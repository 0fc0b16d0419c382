"""Several outputs of one run as a committed set: all of them are there, or none.

Tables are staged under names that no reader looks for; a marker, put in place by one rename, names them. Readers take the tables that
markers name. A run that is repeated finds its marker and changes nothing; one that failed before its marker
stages new tables, and what it left is read by nobody.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from recordspark.operators.workflow import reconcile_queue, reopen_attempts


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def committed(spark: SparkSession, root: str, run: str) -> dict[str, str] | None:
    """Paths by name of a run's tables; None if it was not committed."""
    fs, marker = _fs(spark, f"{root}/_commits/{run}.json")
    return json.loads(spark.read.text(str(marker), wholetext=True).first()[0]) if fs.exists(marker) else None


def commit_set(root: str, run: str, outputs: dict[str, DataFrame]) -> dict[str, str]:
    """Writes the outputs and then the marker that names them; a run that has its marker is left as it is."""
    spark = next(iter(outputs.values())).sparkSession
    done = committed(spark, root, run)
    if done is not None:
        return done
    attempt = uuid.uuid4().hex
    paths = {name: f"{root}/{name}/{run}-{attempt}" for name in outputs}
    for name, df in outputs.items():
        df.write.parquet(paths[name])
    fs, marker = _fs(spark, f"{root}/_commits/{run}.json")
    _, staged = _fs(spark, f"{root}/_commits/.{run}-{attempt}")
    fs.mkdirs(marker.getParent())
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(paths).encode()))
    out.close()
    if not fs.rename(staged, marker):  # another attempt of the same run came first
        fs.delete(staged, False)
    return committed(spark, root, run)


def read_committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of a table by that name over the committed runs; none gives no rows."""
    fs, folder = _fs(spark, f"{root}/_commits")
    found = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    runs = sorted(n.removesuffix(".json") for n in found if n.endswith(".json") and not n.startswith("."))
    paths = [p for p in (committed(spark, root, r).get(name) for r in runs) if p]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def retired(decided: DataFrame) -> DataFrame:
    """rec_id of the records that reconcile_queue() takes out of the queue."""
    return decided.where("change = 'retired'").select("rec_id")


def archived_attempts(decided: DataFrame, journal: DataFrame, why: str = "change", of: tuple[str, ...] = ("reset", "reopened")) -> DataFrame:
    """The journal's rows of records that start afresh, and why: they go to the archive, so that they no longer count."""
    again = decided.where(decided[why].isin(*of)) if of else decided
    return journal.join(again.select("rec_id", again[why].alias("archived_for")), "rec_id")


def reconcile_and_commit(root: str, run: str, queue: DataFrame, eligible: DataFrame, journal: DataFrame) -> dict[str, str]:
    """Queue, retired records and archived attempts of one reconciliation, committed together."""
    decided = reconcile_queue(queue, eligible, journal)
    return commit_set(root, run, {"queue": decided.where("change <> 'retired'"), "retired": retired(decided), "archived": archived_attempts(decided, journal)})


def reopen_and_commit(root: str, run: str, queue: DataFrame, journal: DataFrame) -> dict[str, str]:
    """Reopened records and their old attempts, committed together."""
    again = reopen_attempts(queue, journal)
    return commit_set(root, run, {"reopened": again, "archived": archived_attempts(again, journal, "reason", ())})
