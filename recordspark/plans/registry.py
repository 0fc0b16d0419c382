"""Queries and their SQL by name, filled by the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under a name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Tables whose rows are long texts: work on them should not be bound to the row groups of one file.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    """A given table. A table of texts that is one file, which as few tasks read as it has row groups, is dealt out to all cores, unless little of it is used."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if deal and name in TEXTS and len(df.inputFiles()) == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def run(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Spark SQL over given tables: fixtures that both engines derive with the same text."""
    return spark.sql(sql.format(**{n: "{" + n + "}" for n in names}), **{n: table(spark, sf_dir, n) for n in names})
