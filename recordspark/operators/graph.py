"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.functions.tables import delete, new_path, written
from recordspark.operators.joins import heavy_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, group: the smallest node reachable, for every node of a link between two different nodes.

    Large-star and small-star steps by turns until all links are stars: each node's smallest neighbour is an
    aggregate with partial minima and goes back by a heavy join, so a hub is no single task's work. The
    steps grow with the logarithm of the nodes; each one is a table in the shared folder, and the one before it is deleted.
    Links with a null end say nothing.
    """
    spark = links.sparkSession
    both_ways = lambda e: e.unionAll(e.selectExpr("v u", "u v"))
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    path = new_path(spark, "components")
    e, gone = written(ends.distinct(), path), path
    while True:
        state = both_ways(e.select("u", "v")).join(e.select(F.col("u").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").groupBy("u")
        mixed = state.agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m <> x or x > u").limit(1).count()
        if not mixed:
            break
        around = both_ways(e)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = heavy_join(around, least, ["u"]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = heavy_join(large, least, ["u"]).where("v <> m").selectExpr("v u", "m v").unionAll(least.selectExpr("u", "m v")).distinct()
        path = new_path(spark, "components")
        e, before = written(small, path), gone
        gone = path
        delete(spark, before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("group")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())
