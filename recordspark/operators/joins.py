"""Equi-joins that a few very frequent keys can't bring into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: A key with more than one in SHARE of the rows is hot, so there are fewer than SHARE of them; its rows are dealt over SALTS.
SHARE, SALTS = 1000, 64


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts)


def frequent_keys(rows: DataFrame, keys: list[str], share: int = SHARE) -> list[Row]:
    """keys with more than one in `share` of the rows (nulls not counted), fewer than `share` of them: counted by map-side sums."""
    counts = rows.where(_all(F.col(k).isNotNull() for k in keys)).groupBy(*keys).agg(F.count("*").alias("n_"))
    most = counts.orderBy(F.desc("n_")).limit(share).agg(F.collect_list(F.struct(*keys, "n_")).alias("top")).crossJoin(counts.agg(F.sum("n_").alias("t")))
    r = most.first()  # one row, of at most `share` keys
    return [x[:-1] for x in r["top"] if x["n_"] * share > r["t"]]


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE, salts: int = SALTS) -> DataFrame:
    """left joined with right on equal keys (inner, or left to keep rows of left without a match), as a plain join would give.

    Keys that are frequent in left are found first; only this list, of fewer than `share` keys, is broadcast. Left
    rows of a frequent key take one of `salts` numbers, right rows of such a key are copied to each of them, all other rows
    have number 0, and one shuffle join by key and number does the rest. Null keys match nothing, and in a left join
    are dealt over the numbers too. Columns are left's, then right's without the keys. left is read twice (counts, then the
    join): write it to a table first where it is costly.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    if how == "inner":
        left = left.where(_all(F.col(k).isNotNull() for k in keys))
    hot = frequent_keys(left, keys, share)
    if not hot and how == "inner":
        return left.join(right, keys).select(*columns)
    mark, salt = "hot_", "salt_"
    while mark in columns or salt in columns:
        mark, salt = mark + "_", salt + "_"
    table = F.broadcast(left.sparkSession.createDataFrame([(*k, True) for k in hot], StructType([*left.select(*keys).schema, StructField(mark, BooleanType())])))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    null = ~_all(F.col(k).isNotNull() for k in keys)
    dealt = left.join(table, keys, "left").withColumn(salt, F.when(F.col(mark) | null, spread).otherwise(0)).drop(mark)
    every = F.sequence(F.lit(0), F.when(F.col(mark), F.lit(salts - 1)).otherwise(0))
    copied = right.join(table, keys, "left").withColumn(salt, F.explode(every)).drop(mark)
    return dealt.join(copied, [*keys, salt], how).select(*columns)
