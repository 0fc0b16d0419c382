"""Similarity of two strings by matching blocks, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None) -> float:
    """Twice the characters in matching blocks over all characters: the longest common block first, then the same left and right of it.

    Two empty strings are equal; a null is empty. Frequent characters of strings above 200 characters count like others.
    """
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def sequence_ratio(a: Column, b: Column) -> Column:
    """Column of ratio(), worked out once for each different pair of a batch; for names and titles, after a join has paired them."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        return pd.Series([known.setdefault(p, ratio(*p)) if p not in known else known[p] for p in zip(x.where(x.notna(), ""), y.where(y.notna(), ""))], dtype="float64")

    return run(a, b)
