"""Joins on group keys that may be null."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on `keys`, a null key (the length of length-free models) being equal to a null key. Still an equi-join."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return a.join(b, same, how).drop(*[f"_r_{c}" for c in keys])
