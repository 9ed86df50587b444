"""Short driver-made lists as DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_doubles(values) -> Column:
    """A list of numbers as one array, however long: a single literal in the plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def literal_rows(spark: SparkSession, rows, names) -> DataFrame:
    """A few rows of Python values as a one-partition table of literals (nothing is shipped through Python workers)."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
