"""The registered queries and how their results are printed."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def printed(df: DataFrame, digits: int = 6, dyadic=()) -> DataFrame:
    """Doubles rounded, dates as text, integer types as long, so that results compare across engines.

    Columns in `dyadic` hold sums of powers of two, which often end in an exact 5: they are moved off the rounding tie.
    """
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c + F.lit(1e-9 if name in dyadic else 0.0), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def joined(a: Column, digits: int | None = None) -> Column:
    """An array as one text."""
    each = (lambda x: F.round(x, digits).cast("decimal(38,6)").cast("string")) if digits is not None else (lambda x: x.cast("string"))
    return F.array_join(F.transform(a, each), ",")
