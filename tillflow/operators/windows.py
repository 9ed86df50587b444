"""Last-X+1 windows: one row per customer, `steps` oldest first, the last step is the target.

steps: ARRAY<STRUCT<code INT, date DATE, amount DOUBLE>>
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import class_name, distinct_codes, hash_uniform
from tillflow.settings import DEFAULTS
from tillflow.sources.tables import rank_in_customer


FIELDS = ("code", "date", "amount")


def recent_steps(tx: DataFrame, keep: int, fields=FIELDS) -> DataFrame:
    """The last `keep` purchases of every customer as one array, or all of them where there are fewer.

    `fields` limits what a step carries: models that read classes only need not shuffle dates and amounts.
    """
    names = ", ".join(fields)
    back = ", ".join(f"'{f}', x.{f}" for f in fields)
    return (rank_in_customer(tx, keep).groupBy("customer_id")
            .agg(F.expr(f"array_sort(collect_list(struct(-rn AS o, {names})))").alias("s"))
            .selectExpr("customer_id", f"transform(s, x -> named_struct({back})) AS steps"))


def with_window_columns(df: DataFrame, fields=FIELDS) -> DataFrame:
    """Split `steps` into the inputs and the target."""
    inputs, target = "slice(steps, 1, size(steps) - 1)", "element_at(steps, -1)"
    parts = {"codes": f"transform({inputs}, s -> s.code)", "target": f"{target}.code"}
    if "date" in fields:
        parts |= {"dates": f"transform({inputs}, s -> s.date)", "target_date": f"{target}.date"}
    if "amount" in fields:
        parts["amounts"] = f"transform({inputs}, s -> s.amount)"
    df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in parts.items()])
    return df.withColumn("ground_truth", class_name(F.col("target")))


def last_windows(tx: DataFrame, length: int, fields=FIELDS) -> DataFrame:
    """customer_id, length, steps and their parts, for customers with at least length + 1 purchases. No padding."""
    full = recent_steps(tx, length + 1, fields).where(F.size("steps") == length + 1)
    return with_window_columns(full.withColumn("length", F.lit(length)), fields)


def windows_at(tx: DataFrame, lengths=DEFAULTS.lengths, fields=FIELDS) -> DataFrame:
    """Windows of several lengths from one ranking: the longest window is cut, the history is not ranked again."""
    longest = recent_steps(tx, max(lengths) + 1, fields)
    listed = ", ".join(map(str, lengths))
    each = longest.selectExpr("*", f"explode(filter(array({listed}), x -> x < size(steps))) AS length")
    return with_window_columns(each.withColumn("steps", last_steps(F.col("steps"), F.col("length") + 1)), fields)


def last_steps(steps: Column, keep: Column) -> Column:
    return F.slice(steps, F.size(steps) - keep + 1, keep)


def variable_windows(tx: DataFrame, lo: int, hi: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """One window per customer whose length is drawn uniformly from lo .. min(hi, purchases - 1)."""
    df = recent_steps(tx, hi + 1).where(F.size("steps") >= lo + 1)
    choices = F.size("steps") - F.lit(lo)                     # the array never holds more than hi + 1 steps
    u = hash_uniform(f"{seed}:length", F.col("customer_id"))
    df = df.withColumn("length", (F.lit(lo) + F.floor(u * choices)).cast("int"))
    return with_window_columns(df.withColumn("steps", last_steps(F.col("steps"), F.col("length") + 1)))


def window_shape(windows: DataFrame) -> DataFrame:
    """Add the days from the first input to the target and the number of distinct input classes."""
    return windows.withColumns({
        "span_days": F.datediff("target_date", F.get("dates", F.lit(0))), "distinct_inputs": distinct_codes(F.col("codes"))})
