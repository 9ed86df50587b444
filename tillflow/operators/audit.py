"""Numbers in texts that no result table holds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.settings import DEFAULTS
from tillflow.sources.session import durable

# ---- fixed value: a decimal that is not part of a word or of a longer number (sign and minus sign U+2212 allowed) ----
NUMBER = "(?U)(?<![\\w.])([-+−]?\\d*\\.\\d+)(?![\\w.])"
DECIMALS = (1, 2, 3, 4)
HEAVY_SHARE = 10_000               # a number is heavy from this part of all occurrences on, so there are no more heavy numbers than this
HEAVY_LEAST = 10_000


def known_values(results: DataFrame) -> DataFrame:
    """(decimals, value): every finite number of the result table, absolute, rounded to one to four decimals."""
    numeric = [c for c, t in results.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    numbers = results.select(F.explode(F.array(*[F.abs(F.col(f"`{c}`").cast("double")) for c in numeric])).alias("x"))
    finite = numbers.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("x") < F.lit(float("inf")))).distinct()
    rounded = F.array(*[F.struct(F.lit(d).alias("decimals"), F.bround("x", d).alias("value")) for d in DECIMALS])
    return finite.select(F.inline(rounded)).distinct()


def numbers_in(texts: DataFrame, text: str, keys, ignore=DEFAULTS.trace_ignore) -> DataFrame:
    """(keys, number, decimals, value) for every decimal of one to four places in the texts, ignored numbers left out."""
    raw = F.explode(F.regexp_extract_all(text, F.lit(NUMBER), 1)).alias("found")
    df = texts.select(*keys, raw).withColumn("number", F.regexp_replace("found", "^[-+−]", ""))
    df = df.withColumn("decimals", F.length(F.substring_index("number", ".", -1)))
    return (df.where(~F.col("number").isin(*ignore) & F.col("decimals").isin(*DECIMALS))
            .select(*keys, "number", "decimals", F.col("number").cast("double").alias("value")))


def trace_numbers(texts: DataFrame, text: str, keys, results: DataFrame, ignore=DEFAULTS.trace_ignore) -> DataFrame:
    """Occurrences of numbers that the result table does not hold.

    The texts are searched once. Distinct numbers, with their counts, meet the known values. A number with a large part of all
    occurrences is settled where its occurrences lie, against the list of such numbers, which is short whatever the texts hold; only the
    other occurrences travel by number.
    """
    found, number = durable(numbers_in(texts, text, keys, ignore)), ["decimals", "value"]
    counts = durable(found.groupBy(*number).agg(F.count("*").alias("_n")).join(known_values(results).withColumn("_known", F.lit(True)), number, "left"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(HEAVY_LEAST, total // HEAVY_SHARE)
    heavy = F.broadcast(counts.where(F.col("_n") > limit).select(*number, F.coalesce("_known", F.lit(False)).alias("_known")))
    light = counts.where((F.col("_n") <= limit) & F.col("_known")).select(*number)
    apart = found.join(heavy, number, "left_anti").join(light, number, "left_anti")
    return apart.unionByName(found.join(heavy.where(~F.col("_known")), number, "left_semi")).select(*keys, "number", "decimals")
