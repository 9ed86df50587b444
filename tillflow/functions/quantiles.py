"""Exact order statistics without sorting a column on one task.

A value gets a coarse key that keeps its order (2**12 steps per power of two), and a fine key that keeps the order of the values of one
coarse key (2**32 steps). Totals per coarse key are a small table however long the column is: ranks and prefix sums are located among
these, then among the fine keys of one coarse key, and finished inside one fine key, in parallel. Values that crowd into one coarse key
therefore spread over tasks like others.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.joins import join_groups
from tillflow.functions.literals import literal_doubles

STEPS_PER_OCTAVE = 4096


def order_key(value: Column) -> Column:
    """Integer that never decreases when `value` grows. At most 2**24 keys exist, a few thousand are usual."""
    size = (F.floor(F.log2(F.abs(value)) * STEPS_PER_OCTAVE) + F.lit(1 << 23)).cast("long")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def fine_key(value: Column, key: Column) -> Column:
    """Integer that never decreases when `value` grows among the values of one order_key."""
    # size relative to the lower end of the coarse key: 1 up to 1.00017
    relative = F.abs(value) * F.pow(F.lit(2.0), -(F.abs(key) - F.lit(1 << 23)) / STEPS_PER_OCTAVE)
    step = F.floor((relative - 1) * F.lit(float(1 << 32)) / F.lit(2.0 ** (1 / STEPS_PER_OCTAVE) - 1)).cast("long")
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0).cast("long"))


def _located(cells: DataFrame, keys: list, name: str) -> DataFrame:
    """Of (keys, name, _m, _ranks) cells those that hold some of the ranks, which count from 0 inside `keys`; _left: the ranks inside the cell."""
    along = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    start = cells.withColumn("_start", F.coalesce(F.sum("_m").over(along), F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r["left"] >= F.col("_start")) & (r["left"] < F.col("_start") + F.col("_m")))
    shifted = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("_start")).alias("left")))
    return start.select(*keys, name, shifted.alias("_ranks")).where(F.size("_ranks") > 0)


def exact_quantiles(df: DataFrame, value: str, probs, by=(), weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles: one row per group, array `q` in the order of `probs`, and the count `n`.

    Equal values are merged before anything is shuffled, so a value that fills a third of the rows costs one row.
    `weight` names a column of whole-number repetitions.
    """
    by, probs = list(by), [float(p) for p in probs]
    merged = (df.where(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).cast("double").alias("_v"))
              .agg((F.count("*") if weight is None else F.sum(weight)).alias("_m"))
              .withColumn("_key", order_key(F.col("_v"))))
    per_group = Window.partitionBy(*by)
    along = per_group.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    keys = (merged.groupBy(*by, "_key").agg(F.sum("_m").alias("_m"))
            .withColumn("_start", F.coalesce(F.sum("_m").over(along), F.lit(0))).withColumn("n", F.sum("_m").over(per_group)))
    # a coarse key looks only at the quantiles whose place can lie in it, not at the whole list
    listed, top = literal_doubles(sorted(set(probs))), len(set(probs))
    last = F.greatest(F.col("n") - 1, F.lit(1))
    low, high = (F.col("_start") - 1) / last, (F.col("_start") + F.col("_m")) / last
    edges = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(top))
    if top > 64:                                                             # equal steps are usual: guess the slice, widen it by what the steps differ
        step = max(b - a for a, b in zip(sorted(set(probs)), sorted(set(probs))[1:]))
        least = max(min(b - a for a, b in zip(sorted(set(probs)), sorted(set(probs))[1:])), 1e-9)
        first, most = edges(F.floor(low / step).cast("int") - 2), edges(F.ceil(high / least).cast("int") + 3)
        near = F.slice(listed, first + 1, F.greatest(most - first, F.lit(0)))
    else:
        near = listed
    near = F.filter(near, lambda p: (p >= low - 1e-9) & (p <= high + 1e-9))
    ranks = F.array_distinct(F.flatten(F.transform(near, lambda p: F.array(F.floor(p * (F.col("n") - 1)).cast("long"), F.ceil(p * (F.col("n") - 1)).cast("long")))))
    own = F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_m")))
    keys = keys.withColumn("_ranks", F.transform(own, lambda r: F.struct(r.alias("rank"), (r - F.col("_start")).alias("left")))).where(F.size("_ranks") > 0)
    rows = join_groups(merged, keys.select(*by, "_key", "n", "_ranks"), [*by, "_key"]).withColumn("_fine", fine_key(F.col("_v"), F.col("_key")))
    cells = rows.groupBy(*by, "_key", "_fine").agg(F.sum("_m").alias("_m"), F.first("_ranks").alias("_ranks"))
    fine = _located(cells, [*by, "_key"], "_fine")
    hits = _located(join_groups(rows.drop("_ranks"), fine, [*by, "_key", "_fine"]).withColumn("_w", F.struct("_v", "n")), [*by, "_key", "_fine"], "_w")
    # two entries per wanted quantile at most
    found = hits.select(*by, F.col("_w.n").alias("n"), F.explode(F.col("_ranks.rank")).alias("_rank"), F.col("_w._v").alias("_v")).groupBy(*by).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    at = lambda x: F.element_at("_at", x.cast("long"))
    place = lambda p: p * (F.col("n") - 1)
    q = F.transform(literal_doubles(probs), lambda p: at(F.floor(place(p))) + (at(F.ceil(place(p))) - at(F.floor(place(p)))) * (place(p) - F.floor(place(p))))
    return found.select(*by, "n", q.alias("q"))


def running_totals(df: DataFrame, order: str, sums, by=(), descending: bool = False) -> DataFrame:
    """Inclusive prefix sums of the columns `sums` along `order`, within groups `by`.

    One row per (by, order) is expected. Totals of the coarse keys are scanned first, then those of the fine keys of every coarse key,
    then every fine key on its own, so no task holds a whole group however many distinct values it has and wherever they crowd.
    """
    by, direction = list(by), F.desc if descending else F.asc
    keyed = df.withColumn("_key", order_key(F.col(order))).withColumn("_fine", fine_key(F.col(order), F.col("_key")))
    fine = keyed.groupBy(*by, "_key", "_fine").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    coarse = fine.groupBy(*by, "_key").agg(*[F.sum(f"_t_{s}").alias(f"_t_{s}") for s in sums])

    def before(totals, keys, name, out):
        earlier = Window.partitionBy(*keys).orderBy(direction(name)).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, name, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"{out}{s}") for s in sums])

    keys = [*by, "_key"]
    offsets = join_groups(before(fine, keys, "_fine", "_o_"), before(coarse, by, "_key", "_p_"), keys)
    inside = Window.partitionBy(*keys, "_fine").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (join_groups(keyed, offsets, [*keys, "_fine"])
            .withColumns({f"cum_{s}": F.col(f"_p_{s}") + F.col(f"_o_{s}") + F.sum(s).over(inside) for s in sums})
            .drop("_key", "_fine", *[f"_o_{s}" for s in sums], *[f"_p_{s}" for s in sums]))
