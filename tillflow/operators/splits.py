"""Reproducible draws of customers and the split recipe of both institutions.

A draw orders ids by an md5 of seed and id and takes the first n. The position of the cut comes from a histogram of
the first four hash digits (65,536 rows at most), so no task sorts the whole list.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import draw_hash
from tillflow.functions.literals import literal_rows
from tillflow.operators.cohort import eligible_customers
from tillflow.settings import DEFAULTS
from tillflow.sources.session import durable


def draw(ids: DataFrame, n: int | None = None, seed=DEFAULTS.seed, fraction: float | None = None) -> DataFrame:
    """`n` ids (or the ceiling of a fraction of them), uniformly and without replacement; all if there are fewer."""
    if n is None and fraction is None:
        return ids.select("customer_id")
    hashed = (ids.select("customer_id").withColumn("_h", draw_hash(seed, F.col("customer_id")))
              .withColumn("_b", F.substring("_h", 1, 4)))
    buckets = Window.orderBy("_b")                                     # over the histogram, not over the ids
    cuts = (hashed.groupBy("_b").agg(F.count("*").alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    wanted = F.lit(n) if n is not None else F.ceil(F.lit(fraction) * F.col("_total"))
    cuts = cuts.withColumn("_left", wanted - F.col("_before")).where(F.col("_left") > 0)
    kept = hashed.join(F.broadcast(cuts.select("_b", "_n", "_left")), "_b")
    whole = kept.where(F.col("_left") >= F.col("_n"))
    order = Window.partitionBy("_b").orderBy("_h", "customer_id")      # one bucket of 65,536
    cut = kept.where(F.col("_left") < F.col("_n")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_left"))
    return whole.select("customer_id").unionByName(cut.select("customer_id"))


def draw_excluding(ids: DataFrame, n: int | None, exclude: DataFrame, seed=DEFAULTS.seed) -> DataFrame:
    rest = ids.select("customer_id").join(exclude.select("customer_id"), "customer_id", "left_anti")
    return draw(rest, n, seed)


def train_val_split(ids: DataFrame, val_fraction: float = DEFAULTS.val_fraction, seed=DEFAULTS.seed) -> DataFrame:
    """(customer_id, split): validation is the ceiling of the fraction, the rest trains."""
    val = draw(ids, seed=f"{seed}:val", fraction=val_fraction).withColumn("_val", F.lit(True))
    return (ids.select("customer_id").join(val, "customer_id", "left")
            .select("customer_id", F.when(F.col("_val"), "val").otherwise("train").alias("split")))


def _tag(ids: DataFrame, bank: str, split: str) -> DataFrame:
    return ids.select("customer_id", F.lit(bank).alias("bank"), F.lit(split).alias("split"))


def prepare_splits(tx_a: DataFrame, profiles_a: DataFrame | None, tx_b: DataFrame, profiles_b: DataFrame | None,
                   dev_ids: DataFrame, exclude: DataFrame, pool_size: int = DEFAULTS.train_pool,
                   in_bank_test: int = DEFAULTS.in_bank_test, val_fraction: float = DEFAULTS.val_fraction,
                   seed: int = DEFAULTS.seed) -> DataFrame:
    """(customer_id, bank, split) of the whole recipe.

    Bank A: a pool is drawn and cut into train and val; bank_a_test comes from the customers not drawn. Bank B: dev is
    the eligible part of an earlier list, confirm is every eligible customer not used before, unfiltered drops the
    diversity filter. Eligible ids are written once, because every draw reads them again.
    """
    ids_a = durable(eligible_customers(tx_a, profiles_a))
    pool = durable(draw(ids_a, pool_size, seed))
    parts = train_val_split(pool, val_fraction, seed)
    test_a = draw_excluding(ids_a, in_bank_test, pool, f"{seed}:test")
    b = durable(eligible_customers_by_rule(tx_b, profiles_b))
    ids_b = b.where("strict")
    dev = ids_b.join(dev_ids.select("customer_id"), "customer_id", "left_semi")
    used = exclude.select("customer_id").unionByName(dev.select("customer_id")).distinct()
    return (parts.select("customer_id", F.lit("bank_a").alias("bank"), "split")
            .unionByName(_tag(test_a, "bank_a", "bank_a_test"))
            .unionByName(_tag(dev, "bank_b", "bank_b_dev"))
            .unionByName(_tag(draw_excluding(ids_b, None, used), "bank_b", "bank_b_confirm"))
            .unionByName(_tag(draw_excluding(b, None, used), "bank_b", "bank_b_unfiltered")))


def eligible_customers_by_rule(tx: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Active customers with the flag `strict`: passes the diversity filter. One ranking serves both rules."""
    from tillflow.operators.cohort import recent_diversity

    ids = recent_diversity(tx).where("active").select("customer_id", (F.col("input_classes") >= DEFAULTS.min_distinct).alias("strict"))
    return ids if profiles is None else ids.join(profiles.select("customer_id"), "customer_id", "left_semi")


def prepare_splits_earlier_rule(tx_a, profiles_a, tx_b, profiles_b, pool_size: int = DEFAULTS.train_pool,
                                n_test: int = DEFAULTS.earlier_test, val_fraction: float = DEFAULTS.val_fraction,
                                seed: int = DEFAULTS.seed) -> DataFrame:
    """The earlier recipe: classes counted with the target, one test draw of bank B."""
    pool = durable(draw(eligible_customers(tx_a, profiles_a, on_inputs=False), pool_size, seed))
    test = draw(eligible_customers(tx_b, profiles_b, on_inputs=False), n_test, seed)
    return (train_val_split(pool, val_fraction, seed).select("customer_id", F.lit("bank_a").alias("bank"), "split")
            .unionByName(_tag(test, "bank_b", "test")))


def leakage_check(assignment: DataFrame, exclude: DataFrame) -> DataFrame:
    """(check, overlap): every overlap must be zero."""
    per = assignment.groupBy("bank", "customer_id").agg(*[
        F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "bank_a_test", "bank_b_dev", "bank_b_confirm")])
    per = per.join(exclude.select("customer_id").distinct().withColumn("_used", F.lit(1)), "customer_id", "left")
    used = (F.coalesce(F.col("_used"), F.lit(0)) + F.col("bank_b_dev")) > 0
    checks = {"train and val": (F.col("train") + F.col("val")) > 1,
              "bank_a_test and pool": (F.col("bank_a_test") == 1) & ((F.col("train") + F.col("val")) > 0),
              "bank_b_confirm and excluded": (F.col("bank_b_confirm") == 1) & used}
    sums = per.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("overlap"))
                                          for i, k in enumerate(checks)])))


def require_no_leakage(assignment: DataFrame, exclude: DataFrame) -> None:
    bad = [r["check"] for r in leakage_check(assignment, exclude).collect() if r["overlap"]]      # three rows
    if bad:
        raise ValueError(f"splits overlap: {bad}")


def split_summary(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("bank", "split").agg(F.count("*").alias("customers"))


def split_report(assignment: DataFrame, eligible: dict, excluded: dict, amounts: str = "nominal", seed=DEFAULTS.seed, on_inputs: bool = True) -> DataFrame:
    """(item, value) rows that say how the splits were made: seed, rules, classes, and numbers of eligible, drawn and excluded customers.

    `eligible` and `excluded` map a name to a list of ids.
    """
    from tillflow.settings import CLASSES

    rules = {"seed": seed, "diversity on inputs": str(on_inputs).lower(), "min transactions": DEFAULTS.min_transactions, "min distinct categories": DEFAULTS.min_distinct,
             "categories": ", ".join(CLASSES), "amounts": amounts}
    out = literal_rows(assignment.sparkSession, [(k, str(v)) for k, v in rules.items()], ("item", "value"))
    sizes = [(f"eligible: {k}", v) for k, v in eligible.items()] + [(f"excluded from confirmation: {k}", v) for k, v in excluded.items()]
    for name, ids in sizes:
        out = out.unionByName(ids.select("customer_id").distinct().agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("item"), "value"))
    per = split_summary(assignment).select(F.concat(F.lit("customers: "), "split").alias("item"), F.col("customers").cast("string").alias("value"))
    return out.unionByName(per)


def splits_table(tx: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per split: customers, and those long enough for lengths 9 and 14. Counts are made before the join."""
    n = tx.groupBy("bank", "customer_id").agg(F.count("*").alias("n"))
    return (assignment.join(n, ["bank", "customer_id"]).groupBy("split")
            .agg(F.count("*").alias("customers"), F.count_if(F.col("n") >= 10).alias("at_length_9"),
                 F.count_if(F.col("n") >= 15).alias("at_length_14")))


def overlap_of(a: DataFrame, b: DataFrame, population: int | None = None) -> DataFrame:
    """Sizes of two id lists, their intersection, and the overlap two independent draws would have."""
    both = (a.select("customer_id").distinct().withColumn("_a", F.lit(1))
            .join(b.select("customer_id").distinct().withColumn("_b", F.lit(1)), "customer_id", "full_outer"))
    out = both.agg(F.count("_a").alias("list_a"), F.count("_b").alias("list_b"),
                   F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"))
    if population is None:
        return out
    return out.withColumn("expected", F.col("list_a") * F.col("list_b") / F.lit(float(population)))


def combine_ids(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersection or difference of two id lists, as a set."""
    a, b = a.select("customer_id"), b.select("customer_id")
    return {"union": lambda: a.union(b).distinct(), "intersection": lambda: a.intersect(b),
            "difference": lambda: a.subtract(b)}[how]()
