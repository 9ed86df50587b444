"""Cohort filters and the counts that describe them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import distinct_codes
from tillflow.operators.windows import last_windows, recent_steps, window_shape
from tillflow.settings import CLASSES, DEFAULTS, SHORT_NAMES
from tillflow.sources.tables import rank_in_customer


def purchases_per_customer(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id").agg(F.count("*").alias("n_txn"))


def active_customers(tx: DataFrame, at_least: int = DEFAULTS.min_transactions) -> DataFrame:
    return purchases_per_customer(tx).where(F.col("n_txn") >= at_least)


def recent_diversity(tx: DataFrame, window: int = DEFAULTS.diversity_window,
                     at_least: int = DEFAULTS.min_transactions) -> DataFrame:
    """Per customer: enough purchases?, distinct classes among the inputs and among the window with its target.

    Class sets are bit masks, so no distinct aggregate and no second shuffle is needed.
    """
    rows = rank_in_customer(tx, max(window, at_least))
    bit = F.expr("shiftleft(1, code)")
    in_window, is_input = F.col("rn") <= window, (F.col("rn") > 1) & (F.col("rn") <= window)
    return rows.groupBy("customer_id").agg(
        (F.max("rn") >= at_least).alias("active"),
        F.bit_count(F.coalesce(F.bit_or(F.when(is_input, bit)), F.lit(0))).alias("input_classes"),
        F.bit_count(F.bit_or(F.when(in_window, bit))).alias("window_classes"))


def eligible_customers(tx: DataFrame, profiles: DataFrame | None = None, on_inputs: bool = True,
                       min_distinct: int = DEFAULTS.min_distinct) -> DataFrame:
    """Customers with enough purchases, enough distinct classes and, when profiles are given, a complete profile.

    With `on_inputs` the target is not looked at; without it the classes of the whole window count.
    """
    classes = F.col("input_classes" if on_inputs else "window_classes")
    ids = recent_diversity(tx).where(F.col("active") & (classes >= min_distinct)).select("customer_id")
    return ids if profiles is None else ids.join(profiles.select("customer_id"), "customer_id", "left_semi")


def class_counts_per_customer(tx: DataFrame) -> DataFrame:
    """One row per customer: purchases in every class. Joining this to id lists avoids moving single purchases."""
    return tx.groupBy("customer_id").agg(F.count("*").alias("n_txn"),
                                         *[F.count_if(F.col("code") == k).alias(f"n_{s}") for k, s in enumerate(SHORT_NAMES)])


def class_shares(tx: DataFrame) -> DataFrame:
    """(category, code, n, share) of all four classes, zero where a class does not occur. Empty tables have share 0."""
    counts = tx.agg(F.count("*").alias("all"), *[F.count_if(F.col("code") == k).alias(f"n{k}") for k in range(len(CLASSES))])
    return _shares_from(counts)


def cohort_class_shares(tx: DataFrame, ids: DataFrame) -> DataFrame:
    per = class_counts_per_customer(tx).join(ids.select("customer_id"), "customer_id", "left_semi")
    counts = per.agg(F.sum("n_txn").alias("all"), *[F.sum(f"n_{s}").alias(f"n{k}") for k, s in enumerate(SHORT_NAMES)])
    return _shares_from(counts)


def _shares_from(counts: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("code"),
                              F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("n"),
                              F.coalesce(F.try_divide(F.col(f"n{k}").cast("double"), F.col("all")), F.lit(0.0)).alias("share"))
                     for k, c in enumerate(CLASSES)])
    return counts.select(F.inline(rows))


def last_day(tx: DataFrame) -> DataFrame:
    """Per customer: purchases on the most recent day and whether they are of several classes.

    Days are counted first, so a customer with very many purchases is small before the per-customer step.
    """
    days = tx.groupBy("customer_id", "date").agg(F.count("*").alias("n"), (F.min("code") != F.max("code")).alias("mixed"))
    return (days.groupBy("customer_id").agg(F.max_by(F.struct("n", "mixed"), "date").alias("d"))
            .select("customer_id", F.col("d.n").alias("on_last_day"), F.col("d.mixed").alias("mixed")))


def tied_customers(tx: DataFrame) -> DataFrame:
    return last_day(tx).where(F.col("on_last_day") >= 2).select("customer_id")


def tie_report(tx: DataFrame) -> DataFrame:
    """One row: customers, those with two or more purchases on the last day, and those with several classes on it."""
    tied = F.col("on_last_day") >= 2
    return last_day(tx).agg(
        F.count("*").alias("customers"), F.count_if(tied).alias("tied_last_date"),
        F.coalesce(F.avg(tied.cast("double")), F.lit(0.0)).alias("tied_share"),
        F.count_if(tied & F.col("mixed")).alias("tied_with_different_classes"))


def single_category_share(windows: DataFrame, by: tuple = ()) -> DataFrame:
    """Windows whose inputs hold one class only."""
    single = distinct_codes(F.col("codes")) == 1
    return windows.groupBy(*by).agg(F.count("*").alias("customers"), F.count_if(single).alias("single_category"),
                                    F.coalesce(F.avg(single.cast("double")), F.lit(0.0)).alias("share"))


def cohort_funnel(tx: DataFrame, profiles: DataFrame) -> DataFrame:
    """(step, customers): how many customers pass each filter, one pass over the per-customer flags."""
    flags = recent_diversity(tx).join(profiles.select("customer_id", F.lit(True).alias("profiled")), "customer_id", "left")
    ok = F.coalesce("profiled", F.lit(False))
    steps = {  # fixed values: step names
        "customers with transactions": F.lit(True),
        "with complete demographics": ok,
        "with at least 10 transactions": ok & F.col("active"),
        "eligible: at least 2 classes among the 9 inputs": ok & F.col("active") & (F.col("input_classes") >= DEFAULTS.min_distinct),
        "earlier rule: at least 2 classes among the last 10 (target included)":
            ok & F.col("active") & (F.col("window_classes") >= DEFAULTS.min_distinct)}
    counts = flags.agg(*[F.count_if(c).alias(f"s{i}") for i, c in enumerate(steps.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"s{i}").alias("customers"))
                                            for i, name in enumerate(steps)])))


def cohort_customers(tx: DataFrame, profiles: DataFrame, length: int = DEFAULTS.train_length) -> DataFrame:
    """One row per eligible customer: window, number of purchases, span, distinct input classes, target, profile."""
    w = window_shape(last_windows(tx, length))
    eligible = w.where(F.col("distinct_inputs") >= DEFAULTS.min_distinct)   # length + 1 purchases = the activity filter
    if length + 1 != DEFAULTS.diversity_window:
        eligible = w.join(eligible_customers(tx), "customer_id", "left_semi")
    return eligible.join(purchases_per_customer(tx), "customer_id").join(profiles, "customer_id")


def filter_counts(tx: DataFrame, assignment: DataFrame, lengths=(4, 7, 9)) -> DataFrame:
    """Per split: single-class inputs at several lengths and tied target dates.

    Both facts are found per customer first (one ranking serves every length); the splits join the finished rows.
    """
    fits = lambda x: F.size("steps") > x
    last = lambda x: F.slice(F.transform("steps", lambda s: s["code"]), F.size("steps") - x, F.lit(x))
    facts = recent_steps(tx, max(lengths) + 1).select(
        "customer_id", *[fits(x).alias(f"fit_{x}") for x in lengths],
        *[F.when(fits(x), F.size(F.array_distinct(last(x))) == 1).otherwise(False).alias(f"one_{x}") for x in lengths])
    per = facts.join(last_day(tx), "customer_id").join(assignment.select("customer_id", "split"), "customer_id")
    tied = F.col("on_last_day") >= 2
    return per.groupBy("split").agg(
        *[c for x in lengths for c in (F.count_if(F.col(f"one_{x}")).alias(f"single_at_{x}"),
                                       (100 * F.try_divide(F.count_if(F.col(f"one_{x}")), F.count_if(F.col(f"fit_{x}"))))
                                       .alias(f"single_at_{x}_pct"))],
        F.count("*").alias("customers"), F.count_if(tied).alias("tied"),
        (100 * F.avg(tied.cast("double"))).alias("tied_pct"), F.count_if(tied & F.col("mixed")).alias("tied_mixed"))
