"""Reliability, class-wise calibration and cost-weighted operating points of class probabilities."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, argmax_code, probability_bin
from tillflow.functions.joins import join_groups
from tillflow.settings import CLASSES, DEFAULTS, SHORT_NAMES
from tillflow.sources.predictions import base_model, with_codes

GRID = 10_000                     # thresholds are probabilities rounded to four decimals


def reliability_table(predictions: DataFrame, by=("model", "length"), bins: int = DEFAULTS.ece_bins) -> DataFrame:
    """Per non-empty bin of the top probability: mean confidence, accuracy, count."""
    coded = with_codes(predictions.where(F.col("p").isNotNull())).withColumn("conf", F.array_max("p"))
    return coded.groupBy(*by, probability_bin(F.col("conf"), bins).alias("bin")).agg(
        F.avg("conf").alias("confidence"), F.avg((argmax_code(F.col("p")) == F.col("y")).cast("double")).alias("accuracy"),
        F.count("*").alias("n"))


def class_bins(predictions: DataFrame, by=("model", "length"), bins: int = DEFAULTS.ece_bins) -> DataFrame:
    """Per class and bin of its probability: count, sums of p, of the outcome and of the squared error."""
    coded = with_codes(predictions.where(F.col("p").isNotNull()))
    rows = coded.select(*by, F.inline(F.array(*[
        F.struct(F.lit(k).alias("class_code"), F.get("p", F.lit(k)).alias("q"), (F.col("y") == k).cast("double").alias("o"))
        for k in range(N_CLASSES)])))
    return rows.groupBy(*by, "class_code", probability_bin(F.col("q"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("q").alias("sq"), F.sum("o").alias("so"),
        F.sum((F.col("q") - F.col("o")) * (F.col("q") - F.col("o"))).alias("se"))


def class_reliability(predictions: DataFrame, cls: str, by=("model", "length"), bins: int = DEFAULTS.ece_bins) -> DataFrame:
    return (class_bins(predictions, by, bins).where(F.col("class_code") == CLASSES.index(cls))
            .select(*by, "bin", (F.col("sq") / F.col("n")).alias("mean_probability"),
                    (F.col("so") / F.col("n")).alias("observed_share"), "n"))


def class_calibration(predictions: DataFrame, by=("model", "length"), bins: int = DEFAULTS.ece_bins) -> DataFrame:
    """One-vs-rest ECE per class and the parts of the Brier score, summed over the classes."""
    cells = class_bins(predictions, by, bins)
    keys = [*by, "class_code"]
    base = cells.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum("so").alias("positives"))
    cells = join_groups(cells, base, keys)
    share, observed, mean = F.col("n") / F.col("all"), F.col("so") / F.col("n"), F.col("sq") / F.col("n")
    prior = F.col("positives") / F.col("all")
    per = cells.groupBy(*keys).agg(
        F.sum(share * F.abs(observed - mean)).alias("ece"), F.sum(share * F.pow(mean - observed, F.lit(2))).alias("reliability"),
        F.sum(share * F.pow(observed - prior, F.lit(2))).alias("resolution"), (F.sum("se") / F.max("all")).alias("brier"),
        (F.max(prior) * (1 - F.max(prior))).alias("uncertainty"), (F.sum("sq") / F.max("all")).alias("mean_p"), F.max(prior).alias("share"))
    at = lambda k, c: F.max(F.when(F.col("class_code") == k, F.col(c)))
    out = per.groupBy(*by).agg(
        *[at(k, "ece").alias(f"ece_{s}") for k, s in enumerate(SHORT_NAMES)], F.avg("ece").alias("ece_class_mean"),
        *[F.sum(c).alias(c) for c in ("brier", "reliability", "resolution", "uncertainty")],
        *[at(k, c).alias(f"{c}_{s}") for c in ("mean_p", "share") for k, s in enumerate(SHORT_NAMES)])
    return out.withColumn("remainder", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def calibration_seed_means(calibration: DataFrame, by=("length",), limit: float = 0.005) -> DataFrame:
    """Seed means; a remainder that does not vanish stops the job, because the parts must add up."""
    numbers = [c for c in calibration.columns if c not in ("model", *by)]
    checked = F.when(F.abs("remainder") < limit, F.col("remainder")).otherwise(
        F.raise_error(F.lit("Brier parts do not add up")).cast("double"))
    return (calibration.withColumn("remainder", checked).groupBy(*by, base_model(F.col("model")).alias("base"))
            .agg(F.count("*").alias("seeds"), *[F.avg(c).alias(c) for c in numbers]))


def threshold_grid(predictions: DataFrame, cls: str, by=("model", "length")) -> DataFrame:
    """Per grid point that occurs as a rounded probability: customers and positives at or above it.

    A customer is flagged at t when its unrounded probability is at least t, so it is placed at the largest grid point
    not above the probability. After this count the table has at most 10,001 rows per group.
    """
    q, k = F.get("p", F.lit(CLASSES.index(cls))), F.col("k")
    coded = with_codes(predictions.where(F.col("p").isNotNull()))
    near = F.rint(q * GRID).cast("int")
    rows = coded.select(*by, near.alias("near"), F.when(q >= near / F.lit(float(GRID)), near).otherwise(near - 1).alias("k"),
                        (F.col("y") == CLASSES.index(cls)).cast("long").alias("o"))
    both = rows.groupBy(*by, "near", "k").agg(F.count("*").alias("n"), F.sum("o").alias("pos"))
    grid = both.groupBy(*by, "k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.lit(False).alias("is_t"))
    points = both.groupBy(*by, F.col("near").alias("k")).agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"),
                                                             F.lit(True).alias("is_t"))
    merged = grid.unionByName(points).groupBy(*by, "k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("is_t").alias("is_t"))
    w = Window.partitionBy(*by)
    above = w.orderBy(k.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (merged.withColumns({"flagged": F.sum("n").over(above), "tp": F.sum("pos").over(above),
                                "positives": F.sum("pos").over(w)})
            .where("is_t").select(*by, (k / F.lit(float(GRID))).alias("threshold"), "flagged", "tp", "positives"))


def cost_threshold(predictions: DataFrame, cls: str, by=("model", "length"), cost_miss: float = DEFAULTS.cost_miss,
                   cost_false_alarm: float = DEFAULTS.cost_false_alarm) -> DataFrame:
    """The threshold with the lowest cost of misses and false alarms, the lowest one on ties."""
    cost = cost_miss * (F.col("positives") - F.col("tp")) + cost_false_alarm * (F.col("flagged") - F.col("tp"))
    grid = threshold_grid(predictions, cls, by).withColumn("cost", cost)
    best = grid.groupBy(*by).agg(F.min_by(F.struct("threshold", "cost", "tp", "positives", "flagged"), F.struct("cost", "threshold")).alias("b"))
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    return best.select(*by, "b.threshold", "b.cost", (F.col("b.tp") / at_least_one(F.col("b.positives"))).alias("recall"),
                       (F.col("b.tp") / at_least_one(F.col("b.flagged"))).alias("precision"))


def operating_point(validation: DataFrame, test: DataFrame, cls: str, by=("model", "length"),
                    cost_miss: float = DEFAULTS.cost_miss, cost_false_alarm: float = DEFAULTS.cost_false_alarm) -> DataFrame:
    """The threshold chosen on validation applied to test predictions, next to the most probable class."""
    chosen = cost_threshold(validation, cls, by, cost_miss, cost_false_alarm).select(*by, "threshold")     # a row per model
    k = CLASSES.index(cls)
    coded = join_groups(with_codes(test.where(F.col("p").isNotNull())), chosen, by)
    flag, top, pos = F.get("p", F.lit(k)) >= F.col("threshold"), F.col("yhat") == k, F.col("y") == k
    share = lambda hit, of: F.try_divide(F.count_if(hit).cast("double"), F.count_if(of))
    return coded.groupBy(*by, "threshold").agg(
        share(flag & pos, pos).alias("recall"), share(flag & pos, flag).alias("precision"),
        (100 * F.avg(flag.cast("double"))).alias("flagged_pct"), (100 * F.avg(pos.cast("double"))).alias("positives_pct"),
        share(top & pos, pos).alias("argmax_recall"), share(top & pos, top).alias("argmax_precision"),
        (100 * F.avg(top.cast("double"))).alias("argmax_flagged_pct"))
