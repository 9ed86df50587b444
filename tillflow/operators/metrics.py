"""Confusion matrices and everything that is arithmetic on them; probability scores."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, argmax_code, in_top2, probability_bin
from tillflow.functions.joins import join_groups
from tillflow.functions.quantiles import running_totals
from tillflow.settings import CLASSES, DEFAULTS, SHORT_NAMES
from tillflow.sources.predictions import base_model, with_codes

CELLS = [f"c{t}{p}" for t in range(N_CLASSES) for p in range(N_CLASSES + 1)]
OVERALL = ["acc", "prec_w", "rec_w", "f1_w", "macro_f1", "bal_acc"]
CLASS_F1 = [f"f1_{s}" for s in SHORT_NAMES]
ALL_METRICS = OVERALL + [f"{m}_{s}" for s in SHORT_NAMES for m in ("p", "r", "f1")]


def confusion_cells(coded: DataFrame, by=("model", "length"), weight: str | None = None) -> DataFrame:
    """One row per group, the 20 cells of truth x answer as columns c<truth><answer> (answer 4 = not a class).

    Pairs are counted map-side first; the second step only spreads at most 20 counts per group over columns.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    counted = coded.groupBy(*by, (F.col("y") * (N_CLASSES + 1) + F.col("yhat")).alias("_cell")).agg(n.alias("_n"))
    return counted.groupBy(*by).agg(*[F.expr(f"coalesce(sum(_n) FILTER (WHERE _cell = {i}), 0)").alias(c) for i, c in enumerate(CELLS)])


def confusion_matrix(predictions: DataFrame, by=("model", "length")) -> DataFrame:
    """(group, truth, prediction, n), zeros present."""
    names = CLASSES + ("not a category",)
    wide = confusion_cells(with_codes(predictions), by)
    rows = F.array(*[F.struct(F.lit(CLASSES[t]).alias("truth"), F.lit(names[p]).alias("answer"), F.col(f"c{t}{p}").alias("n"))
                     for t in range(N_CLASSES) for p in range(N_CLASSES + 1)])
    return wide.select(*by, F.inline(rows))


def add_metrics(cells: DataFrame) -> DataFrame:
    """Add n and every metric to rows that carry the 20 cells. Undefined ratios are 0."""
    ks = range(N_CLASSES)
    sums = [f"CAST({' + '.join(f'c{k}{p}' for p in range(N_CLASSES + 1))} AS DOUBLE) AS _s{k}" for k in ks]
    sums += [f"CAST({' + '.join(f'c{t}{k}' for t in ks)} AS DOUBLE) AS _q{k}" for k in ks]
    ratio = lambda a, b: f"coalesce(try_divide({a}, {b}), 0D)"
    per = ["_s0 + _s1 + _s2 + _s3 AS n"]
    for k, s in enumerate(SHORT_NAMES):
        per += [f"{ratio(f'c{k}{k}', f'_q{k}')} AS p_{s}", f"{ratio(f'c{k}{k}', f'_s{k}')} AS r_{s}", f"{ratio(f'2 * c{k}{k}', f'_s{k} + _q{k}')} AS f1_{s}"]
    weighted = lambda m: " + ".join(f"try_divide(_s{k}, n) * {m}_{s}" for k, s in enumerate(SHORT_NAMES))
    plain = lambda m: "(" + " + ".join(f"{m}_{s}" for s in SHORT_NAMES) + f") / {N_CLASSES}"
    overall = [f"try_divide({' + '.join(f'c{k}{k}' for k in ks)}, n) AS acc", f"{weighted('p')} AS prec_w", f"{weighted('r')} AS rec_w",
               f"{weighted('f1')} AS f1_w", f"{plain('f1')} AS macro_f1", f"{plain('r')} AS bal_acc"]
    return (cells.selectExpr("*", *sums).selectExpr("*", *per).selectExpr("*", *overall)
            .drop(*[f"_s{k}" for k in ks], *[f"_q{k}" for k in ks]))


def classification_metrics(predictions: DataFrame, by=("model", "length")) -> DataFrame:
    return add_metrics(confusion_cells(with_codes(predictions), by)).select(*by, F.col("n").cast("long").alias("n"), *ALL_METRICS)


def selection_score(predictions: DataFrame, by=("model", "length"), metric: str = "macro_f1") -> DataFrame:
    if metric not in ("macro_f1", "f1_w"):
        raise ValueError(f"selection uses macro_f1 or f1_w, not {metric!r}")
    return classification_metrics(predictions, by).select(*by, F.col(metric).alias("score"))


def long_metrics(df: DataFrame, by, metrics=tuple(ALL_METRICS)) -> DataFrame:
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))


# ---- probability scores --------------------------------------------------------------------------------------
def _one_vs_rest(coded: DataFrame, by) -> DataFrame:
    """One row per prediction and class: score and whether the class is the truth."""
    rows = F.array(*[F.struct(F.lit(k).alias("class_code"), F.get("p", F.lit(k)).alias("score"),
                              (F.col("y") == k).cast("long").alias("hit")) for k in range(N_CLASSES)])
    return coded.select(*by, F.inline(rows))


def average_precision(coded: DataFrame, by=("model", "length")) -> DataFrame:
    """Average precision per class, equal scores taken together. Null when a class never is the truth."""
    keys = [*by, "class_code"]
    scores = _one_vs_rest(coded, by).groupBy(*keys, "score").agg(F.sum("hit").alias("tp"), F.count("*").alias("all"))
    ranked = running_totals(scores, "score", ("tp", "all"), by=keys, descending=True)
    return (ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_all")), F.sum("tp")).alias("ap")))


def probability_metrics(predictions: DataFrame, by=("model", "length"), bins: int = DEFAULTS.ece_bins) -> DataFrame:
    """PR-AUC per class and its mean over present classes, top-2 accuracy, top-label ECE and the Brier score."""
    coded = with_codes(predictions.where(F.col("p").isNotNull()))
    ap = average_precision(coded, by).groupBy(*by).agg(
        *[F.max(F.when(F.col("class_code") == k, F.col("ap"))).alias(f"pr_auc_{s}") for k, s in enumerate(SHORT_NAMES)],
        F.avg("ap").alias("pr_auc_macro"))
    y = F.col("y")
    brier = sum(((F.get("p", F.lit(k)) - (y == k).cast("double")) * (F.get("p", F.lit(k)) - (y == k).cast("double"))
                 for k in range(N_CLASSES)), F.lit(0.0))
    binned = coded.withColumn("conf", F.array_max("p")).select(
        *by, "conf", probability_bin(F.col("conf"), bins).alias("bin"), (argmax_code(F.col("p")) == y).cast("double").alias("right"),
        in_top2(F.col("p"), y).cast("double").alias("top2"), brier.alias("brier"))
    per_bin = binned.groupBy(*by, "bin").agg(F.count("*").alias("m"), F.sum("conf").alias("conf"), F.sum("right").alias("right"),
                                             F.sum("top2").alias("top2"), F.sum("brier").alias("brier"))
    rest = per_bin.groupBy(*by).agg((F.sum("top2") / F.sum("m")).alias("top2_acc"),
                                    (F.sum(F.abs(F.col("right") - F.col("conf"))) / F.sum("m")).alias("ece"),
                                    (F.sum("brier") / F.sum("m")).alias("brier"))
    return join_groups(ap, rest, by)


def model_summary(predictions: DataFrame, by=("model", "length")) -> DataFrame:
    """Label metrics of every model, probability metrics where it gives probabilities."""
    return join_groups(classification_metrics(predictions, by), probability_metrics(predictions, by), by, "left")


def seed_summary(summary: DataFrame, metrics, by=("length",)) -> DataFrame:
    """Mean and sample standard deviation over the seeds of one base model; sd is null for a single run."""
    named = summary.withColumn("base", base_model(F.col("model")))
    return named.groupBy("base", *by).agg(F.count("*").alias("seeds"), F.min_by("n", "model").alias("n"),
                                          *[f(m).alias(f"{m}_{k}") for m in metrics
                                            for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def shift_table(predictions: DataFrame, in_bank: str, cross_bank: str, length: int = DEFAULTS.train_length,
                metrics=("acc", "f1_w", "macro_f1", *CLASS_F1)) -> DataFrame:
    """Seed means on both splits and the drop between them, for models scored on both."""
    at = predictions.where((F.col("length") == length) & F.col("split").isin(in_bank, cross_bank))
    scores = classification_metrics(at, ("split", "model")).withColumn("base", base_model(F.col("model")))
    on = lambda split, m: F.avg(F.when(F.col("split") == split, F.col(m)))
    wide = scores.groupBy("base").agg(
        F.count_if(F.col("split") == in_bank).alias("seeds_in_bank"), F.count_if(F.col("split") == cross_bank).alias("seeds_cross_bank"),
        *[on(s, m).alias(f"{m}_{n}") for m in metrics for s, n in ((in_bank, "in_bank"), (cross_bank, "cross_bank"))])
    both = wide.where((F.col("seeds_in_bank") > 0) & (F.col("seeds_cross_bank") > 0))
    return both.withColumns({f"{m}_drop": F.col(f"{m}_in_bank") - F.col(f"{m}_cross_bank") for m in metrics})


def group_metrics(predictions: DataFrame, attributes: DataFrame, by=("model",), keys=("customer_id",)) -> DataFrame:
    """Metrics per level of customer attributes. `attributes`: the customer `keys` and one text column per variable."""
    variables = [c for c in attributes.columns if c not in keys]
    joined = with_codes(predictions).join(attributes, list(keys))
    cells = joined.groupBy(*by, "y", "yhat", *variables).agg(F.count("*").alias("w"))     # merge before unpivoting
    rows = cells.select(*by, "y", "yhat", "w", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).alias("level")) for v in variables])))
    groups = (*by, "variable", "level")
    return add_metrics(confusion_cells(rows, groups, "w")).select(*groups, F.col("n").cast("long").alias("n"), *ALL_METRICS)


def level_shares(attributes: DataFrame) -> DataFrame:
    """(variable, level, n, share in %) of customer attributes."""
    variables = [c for c in attributes.columns if c != "customer_id"]
    cells = attributes.groupBy(*variables).agg(F.count("*").alias("w"))
    rows = cells.select("w", F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("level")) for v in variables])))
    n = rows.groupBy("variable", "level").agg(F.sum("w").alias("n"))
    return n.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("variable")))


def invalid_answers(predictions: DataFrame, by=("model", "length")) -> DataFrame:
    bad = ~F.coalesce(F.col("prediction").isin(*CLASSES), F.lit(False))
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("not_a_category"),
                                        (100.0 * F.avg(bad.cast("double"))).alias("share_pct"))


def common_population(predictions: DataFrame, length: int | None = None) -> DataFrame:
    """Customers every (model, length) of the table covers; with `length` those that every model of that length covers."""
    rows = predictions if length is None else predictions.where(F.col("length") == length)
    per = rows.groupBy("customer_id").agg(F.count("*").alias("covered"))
    models = rows.groupBy("model", "length").agg(F.lit(1).alias("one")).agg(F.count("*").alias("m"))
    return per.where(F.col("covered") == models.scalar()).select("customer_id")


def at_fixed_population(predictions: DataFrame, longest: int = max(DEFAULTS.lengths)) -> DataFrame:
    """Predictions of every length for the customers of the longest one, so that scores of several lengths are of the same customers."""
    return predictions.join(common_population(predictions, longest), "customer_id", "left_semi")


def align_models(predictions: DataFrame, models) -> DataFrame:
    """One row per customer with the answers of all `models` as `yhat_<i>`, customers missing in one left out."""
    coded = with_codes(predictions.where(F.col("model").isin(*models)))
    wide = coded.groupBy("customer_id").agg(F.max("y").alias("y"), *[
        F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(f"yhat_{i}") for i, m in enumerate(models)])
    return wide.dropna()


def population_check(predictions: DataFrame, by=("length",)) -> DataFrame:
    """Per length: models, customers, and whether every model covers the same customers (count, sum and xor of hashes)."""
    h = F.xxhash64("customer_id")
    per = predictions.groupBy("model", *by).agg(F.count("*").alias("n"), F.sum((h % 1_000_003).cast("long")).alias("s"),
                                                F.bit_xor(h).alias("x"))
    return per.groupBy(*by).agg(F.count("*").alias("models"), F.max("n").alias("customers"),
                                ((F.min("n") == F.max("n")) & (F.min("s") == F.max("s")) & (F.min("x") == F.max("x"))).alias("same"))


def require_same_population(predictions: DataFrame) -> None:
    """Stops if the models of a length cover different customers; the message names every such length."""
    bad = population_check(predictions).where(~F.col("same")).agg(F.array_join(F.array_sort(F.collect_set(F.col("length").cast("string"))), ", ")).first()[0]
    if bad:
        raise ValueError(f"models cover different customers at length {bad}")


def select_best(scores: DataFrame, order: dict, by=()) -> DataFrame:
    """The candidate with the best score; on ties the first one in `order` (name -> position)."""
    position = F.lit(len(order))
    for name, i in order.items():
        position = F.when(F.col("model") == name, F.lit(i)).otherwise(position)
    return scores.groupBy(*by).agg(F.max_by("model", F.struct("score", -position)).alias("model"), F.max("score").alias("score"))
