"""Registered queries: predictors, features, metrics, resampling, tests."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, age_band, argmax_code, class_name, span_band
from tillflow.functions.literals import literal_rows
from tillflow.operators import baselines as B
from tillflow.operators import boosting as Z
from tillflow.operators import calibration as K
from tillflow.operators import cohort as C
from tillflow.operators import features as X
from tillflow.operators import linear as N
from tillflow.operators import metrics as M
from tillflow.operators import models as L
from tillflow.operators import resampling as R
from tillflow.operators import scoring as G
from tillflow.operators import significance as S
from tillflow.operators import windows as W
from tillflow.plans import tables as P
from tillflow.plans.preparation import _assignment as split_assignment
from tillflow.plans.registry import joined, printed, query
from tillflow.settings import DEFAULTS
from tillflow.sources import logs
from tillflow.sources import predictions as IO
from tillflow.sources import testdata as T
from tillflow.sources.session import durable

COMPARED = ("averaging", "last-category", "markov1")
HASHED = S.Resampler("hashed")
NINE = DEFAULTS.train_length
PATIENCE = 10                                              # rounds of the registered trees without a better validation loss; the operator's default is 50
BY_BANK = ("split", "model", "length")
EXACT = ("mcnemar_p", "mcnemar_p_holm", "p_holm")           # exact binomial p values


def _windows(spark, d, bank, length=NINE):
    return W.last_windows(P.transactions(spark, d, bank), length)


def _both_windows(spark, d, length=NINE):
    return P.both_banks(spark, d, lambda tx: W.last_windows(tx, length))


def flagship(spark, d):
    """Three simple predictors of bank A's cohort at length 9, scored."""
    tx = T.bank_a(spark, d)
    cohort = durable(C.cohort_customers(tx, T.profiles(spark, d)))         # read twice: to fit and to score
    rows = B.score_baselines(cohort, B.markov_fit(cohort))
    return printed(M.classification_metrics(rows, ("model",)).select("model", "n", "acc", "macro_f1", *M.CLASS_F1))


@query
def flagship_baselines(spark, d):
    return flagship(spark, d)


# ---- predictors and features -----------------------------------------------------------------------------------
def _coded(rows):
    return printed(IO.with_codes(rows).select("split", "model", F.coalesce("length", F.lit(0)).alias("length"), "customer_id", "y", "yhat",
                                              F.coalesce(joined(F.col("p"), 6), F.lit("")).alias("p")))


@query
def score_baselines(spark, d):
    """averaging, last-category and markov1 of both banks at every length; transitions come from bank A."""
    w = P.both_banks(spark, d, lambda tx: W.windows_at(tx, fields=P.CODES_ONLY)).withColumnRenamed("bank", "split")
    return _coded(B.score_baselines(w, P.fitted_transitions(spark, d), keys=("split", "customer_id")))


@query
def random_and_proportional(spark, d):
    a, b = (P.free_predictions(spark, d, bank).withColumn("split", F.lit(bank)) for bank in ("bank_a", "bank_b"))
    return _coded(a.unionByName(b))


@query
def averaging_ties_lowest(spark, d):
    w = P.both_banks(spark, d, W.windows_at)
    return printed(w.select("bank", "customer_id", "length", B.most_frequent_code(F.col("codes"), "lowest").alias("code")))


@query
def last_category(spark, d):
    return printed(_both_windows(spark, d).select("bank", "customer_id", B.last_code(F.col("codes")).alias("code"), "target"))


@query
def markov_fit(spark, d):
    return printed(P.fitted_transitions(spark, d))


@query
def sequence_features(spark, d):
    return printed(X.sequence_features(_both_windows(spark, d)).select("bank", "customer_id", *X.sequence_feature_names()))


@query
def full_features(spark, d):
    """Amounts, dates and profile of profiled customers (the sequence part is a query of its own)."""
    p = T.profiles(spark, d)
    w = _both_windows(spark, d).join(p.select("customer_id"), "customer_id", "left_semi")
    return printed(X.full_features(w, p).select("bank", "customer_id", *X.AMOUNT_DATE_NAMES, "age", *X.PROFILE_LEVELS))


@query
def one_hot(spark, d):
    """Levels learned on the customers of even id; a level not seen there has no index."""
    p = T.profiles(spark, d)
    levels = X.level_table(p.where((F.col("customer_id") % 2 == 0) & (F.col("occupation") != "retired")))
    return printed(X.one_hot(p, levels).select("customer_id", "age", joined(F.col("hot")).alias("hot")))


@query
def class_weights(spark, d):
    out = None
    for kind in ("none", "inverse", "balanced"):
        part = P.both_banks(spark, d, lambda tx: X.class_weights(W.last_windows(tx, NINE), kind)).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return printed(out)


@query
def padded_sequence(spark, d):
    """Both paddings: tokens 1..4 padded with 0, and codes padded with 4; and the shifted targets."""
    w = P.both_banks(spark, d, lambda tx: W.windows_at(tx, (4, 14)))
    w = X.next_step_targets(X.padded_sequence(w, 9, 0, 1).withColumnRenamed("tokens", "shifted"), 9)
    w = X.padded_sequence(w, 9, N_CLASSES)
    return printed(w.select("bank", "customer_id", "length", joined(F.col("shifted")).alias("shifted"), joined(F.col("tokens")).alias("tokens"),
                            joined(F.col("next_codes")).alias("next_codes")))


KINDS = ("seq", "full")


def _features(spark, d, bank="bank_a"):
    return X.sequence_features(_windows(spark, d, bank)).withColumn("fold", F.pmod(F.col("customer_id"), F.lit(5)))


def _split_features(spark, d):
    """Feature rows of every split at the training length, with their split; customers of the splits have profiles."""
    p, assignment = T.profiles(spark, d), durable(split_assignment(spark, d))
    parts = []
    for bank in ("bank_a", "bank_b"):
        own = assignment.where(F.col("bank") == bank).select("customer_id", "split")
        parts.append(X.full_features(_windows(spark, d, bank).join(own, "customer_id"), p))
    return parts[0].unionByName(parts[1])


def _feature_rows(spark, d):
    """Per feature set: the rows of all splits, and how many numbers and zero-one columns they hold."""
    features = durable(_split_features(spark, d))
    levels = X.level_table(features.where("split = 'train'"))
    for kind in KINDS:
        full = kind == "full"
        numeric = X.sequence_feature_names() + ([*X.AMOUNT_DATE_NAMES, "age"] if full else [])
        yield kind, N.rows_of(X.one_hot(features, levels) if full else features, numeric, full), len(numeric), levels.count() if full else 0


def _fitted(spark, d):
    """Per feature set: the models of the whole grid, their validation scores, and the rows of all splits."""
    out = {}
    for kind, rows, n_numeric, n_hot in _feature_rows(spark, d):
        models = N.fit_grid(rows.where("split = 'train'"), L.LOGISTIC_GRID, n_numeric, n_hot)
        out[kind] = rows, models, N.grid_scores(models, rows.where("split = 'val'"))
    return out


@query
def logistic_model(spark, d):
    """All settings of the grid on both feature sets of the train split: whether each penalised loss is at its minimum, and below that of the class shares."""
    out, sizes = [], {}
    for kind, (rows, models, _) in _fitted(spark, d).items():
        sizes = sizes or {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
        for m in models:
            out.append((kind, m.settings["C"], m.settings["weights"], sizes["train"], m.gradient < N.TOLERANCE, m.loss < math.log(N_CLASSES)))
    return printed(literal_rows(spark, out, ("kind", "c", "weights", "n_train", "at_minimum", "better_than_nothing")))


@query
def grid_select(spark, d):
    """The setting selected on validation for each feature set: its score is the largest of the grid's."""
    out = []
    for kind, (rows, models, scores) in _fitted(spark, d).items():
        i = N.best_of(models, scores)
        out.append((kind, len(scores), rows.where("split = 'val'").count(), scores[i] == max(scores) and scores.index(max(scores)) == i, 0 < scores[i] < 1))
    return printed(literal_rows(spark, out, ("kind", "settings", "n_val", "first_of_the_best", "score_is_a_share")))


@query
def logistic_scores(spark, d):
    """Metrics of the selected models, logit-seq and logit-full, on every split that was not trained on."""
    out = None
    for kind, (rows, models, scores) in _fitted(spark, d).items():
        scored = L.score_windows(models[N.best_of(models, scores)], rows.where("split <> 'train'"), f"logit-{kind}")
        out = scored if out is None else out.unionByName(scored)
    return printed(M.classification_metrics(out, ("split", "model")))


@query
def gbdt_model(spark, d):
    """Boosted trees on both feature sets: the whole grid, stopped early on validation, the selected model scored on every other split."""
    out = None
    for kind, rows, n_numeric, n_hot in _feature_rows(spark, d):
        learnt = rows.where("split in ('train', 'val')").withColumn("is_val", F.col("split") == "val")
        models = Z.fit_grid(learnt, L.TREE_GRID, n_numeric, n_hot, patience=PATIENCE)
        scores = Z.grid_scores(models, rows.where("split = 'val'"))
        i = N.best_of(models, scores)
        scored = L.score_windows(models[i], rows.where("split <> 'train'"), f"gbdt-{kind}")
        part = scored.groupBy("split", "model").agg(
            F.count("*").alias("n"), F.count_if(F.abs(F.aggregate("p", F.lit(0.0), lambda a, q: a + q) - 1) < 1e-9).alias("n_probabilities"),
            F.count_if(F.col("prediction") == class_name(argmax_code(F.col("p")))).alias("n_argmax"))
        part = part.withColumns({"settings": F.lit(len(models)).cast("long"), "first_of_the_best": F.lit(scores.index(max(scores)) == i),
                                 "not_above_the_class_shares": F.lit(all(m.loss <= m.start_loss for m in models))})
        out = part if out is None else out.unionByName(part)
    return printed(out)


@query
def score_in_batches(spark, d):
    """A caller's numpy model (smoothed frequencies) applied batch by batch."""
    def frequencies(batch):
        import numpy as np

        codes = np.stack(batch["codes"].to_numpy())
        return np.stack([(codes == k).sum(axis=1) + 1 for k in range(4)], axis=1) / (codes.shape[1] + 4)

    rows = G.score_in_batches(_windows(spark, d, "bank_a"), frequencies)
    return printed(rows.select("customer_id", "prediction", joined(F.col("p"), 6).alias("p")))


# ---- tables of scores --------------------------------------------------------------------------------------------
@query
def prediction_inventory(spark, d):
    rows = IO.inventory(P.predictions_of(spark, d, "bank_a"))
    return printed(rows.withColumn("length", F.coalesce("length", F.lit(0))))


@query
def label_scoring_table(spark, d):
    rows = P.length_predictions(spark, d, "bank_a", (NINE,)).where(F.col("model") == "noisy")
    scored = G.label_scores_to_predictions(rows.select("customer_id", F.transform("p", lambda x: 2 * F.ln(x)).alias("scores")))
    return printed(scored.select("customer_id", "prediction", joined(F.col("p"), 6).alias("p")))


@query
def clean_answers(spark, d):
    rows = G.clean_answers(P.generated_answers(spark, d, "bank_a"))
    return rows.select("customer_id", "prediction", "is_category")


@query
def invalid_answers(spark, d):
    rows = G.clean_answers(P.generated_answers(spark, d, "bank_a").unionByName(P.generated_answers(spark, d, "bank_b")))
    return printed(M.invalid_answers(rows, ("split", "model")))


@query
def generation_agreement(spark, d):
    g = G.clean_answers(P.generated_answers(spark, d, "bank_a")).withColumns({"model": F.lit("random"), "length": F.lit(0)})
    s = P.free_predictions(spark, d, "bank_a").where(F.col("model") == "random-seed2")
    return printed(G.generation_agreement(g, s.withColumns({"model": F.lit("random"), "length": F.lit(0), "split": F.lit("bank_a")})))


@query
def scorer_agreement(spark, d):
    rows = P.length_predictions(spark, d, "bank_a", (NINE,))
    logs = lambda m: rows.where(F.col("model") == m).select("customer_id", F.transform("p", lambda x: F.ln(x)).alias("scores"))
    return printed(G.scorer_agreement(logs("noisy"), logs("freq")))


@query
def align_models(spark, d):
    rows = P.predictions_of(spark, d, "bank_a", (NINE,))
    return printed(M.align_models(rows, ["averaging", "markov1", "random"]))


@query
def common_population(spark, d):
    return M.common_population(P.length_predictions(spark, d, "bank_a"))


@query
def fixed_population(spark, d):
    """Scores of every length on the customers of the longest one."""
    rows = M.at_fixed_population(P.length_predictions(spark, d, "bank_a"))
    return printed(M.classification_metrics(rows).select("model", "length", "n", *M.OVERALL, *M.CLASS_F1))


@query
def population_check(spark, d):
    rows = P.length_predictions(spark, d, "bank_a")
    partial = rows.where((F.col("length") != 4) | (F.col("model") != "freq") | (F.col("customer_id") % 3 != 0))
    return printed(M.population_check(partial))


@query
def confusion_matrix(spark, d):
    rows = P.both_predictions(spark, d)
    gen = G.clean_answers(P.generated_answers(spark, d, "bank_a")).select("split", "model", "length", "customer_id", "ground_truth", "prediction", F.lit(None).cast("array<double>").alias("p"))
    cells = M.confusion_matrix(rows.unionByName(gen), ("split", "model", "length"))
    return printed(cells.withColumn("length", F.coalesce("length", F.lit(0))))


@query
def classification_metrics(spark, d):
    rows = M.classification_metrics(P.both_predictions(spark, d), ("split", "model", "length"))
    return printed(rows.withColumn("length", F.coalesce("length", F.lit(0))))


@query
def selection_score(spark, d):
    rows = P.both_predictions(spark, d, free=False)
    return printed(M.selection_score(rows, BY_BANK).withColumn("metric", F.lit("macro_f1")).unionByName(
        M.selection_score(rows, BY_BANK, metric="f1_w").withColumn("metric", F.lit("f1_w"))))


@query
def select_best(spark, d):
    """The best model per length by macro-F1, the first listed wins ties."""
    scores = M.selection_score(P.length_predictions(spark, d, "bank_b"))
    return printed(M.select_best(scores, {m: i for i, m in enumerate(COMPARED)}, ("length",)))


@query
def probability_metrics(spark, d):
    rows = P.both_predictions(spark, d, free=False)
    name = F.when(F.col("split") == "bank_a", F.col("model")).otherwise(F.concat("model", F.lit("-b")))
    return printed(M.probability_metrics(rows.withColumn("model", name)))


@query
def model_summary(spark, d):
    rows = M.model_summary(P.predictions_of(spark, d, "bank_a"))
    return printed(rows.withColumn("length", F.coalesce("length", F.lit(0))))


@query
def seed_summary(spark, d):
    rows = M.classification_metrics(P.predictions_of(spark, d, "bank_a"))
    return printed(M.seed_summary(rows, ("acc", "macro_f1", "f1_clothing")).withColumn("length", F.coalesce("length", F.lit(0))))


@query
def shift_table(spark, d):
    return printed(M.shift_table(P.both_predictions(spark, d, (NINE,), free=False), "bank_a", "bank_b"))


@query
def subgroup_metrics(spark, d):
    """Scores by gender and age band of profiled customers."""
    p = T.profiles(spark, d).select("customer_id", "gender", age_band(F.col("age")).alias("age_band"))
    rows = P.length_predictions(spark, d, "bank_a", (NINE,))
    return printed(M.group_metrics(rows, p).select("model", "variable", "level", "n", "acc", "macro_f1", "r_clothing", "f1_clothing"))


def _slices(spark, d, bank):
    return _slices_of(_windows(spark, d, bank))


def _slices_of(windows):
    return W.window_shape(windows).select("customer_id", span_band(F.col("span_days")).alias("span"), F.col("distinct_inputs").cast("string").alias("distinct"))


@query
def slice_metrics(spark, d):
    """Seed means by span slice and by number of distinct input classes, on both banks."""
    rows = P.both_predictions(spark, d, (NINE,), free=False).where(F.col("model").isin("averaging") | F.col("model").startswith("coin"))
    slices = P.both_banks(spark, d, lambda tx: _slices_of(W.last_windows(tx, NINE))).withColumnRenamed("bank", "split")
    means = M.seed_summary(M.group_metrics(rows, slices, ("split", "model"), ("split", "customer_id")), ("acc", "f1_w", "macro_f1", "f1_clothing"), ("split", "variable", "level"))
    return printed(means.drop("acc_sd", "f1_w_sd", "macro_f1_sd", "f1_clothing_sd"))


@query
def slice_shares(spark, d):
    a, b = (M.level_shares(_slices(spark, d, bank)).withColumn("split", F.lit(bank)) for bank in ("bank_a", "bank_b"))
    return printed(a.unionByName(b))


# ---- calibration -------------------------------------------------------------------------------------------------
@query
def reliability_table(spark, d):
    return printed(K.reliability_table(P.both_predictions(spark, d, free=False), BY_BANK))


@query
def class_reliability(spark, d):
    return printed(K.class_reliability(P.both_predictions(spark, d, free=False), "Clothing", BY_BANK))


@query
def class_calibration(spark, d):
    return printed(K.class_calibration(P.both_predictions(spark, d, free=False), BY_BANK))


@query
def cost_threshold(spark, d):
    return printed(K.cost_threshold(P.both_predictions(spark, d, free=False), "Clothing", BY_BANK))


@query
def operating_point(spark, d):
    """Thresholds chosen on bank A, applied to bank B."""
    return printed(K.operating_point(P.length_predictions(spark, d, "bank_a"), P.length_predictions(spark, d, "bank_b"), "Clothing"))


# ---- resampling and tests ------------------------------------------------------------------------------------------
SCORED = ["averaging", "last-category", "markov1", "coin", "coin-seed2", "coin-seed3"]


def _aligned(spark, d, bank, models, lengths=DEFAULTS.lengths):
    rows = P.length_predictions(spark, d, bank, lengths).where(F.col("model").isin(*models))
    return durable(R.answers(IO.with_codes(rows), models))


BANKS = ("split", "length")


def _cells_of_banks(spark, d):
    """Joint cells of both banks at every length, and the aligned answers."""
    rows = P.both_predictions(spark, d, free=False).where(F.col("model").isin(*SCORED))
    aligned = durable(R.answers(IO.with_codes(rows), SCORED, BANKS))
    return aligned, R.joint_cells(aligned, BANKS)


@query
def bootstrap_intervals(spark, d):
    """10,000 multinomial resamples of both banks at every length: point scores with their intervals."""
    aligned, cells = _cells_of_banks(spark, d)
    limits = R.metric_intervals(R.draw_scores(R.multinomial_draws(cells, SCORED, BANKS)), (*BANKS, "model"))
    points = M.long_metrics(R.point_scores(aligned, SCORED, BANKS), (*BANKS, "model"))
    return printed(points.join(limits, [*BANKS, "model", "metric"]))


@query
def bootstrap_law(spark, d):
    """Whether the same resamples' cell counts have the mean and the variance of their law."""
    _, cells = _cells_of_banks(spark, d)
    return printed(R.cell_law(cells, R.multinomial_draws(cells, SCORED, BANKS), SCORED, BANKS))


@query
def poisson_bootstrap(spark, d):
    """The confusion cells of every hashed resample."""
    return printed(R.poisson_draws(R.joint_cells(_aligned(spark, d, "bank_a", SCORED)), SCORED))


@query
def metric_intervals(spark, d):
    draws = HASHED.scores(_aligned(spark, d, "bank_a", SCORED), SCORED, ("length",))
    return printed(R.metric_intervals(draws))


@query
def seed_mean(spark, d):
    aligned = _aligned(spark, d, "bank_a", SCORED)
    return printed(R.seed_means(R.point_scores(aligned, SCORED)))


@query
def paired_comparison(spark, d):
    aligned = _aligned(spark, d, "bank_a", SCORED)
    pairs = [("coin", "averaging"), ("coin", "markov1"), ("averaging", "averaging")]
    return printed(R.compare(R.point_scores(aligned, SCORED), HASHED.scores(aligned, SCORED, ("length",)), pairs))


@query
def mcnemar_exact(spark, d):
    rows = P.both_predictions(spark, d, free=False).where(F.col("model").isin(*SCORED))
    by = ("split", "length")
    cells = R.joint_cells(R.answers(IO.with_codes(rows), SCORED, by), by)
    return printed(S.mcnemar(cells, SCORED, [("coin", m) for m in COMPARED] + [("coin", "coin")], by), dyadic=EXACT)


@query
def holm(spark, d):
    cells = R.joint_cells(_aligned(spark, d, "bank_a", SCORED))
    tests = S.mcnemar(cells, SCORED, [(a, m) for a in ("coin", "coin-seed2") for m in COMPARED])
    return printed(S.holm(tests, "mcnemar_p", ("length", "a")).select("length", "a", "b", "mcnemar_p", "p_holm"), dyadic=EXACT)


@query
def significance_table(spark, d):
    return printed(S.significance_table(P.predictions_of(spark, d, "bank_a"), ["coin", "noisy"], [*COMPARED, "random", "proportional"], HASHED), dyadic=EXACT[:2])


@query
def families(spark, d):
    return printed(S.families(P.predictions_of(spark, d, "bank_a"), ["coin"], list(COMPARED), HASHED))


@query
def choose_comparator(spark, d):
    return printed(S.choose_comparator(P.length_predictions(spark, d, "bank_a", (NINE,)), COMPARED))


def _primary(spark, d, resampler, without=None):
    return S.primary_endpoint(P.length_predictions(spark, d, "bank_a", (NINE,)), P.length_predictions(spark, d, "bank_b", (NINE,)),
                              "coin", resampler, COMPARED, NINE, without)


@query
def primary_endpoint(spark, d):
    return printed(_primary(spark, d, HASHED))


@query
def primary_endpoint_without_ties(spark, d):
    return printed(_primary(spark, d, HASHED, C.tied_customers(T.bank_b(spark, d))))


@query
def primary_endpoint_exact(spark, d):
    """The same endpoint with 10,000 multinomial resamples."""
    return printed(_primary(spark, d, S.Resampler()))


PAIR_SPECS = ("coin:averaging", "coin,coin-seed2,coin-seed3:markov1", "coin@4:coin@9", "coin:random", "coin:absent")


@query
def pair_table(spark, d):
    return printed(S.compare_pairs(P.predictions_of(spark, d, "bank_a"), PAIR_SPECS, HASHED), dyadic=EXACT[:2])


@query
def factorial_effects(spark, d):
    return printed(S.factorial_effects(P.factorial_predictions(spark, d, "bank_a"), P.FACTORIAL_CELLS, HASHED))


# ---- logs --------------------------------------------------------------------------------------------------------
@query
def run_cost(spark, d):
    """Training and scoring records, here of customers and orders, rolled up per model; a model may have only one of the two."""
    training = T.table(spark, d, "customer").selectExpr(
        "concat('m', c_nationkey, '-seed', c_custkey) AS run", "abs(c_acctbal) / 100 AS hours", "CAST(c_custkey % 32 AS DOUBLE) AS peak_gb", "c_custkey * 10 AS steps")
    passes = F.when(F.col("scorer") == "first", 1).when(F.col("scorer") == "sequence", 4)
    scoring = T.table(spark, d, "orders").selectExpr(
        "concat('m', o_custkey % 30, '-seed', o_orderkey) AS run", "CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'sequence' ELSE 'other' END AS scorer",
        "o_orderkey % 100 + 1 AS n", "o_totalprice / 1000 AS seconds").withColumns({"passes_per_prompt": passes, "ms_per_customer": 1000 * F.col("seconds") / F.col("n")})
    named = lambda df: df.withColumn("model", IO.base_model(F.col("run")))
    return printed(logs.run_cost(named(training), named(scoring)))
