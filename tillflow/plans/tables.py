"""Windows and prediction tables of both banks, the inputs of the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES
from tillflow.operators import baselines as B
from tillflow.operators.cohort import class_shares, cohort_customers
from tillflow.operators.windows import last_windows, windows_at
from tillflow.settings import DEFAULTS
from tillflow.sources import testdata as T
from tillflow.sources.tables import between_dates

SEASON = ("1996-01-01", "1998-12-31")         # of bank A's years; bank B has one year, see season_b
SEASON_B = ("2024-01-01", "2024-06-30")
DRAW_SEEDS = (42, 2, 3)
COIN_SEEDS = (42, 2, 3)
FACTORIAL_CELLS = {(i, j, k): f"cell{i}{j}{k}" for i in (0, 1) for j in (0, 1) for k in (0, 1)}


def transactions(spark: SparkSession, d: str, bank: str) -> DataFrame:
    return T.bank_a(spark, d) if bank == "bank_a" else T.bank_b(spark, d)


def both_banks(spark, d, make) -> DataFrame:
    """`make(transactions)` of both banks under a `bank` column."""
    a, b = (make(transactions(spark, d, bank)).withColumn("bank", F.lit(bank)) for bank in ("bank_a", "bank_b"))
    return a.unionByName(b)


def cohort_of(spark, d, bank: str) -> DataFrame:
    return cohort_customers(transactions(spark, d, bank), T.profiles(spark, d))


def season_cohort(spark, d) -> DataFrame:
    return cohort_customers(between_dates(T.bank_b(spark, d), *SEASON_B), T.profiles(spark, d))


CODES_ONLY = ("code",)


def fitted_transitions(spark, d) -> DataFrame:
    return B.markov_fit(last_windows(T.bank_a(spark, d), DEFAULTS.train_length, CODES_ONLY))


def _hash(text: str) -> str:
    """Uniform number hashed from a text, the length and the customer (as in functions.expressions.hash_uniform)."""
    return f"(CAST(conv(substring(md5(concat_ws(':', '{text}', length, customer_id)), 1, 8), 16, 10) AS DOUBLE) / 4294967296D)"


def coin_code(seed, name: str, right: float):
    """The true class with probability `right`, else a hashed class: a stand-in for a learned model."""
    hashed = _hash(f"{seed}:{name}")
    return F.expr(f"CASE WHEN {_hash(f'{seed}:{name}-right')} < {right!r}D THEN target ELSE CAST(floor({hashed} * {N_CLASSES}) AS INT) END")


def frequency_vector():
    """p_k = (count_k + 1) / (X + 4)."""
    terms = [f"(size(filter(codes, c -> c = {k})) + 1) / (size(codes) + {N_CLASSES})" for k in range(N_CLASSES)]
    return F.expr(f"array({', '.join(terms)})")


def with_noise(windows: DataFrame) -> DataFrame:
    """Add `noise`: a hashed number per class, with a bonus for the true class."""
    u = [f"{_hash(f'{DEFAULTS.seed}:noisy{k}')} + IF(target = {k}, 0.3D, 0D)" for k in range(N_CLASSES)]
    return windows.withColumn("noise", F.expr(f"array({', '.join(u)})"))


def noisy_vector():
    """The noise, normalised: many distinct probabilities."""
    total = " + ".join(f"noise[{k}]" for k in range(N_CLASSES))
    return F.expr(f"transform(noise, x -> x / ({total}))")


def length_models() -> dict:
    """Test-only predictors: freq and noisy give probabilities, coin has three seeds."""
    return {"freq": (None, frequency_vector()), "noisy": (None, noisy_vector()),
            **{B.name_of("coin", s): (coin_code(s, "coin", 0.4), None) for s in COIN_SEEDS}}


def length_predictions(spark, d, bank: str, lengths=DEFAULTS.lengths) -> DataFrame:
    """averaging, last-category, markov1, freq, noisy, and three seeds of coin."""
    w = windows_at(transactions(spark, d, bank), lengths, CODES_ONLY)
    return B.score_baselines(with_noise(w), fitted_transitions(spark, d), more=length_models())


def free_predictions(spark, d, bank: str) -> DataFrame:
    """random and proportional, three seeds each; shares come from bank A."""
    final = last_windows(transactions(spark, d, bank), 1, CODES_ONLY)
    return B.score_baselines(final, None, class_shares(T.bank_a(spark, d)), seeds=DRAW_SEEDS)


def predictions_of(spark, d, bank: str, lengths=DEFAULTS.lengths) -> DataFrame:
    """Everything of one bank from one ranking, with `split` = the bank."""
    w = windows_at(transactions(spark, d, bank), (1, *lengths), CODES_ONLY)
    rows = B.score_baselines(with_noise(w), fitted_transitions(spark, d), class_shares(T.bank_a(spark, d)), seeds=DRAW_SEEDS, more=length_models())
    return rows.withColumn("split", F.lit(bank))


def both_predictions(spark, d, lengths=DEFAULTS.lengths, free: bool = True) -> DataFrame:
    """Predictions of both banks; the banks are one table of windows, so one pass answers both."""
    wanted = (1, *lengths) if free else lengths
    w = both_banks(spark, d, lambda tx: windows_at(tx, wanted, CODES_ONLY)).withColumnRenamed("bank", "split")
    return B.score_baselines(with_noise(w), fitted_transitions(spark, d), class_shares(T.bank_a(spark, d)) if free else None,
                             seeds=DRAW_SEEDS, more=length_models(), keys=("split", "customer_id"))


def generated_answers(spark, d, bank: str) -> DataFrame:
    """Free text of the random model: a trailing period, outer space, and 'n/a' for every fiftieth customer."""
    rows = free_predictions(spark, d, bank).where(F.col("model") == "random")
    text = F.when(F.col("customer_id") % 50 == 0, "n/a").otherwise(F.concat(F.lit(" "), "prediction", F.lit(".")))
    return rows.select(F.lit(bank).alias("split"), F.lit("random-gen").alias("model"), "length", "customer_id", "ground_truth", text.alias("answer"))


def factorial_predictions(spark, d, bank: str, length: int = DEFAULTS.train_length) -> DataFrame:
    w = last_windows(transactions(spark, d, bank), length, CODES_ONLY)
    cells = {name: (coin_code(DEFAULTS.seed, name, 0.25 + 0.05 * sum(level)), None) for level, name in FACTORIAL_CELLS.items()}
    return B.score_baselines(w, None, more=cells)
