"""Heuristic predictors. Input: window rows (customer_id, length, codes, target, ground_truth)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, argmax_code, class_name, count_code, hash_uniform, last_seen
from tillflow.settings import DEFAULTS


def random_code(seed, key: Column) -> Column:
    return F.floor(hash_uniform(f"{seed}:random", key) * N_CLASSES).cast("int")


def proportional_code(shares: Column, seed, key: Column) -> Column:
    """A class drawn from `shares` (array of four): the number of cumulative shares at or below the uniform number."""
    u = hash_uniform(f"{seed}:proportional", key)
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    running, passed = F.lit(0.0), F.lit(0)
    for k in range(N_CLASSES - 1):
        running = running + F.get(shares, F.lit(k)) / total
        passed = passed + F.when(u >= running, 1).otherwise(0)
    return passed.cast("int")


def most_frequent_code(codes: Column, ties: str = "recency") -> Column:
    """Modal class. Ties go to the class seen last, or with ties="lowest" to the lowest code."""
    return argmax_code(_class_keys(codes, ties))


def _class_keys(codes: Column, ties: str) -> Column:
    """Per class a number that is largest for the modal class: its count, then (recency) the place it was last seen."""
    if ties == "lowest":
        return F.array(*[count_code(codes, k) for k in range(N_CLASSES)])
    width = F.size(codes) + 1
    return F.array(*[count_code(codes, k) * width + last_seen(codes, k) for k in range(N_CLASSES)])


def last_code(codes: Column) -> Column:
    return F.element_at(codes, -1)


def markov_fit(windows: DataFrame) -> DataFrame:
    """(prev, next, n, p): transitions between neighbours, inputs and target, add-one smoothed, complete 4 x 4 grid."""
    before, after = "slice(steps, 1, size(steps) - 1)", "slice(steps, 2, size(steps) - 1)"
    pair = F.expr(f"zip_with({before}, {after}, (a, b) -> a.code * {N_CLASSES} + b.code)")
    seen = windows.select(F.explode(pair).alias("cell")).groupBy("cell").agg(F.count("*").alias("seen"))
    grid = windows.sparkSession.range(N_CLASSES * N_CLASSES).select(F.col("id").cast("int").alias("cell"))
    full = grid.join(F.broadcast(seen), "cell", "left").select(        # 16 cells
        F.floor(F.col("cell") / N_CLASSES).cast("int").alias("prev"), (F.col("cell") % N_CLASSES).cast("int").alias("next"),
        (F.coalesce("seen", F.lit(0)) + 1).alias("n"))
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def transition_matrix(transitions: DataFrame) -> DataFrame:
    """One row, column `m`: ARRAY<ARRAY<DOUBLE>>, rows and columns in code order."""
    rows = transitions.groupBy("prev").agg(F.array_sort(F.collect_list(F.struct("next", "p"))).alias("r"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("prev", F.transform("r", lambda x: x["p"]).alias("r")))).alias("m")
                    ).select(F.transform("m", lambda x: x["r"]).alias("m"))


def share_vector(shares: DataFrame) -> DataFrame:
    """One row, the four class shares in code order."""
    return shares.agg(F.array_sort(F.collect_list(F.struct("code", "share"))).alias("s")).select(
        F.transform("s", lambda x: x["share"]).alias("s"))


def name_of(base: str, seed: int) -> str:
    return base if seed == DEFAULTS.seed else f"{base}-seed{seed}"


def score_baselines(windows: DataFrame, transitions: DataFrame | None, shares: DataFrame | None = None, ties: str = "recency",
                    seeds=(DEFAULTS.seed,), more: dict | None = None, keys=("customer_id",)) -> DataFrame:
    """Every heuristic answer of every window in one pass: (keys, length, ground_truth, model, prediction, p).

    averaging, last-category and, with `transitions`, markov1 answer each window. With `shares` the windows of length 1
    (the final purchase of every customer) are answered by random and proportional only, without a length. `more` adds
    predictors that read windows: name -> (code expression, probability expression or None).
    """
    none = F.lit(None).cast("array<double>")
    w, extra = windows.withColumn("_keys", _class_keys(F.col("codes"), ties)), more or {}
    columns = {"_averaging": argmax_code(F.col("_keys")), "_last": last_code(F.col("codes"))}
    if transitions is not None:
        w = w.withColumn("_m", transition_matrix(transitions).scalar())
        columns["_p"] = F.get("_m", last_code(F.col("codes")))
    columns |= {f"_x{i}": p for i, (_, p) in enumerate(extra.values()) if p is not None}
    w = w.withColumns(columns)
    answer = lambda model, code, p=none: F.struct(F.lit(model).alias("model"), code.alias("code"), p.alias("p"))
    rules = [answer("averaging", F.col("_averaging")), answer("last-category", F.col("_last"))]
    if transitions is not None:
        rules.append(answer("markov1", argmax_code(F.col("_p")), F.col("_p")))
    for i, (name, (code, p)) in enumerate(extra.items()):
        rules.append(answer(name, argmax_code(F.col(f"_x{i}")) if code is None else code, none if p is None else F.col(f"_x{i}")))
    listed, length = F.array(*rules), F.col("length")
    if shares is not None:
        w = w.withColumn("_s", share_vector(shares).scalar())
        draws = [answer(name_of(m, s), c) for s in seeds for m, c in (
            ("random", random_code(s, F.col("customer_id"))), ("proportional", proportional_code(F.col("_s"), s, F.col("customer_id"))))]
        listed = F.when(length == 1, F.array(*draws)).otherwise(listed)
        length = F.when(length != 1, length)
    rows = w.select(*keys, length.alias("length"), "ground_truth", F.inline(listed))
    return rows.select("model", "length", *keys, "ground_truth", class_name(F.col("code")).alias("prediction"), "p")
