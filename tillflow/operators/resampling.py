"""Paired bootstrap of prediction tables.

Rows: population keys `by`, customer_id, model, y, yhat. All models of a population are resampled together. Metrics
depend on a resample only through counts of joint cells (truth and the answer of every model), so the resampling runs
on those cells: counting cells of customers drawn with replacement is one multinomial draw over the cells.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES
from tillflow.operators.metrics import ALL_METRICS, CELLS, add_metrics, confusion_cells
from tillflow.settings import DEFAULTS
from tillflow.sources.predictions import base_model
from tillflow.sources.session import durable

ABSENT = -1                    # code of a model that has no answers in a population
CELLS_PER_TASK = 4096
DRAWS_PER_BLOCK = 250
FAN = 256                      # children of a node of the tree of parts


def at_every_length(predictions: DataFrame) -> DataFrame:
    """Repeat the answers of length-free models at every length that has the customer."""
    where = predictions.where(F.col("length").isNotNull()).select("customer_id", "length").distinct()
    free = predictions.where(F.col("length").isNull()).drop("length").join(where, "customer_id")
    return predictions.where(F.col("length").isNotNull()).unionByName(free)


def _wide_answers(rows: DataFrame, models, by) -> DataFrame:
    listed = ", ".join(f"CAST(coalesce(max(yhat) FILTER (WHERE model = '{m}'), {ABSENT}) AS INT)" for m in models)
    return rows.where(F.col("model").isin(*models)).groupBy(*by, "customer_id").agg(F.max("y").alias("y"), F.expr(f"array({listed})").alias("codes"))


def _present(codes: str = "codes") -> Column:
    return F.size(F.filter(codes, lambda c: c != ABSENT))


def answers(rows: DataFrame, models, by=("length",)) -> DataFrame:
    """One row per customer of a population: y and `codes`, the answers in the order of `models`. Customers missing in one are left out."""
    return _wide_answers(rows, models, by).where(_present() == len(models))


def aligned_answers(rows: DataFrame, models, by=("length",), same=lambda population: True) -> DataFrame:
    """The same as a written table, for populations that need not have all of `models`; a model that a population lacks is ABSENT in it.

    Customers missing in one of their population's models are left out; where `same` holds for a population (a row of `by`), they stop the
    job. What a population has is counted in the written table, a row per population, so the predictions are evaluated once.
    """
    by = list(by)
    wide = durable(_wide_answers(rows, models, by))
    held = wide.groupBy(*by).agg(F.count("*").alias("_n"), *[F.count_if(F.get("codes", F.lit(i)) != ABSENT).alias(f"_{i}") for i in range(len(models))]).collect()
    partial = [r for r in held if any(0 < r[f"_{i}"] < r["_n"] for i in range(len(models)))]
    wrong = sorted({str(r[by[-1]]) for r in partial if same(r)})
    if wrong:
        raise ValueError(f"models cover different customers at length {', '.join(wrong)}")
    whole = F.lit(True)
    for r in partial:
        here = F.lit(True)
        for c in by:
            here = here & F.col(c).eqNullSafe(F.lit(r[c]))
        whole = F.when(here, _present() == sum(r[f"_{i}"] > 0 for i in range(len(models)))).otherwise(whole)
    return wide.where(whole)


def joint_cells(aligned: DataFrame, by=("length",)) -> DataFrame:
    return aligned.groupBy(*by, "y", "codes").agg(F.count("*").alias("n"))


def _part_totals(parted: DataFrame, by: list, blocks: Column, draws: int, seed: int) -> DataFrame:
    """(by, _part, _block, _total): how many of each resample's customers fall into each part, an array over the draws of the block."""
    types, n_by, per_block = dict(parted.dtypes), len(by), DRAWS_PER_BLOCK
    weights = parted.groupBy(*by, "_part").agg(F.sum("n").alias("_w"))
    most, depth = weights.agg(F.max("_part")).first()[0], 1
    while most is not None and most + 1 > FAN ** depth:
        depth += 1
    size = F.least(F.lit(per_block), F.lit(draws) - F.col("_block") * per_block)
    above = (weights.groupBy(*by).agg(F.sum("_w").alias("_w")).withColumn("_block", F.explode(blocks))
             .select(*by, F.lit(0).cast("long").alias("_node"), "_block", F.array_repeat("_w", size.cast("int")).alias("_total")))
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["_node long", "_block int", "_total array<long>"])

    def sharer(level):
        def share(key, rows, parent):
            import numpy as np
            import pandas as pd

            rows = rows.sort_values("_child")
            w, node, block = rows["_w"].to_numpy(dtype=np.int64), int(key[n_by]), int(key[n_by + 1])
            total = np.asarray(parent["_total"].iloc[0], dtype=np.int64)
            drawn = np.random.default_rng([seed, block, node, level + 1]).multinomial(total, np.tile(w / w.sum(), (len(total), 1)))
            out = pd.DataFrame({"_node": rows["_child"].to_numpy(), "_block": block, "_total": list(drawn.T)})
            for i, value in enumerate(key[:n_by]):
                out.insert(i, by[i], value)
            return out

        return share

    for level in reversed(range(depth)):
        children = (weights.groupBy(*by, F.expr(f"_part div {FAN ** level}").alias("_child")).agg(F.sum("_w").alias("_w"))
                    .withColumn("_parent", F.expr(f"_child div {FAN}")).withColumn("_block", F.explode(blocks)))
        keys = [*by, "_parent", "_block"]
        up = above.select(*[F.col(c).alias(f"_of{c}") for c in by], F.col("_node").alias("_of_parent"), F.col("_block").alias("_of_block"), "_total")
        above = children.select(*keys, "_child", "_w").groupBy(*keys).cogroup(
            up.groupBy(*[f"_of{c}" for c in by], "_of_parent", "_of_block")).applyInPandas(sharer(level), schema)
    return above.withColumnRenamed("_node", "_part").withColumn("_part", F.col("_part").cast("int"))


def _unfolded(drawn, y, codes, models, columns, keys, first_draw):
    """Resampled counts of joint cells (draws x cells) as confusion cells of every model that has answers."""
    import numpy as np
    import pandas as pd

    out, drawn = [], drawn.astype(np.float64)                                # counts: exact in a float product
    for j, model in enumerate(models):
        if (codes[:, j] == ABSENT).any():
            continue
        slots = np.zeros((len(y), len(CELLS)))
        slots[np.arange(len(y)), y * (N_CLASSES + 1) + codes[:, j]] = 1
        frame = pd.DataFrame((drawn @ slots).astype(np.int64), columns=list(CELLS))
        frame.insert(0, "model", model)
        frame.insert(0, "draw", first_draw + np.arange(len(drawn)))
        for i, value in enumerate(keys):
            frame.insert(i, columns[i], value)
        out.append(frame)
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def multinomial_draws(cells: DataFrame, models, by=("length",), draws: int = DEFAULTS.bootstrap_draws,
                      seed: int = DEFAULTS.seed) -> DataFrame:
    """Resampled confusion cells: (by, draw, model, c00 .. c34).

    Cells are cut into parts of about CELLS_PER_TASK and draws into blocks. A tree hands a resample's size down to the parts, FAN
    children at a time, once per block; then each part splits its share over its cells. Every step reads and writes rows in proportion
    to cells or parts. The streams hang on seed, level, block and node only, so the result does not depend on the cluster; a population
    cut into another number of parts draws other numbers by the same law.
    """
    by, models = list(by), list(models)
    sizes = cells.groupBy(*by).agg(F.ceil(F.count("*") / CELLS_PER_TASK).alias("_parts"))
    parted = cells.join(sizes, by).withColumn("_part", F.pmod(F.xxhash64("y", "codes"), F.col("_parts")).cast("int"))
    blocks = F.sequence(F.lit(0), F.lit(-(-draws // DRAWS_PER_BLOCK) - 1))
    work = parted.withColumn("_block", F.explode(blocks)).select(*by, "_part", "_block", "y", "codes", "n")
    n_by, per_block, columns = len(by), DRAWS_PER_BLOCK, [*by, "draw", "model", *CELLS]
    totals = _part_totals(parted, by, blocks, draws, seed)

    def resample(key, part, whole):
        import numpy as np
        import pandas as pd

        keys, this, block = key[:n_by], int(key[n_by]), int(key[n_by + 1])
        size = min(per_block, draws - block * per_block)
        codes, y = np.stack(part["codes"].to_numpy()), part["y"].to_numpy()
        order = np.lexsort(np.column_stack([codes, y]).T)
        codes, y, n = codes[order], y[order], part["n"].to_numpy(dtype=np.int64)[order]
        total = np.asarray(whole["_total"].iloc[0], dtype=np.int64)
        drawn = np.random.default_rng([seed, block, this + 1]).multinomial(total, np.tile(n / n.sum(), (size, 1)))
        return _unfolded(drawn, y, codes, models, columns, keys, block * per_block)

    types = dict(cells.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["draw int", "model string"] + [f"{c} long" for c in CELLS])
    keys = [*by, "_part", "_block"]
    whole = totals.select(*[F.col(c).alias(f"_of{c}") for c in keys], "_total")                # own names: both sides share a source
    shares = work.groupBy(*keys).cogroup(whole.groupBy(*[f"_of{c}" for c in keys])).applyInPandas(resample, schema)
    return shares.groupBy(*by, "draw", "model").agg(*[F.sum(c).alias(c) for c in CELLS])


# ---- fixed values: multipliers of a 32-bit mixing function ----
MIXERS = (0x85EBCA6B, 0xC2B2AE35)
STRIDES = (0x9E3779B1, 0x85EBCA77)       # of draws and of chunks
CHUNK = 64                               # customers of a chunk, or a power of it


def _mixed(x):
    """A bijection on 32 bits that spreads every bit (numpy uint64 in, uint64 below 2^32 out)."""
    import numpy as np

    low = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIXERS[0])) & low
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(MIXERS[1])) & low
    return x ^ (x >> np.uint64(16))


def _poisson_limits(mean: int):
    """32-bit limits: a uniform number reaches as many of them as a Poisson count with this mean has."""
    import math

    import numpy as np

    k = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    logs = k * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    limits = np.floor(np.cumsum(np.exp(logs)) * 2.0 ** 32)
    return limits[limits < 2.0 ** 32].astype(np.uint64)


def chunks_of(n):
    """Cells' customers cut into chunks: (cell, number of the chunk, customers). One chunk of n mod 64, then powers of 64, fewer than 64 of each."""
    import numpy as np

    n = np.asarray(n, np.int64)
    cell, number, size, level = [np.flatnonzero(n % CHUNK)], [np.zeros(int((n % CHUNK > 0).sum()), np.int64)], [n[n % CHUNK > 0] % CHUNK], 1
    while len(n) and n.max() >= CHUNK ** level:
        digit = n // CHUNK ** level % CHUNK
        cell.append(np.repeat(np.arange(len(n)), digit))
        number.append(CHUNK * level + np.arange(digit.sum()) - np.repeat(np.cumsum(digit) - digit, digit))
        size.append(np.full(int(digit.sum()), CHUNK ** level))
        level += 1
    return tuple(np.concatenate(x) for x in (cell, number, size))


def poisson_draws(cells: DataFrame, models, by=("length",), draws: int = DEFAULTS.bootstrap_draws, seed: int = DEFAULTS.seed) -> DataFrame:
    """The same confusion cells from hashed Poisson weights: each customer of a resample counts Poisson(1) times.

    The weights of a cell's customers matter only as their sum, a Poisson number with the cell's size as mean. A cell is cut into chunks
    of fewer than 64 customers or a power of 64, and each chunk draws one number from a hash of seed, population, cell, chunk and draw:
    the work is cells x draws, and the numbers do not depend on partitioning. Draws count from 1.
    """
    by, models = list(by), list(models)
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("y").cast("string"),
                             F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")))
    word = lambda i: F.conv(F.substring(name, 1 + 8 * i, 8), 16, 10).cast("long")
    sizes = cells.groupBy(*by).agg(F.ceil(F.count("*") / CELLS_PER_TASK).alias("_parts"))
    parted = cells.join(sizes, by).withColumn("_part", F.pmod(F.xxhash64("y", "codes"), F.col("_parts")).cast("int"))
    blocks = F.sequence(F.lit(0), F.lit(-(-draws // DRAWS_PER_BLOCK) - 1))
    work = parted.withColumns({"_w0": word(0), "_w1": word(1)}).withColumn("_block", F.explode(blocks)).select(
        *by, "_part", "_block", "y", "codes", "n", "_w0", "_w1")
    n_by, per_block, columns = len(by), DRAWS_PER_BLOCK, [*by, "draw", "model", *CELLS]

    def resample(key, part):
        import numpy as np

        block = int(key[n_by + 1])
        draw = np.arange(block * per_block + 1, min(draws, (block + 1) * per_block) + 1, dtype=np.uint64)
        w0, w1 = (part[c].to_numpy(dtype=np.uint64) for c in ("_w0", "_w1"))
        low = np.uint64(0xFFFFFFFF)
        of_draw = _mixed(w0 ^ ((draw * np.uint64(STRIDES[0])) & low)[:, None])
        cell, number, size = chunks_of(part["n"])
        of_chunk = _mixed(w1[cell] ^ ((number.astype(np.uint64) * np.uint64(STRIDES[1])) & low))
        drawn = np.zeros((len(draw), len(part)), np.int64)
        for mean in np.unique(size):
            limits, these = _poisson_limits(int(mean)), np.flatnonzero(size == mean)
            for s in range(0, len(these), CELLS_PER_TASK):                   # a cell has few chunks of a size, a part may have many
                some = these[s:s + CELLS_PER_TASK]
                counts = np.searchsorted(limits, _mixed(of_draw[:, cell[some]] ^ of_chunk[some]), side="right")
                order = np.argsort(cell[some], kind="stable")
                own = cell[some][order]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                drawn[:, own[first]] += np.add.reduceat(counts[:, order], first, axis=1)
        return _unfolded(drawn, part["y"].to_numpy(), np.stack(part["codes"].to_numpy()), models, columns, key[:n_by], int(draw[0]))

    types = dict(cells.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["draw int", "model string"] + [f"{c} long" for c in CELLS])
    shares = work.groupBy(*by, "_part", "_block").applyInPandas(resample, schema)
    return shares.groupBy(*by, "draw", "model").agg(*[F.sum(c).alias(c) for c in CELLS])


def cell_law(cells: DataFrame, draws: DataFrame, models, by=("length",), n_draws: int = DEFAULTS.bootstrap_draws, errors: float = 5.0) -> DataFrame:
    """(by, model, truth, answer, expected_mean, expected_var, mean_ok, var_ok): do multinomial resamples follow their law?

    A confusion cell that holds a share p of n customers is a binomial count in every resample, with mean np and variance np(1 - p).
    ok: mean and variance over the draws lie within `errors` standard errors of these; those of the variance come from the binomial's
    fourth moment. Only cells that occur are listed.
    """
    by, listed = list(by), F.array(*[F.struct(F.lit(m).alias("model"), F.get("codes", F.lit(i)).alias("answer")) for i, m in enumerate(models)])
    own = (cells.select(*by, "y", "n", F.inline(listed)).where(F.col("answer") != ABSENT).groupBy(*by, "model", F.col("y").alias("truth"), "answer")
           .agg(F.sum("n").cast("double").alias("c")))
    size = cells.groupBy(*by).agg(F.sum("n").cast("double").alias("_n"))
    p = F.col("c") / F.col("_n")
    law = own.join(size, by).withColumns({"expected_mean": F.col("c"), "expected_var": F.col("c") * (1 - p), "_pq": p * (1 - p)})
    unpivoted = draws.select(*by, "model", F.inline(F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(a).alias("answer"), F.col(f"c{t}{a}").alias("x"))
                                                               for t in range(N_CLASSES) for a in range(N_CLASSES + 1)])))
    seen = unpivoted.groupBy(*by, "model", "truth", "answer").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    fourth = F.col("expected_var") * (1 + 3 * (F.col("_n") - 2) * F.col("_pq"))
    mean_error = F.sqrt(F.col("expected_var") / n_draws)
    var_error = F.sqrt((fourth - F.pow("expected_var", F.lit(2.0)) * (n_draws - 3) / (n_draws - 1)) / n_draws)
    tiny = 1e-9
    return law.join(seen, [*by, "model", "truth", "answer"]).select(
        *by, "model", "truth", "answer", "expected_mean", "expected_var", (F.abs(F.col("m") - F.col("expected_mean")) <= errors * mean_error + tiny).alias("mean_ok"),
        (F.abs(F.col("v") - F.col("expected_var")) <= errors * var_error + tiny).alias("var_ok"))


def point_scores(aligned: DataFrame, models, by=("length",)) -> DataFrame:
    """Metrics of every model on the aligned customers: (by, model, metrics)."""
    cells = joint_cells(aligned, by)
    rows = cells.select(*by, "y", "n", F.inline(F.arrays_zip(
        F.array(*map(F.lit, models)).alias("model"), F.col("codes").alias("yhat")))).where(F.col("yhat") != ABSENT)
    return add_metrics(confusion_cells(rows, (*by, "model"), "n")).drop(*CELLS)


def draw_scores(draws: DataFrame) -> DataFrame:
    return add_metrics(draws).drop(*CELLS)


def seed_means(scores: DataFrame, by=("length",), metrics=tuple(ALL_METRICS)) -> DataFrame:
    """Average over the seeds of a model (also per draw, when `draw` is one of `by`)."""
    return (scores.withColumn("model", base_model(F.col("model"))).groupBy(*by, "model")
            .agg(F.count("*").alias("seeds"), F.max("n").alias("n"), *[F.avg(m).alias(m) for m in metrics]))


def metric_intervals(scores: DataFrame, by=("length", "model"), metrics=tuple(ALL_METRICS), level=(0.025, 0.975)) -> DataFrame:
    """(by, metric, low, high): percentiles over the draws. A group holds one value per draw."""
    q = scores.groupBy(*by).agg(*[F.percentile(m, F.array(*map(F.lit, level))).alias(m) for m in metrics])
    return q.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.get(m, F.lit(0)).alias("low"),
                                                     F.get(m, F.lit(1)).alias("high")) for m in metrics])))


TOLERANCE = 1e-12                # differences below this are numerical noise


def compare(points: DataFrame, draws: DataFrame, pairs, by=("length",), metrics=tuple(ALL_METRICS),
            mde_factor: float = DEFAULTS.mde_factor) -> DataFrame:
    """Paired differences a - b: (by, a, b, metric, diff, low, high, p, mde).

    `pairs` is a short list of (a, b) model names. p is the share of draws at least as far from the estimate
    as the estimate is from zero, never below one draw; mde is the smallest difference the comparison could detect.
    """
    by = list(by)

    def differences(scores, keys, prefix):
        """a - b of every listed pair. A group holds one row per model, so all pairs come from one grouping."""
        fields = ", ".join(metrics)
        at = scores.groupBy(*keys).agg(F.expr(f"map_from_entries(collect_list(struct(model, struct({fields}))))").alias("_m"))
        listed = ", ".join(f"struct('{a}' AS a, '{b}' AS b, _m['{a}'] AS x, _m['{b}'] AS y)" for a, b in pairs)
        each = at.selectExpr(*keys, f"inline(filter(array({listed}), e -> e.x IS NOT NULL AND e.y IS NOT NULL))")
        return each.selectExpr(*keys, "a", "b", *[f"x.{m} - y.{m} AS {prefix}_{m}" for m in metrics])

    est = differences(points, by, "e")
    both = differences(draws, [*by, "draw"], "d").join(est, [*by, "a", "b"])
    far = lambda m: (F.abs(F.col(f"d_{m}") - F.col(f"e_{m}")) >= F.abs(F.col(f"e_{m}")) - TOLERANCE).cast("double")
    agg = both.groupBy(*by, "a", "b").agg(F.count("*").alias("_draws"), *[x for m in metrics for x in (
        F.max(f"e_{m}").alias(f"e_{m}"), F.percentile(f"d_{m}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"q_{m}"),
        F.avg(far(m)).alias(f"p_{m}"), F.stddev_samp(f"d_{m}").alias(f"s_{m}"))])
    return agg.select(*by, "a", "b", F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"e_{m}").alias("diff"), F.get(f"q_{m}", F.lit(0)).alias("low"),
        F.get(f"q_{m}", F.lit(1)).alias("high"), F.greatest(F.col(f"p_{m}"), 1.0 / F.col("_draws")).alias("p"),
        (F.lit(mde_factor) * F.col(f"s_{m}")).alias("mde")) for m in metrics])))
