"""Exact McNemar tests, Holm correction, and the comparison tables built from paired resamples."""
from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.literals import literal_rows
from tillflow.operators import resampling as R
from tillflow.operators.metrics import CLASS_F1, classification_metrics, select_best
from tillflow.settings import COMPARATORS, DEFAULTS
from tillflow.sources.predictions import SEED_NAME, base_model, with_codes
from tillflow.sources.session import durable

TESTED = ("f1_w", "macro_f1", "bal_acc", *CLASS_F1)
PAIR_METRICS = ("acc", "f1_w", "macro_f1", *CLASS_F1)
FAMILY_METRICS = ("acc", "f1_w", "macro_f1", "bal_acc", *CLASS_F1)


def holm(df: DataFrame, p: str, family, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p values inside each family (a family is a handful of comparisons).

    A null p takes no rank, does not count in its family and stays null.
    """
    w = Window.partitionBy(*family)
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))).withColumn("_m", F.count(p).over(w))
    step = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_rank") + 1)))
    running = F.max(step).over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), running)).drop("_rank", "_m")


def _ln_factorial(m: Column) -> Column:
    """ln(m!): a table below 20, Stirling's series from there on (error below 1e-12)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)])
    x = m.cast("double")
    stirling = (x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)))
    return F.when(m < 20, F.get(small, m.cast("int"))).otherwise(stirling)


def exact_binomial_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c at one half; 1 without discordant customers.

    The lower tail is summed from its largest term downwards; the terms left out after 12 standard deviations are
    below double precision, so the work grows with the square root of the number of discordant customers.
    """
    n, k = (b + c), F.least(b, c)
    ln_top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) - n * math.log(2)
    terms = F.least(k, F.ceil(12 * F.sqrt(n.cast("double"))) + 64)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    # term(k - i) = term(k - i + 1) * (k - i + 1) / (n - k + i)
    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))
    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, step)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(ln_top) * tail))


def mcnemar(cells: DataFrame, models, pairs, by=("length",)) -> DataFrame:
    """(by, a, b, only_a, only_b, mcnemar_p): customers only one of two models gets right, from the joint cells."""
    place = {m: i for i, m in enumerate(models)}
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.get("codes", F.lit(place[a])).alias("ya"),
                                F.get("codes", F.lit(place[b])).alias("yb")) for a, b in pairs])
    both = cells.select(*by, "y", "n", F.inline(listed))
    ya, yb = F.col("ya"), F.col("yb")
    right_a, right_b = ya == F.col("y"), yb == F.col("y")
    sums = both.where((ya != R.ABSENT) & (yb != R.ABSENT)).groupBy(*by, "a", "b").agg(
        F.sum(F.when(right_a & ~right_b, F.col("n")).otherwise(0)).alias("only_a"),
        F.sum(F.when(~right_a & right_b, F.col("n")).otherwise(0)).alias("only_b"))
    return sums.withColumn("mcnemar_p", exact_binomial_p(F.col("only_a"), F.col("only_b")))


class Resampler:
    """How resamples are drawn from the joint cells: `exact` (multinomial) or `hashed` (Poisson weights, reproducible in SQL)."""

    def __init__(self, kind: str = "exact", draws: int = DEFAULTS.bootstrap_draws, seed: int = DEFAULTS.seed):
        if kind not in ("exact", "hashed"):
            raise ValueError(f"unknown resampling {kind!r}")
        self.kind, self.draws, self.seed = kind, draws, seed

    def scores(self, aligned: DataFrame, models, by) -> DataFrame:
        draw = R.multinomial_draws if self.kind == "exact" else R.poisson_draws
        return R.draw_scores(draw(R.joint_cells(aligned, by), models, by, self.draws, self.seed))


def _coded(predictions: DataFrame) -> DataFrame:
    """The codes of predictions as a written table: models, lengths and customers are read from it, the predictions are evaluated once."""
    return durable(with_codes(predictions).select("length", "customer_id", "model", "y", "yhat"))


def significance_table(predictions: DataFrame, llms, baselines, resampler: Resampler, metrics=TESTED) -> DataFrame:
    """Every learned model against every baseline per length: differences, exact McNemar p, Holm over the baselines.

    Long form: one row per metric; the McNemar columns repeat. `N`: customers of the length; `family`: what Holm's steps run over.
    Models of one length that cover different customers stop the job.
    """
    models, pairs = [*llms, *baselines], list(itertools.product(llms, baselines))
    aligned = R.aligned_answers(R.at_every_length(_coded(predictions.where(F.col("model").isin(*models)))), models)
    res = R.compare(R.point_scores(aligned, models), resampler.scores(aligned, models, ("length",)), pairs, metrics=metrics)
    mc = holm(mcnemar(R.joint_cells(aligned), models, pairs), "mcnemar_p", ("length", "a"), "mcnemar_p_holm")
    out = holm(res, "p", ("length", "a", "metric")).join(mc, ["length", "a", "b"])
    size = aligned.groupBy("length").agg(F.count("*").alias("N"))
    held = out.groupBy("length", "a").agg(F.array_sort(F.collect_set("b")).alias("_b"))          # a handful of names
    text = F.concat("a", F.lit(" against "), F.size("_b").cast("string"), F.lit(" baselines ("), F.array_join("_b", ", "),
                    F.lit(") at length "), F.col("length").cast("string"), F.lit(", one family per metric"))
    return out.join(size, "length").join(held.select("length", "a", text.alias("family")), ["length", "a"])


def families(predictions: DataFrame, llms, comparators, resampler: Resampler, metrics=FAMILY_METRICS) -> DataFrame:
    """Seed means of every learned model against seed means of every comparator, Holm inside (model, length, metric)."""
    named = predictions.where(F.col("length").isNotNull()).withColumn("base", base_model(F.col("model")))
    named = durable(with_codes(named.where(F.col("base").isin(*llms, *comparators))).select("length", "customer_id", "model", "y", "yhat"))
    models = _names(named)
    aligned = R.aligned_answers(named, models, same=lambda population: False)
    points = R.seed_means(R.point_scores(aligned, models), metrics=metrics)
    draws = R.seed_means(resampler.scores(aligned, models, ("length",)), ("length", "draw"), metrics)
    res = holm(R.compare(points, draws, list(itertools.product(llms, comparators)), metrics=metrics),
               "p", ("length", "a", "metric"))
    info = points.select("length", F.col("model").alias("b"), F.col("n"), F.col("seeds").alias("b_seeds"))
    lead = points.select("length", F.col("model").alias("a"), F.col("seeds").alias("a_seeds"))
    text = info.where(F.col("b").isin(*comparators)).groupBy("length").agg(
        F.count("*").alias("_k"), F.array_join(F.array_sort(F.collect_set("b")), ", ").alias("_names"))
    label = F.concat("a", F.lit(" against "), F.col("_k").cast("string"), F.lit(" comparators ("), "_names",
                     F.lit(") at length "), F.col("length").cast("string"), F.lit(", one family per metric"))
    return (res.join(info, ["length", "b"]).join(lead, ["length", "a"]).join(text, "length")
            .withColumn("family", label).drop("_k", "_names"))


def _names(predictions: DataFrame) -> list[str]:
    """Model names of a prediction table (a partition column of the stored tables)."""
    return sorted(r["model"] for r in predictions.select("model").distinct().collect())


def choose_comparator(validation: DataFrame, comparators=COMPARATORS, length: int = DEFAULTS.train_length) -> DataFrame:
    """The comparator with the best seed-mean macro-F1 on validation predictions; the first listed wins ties."""
    at = validation.where(F.col("length") == length).withColumn("base", base_model(F.col("model")))
    at = at.where(F.col("base").isin(*comparators))
    means = classification_metrics(at, ("base", "model")).groupBy("base").agg(F.avg("macro_f1").alias("score"))
    return select_best(means.withColumnRenamed("base", "model"), {m: i for i, m in enumerate(comparators)})


def primary_endpoint(validation: DataFrame, confirm: DataFrame, llm: str, resampler: Resampler | None,
                     comparators=COMPARATORS, length: int = DEFAULTS.train_length, without: DataFrame | None = None) -> DataFrame:
    """Macro-F1 of the seed means of `llm` minus those of the comparator chosen on validation.

    `without` holds customers to leave out (tied target dates). Without a resampler only the point difference is given.
    """
    chosen = choose_comparator(validation, comparators, length).collect()[0]["model"]        # one name
    if chosen is None:
        raise ValueError("no comparator has validation predictions")
    at = confirm.where(F.col("length") == length).withColumn("base", base_model(F.col("model"))).where(F.col("base").isin(llm, chosen))
    if without is not None:
        at = at.join(without.select("customer_id"), "customer_id", "left_anti")
    at = durable(with_codes(at).select("length", "customer_id", "model", "y", "yhat"))
    models = _names(at)
    if not {re.sub(SEED_NAME, r"\1", m) for m in models} >= {llm, chosen}:
        raise ValueError(f"missing predictions of {llm} or {chosen}")
    aligned = durable(R.answers(at, models))
    points = durable(R.seed_means(R.point_scores(aligned, models), metrics=("macro_f1",)))
    side = lambda name, p: points.where(F.col("model") == name).select(
        "length", F.col("n").cast("long").alias("n") if p == "a" else F.lit(1).alias("_1"), F.lit(name).alias(p),
        F.col("seeds").alias(f"{p}_seeds"), F.col("macro_f1").alias(f"{p}_macro_f1"))
    out = side(llm, "a").join(side(chosen, "b").drop("_1"), "length")
    out = out.withColumn("diff", F.col("a_macro_f1") - F.col("b_macro_f1"))
    if resampler is None:
        return out
    draws = R.seed_means(resampler.scores(aligned, models, ("length",)), ("length", "draw"), ("macro_f1",))
    res = R.compare(points, draws, [(llm, chosen)], metrics=("macro_f1",))
    return out.join(res.select("length", "low", "high", "p", "mde"), "length")


def parse_pair(spec: str) -> tuple:
    """`A:B`, each side `name[,name...][@length]` -> ((names, length or None), (names, length or None))."""
    def side(text):
        names, _, length = text.partition("@")
        return tuple(names.split(",")), int(length) if length else None

    a, sep, b = spec.partition(":")
    if not sep or not a or not b:
        raise ValueError(f"a pair is written A:B, not {spec!r}")
    return side(a), side(b)


def pair_runs(specs, lengths, available) -> list[tuple]:
    """(spec, names_a, length_a, names_b, length_b) of every pair whose models are all available.

    `available` is a set of (model, length or None). A pair without lengths runs at every length that has both sides.
    """
    has = lambda names, x: all((n, x) in available or (n, None) in available for n in names)
    runs = []
    for spec in specs:
        (names_a, xa), (names_b, xb) = parse_pair(spec)
        wanted = [(xa or xb, xb or xa)] if xa or xb else [(x, x) for x in lengths]
        runs += [(spec, names_a, x, names_b, z) for x, z in wanted if has(names_a, x) and has(names_b, z)]
    return runs


def compare_pairs(predictions: DataFrame, specs, resampler: Resampler, lengths=DEFAULTS.lengths, metrics=PAIR_METRICS) -> DataFrame:
    """Single paired comparisons; sides of several names are seed means, sides of different lengths use the customers
    present at both. McNemar columns are null where a side is a mean. Models of one length that cover different customers stop the job."""
    spark, predictions = predictions.sparkSession, _coded(predictions)
    available = {(r["model"], r["length"]) for r in predictions.select("model", "length").distinct().collect()}
    runs = pair_runs(specs, lengths, available)
    label = lambda xa, xb: str(xa) if xa == xb else f"{xa} vs {xb}"
    members, singles = [], []
    for spec, names_a, xa, names_b, xb in runs:
        for s, names, x in (("a", names_a, xa), ("b", names_b, xb)):
            for i, n in enumerate(names):
                members.append((spec, label(xa, xb), x, n, s, f"{s}{i}"))
        if len(names_a) == len(names_b) == 1:
            singles.append((spec, label(xa, xb)))
    table = literal_rows(spark, members, ("pair", "at", "length", "source", "side", "slot"))
    rows = R.at_every_length(predictions).withColumnRenamed("model", "source")
    rows = rows.join(F.broadcast(table), ["source", "length"]).withColumnRenamed("slot", "model")
    slots, by = sorted({m[5] for m in members}), ("pair", "at")
    aligned = R.aligned_answers(rows, slots, by, same=lambda population: " vs " not in population["at"])
    mean = lambda df, keys: (df.withColumn("model", F.substring("model", 1, 1)).groupBy(*keys, "model")
                             .agg(F.max("n").cast("long").alias("n"), *[F.avg(m).alias(m) for m in metrics]))
    points = mean(R.point_scores(aligned, slots, by), by)
    draws = mean(resampler.scores(aligned, slots, by), (*by, "draw"))
    res = R.compare(points, draws, [("a", "b")], by, metrics).drop("a", "b")
    cells = R.joint_cells(aligned, by)
    mc = mcnemar(cells, slots, [("a0", "b0")], by).drop("a", "b")
    mc = mc.join(F.broadcast(literal_rows(spark, singles or [("", "")], by)), list(by), "left_semi")
    n = points.where(F.col("model") == "a").select(*by, "n")
    return res.join(n, list(by)).join(mc, list(by), "left").withColumnRenamed("at", "length")


FACTORS = ("amounts", "dates", "demographics")
FACTORIAL_METRICS = ("f1_w", "acc", "macro_f1", "f1_clothing")


def sign_rows(cells: dict) -> list[tuple]:
    """(model, effect, sign) for all main effects and interactions. `cells`: (0/1, 0/1, 0/1) -> model name."""
    out = []
    for size in (1, 2, 3):
        for term in itertools.combinations(range(3), size):
            kind = "main effect" if size == 1 else "interaction"
            effect = f"{kind}: " + " x ".join(FACTORS[i] for i in term)
            out += [(model, effect, math.prod(1 if level[i] else -1 for i in term)) for level, model in cells.items()]
    return out


def factorial_effects(predictions: DataFrame, cells: dict, resampler: Resampler, length: int = DEFAULTS.train_length,
                      metrics=FACTORIAL_METRICS) -> DataFrame:
    """Main effects and interactions of the 2 x 2 x 2 conditions: signed sums over four, intervals from the draws."""
    spark, models, by = predictions.sparkSession, list(cells.values()), ("length",)
    rows = with_codes(predictions.where((F.col("length") == length) & F.col("model").isin(*models)))
    aligned = R.aligned_answers(rows, models, by)
    signs = F.broadcast(literal_rows(spark, sign_rows(cells), ("model", "effect", "sign")))

    def effects(scores, keys):
        signed = scores.join(signs, "model")
        sums = signed.groupBy(*keys, "effect").agg(*[(F.sum(F.col("sign") * F.col(m)) / 4).alias(m) for m in metrics])
        return sums.select(*keys, "effect", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))

    point = effects(R.point_scores(aligned, models, by), ["length"]).withColumnRenamed("value", "estimate")
    draws = effects(resampler.scores(aligned, models, by), ["length", "draw"])
    limits = draws.groupBy("effect", "metric").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return point.join(limits, ["effect", "metric"]).select(
        "metric", "effect", "estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
