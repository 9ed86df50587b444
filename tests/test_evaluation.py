import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillflow.functions.quantiles import exact_quantiles, running_totals
from tillflow.operators import baselines as B, calibration as K, metrics as M, resampling as R, significance as S
from tillflow.settings import CLASSES
from tillflow.sources.predictions import with_codes

NAMES = (*CLASSES, "not a category")


def table(spark, y, models, length=9):
    """Long predictions; models: name -> codes (4 = invalid)."""
    rows = [("s", m, length, i, CLASSES[t], NAMES[c]) for m, codes in models.items() for i, (t, c) in enumerate(zip(y, codes))]
    return spark.createDataFrame([(*r, None) for r in rows], "split string, model string, length int, customer_id long, ground_truth string, prediction string, p array<double>")


def numpy_metrics(y, p):
    """Straight from the definitions."""
    out, f1s, recalls, w = {"acc": float((y == p).mean())}, [], [], []
    wp = wr = wf = 0.0
    for k in range(4):
        tp, support, answered = int(((y == k) & (p == k)).sum()), int((y == k).sum()), int((p == k).sum())
        prec, rec = (tp / answered if answered else 0.0), (tp / support if support else 0.0)
        f1 = 2 * tp / (support + answered) if support + answered else 0.0
        f1s.append(f1); recalls.append(rec)
        share = support / len(y)
        wp, wr, wf = wp + share * prec, wr + share * rec, wf + share * f1
    return out | {"prec_w": wp, "rec_w": wr, "f1_w": wf, "macro_f1": float(np.mean(f1s)), "bal_acc": float(np.mean(recalls)), "f1_clothing": f1s[0]}


def test_metrics_equal_their_definitions(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 4, 500), rng.integers(0, 5, 500)
    row = M.classification_metrics(table(spark, y, {"m": p})).collect()[0]
    for name, value in numpy_metrics(y, p).items():
        assert math.isclose(row[name], value, rel_tol=1e-12), name


def test_invalid_answer_is_an_error(spark):
    row = M.classification_metrics(table(spark, [0, 1, 2, 3, 2], {"m": [0, 1, 2, 3, 4]})).collect()[0]
    assert (row["acc"], row["r_food"], row["p_food"]) == (0.8, 0.5, 1.0)
    cells = M.confusion_matrix(table(spark, [0], {"m": [4]})).collect()
    assert len(cells) == 20 and sum(r["n"] for r in cells) == 1


def test_perfect_probabilities(spark):
    y = [0, 1, 2, 3] * 25
    rows = [("s", "m", 9, i, CLASSES[t], CLASSES[t], [1.0 if k == t else 0.0 for k in range(4)]) for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "split string, model string, length int, customer_id long, ground_truth string, prediction string, p array<double>")
    row = M.probability_metrics(df).collect()[0]
    assert (row["pr_auc_macro"], row["top2_acc"], row["ece"], row["brier"]) == (1.0, 1.0, 0.0, 0.0)


def test_absent_class_has_no_pr_auc(spark):
    df = spark.createDataFrame([("m", None, 1, CLASSES[0], CLASSES[0], [0.7, 0.1, 0.1, 0.1])],
                               "model string, length int, customer_id long, ground_truth string, prediction string, p array<double>")
    row = M.model_summary(df).collect()[0]
    assert row["pr_auc_clothing"] == 1.0 and row["pr_auc_gas"] is None and row["pr_auc_macro"] == 1.0 and row["length"] is None


def test_averaging_ties_and_markov(spark):
    rows = spark.createDataFrame([(0, [0, 0, 1, 1, 2]), (1, [1, 1, 0, 0, 3]), (2, [3, 3, 3, 0, 0])], "i int, codes array<int>")
    got = rows.select("i", B.most_frequent_code(F.col("codes")).alias("r"), B.most_frequent_code(F.col("codes"), "lowest").alias("l"),
                      B.last_code(F.col("codes")).alias("last")).orderBy("i").collect()
    assert [(r["r"], r["l"], r["last"]) for r in got] == [(1, 0, 2), (0, 0, 3), (3, 3, 0)]
    steps = spark.createDataFrame([(0, [(0,), (1,), (0,)]), (1, [(0,), (1,), (1,)])], "i int, steps array<struct<code:int>>")
    t = {(r["prev"], r["next"]): r for r in B.markov_fit(steps).collect()}
    assert len(t) == 16 and t[0, 1]["n"] == 3 and t[1, 0]["n"] == 2 and t[1, 1]["n"] == 2 and t[2, 2]["p"] == 0.25
    assert t[0, 1]["p"] == 0.5


def test_holm_golden(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.2, 0.012, 0.05, 0.001, 0.3])], "i int, p double").withColumn("f", F.lit(1))
    got = [r["p_holm"] for r in S.holm(df, "p", ("f",)).orderBy("i").collect()]
    assert np.allclose(got, [0.4, 0.048, 0.15, 0.005, 0.4])            # 2 x 0.2 is above 1 x 0.3


def exact_p(b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    total, term = 0, 1
    for i in range(k + 1):
        total += term
        term = term * (n - i) // (i + 1)
    return min(1.0, 2 * total / 2 ** n)


def test_exact_mcnemar_small_and_large(spark):
    cases = [(3, 7), (0, 0), (0, 5), (10, 10), (1, 0), (60, 90), (480, 520), (5000, 5300), (0, 3000)]
    df = spark.createDataFrame(cases, "b long, c long").select("b", "c", S.exact_binomial_p(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        assert math.isclose(r["p"], exact_p(r["b"], r["c"]), rel_tol=1e-8, abs_tol=1e-300), (r["b"], r["c"])


def test_self_comparison_is_zero(spark):
    y = np.random.default_rng(1).integers(0, 4, 300)
    aligned = R.answers(with_codes(table(spark, y, {"a": y, "b": y})), ["a", "b"])
    for kind in ("exact", "hashed"):
        draws = S.Resampler(kind, draws=30).scores(aligned, ["a", "b"], ("length",))
        for r in R.compare(R.point_scores(aligned, ["a", "b"]), draws, [("a", "b")], metrics=("f1_w",)).collect():
            assert (r["diff"], r["low"], r["high"], r["p"], r["mde"]) == (0.0, 0.0, 0.0, 1.0, 0.0)
    mc = S.mcnemar(R.joint_cells(aligned), ["a", "b"], [("a", "b")]).collect()[0]
    assert (mc["only_a"], mc["only_b"], mc["mcnemar_p"]) == (0, 0, 1.0)


def test_multinomial_draws_follow_theory_and_ignore_partitioning(spark, monkeypatch):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 400)
    p = np.where(rng.random(400) < 0.6, y, rng.integers(0, 4, 400))
    q = np.where(rng.random(400) < 0.5, y, rng.integers(0, 5, 400))
    models = ["p", "q"]
    aligned = R.answers(with_codes(table(spark, y, {"p": p, "q": q})), models)
    cells = R.joint_cells(aligned)
    draws = R.multinomial_draws(cells, models, draws=2000)
    acc = R.draw_scores(draws).select("model", "draw", "acc", "n").toPandas()
    assert (acc["n"] == 400).all() and len(acc) == 4000
    for name, codes in (("p", p), ("q", q)):
        a, got = (y == codes).mean(), acc[acc["model"] == name]["acc"]
        assert abs(got.mean() - a) < 0.003 and abs(got.std() - math.sqrt(a * (1 - a) / 400)) < 0.001
    wide = acc.pivot(index="draw", columns="model", values="acc")
    true = np.corrcoef(y == p, y == q)[0, 1]
    assert abs(wide.corr().iloc[0, 1] - true) < 0.08                      # pairing is kept
    again = R.multinomial_draws(R.joint_cells(aligned.repartition(5)), models, draws=2000)
    order = ["draw", "model"]
    assert draws.orderBy(*order).collect() == again.orderBy(*order).collect()
    monkeypatch.setattr(R, "CELLS_PER_TASK", 7)                            # many parts per population
    many = R.draw_scores(R.multinomial_draws(cells, models, draws=1000)).toPandas()
    assert (many["n"] == 400).all() and abs(many[many["model"] == "p"]["acc"].mean() - (y == p).mean()) < 0.005


def test_population_rules(spark):
    y = [0, 1, 2, 3]
    full, part = table(spark, y, {"a": y, "b": y}), table(spark, y, {"c": y}).where("customer_id < 3")
    both = full.unionByName(part)
    assert M.common_population(both).count() == 3
    assert not M.population_check(both).collect()[0]["same"] and M.population_check(full).collect()[0]["same"]
    with pytest.raises(ValueError):
        M.require_same_population(both)
    assert M.align_models(both, ["a", "c"]).count() == 3
    assert R.answers(with_codes(both), ["a", "b", "c"]).count() == 3


def test_pair_specs():
    assert S.parse_pair("a,b@4:c") == ((("a", "b"), 4), (("c",), None))
    have = {("a", 4), ("a", 9), ("c", None), ("d", 9)}
    assert S.pair_runs(["a:c", "a:d", "a@4:a@9", "a:x"], (4, 9), have) == [
        ("a:c", ("a",), 4, ("c",), 4), ("a:c", ("a",), 9, ("c",), 9), ("a:d", ("a",), 9, ("d",), 9), ("a@4:a@9", ("a",), 4, ("a",), 9)]
    with pytest.raises(ValueError):
        S.parse_pair("a")


def test_factorial_signs():
    cells = {(i, j, k): f"{i}{j}{k}" for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    rows = S.sign_rows(cells)
    assert len(rows) == 56 and len({e for _, e, _ in rows}) == 7
    assert all(sum(s for _, e, s in rows if e == x) == 0 for x in {e for _, e, _ in rows})


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(3)
    q, y = np.round(rng.random(200), 5), rng.integers(0, 4, 200)
    rows = [("m", 9, i, CLASSES[t], CLASSES[0], [float(x), 1 - float(x), 0.0, 0.0]) for i, (x, t) in enumerate(zip(q, y))]
    df = spark.createDataFrame(rows, "model string, length int, customer_id long, ground_truth string, prediction string, p array<double>")
    got = K.cost_threshold(df, "Clothing").collect()[0]
    best = None
    for t in np.unique(np.round(q, 4)):
        cost = 5 * ((q < t) & (y == 0)).sum() + ((q >= t) & (y != 0)).sum()
        if best is None or cost < best[0]:
            best = (cost, t, ((q >= t) & (y == 0)).sum() / (y == 0).sum())
    assert got["cost"] == best[0] and math.isclose(got["threshold"], best[1]) and math.isclose(got["recall"], best[2])


def test_quantiles_and_prefix_sums_match_numpy(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 50, 3000), np.full(2000, 7.25), [0.0, -0.0, 1e-9, 1e12]])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, g int")
    probs = [0, 0.1, 1 / 3, 0.5, 0.77, 1]
    got = exact_quantiles(df, "v", probs).collect()[0]
    assert got["n"] == len(values) and np.allclose(got["q"], np.quantile(values, probs))
    for r in exact_quantiles(df, "v", probs, ("g",)).collect():
        assert np.allclose(r["q"], np.quantile(values[np.arange(len(values)) % 3 == r["g"]], probs))
    merged = df.groupBy("v").agg(F.count("*").alias("k"))
    assert np.allclose(exact_quantiles(merged, "v", probs, weight="k").collect()[0]["q"], np.quantile(values, probs))
    sums = running_totals(merged, "v", ("k",), descending=True).collect()
    assert all(r["cum_k"] == int((values >= r["v"]).sum()) for r in sums)


def test_shift_and_seed_summary(spark):
    y = [0, 1, 2, 3]
    rows = table(spark, y, {"m": y, "m-seed2": [0, 1, 2, 2]}).withColumn("split", F.lit("in")).unionByName(
        table(spark, y, {"m": [0, 0, 0, 0], "other": y}).withColumn("split", F.lit("out")))
    s = M.shift_table(rows, "in", "out").collect()
    assert len(s) == 1 and s[0]["base"] == "m" and s[0]["seeds_in_bank"] == 2 and math.isclose(s[0]["acc_drop"], 0.875 - 0.25)
    one = M.seed_summary(M.classification_metrics(rows.where("split = 'out'")), ("acc",)).where("base = 'other'").collect()[0]
    assert one["seeds"] == 1 and one["acc_sd"] is None


def test_holm_leaves_null_out(spark):
    df = spark.createDataFrame([("f", 0, 0.02), ("f", 1, None), ("f", 2, 0.3), ("f", 3, 0.015)], "f string, i int, p double")
    got = [r["p_holm"] for r in S.holm(df, "p", ("f",)).orderBy("i").collect()]
    assert got[1] is None and np.allclose([got[0], got[2], got[3]], [0.045, 0.3, 0.045])


def test_models_must_cover_the_same_customers(spark):
    y = [0, 1, 2, 3, 0, 1]
    both = table(spark, y, {"a": y, "b": [0, 1, 2, 3, 1, 1]})
    part = both.where("model = 'a' OR customer_id <> 2")
    draws = S.Resampler("exact", draws=20)
    assert S.significance_table(both, ["a"], ["b"], draws).select("N", "family").distinct().collect() == [
        (6, "a against 1 baselines (b) at length 9, one family per metric")]
    for call in (lambda: S.significance_table(part, ["a"], ["b"], draws), lambda: S.compare_pairs(part, ["a:b"], draws, lengths=(9,)),
                 lambda: S.factorial_effects(part, {(0, 0, 0): "a", (0, 0, 1): "b"}, draws)):
        with pytest.raises(ValueError, match="different customers at length 9"):
            call()


def test_a_tree_of_parts_keeps_the_law(spark, monkeypatch):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 600)
    aligned = R.answers(with_codes(table(spark, y, {m: np.where(rng.random(600) < 0.6, y, rng.integers(0, 5, 600)) for m in "ab"})), ["a", "b"])
    cells, spread = R.joint_cells(aligned), {}
    for parts, fan in ((4096, 256), (2, 2)):
        monkeypatch.setattr(R, "CELLS_PER_TASK", parts)
        monkeypatch.setattr(R, "FAN", fan)
        draws = R.multinomial_draws(cells, ["a", "b"], draws=600).toPandas()
        assert len(draws) == 1200 and (draws[list(R.CELLS)].sum(axis=1) == 600).all()
        spread[parts] = R.draw_scores(spark.createDataFrame(draws)).toPandas().groupby("model")["acc"].agg(["mean", "std"])
    a, b = spread[4096], spread[2]
    assert (a["mean"] - b["mean"]).abs().max() < 0.005 and ((a["std"] / b["std"]) - 1).abs().max() < 0.15


@pytest.mark.parametrize("table", ["pairs", "significance"])
def test_comparisons_evaluate_the_predictions_once(spark, table, monkeypatch):
    rows = [(c, x, m, "clothing", "clothing" if (c + i) % 3 else "groceries") for c in range(30) for i, m in enumerate(("coin", "random")) for x in ((4, 9) if m == "coin" else (None,))]
    evaluated = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            evaluated.add(b.num_rows)
            yield b
    kinds = "customer_id long, length int, model string, ground_truth string, prediction string"
    predictions = spark.createDataFrame(rows, kinds).mapInArrow(count, kinds)

    class Aligned(Exception):
        pass

    def stop(rows, *rest, **more):
        rows.count()
        raise Aligned
    monkeypatch.setattr(R, "aligned_answers", stop)
    with pytest.raises(Aligned):
        if table == "pairs":
            S.compare_pairs(predictions, ("coin:random",), S.Resampler("hashed", 10))
        else:
            S.significance_table(predictions, ["coin"], ["random"], S.Resampler("hashed", 10))
    assert evaluated.value == len(rows)
