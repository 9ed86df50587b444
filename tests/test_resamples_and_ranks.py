"""Poisson resamples by cells, the law of multinomial ones, crowded order statistics, heavy numbers, fixed populations."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillflow.functions.quantiles import exact_quantiles, order_key, running_totals
from tillflow.operators import audit, metrics as M, resampling as R, significance as S
from tillflow.sources.predictions import with_codes
from tests.test_evaluation import table

CELLS = "length int, y int, codes array<int>, n long"


def test_chunks_hold_every_customer():
    n = [0, 1, 63, 64, 65, 4095, 4096, 300_000, 2 * 64**3 + 64 + 7]
    cell, number, size = R.chunks_of(n)
    assert [int(size[cell == i].sum()) for i in range(len(n))] == n and len(set(zip(cell, number))) == len(cell)
    assert max(np.bincount(cell)) <= 4 * 63


def test_poisson_counts_follow_their_law_and_ignore_partitioning(spark):
    sizes = [1, 5, 64, 70, 5000, 300_000]
    cells = spark.createDataFrame([(9, i % 4, [i // 4, (i + 1) % 4], n) for i, n in enumerate(sizes)], CELLS)
    draws = R.poisson_draws(cells, ["a", "b"], draws=3000).toPandas()
    a = draws[draws["model"] == "a"]
    assert sorted(a["draw"]) == list(range(1, 3001))
    for i, n in enumerate(sizes):
        x = a[f"c{i % 4}{i // 4}"]
        assert abs(x.mean() - n) < 5 * math.sqrt(n / 3000) and abs(x.var() / n - 1) < 5 * math.sqrt((2 + 1 / n) / 3000)
    assert abs(np.corrcoef(a["c00"], a["c10"])[0, 1]) < 0.1
    order = ["draw", "model"]
    again = R.poisson_draws(cells.repartition(5), ["a", "b"], draws=3000).toPandas()
    assert again.sort_values(order).reset_index(drop=True).equals(draws.sort_values(order).reset_index(drop=True))


def test_poisson_draws_equal_a_plain_version(spark):
    cells = spark.createDataFrame([(4, 0, [1, -1], 3), (4, 2, [2, -1], 70), (9, 1, [0, 3], 129)], CELLS)
    got = {(r["length"], r["draw"], r["model"]): r for r in R.poisson_draws(cells, ["a", "b"], draws=40, seed=7).collect()}
    import hashlib

    def mixed(x):
        x = ((x ^ (x >> 16)) * 0x85EBCA6B) % 2**32
        x = ((x ^ (x >> 13)) * 0xC2B2AE35) % 2**32
        return x ^ (x >> 16)

    def poisson(u, mean):
        k, below = 0, math.exp(-mean)
        while u >= math.floor(below * 2**32):
            k += 1
            below += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        return k

    for length, y, codes, n in ((4, 0, [1, -1], 3), (4, 2, [2, -1], 70), (9, 1, [0, 3], 129)):
        h = hashlib.md5(f"7:{length}:{y}:{codes[0]},{codes[1]}".encode()).hexdigest()
        w = int(h[:8], 16), int(h[8:16], 16)
        for draw in range(1, 41):
            total = 0
            for number, size in [(0, n % 64)] + [(64 + i, 64) for i in range(n // 64)]:
                u = mixed(mixed(w[0] ^ (draw * 0x9E3779B1 % 2**32)) ^ mixed(w[1] ^ (number * 0x85EBCA77 % 2**32)))
                total += poisson(u, size) if size else 0
            assert got[length, draw, "a"][f"c{y}{codes[0]}"] == total
    assert (4, 1, "b") not in got and got[9, 1, "b"]["c13"] == got[9, 1, "a"]["c10"]


def test_law_of_the_cells_is_checked(spark):
    cells = spark.createDataFrame([(9, i % 4, [(i // 4) % 5, (i * 7) % 5], 3 + 11 * i) for i in range(20)], CELLS)
    draws = R.multinomial_draws(cells, ["a", "b"], draws=2000)
    law = R.cell_law(cells, draws, ["a", "b"], n_draws=2000).toPandas()
    assert law["mean_ok"].all() and law["var_ok"].all() and len(law) > 20
    n = 20 * 3 + 11 * 190
    assert np.allclose(law["expected_var"], law["expected_mean"] * (1 - law["expected_mean"] / n))
    two = spark.createDataFrame([(9, 0, [0, 1], 500), (9, 1, [1, 1], 500)], CELLS)
    wrong = R.cell_law(two, R.poisson_draws(two, ["a", "b"], draws=2000), ["a", "b"], n_draws=2000).toPandas()
    assert not wrong["var_ok"].any() and wrong["mean_ok"].all()            # Poisson counts vary more where a cell is large


def test_resampled_tests_can_reject(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 500)
    good, bad = np.where(rng.random(500) < 0.9, y, (y + 1) % 4), np.where(rng.random(500) < 0.3, y, (y + 1) % 4)
    rows = S.significance_table(table(spark, y, {"good": good, "bad": bad}), ["good"], ["bad"], S.Resampler("hashed", draws=2000), metrics=("macro_f1",)).collect()
    assert rows[0]["p"] == 1 / 2000 and rows[0]["p_holm"] < 0.05 and rows[0]["low"] > 0


def test_crowded_values_spread_over_fine_keys(spark):
    values = np.concatenate([1000 + np.arange(100_000) * 1e-7, -1000 - np.arange(50_000) * 1e-7, [0.0, 5.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    assert df.select(order_key(F.col("v")).alias("k")).distinct().count() == 4
    probs = [i / 500 for i in range(501)]
    assert np.allclose(exact_quantiles(df, "v", probs).collect()[0]["q"], np.quantile(values, probs), rtol=1e-14)
    sums = running_totals(df.groupBy("v").agg(F.count("*").alias("k")), "v", ("k",))
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "_fine" in plan
    got = sums.orderBy("v").select("cum_k").toPandas()["cum_k"].to_numpy()
    assert (got == np.arange(1, len(values) + 1)).all()


@pytest.mark.parametrize("probs", [[0.3], [0, 1], [i / 99 for i in range(100)], sorted({0.001, 0.5, 0.999, *[i / 200 for i in range(201)]})])
def test_quantiles_of_uneven_lists_and_small_groups(spark, probs):
    rng = np.random.default_rng(len(probs))
    groups = {0: rng.normal(size=1), 1: rng.normal(size=2), 2: rng.lognormal(3, 2, 700).round(1), 3: np.full(50, 4.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g int, v double")
    for r in exact_quantiles(df, "v", probs, ("g",)).collect():
        assert r["n"] == len(groups[r["g"]]) and np.allclose(r["q"], np.quantile(groups[r["g"]], probs))


def test_heavy_numbers_are_settled_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(audit, "HEAVY_LEAST", 20)
    texts = [(i, f"paid 12.50 and 0.7{i % 3}, then 3.14") for i in range(90)]
    df, results = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(12.5, 0.71)], "a double, b double")
    got = sorted((r["id"], r["number"]) for r in audit.trace_numbers(df, "t", ("id",), results).collect())
    assert got == sorted([(i, "3.14") for i in range(90)] + [(i, f"0.7{i % 3}") for i in range(90) if i % 3 != 1])


def test_fixed_population_is_that_of_the_longest_length(spark):
    y = [0, 1, 2, 3, 0]
    rows = table(spark, y, {"a": y, "b": y}, 4).unionByName(table(spark, y, {"a": y, "b": y}, 14).where("customer_id < 3"))
    kept = M.at_fixed_population(rows)
    assert sorted({(r["length"], r["customer_id"]) for r in kept.collect()}) == [(x, i) for x in (4, 14) for i in range(3)]
    assert M.common_population(rows, 4).count() == 5 and with_codes(kept).count() == 12
