"""Boosted trees of a whole grid against a plain version, and against four separate binary fits."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillflow.operators import boosting as T
from tillflow.operators import models as L
from tillflow.settings import CLASSES

FIELDS = "x array<double>, hot array<int>, target int, is_val boolean"


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * [1, 10, 0.1], 2)
    hot = [sorted(rng.choice(1500, rng.integers(0, 3), replace=False).tolist()) + [1500] * int(rng.random() < 0.3) for _ in range(n)]
    y = [int(np.clip(round(1.5 + a + 1.5 * (1500 in h) - (b > 5) + rng.normal(0, 0.4)), 0, 3)) for (a, b, _), h in zip(x, hot)]
    return x, hot, np.array(y), rng.random(n) < 0.3


def table(spark, x, hot, y, val, parts):
    return spark.createDataFrame([(r.tolist(), h, int(t), bool(v)) for r, h, t, v in zip(x, hot, y, val)], FIELDS).repartition(parts)


def plain_trees(columns, y, train, weight, step, depth, least, rounds):
    """Margins after `rounds`, by the textbook: every cut of every column tried on the rows themselves."""
    n, onehot = len(y), np.eye(4)[y]
    share = np.maximum(weight * onehot[train].sum(0), 0.5)
    z = np.tile(np.log(share / share.sum()), (n, 1))
    for _ in range(rounds):
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        g, h = weight[y][:, None] * (p - onehot), 4 / 3 * weight[y][:, None] * p * (1 - p)
        for k in range(4):
            def grow(rows, level):
                inner = rows[train[rows]]
                found, score = None, lambda i: g[i, k].sum() ** 2 / h[i, k].sum()
                for c in range(columns.shape[1]) if level < depth else ():
                    for cut in np.unique(columns[inner, c])[:-1]:
                        a, b = inner[columns[inner, c] <= cut], inner[columns[inner, c] > cut]
                        if min(len(a), len(b)) >= least and min(h[a, k].sum(), h[b, k].sum()) >= 1e-3:
                            gain = round(score(a) + score(b) - score(inner), T.DIGITS)
                            if gain > 0 and (found is None or gain > found[0]):
                                found = gain, c, cut
                if found:
                    low = columns[rows, found[1]] <= found[2]
                    return grow(rows[low], level + 1) + grow(rows[~low], level + 1)
                return [(rows, -step * g[inner, k].sum() / h[inner, k].sum())]
            for rows, value in grow(np.arange(n), 0):
                z[rows, k] += value
    return z


def test_grid_equals_the_plain_version(spark):
    x, hot, y, val = drawn(160, 3)
    x = np.round(x / [1, 10, 0.1])                                                         # few values: a bin each
    settings = [{"step": 0.3, "depth": 2, "min_rows": 5, "weights": "none"}, {"step": 0.2, "depth": 3, "min_rows": 12, "weights": "balanced"}]
    rows = table(spark, x, hot, y, val, 5)
    models = T.fit_grid(rows, settings, 3, 1501, rounds=10, patience=99)                  # more rounds than margins are kept for
    levels = sorted({i for h in hot for i in h})
    columns = np.hstack([x, [[float(i in h) for i in levels] for h in hot]])
    sizes = np.bincount(y[~val], minlength=4)
    for s, m in zip(settings, models):
        weight = np.ones(4) if s["weights"] == "none" else sizes.sum() / (4 * sizes)
        seen = []
        for r in range(len(m.rounds) + 1):
            z = plain_trees(columns, y, ~val, weight, s["step"], s["depth"], s["min_rows"], r)
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            seen.append(-np.log(p[val, y[val]]).mean())
        assert m.loss == pytest.approx(min(seen), abs=1e-5) and int(np.argmin(seen)) == len(m.rounds) and m.start_loss == pytest.approx(seen[0], abs=1e-6)
        got = m.predict(rows.withColumn("i", F.xxhash64("x", "hot", "target"))).select("x", "hot", "p").collect()
        want = {(tuple(a), tuple(b)): q for a, b, q in zip(x.tolist(), hot, p)}
        assert all(np.allclose(g["p"], want[tuple(g["x"]), tuple(g["hot"])], atol=1e-5) for g in got)


def test_partitions_do_not_change_the_trees(spark):
    x, hot, y, val = drawn(300, 8)
    setting = [{"step": 0.2, "depth": 3, "min_rows": 5, "weights": "none"}]
    one, many = (T.fit_grid(table(spark, x, hot, y, val, n), setting, 3, 1501, rounds=4)[0] for n in (1, 70))
    assert [[t.col.tolist() for t in r] for r in one.rounds] == [[t.col.tolist() for t in r] for r in many.rounds]
    assert one.loss == pytest.approx(many.loss, abs=1e-6) and any(3 + 1500 in t.col for r in one.rounds for t in r)


def test_joint_trees_are_not_worse_than_four_binary_fits(spark):
    x, _, y, val = drawn(900, 5)
    rows = table(spark, x, [[]] * 900, y, val, 3)
    setting = {"step": 0.1, "depth": 4, "min_rows": 20, "weights": "none"}
    model = T.fit_grid(rows, [setting], 3, rounds=200, patience=20)[0]
    f = rows.select("target", F.lit(0).alias("customer_id"), *[F.col("x")[i].alias(f"x{i}") for i in range(3)], "is_val")
    binary = L.fit_trees(f.where("not is_val"), f.where("is_val"), ["x0", "x1", "x2"], rounds=20, **setting)
    loss = binary.predict(f.where("is_val")).agg(F.avg(-F.log(F.get("p", F.col("target"))))).first()[0]
    assert model.loss <= loss and model.loss < 0.8 * model.start_loss and model.tried < 200


def test_odd_rows(spark):
    rows = spark.createDataFrame([([float(i), None if i % 3 else 1.0], [], i % 2, i > 25) for i in range(40)], FIELDS)
    model = T.fit_grid(rows, [{"step": 0.3, "depth": 2, "min_rows": 3, "weights": "balanced"}], 2, rounds=5)[0]
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in model.predict(rows).collect())
    alike = spark.createDataFrame([([1.0], [], 2, i > 5) for i in range(9)], FIELDS)
    model = T.fit_grid(alike, [{"step": 0.3, "depth": 2, "min_rows": 1, "weights": "none"}], 1)[0]
    assert model.tried <= 2 and {r["prediction"] for r in model.predict(alike).collect()} == {CLASSES[2]}
    with pytest.raises(ValueError, match="no rows"):
        T.fit_grid(rows.where("false"), L.TREE_GRID, 2)
