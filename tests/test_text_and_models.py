import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillflow.operators import audit, features as X, linear as N, models as L, prompts as Q, scoring as G
from tillflow.operators.windows import with_window_columns
from tillflow.settings import CLASSES
from tillflow.sources import logs, manifest, predictions as IO

CODES = [3, 0, 1, 2, 2]
DATES = ["2019-12-30", "2020-01-02", "2020-01-02", "2020-02-29", "2020-03-01"]
AMOUNTS = [0.333, 0.333, 0.333, 1250.5, 8.0]                     # the sum is rounded, not its parts


@pytest.fixture(scope="module")
def window(spark):
    steps = list(zip(CODES, DATES, AMOUNTS)) + [(1, "2020-03-02", 1.0)]
    df = spark.createDataFrame([(1, 5, steps)], "customer_id long, length int, steps array<struct<code:int,date:string,amount:double>>")
    typed = F.transform("steps", lambda s: F.struct(s["code"].alias("code"), s["date"].cast("date").alias("date"), s["amount"].alias("amount")))
    return with_window_columns(df.withColumn("steps", typed))


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, 27, "female", "single", "university", "retired", "high")],
                                 "customer_id long, age int, gender string, marital_status string, education string, occupation string, income_group string")


def text(window, people, condition, drop=None):
    return Q.build_samples(window, people, Q.prompt_context(condition, drop)).collect()[0]


FULL = ("I am 27 years old, single female, university graduate, and retired. In terms of my income, I belong to the high income group. "
        "I made 5 purchases. Their categories, oldest first: Other, Clothing, Gas stations, Food and grocery, Food and grocery. "
        "Their dates, oldest first: 2019-12-30, 2020-01-02, 2020-01-02, 2020-02-29, 2020-03-01. "
        "Their amounts, oldest first: TL 0.33, TL 0.33, TL 0.33, TL 1250.50, TL 8.00. In total I spent TL 1259.50.")


def test_full_text(window, people):
    row = text(window, people, "full")
    assert row["input"] == FULL and row["response"] == "Gas stations." and row["target_class"] == 1
    assert row["instruction"].endswith("Answer with one of: Clothing, Gas stations, Food and grocery, Other.")


def test_conditions_only_leave_sentences_out(window, people):
    for condition in Q.CONDITIONS[:-1]:
        row = text(window, people, condition)
        assert all(s.rstrip(".") in FULL for s in row["input"].split(". ")), condition
    neutral = text(window, people, "neutral")
    assert neutral["input"] == "I made 5 purchases. Their categories, oldest first: D, A, B, C, C." and neutral["response"] == "B."
    assert text(window, people, "full", "gender")["input"].startswith("I am 27 years old, single, university graduate, and")
    assert "income group" not in text(window, people, "full", "income_group")["input"]
    for bad in ("seq+dates+amounts", "seq+amounts+dates+demographics", "all"):
        with pytest.raises(ValueError):
            Q.prompt_context(bad)
    with pytest.raises(ValueError):
        Q.prompt_context("full", "height")


def test_missing_profile_stops(window, people):
    with pytest.raises(Exception, match="no profile for customer 1"):
        Q.build_samples(window, people.where("customer_id = 2"), Q.prompt_context("full")).collect()
    with pytest.raises(ValueError):
        Q.build_samples(window, None, Q.prompt_context("full"))


def test_few_shot_and_length_guard(spark):
    rows = [(i, "do", f"input {i}", f"{CLASSES[i % 4]}.", i % 4) for i in range(40)]
    samples = spark.createDataFrame(rows, "customer_id long, instruction string, input string, response string, target_class int")
    shots = Q.few_shot_examples(samples, 3).orderBy("position").collect()
    assert [r["position"] for r in shots] == list(range(1, 13)) and sorted(r["target_class"] for r in shots) == sorted([0, 1, 2, 3] * 3)
    assert shots == Q.few_shot_examples(samples.repartition(7), 3).orderBy("position").collect()
    first = Q.with_few_shot(samples, Q.few_shot_examples(samples, 3)).first()["input"]
    assert first.startswith("Examples from other customers:\n\nExample 1:\ninput ") and "\n\nNow my information:\ninput " in first and first.count("Answer: ") == 12
    with pytest.raises(Exception, match="fewer than 11"):
        Q.few_shot_examples(samples, 11).collect()
    assert Q.longest_sample(samples).collect()[0]["longest"] == max(len(f"do input {i} {CLASSES[i % 4]}.".split()) for i in range(40))
    with pytest.raises(ValueError):
        Q.require_length(samples, 4)


@pytest.mark.parametrize("name, variants", [("build_samples_minus_field", 6), ("build_samples_conditions", 8)])
def test_variants_of_samples_share_one_table_of_windows(spark, name, variants):
    from tillflow.plans.catalog import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("collect_list") < variants      # a task holds the windows once, not once per variant
    label = df.columns[-1]
    per = df.groupBy(label).count().collect()
    assert len(per) == variants and len({r["count"] for r in per}) == 1


def test_answers_and_names(spark):
    df = spark.createDataFrame([(1, " Clothing.\n"), (2, "Other"), (3, "n/a"), (4, "Food and grocery..")], "customer_id long, answer string")
    got = [(r["prediction"], r["is_category"]) for r in G.clean_answers(df).orderBy("customer_id").collect()]
    assert got == [("Clothing", True), ("Other", True), ("n/a", False), ("Food and grocery.", False)]
    row = spark.range(1).select(Q.run_name(F.lit("m"), F.lit("full"), F.lit("marital_status"), F.lit(2)).alias("a"),
                                Q.run_name(F.lit("m"), F.lit("seq"), F.lit(None).cast("string"), F.lit(42)).alias("b")).first()
    assert (row["a"], row["b"]) == ("m-full-minus-marital-status-seed2", "m-seq")


def test_sequence_features(spark):
    w = spark.createDataFrame([(0, [0, 0, 1, 2]), (1, [3, 3, 3, 3])], "customer_id long, codes array<int>")
    f = X.sequence_features(w).orderBy("customer_id").collect()
    assert [r["count_clothing"] for r in f] == [2, 0] and [r["last_is_food"] for r in f] == [1, 0]
    assert [r["since_other"] for r in f] == [4, 0] and [r["switches"] for r in f] == [2, 0] and [r["second_last_is_gas"] for r in f] == [1, 0]


def test_one_hot_uses_training_levels(spark):
    train = spark.createDataFrame([("a", "x"), ("b", None), ("b", "x")], "job string, town string")
    levels = X.level_table(train, ("job", "town"))
    at = {(r["variable"], r["level"]): r["index"] for r in levels.collect()}
    assert set(at) == {("job", "a"), ("job", "b"), ("town", "x")} and sorted(at.values()) == [0, 1, 2]
    rows = spark.createDataFrame([(1, "student", None), (2, "b", "x"), (3, None, "x")], "i int, job string, town string")
    got = {r["i"]: r["hot"] for r in X.one_hot(rows, levels, ("job", "town")).collect()}
    assert got == {1: [], 2: sorted((at["job", "b"], at["town", "x"])), 3: [at["town", "x"]]}


def test_one_hot_takes_a_hundred_thousand_levels(spark, monkeypatch):
    rows = spark.range(100_000).select("id", F.concat(F.lit("level "), F.col("id").cast("string")).alias("code"))
    levels = X.level_table(rows, ("code",))
    for few in (X.BROADCAST_LEVELS, 10):
        monkeypatch.setattr(X, "BROADCAST_LEVELS", few)
        got = X.one_hot(rows, levels, ("code",)).agg(F.count_if(F.size("hot") == 1).alias("n"), F.countDistinct(F.col("hot")[0]).alias("d"), F.max(F.col("hot")[0]).alias("top")).first()
        assert (got["n"], got["d"], got["top"]) == (100_000, 100_000, 99_999)


def test_the_logistic_grid_reaches_the_minimum(spark):
    rng = np.random.default_rng(11)
    x, hot = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 5, 0], [sorted(rng.choice(6, rng.integers(0, 3), replace=False).tolist()) for _ in range(300)]
    y = [int(np.argmax([a, b / 10, 2 * (1 in h), rng.normal()])) for (a, b, _), h in zip(x, hot)]
    rows = spark.createDataFrame([(r.tolist(), h, t) for r, h, t in zip(x, hot, y)], "x array<double>, hot array<int>, target int").repartition(5)
    settings = [{"C": c, "weights": w} for c in (0.1, 10.0) for w in ("none", "balanced")]
    models = N.fit_grid(rows, settings, 3, 6)
    whole = np.hstack([x, [[float(i in h) for i in range(6)] for h in hot]])
    z, t = (whole - whole.mean(0)) / np.where(whole.std(0) > 0, whole.std(0), 1), np.eye(4)[y]
    for s, m in zip(settings, models):
        weight = np.ones(300) if s["weights"] == "none" else 300 / (4 * t.sum(0))[y]
        logits = z @ m.theta[:-1] + m.theta[-1]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ ((p - t) * weight[:, None]) + m.theta[:-1] / s["C"]
        assert np.abs(g).max() / weight.sum() < 2e-6 and np.abs(((p - t) * weight[:, None]).sum(0)).max() / weight.sum() < 2e-6
        assert np.allclose([r["p"] for r in m.predict(rows.select("*")).orderBy("x").collect()], p[np.lexsort(x.T[::-1])])
    assert len(N.grid_scores(models, rows)) == 4 and N.best_of(models, [0.1, 0.3, 0.3, 0.2]) == 1


def test_padding(spark):
    w = spark.createDataFrame([(0, [0, 1], [(0,), (1,), (2,)])], "i int, codes array<int>, steps array<struct<code:int>>")
    row = X.next_step_targets(X.padded_sequence(w, 4, 0, 1), 4).collect()[0]
    assert row["tokens"] == [0, 0, 1, 2] and row["next_codes"] == [-100, -100, 1, 2]


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        t = int(rng.integers(0, 4))
        rows.append((i, 9, t, CLASSES[t], float(t + rng.normal(0, 0.4)), float(rng.normal())))
    return spark.createDataFrame(rows, "customer_id long, length int, target int, ground_truth string, x double, z double")


def test_models_learn_and_survive_saving(spark, examples, tmp_path):
    train, val = examples.where("customer_id % 4 > 0"), examples.where("customer_id % 4 = 0")
    fits = {"logit": L.fit_logistic(train, ["x", "z"], 10.0), "trees": L.fit_trees(train, val, ["x", "z"], depth=2, rounds=4, min_rows=5)}
    for name, model in fits.items():
        rows = L.score_windows(model, val, name).orderBy("customer_id").collect()
        assert np.allclose([sum(r["p"]) for r in rows], 1.0)
        assert np.mean([r["prediction"] == r["ground_truth"] for r in rows]) > 0.6, name
        L.save_model(model, spark, str(tmp_path / name))
        again = L.score_windows(L.load_model(spark, str(tmp_path / name)), val, name).orderBy("customer_id").collect()
        assert rows == again
    about = json.loads(spark.read.text(str(tmp_path / "logit" / "about")).first()["value"])
    spark.range(1).select(F.lit(json.dumps(about | {"classes": ["x"]})).alias("value")).write.mode("overwrite").text(str(tmp_path / "logit" / "about"))
    with pytest.raises(ValueError, match="trained with the classes"):
        L.load_model(spark, str(tmp_path / "logit"))


def test_grid_keeps_the_first_best(spark, examples):
    best, log = L.grid_select(lambda **s: L.fit_logistic(examples, ["x"], max_iter=5, **s), L.grid(C=(1.0, 1.0), weights=("none",)), examples)
    assert len(log) == 2 and log[0][1] == log[1][1] and best.settings == log[0][0]
    assert len(L.LOGISTIC_GRID) == 8 and len(L.TREE_GRID) == 24


def test_prediction_tables(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("files")
    (tmp_path / "m_last9.csv").write_text("customer_id,ground_truth,prediction,p_Clothing,p_Gas stations,p_Food and grocery,p_Other\n2,Other,NA,0.1,0.2,0.3,0.4\n1,Other,Other,0.1,0.2,0.3,0.4\n")
    (tmp_path / "random.csv").write_text("customer_id,ground_truth,prediction\n1,Clothing,\n")
    rows = IO.read_prediction_files(spark, str(tmp_path), "val")
    got = {(r["model"], r["length"], r["customer_id"]): (r["prediction"], r["p"]) for r in rows.collect()}
    assert got == {("m", 9, 2): ("NA", [0.1, 0.2, 0.3, 0.4]), ("m", 9, 1): ("Other", [0.1, 0.2, 0.3, 0.4]), ("random", None, 1): ("", None)}
    out = str(tmp_path_factory.mktemp("out") / "table")
    IO.write_predictions(rows, out)
    IO.write_predictions(rows.where("model = 'm'"), out)                   # writing a part again replaces it
    back = IO.read_predictions(spark, out)
    assert back.count() == 3 and {r["length"] for r in back.collect()} == {9, None}
    found = IO.inventory_of_files(spark, str(tmp_path)).collect()
    assert {(r["model"], r["length"]) for r in found} == {("m", 9), ("random", None)}


def test_manifests(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_text(name)
    manifest.write_manifest(manifest.file_digests(spark, str(folder)), str(tmp_path / "recorded"))
    recorded = manifest.read_manifest(spark, str(tmp_path / "recorded"))
    manifest.require_same(recorded, manifest.file_digests(spark, str(folder)))
    (folder / "a").write_text("changed"); (folder / "b").unlink(); (folder / "d").write_text("d")
    now = manifest.file_digests(spark, str(folder))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in manifest.manifest_diff(recorded, now).collect()}
    assert got == {"a": "changed", "b": "missing", "d": "new"}
    with pytest.raises(ValueError):
        manifest.require_same(recorded, now)


def test_cost_of_runs(spark, tmp_path):
    for run, hours in (("q-full", 2), ("q-full-seed2", 4)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "training_log.json").write_text(json.dumps({"wall_clock_s": hours * 3600, "base_model": "b", "peak_gpu_memory_gb": 20.0, "steps": 10, "n_samples": 5}))
    (tmp_path / "runs" / "lstm").mkdir()
    (tmp_path / "runs" / "lstm" / "training_log.json").write_text(json.dumps({"selected": {"lr": 1}, "grid": [{"seconds": 1.5}, {"diverged": True}], "seeds": {"42": {"seconds": 2.0}, "2": {"seconds": 4.0}}}))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "q-full.scoring.json").write_text(json.dumps([{"name": "q-full", "score": "first", "runs": [{"split": "s", "length": 9, "N": 100, "seconds": 5.0}, {"split": "s", "length": 4, "N": 1, "seconds": 1.0}]}]))
    (tmp_path / "p" / "x-gen.scoring.json").write_text(json.dumps([{"name": "x-gen", "score": "first", "runs": [{"split": "s", "length": 9, "N": 1, "not_a_category": 1}]}]))
    train, score = logs.run_training(spark, str(tmp_path / "runs")), logs.scoring_runs(spark, str(tmp_path / "p"), "s", 9)
    row = logs.run_cost(train, score).collect()
    assert len(row) == 1 and (row[0]["model"], row[0]["runs"], row[0]["hours_mean"], row[0]["ms_per_customer"], row[0]["passes_per_prompt"]) == ("q-full", 2, 3.0, 50.0, 1)
    grid = logs.grid_training(spark, str(tmp_path / "runs")).collect()
    assert [(g["model"], g["grid_configurations"], g["grid_seconds"], g["seconds_per_seed"]) for g in grid] == [("lstm", 2, 1.5, 3.0)]
    assert logs.training_totals(train).collect()[0]["hours"] == 6.0


def test_numbers_without_a_source(spark):
    texts = spark.createDataFrame([(1, "F1 was 0.512 and +3.1, then v1.2.3, 7.25."), (2, "0.05 and 0.91 (0.4999)")], "doc long, t string")
    results = spark.createDataFrame([(0.5119, "x"), (-3.14, "y")], "v double, name string")
    got = sorted((r["doc"], r["number"]) for r in audit.trace_numbers(texts, "t", ("doc",), results).collect())
    assert got == [(2, "0.4999"), (2, "0.91")]


def test_a_number_beside_a_letter_of_any_script_is_no_number(spark):
    texts = spark.createDataFrame([(1, "ş0.123 0.456ß é.25 (0.789)")], "doc long, t string")
    assert [r["number"] for r in audit.numbers_in(texts, "t", ["doc"]).collect()] == ["0.789"]
