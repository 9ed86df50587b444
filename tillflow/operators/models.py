"""Learned baselines on feature tables with pyspark.ml."""
from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, GBTClassificationModel, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, argmax_code, class_name
from tillflow.operators.features import class_weights
from tillflow.operators.metrics import selection_score
from tillflow.settings import CLASSES, DEFAULTS

# ---- fixed values: the searched settings (trees are limited by depth where the grid of the study limits leaves) ----
LOGISTIC_GRID = tuple({"C": c, "weights": w} for c in (0.01, 0.1, 1.0, 10.0) for w in ("none", "balanced"))
TREE_GRID = tuple({"step": lr, "depth": d, "min_rows": m, "weights": w}
                  for lr in (0.05, 0.1) for d in (4, 5, 6) for m in (20, 100) for w in ("none", "balanced"))


def grid(**candidates) -> list[dict]:
    """All combinations of the candidate values."""
    return [dict(zip(candidates, values)) for values in itertools.product(*candidates.values())]


def weighted(train: DataFrame, kind: str) -> DataFrame:
    """Add `_weight` of the row's class (a table of four rows)."""
    w = class_weights(train, kind).select("target", F.col("weight").alias("_weight"))
    return train.join(F.broadcast(w), "target")


@dataclass
class FittedModel:
    """Stages that turn feature rows into `p`, with the settings that made them."""

    kind: str
    features: list
    settings: dict
    stages: object            # PipelineModel, or the four one-vs-rest tree models

    def predict(self, features: DataFrame) -> DataFrame:
        """Add `p` and `prediction`."""
        if self.kind == "logistic":
            scored = self.stages.transform(features).withColumn("p", vector_to_array("probability"))
        else:
            scored, positive = _assembled(features, self.features), []
            for k, model in enumerate(self.stages):
                model.setFeaturesCol("_x").setPredictionCol(f"_y{k}").setRawPredictionCol(f"_m{k}").setProbabilityCol(f"_p{k}")
                scored = model.transform(scored)
                positive.append(vector_to_array(f"_p{k}")[1])
            total = sum(positive[1:], positive[0])
            scored = scored.withColumn("p", F.array(*[q / total for q in positive]))
        return scored.select(*features.columns, "p").withColumn("prediction", class_name(argmax_code(F.col("p"))))


def _assembled(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def fit_logistic(train: DataFrame, features, C: float = 1.0, weights: str = "none", max_iter: int = 100) -> FittedModel:
    """Standardised multinomial logistic regression. The penalty per row is 1 / (C n)."""
    data = weighted(train, weights)
    n = data.agg(F.sum("_weight")).collect()[0][0]
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
              LogisticRegression(featuresCol="_x", labelCol="target", weightCol="_weight", family="multinomial",
                                 regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)]
    return FittedModel("logistic", list(features), {"C": C, "weights": weights}, Pipeline(stages=stages).fit(data))


def fit_trees(train: DataFrame, validation: DataFrame, features, step: float = 0.1, depth: int = 5, min_rows: int = 20,
              weights: str = "none", rounds: int = 100, seed: int = DEFAULTS.seed) -> FittedModel:
    """Boosted trees, one class against the rest, stopped early on the validation rows; probabilities are normalised."""
    columns = ["target", *features]
    data = (weighted(train.select(*columns), weights).withColumn("_is_val", F.lit(False))
            .unionByName(validation.select(*columns).withColumns({"_weight": F.lit(1.0), "_is_val": F.lit(True)})))
    data = _assembled(data, features).select("target", "_x", "_weight", "_is_val").persist()
    models = []
    for k in range(N_CLASSES):
        one = data.withColumn("_label", (F.col("target") == k).cast("double"))
        models.append(GBTClassifier(featuresCol="_x", labelCol="_label", weightCol="_weight", validationIndicatorCol="_is_val",
                                    stepSize=step, maxDepth=depth, minInstancesPerNode=min_rows, maxIter=rounds, seed=seed).fit(one))
    data.unpersist()
    return FittedModel("trees", list(features), {"step": step, "depth": depth, "min_rows": min_rows, "weights": weights}, models)


def grid_select(fit, settings, validation: DataFrame, metric: str = "macro_f1"):
    """Fit every setting; keep the best validation score, the first one on ties. -> (model, [(setting, score), ...])"""
    best, best_score, log = None, None, []
    for s in settings:
        model = fit(**s)
        rows = model.predict(validation).select(F.lit("candidate").alias("model"), "ground_truth", "prediction")
        score = selection_score(rows, ("model",), metric).collect()[0]["score"]           # one number
        log.append((s, score))
        if best is None or score > best_score:
            best, best_score = model, score
    return best, log


def score_windows(model: FittedModel, feature_rows: DataFrame, name: str) -> DataFrame:
    """Prediction rows of a fitted model for the feature rows of any splits and lengths."""
    keys = [c for c in ("split", "length") if c in feature_rows.columns]
    return model.predict(feature_rows).select(*keys, F.lit(name).alias("model"), "customer_id", "ground_truth", "prediction", "p")


def save_model(model: FittedModel, spark: SparkSession, folder: str) -> None:
    parts = [model.stages] if model.kind == "logistic" else model.stages
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{folder}/part{i}")
    about = {"kind": model.kind, "features": model.features, "settings": model.settings, "classes": list(CLASSES)}
    spark.range(1).select(F.lit(json.dumps(about)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load_model(spark: SparkSession, folder: str) -> FittedModel:
    """A saved model; one trained with other classes is refused."""
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    if about["classes"] != list(CLASSES):
        raise ValueError(f"{folder} was trained with the classes {about['classes']}, not {list(CLASSES)}")
    if about["kind"] == "logistic":
        stages = PipelineModel.load(f"{folder}/part0")
    else:
        stages = [GBTClassificationModel.load(f"{folder}/part{k}") for k in range(N_CLASSES)]
    return FittedModel(about["kind"], about["features"], about["settings"], stages)
