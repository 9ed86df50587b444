"""Training and scoring logs (JSON) as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.sources.predictions import base_model

TRAINING_SCHEMA = ("wall_clock_s double, base_model string, peak_gpu_memory_gb double, steps long, n_samples long, "
                   "load_in_8bit boolean, selected string, grid array<struct<seconds: double>>, "
                   "seeds map<string, struct<seconds: double>>")
SCORING_SCHEMA = ("name string, score string, few_shot boolean, labels array<string>, "
                  "runs array<struct<split: string, length: int, N: long, seconds: double, not_a_category: long>>")


def _read(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    return (spark.read.option("multiLine", True).schema(schema).json(pattern)
            .withColumn("path", F.col("_metadata.file_path")))


def run_training(spark: SparkSession, runs: str) -> DataFrame:
    """Fine-tuning runs: one row per runs/<name>/training_log.json with a wall-clock time."""
    df = _read(spark, f"{runs}/*/training_log.json", TRAINING_SCHEMA).where(F.col("wall_clock_s").isNotNull())
    run = F.regexp_extract("path", r"([^/]+)/training_log\.json$", 1)
    return df.select(run.alias("run"), base_model(run).alias("model"), "base_model",
                     (F.col("wall_clock_s") / 3600).alias("hours"), F.col("peak_gpu_memory_gb").alias("peak_gb"),
                     "steps", F.col("n_samples").alias("samples"), F.col("load_in_8bit").alias("eight_bit"))


def grid_training(spark: SparkSession, runs: str) -> DataFrame:
    """Grid-searched models: size and seconds of the grid, seeds and mean seconds per seed."""
    df = _read(spark, f"{runs}/*/training_log.json", TRAINING_SCHEMA).where(F.col("selected").isNotNull())
    seconds = F.filter(F.transform(F.map_values("seeds"), lambda s: s["seconds"]), lambda s: s.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return df.select(F.regexp_extract("path", r"([^/]+)/training_log\.json$", 1).alias("model"),
                     F.coalesce(F.size("grid"), F.lit(0)).alias("grid_configurations"),
                     total(F.transform("grid", lambda g: g["seconds"])).alias("grid_seconds"),
                     F.coalesce(F.size("seeds"), F.lit(0)).alias("seeds"),
                     F.when(F.size(seconds) > 0, total(seconds) / F.size(seconds)).alias("seconds_per_seed"))


def scoring_runs(spark: SparkSession, predictions: str, split: str, length: int) -> DataFrame:
    """Label-scoring runs of one split and length; generation logs are left out."""
    df = (_read(spark, f"{predictions}/*.scoring.json", SCORING_SCHEMA)
          .where(~F.col("path").endswith("-gen.scoring.json")).withColumn("r", F.explode("runs")))
    passes = F.when(F.col("score") == "first", 1).when(F.col("score") == "sequence", 4)
    return (df.where((F.col("r.split") == split) & (F.col("r.length") == length) & F.col("r.seconds").isNotNull())
            .select(F.col("name").alias("run"), base_model(F.col("name")).alias("model"),
                    F.col("score").alias("scorer"), F.coalesce("few_shot", F.lit(False)).alias("few_shot"),
                    passes.alias("passes_per_prompt"), F.col("r.N").alias("n"), F.col("r.seconds").alias("seconds"),
                    (1000 * F.col("r.seconds") / F.col("r.N")).alias("ms_per_customer")))


def run_cost(training: DataFrame, scoring: DataFrame) -> DataFrame:
    """Per model: runs, hours, memory and steps of training next to seconds and time per customer of scoring."""
    t = training.groupBy("model").agg(
        F.count("*").alias("runs"), F.avg("hours").alias("hours_mean"), F.min("hours").alias("hours_min"),
        F.max("hours").alias("hours_max"), F.max("peak_gb").alias("peak_gb"),
        F.min_by("steps", "run").alias("steps"))
    s = scoring.groupBy("model").agg(
        F.count("*").alias("scored_runs"), F.min_by("n", "run").alias("n"), F.avg("seconds").alias("seconds_mean"),
        F.avg("ms_per_customer").alias("ms_per_customer"), F.min_by("scorer", "run").alias("scorer"),
        F.min_by("passes_per_prompt", "run").alias("passes_per_prompt"))
    return t.join(s, "model", "full_outer")


def training_totals(training: DataFrame) -> DataFrame:
    return training.agg(F.count("*").alias("runs"), F.sum("hours").alias("hours"))
