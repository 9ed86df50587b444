"""Per-customer prediction tables.

Long form: split, model, length (null for models that read no history), customer_id, ground_truth, prediction, and
`p`, the four class probabilities in code order (null where a model gives none).
"""
from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillflow.functions.expressions import class_code
from tillflow.settings import CLASSES
from tillflow.sources.raw import files_of, heads, own_names

COLUMNS = ("split", "model", "length", "customer_id", "ground_truth", "prediction", "p")
FILE_NAME = r"([^/]+?)(?:_last(\d+))?\.csv$"
SEED_NAME = r"^(.+?)-seed(\d+)$"


def file_name(model: str, length: int | None = None) -> str:
    return f"{model}.csv" if length is None else f"{model}_last{length}.csv"


def split_name(path):
    """(model, length) columns from a file name column."""
    length = F.regexp_extract(path, FILE_NAME, 2)
    return F.regexp_extract(path, FILE_NAME, 1), F.when(length != "", length.cast("int"))


def base_model(model):
    """Name without its `-seed<k>` ending."""
    return F.regexp_replace(model, SEED_NAME, "$1")


def write_predictions(df: DataFrame, folder: str) -> None:
    """One folder per split, model and length, rows sorted by customer; writing a part again replaces that part."""
    (df.select(*COLUMNS).repartition("split", "model", "length", F.pmod(F.xxhash64("customer_id"), F.lit(64)))
     .sortWithinPartitions("split", "model", "length", "customer_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("split", "model", "length").parquet(folder))


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(folder)
    return df.select(F.col("split").cast("string"), F.col("model").cast("string"), F.col("length").cast("int"),
                     "customer_id", "ground_truth", "prediction", "p")


def read_prediction_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Prediction CSV files of other tools, named <model>[_last<X>].csv. The answer text is kept as written.

    Files of one header are one scan; model and length come from the name of the file that a row stands in.
    """
    probs = [f"p_{c}" for c in CLASSES]
    groups: dict = {}
    for row in heads(files_of(spark, folder, "*.csv").where("length > 0")).collect():       # a name and a header per file
        groups.setdefault(row["header"], []).append(row["path"])
    out = None
    for header, paths in sorted(groups.items()):
        names = own_names(next(csv.reader([header])))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        raw = spark.read.option("header", True).option("nullValue", "\u0001").option("emptyValue", "").schema(schema).csv(sorted(paths))
        p = F.array(*[F.col(f"`{c}`").try_cast("double") for c in probs]) if all(c in names for c in probs) else F.lit(None).cast("array<double>")
        model, length = split_name(F.url_decode(F.col("_metadata.file_name")))
        part = raw.select(F.lit(split).alias("split"), model.alias("model"), length.alias("length"),
                          F.col("customer_id").cast("long"), "ground_truth",
                          F.coalesce("prediction", F.lit("")).alias("prediction"), p.alias("p"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no prediction files in {folder}")
    return out


def inventory(predictions: DataFrame) -> DataFrame:
    """Every (model, length) with its number of customers and its file name."""
    n = predictions.groupBy("model", "length").agg(F.count("*").alias("customers"))
    return n.withColumn("file", F.when(F.col("length").isNull(), F.concat("model", F.lit(".csv")))
                        .otherwise(F.concat("model", F.lit("_last"), F.col("length").cast("string"), F.lit(".csv"))))


def inventory_of_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    model, length = split_name(F.col("path"))
    return files.select(model.alias("model"), length.alias("length"), "path")


def with_codes(predictions: DataFrame) -> DataFrame:
    """Add the codes y (truth, 0..3) and yhat (answer, 4 = not a class)."""
    return predictions.withColumns({"y": class_code(F.col("ground_truth")), "yhat": class_code(F.col("prediction"))})
