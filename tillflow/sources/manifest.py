"""SHA-256 fingerprints of files or rows, and the comparison of two versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.sources.stores import listed, opened

BLOCK = 1 << 20


def file_digests(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, sha256) of the stored bytes of every file below the folders.

    Folders are listed where the tasks run (see stores.listed); each file is read in blocks of BLOCK bytes by the task that hashes it, so
    its size does not matter. Compressed files are hashed as they are.
    """
    def hashed(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with opened(path, compression=None) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "sha256": out})

    files = listed(spark, *folders).select("path").repartition("path")
    return files.mapInPandas(hashed, "path string, sha256 string").withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines `sha256  path`."""
    line = F.col("value")
    return spark.read.text(path).where(F.trim(line) != "").select(
        F.substring_index(line, "  ", 1).alias("sha256"), F.regexp_extract(line, r"^\S+  (.*)$", 1).alias("path"))


def write_manifest(digests: DataFrame, folder: str) -> None:
    (digests.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value"))
     .write.mode("overwrite").text(folder))


def row_digests(df: DataFrame, key: str, columns) -> DataFrame:
    """(key, sha256) of the listed columns of every row, written as text and joined with '|'."""
    return df.select(F.col(key), F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
                     .alias("sha256"))


def manifest_diff(recorded: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Keys whose digest differs: status missing, changed or new."""
    both = (recorded.select(key, F.col("sha256").alias("_old"))
            .join(now.select(key, F.col("sha256").alias("_new")), key, "full_outer"))
    status = (F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "new")
              .when(F.col("_old") != F.col("_new"), "changed"))
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(key, "status")


def require_same(recorded: DataFrame, now: DataFrame, key: str = "path") -> None:
    """Stops if a recorded key is missing or changed; the message names every one."""
    bad = manifest_diff(recorded, now, key).where(F.col("status") != "new").agg(
        F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ", ")).first()[0]
    if bad:
        raise ValueError(f"recorded but not found or changed: {bad}")
