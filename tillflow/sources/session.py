"""Session and materialisation helpers."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "tillflow") -> SparkSession:
    """A session for tests and the local benchmark; on a cluster the caller brings its own."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")      # no call-site capture per expression
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")      # small local data, all cores
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share. Only a local session that names none (tests, the local
    benchmark) gets a temporary folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        global _LOCAL
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="tillflow-scratch-")
        folder = _LOCAL
    return folder


_LOCAL = ""


def durable(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below the scratch folder and read back, so lost executors do not recompute it and readers prune columns."""
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/tillflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by `durable` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
