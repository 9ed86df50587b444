"""Files as the tasks see them: streams of bytes and folder listings, from paths as Spark and Hadoop write them."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.sources.session import scratch_folder


def store_of(path: str):
    """(pyarrow file system, path inside it) of file:/x, /x, hdfs://host/x, s3a://bucket/x."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def opened(path: str, compression: str | None = "detect"):
    """A stream of a file's bytes; by default a compressed file's content. `compression=None` gives the bytes as they are stored."""
    store, inside = store_of(path)
    return store.open_input_stream(inside, compression=compression)


def seekable(path: str):
    store, inside = store_of(path)
    return store.open_input_file(inside)


def _children(batches):
    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            store, inside = store_of(folder)
            head = folder.removesuffix("/")
            here = store.get_file_info(inside)
            if here.type == fs.FileType.NotFound:
                raise FileNotFoundError(folder)
            if here.type == fs.FileType.File:
                yield pd.DataFrame({"path": [head], "is_folder": [False], "length": [here.size]})
                continue
            found = store.get_file_info(fs.FileSelector(inside))
            for s in range(0, len(found), 10_000):
                some = found[s:s + 10_000]
                yield pd.DataFrame({"path": [f"{head}/{x.base_name}" for x in some], "is_folder": [x.type == fs.FileType.Directory for x in some],
                                    "length": [x.size or 0 for x in some]})


def listed(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, length) of every file below the folders, links followed; a path that is a file stands for itself.

    The tree is listed level by level where the tasks run: one job lists all folders of a level, and only the number of folders below
    comes to the driver. A path that does not exist stops the job.
    """
    root = f"{scratch_folder(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    kinds, level, out = "path string, is_folder boolean, length long", spark.createDataFrame([(f,) for f in dict.fromkeys(folders)], "path string"), None
    depth = 0
    while True:
        level.repartition("path").mapInPandas(_children, kinds).write.parquet(f"{root}/{depth}")
        found = spark.read.schema(kinds).parquet(f"{root}/{depth}")
        files = found.where(~F.col("is_folder")).select("path", "length")
        out = files if out is None else out.unionByName(files)
        level = found.where("is_folder").select("path")
        if level.isEmpty():
            return out.distinct()
        depth += 1
