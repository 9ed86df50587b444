"""What the operators share: document tables, tables written to the shared folder, and words as numbers."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a local session that names none (tests) gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="tillflow-llm-")
    return _LOCAL


_LOCAL = ""


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, keeps column pruning."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by `written` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---- words as 64-bit numbers -------------------------------------------------------------------------------------------
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK = 1 << 20                                     # bytes of text turned into words at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, CHUNK + 1)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for slices of about CHUNK bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offs, offs[first] + CHUNK, side="right")) - 1
        end = min(len(texts), max(end, first + 1))
        yield first, end, data[offs[first]:offs[end]], offs[first:end + 1] - offs[first]
        first = end


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, A-Z lower-cased if `fold`: (64-bit hash, row in the chunk, first byte, end byte), in text order.

    gap: for each byte value whether it stands between words.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    space = gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts])
    return h, np.searchsorted(offs, starts, side="right") - 1, starts, ends


def row_spans(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of the n rows of a chunk begin (n + 1 places)."""
    return np.searchsorted(rows, np.arange(n + 1))
