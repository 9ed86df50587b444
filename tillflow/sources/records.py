"""Delimited text cut into records by many tasks, with a row number that hangs on nothing but the files.

A file is dealt to tasks in blocks of BLOCK bytes. Where quoted line breaks count, the first pass gives the number of quotes and line ends
of every block, for both cases: the block starts outside of quotes, or inside. An exclusive xor over the quote counts of a file's blocks
tells which case holds, and the sums of the true line ends tell the number of the first record that starts in a block. The second pass
cuts the blocks; a block's last record is read on into the following blocks until its end.
"""
from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillflow.sources.session import durable
from tillflow.sources.stores import seekable

BLOCK = 16 << 20
AHEAD = 1 << 16                  # bytes read at a time behind a block's end
# ---- fixed values: endings of files that cannot be read from the middle ----
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def can_be_cut(path: str, encoding: str) -> bool:
    """Whether a file's line ends can be found in its bytes: it is not packed, and a byte below 128 always is that character."""
    name = codecs.lookup(encoding).name
    return not path.lower().endswith(PACKED) and (name in ("utf-8", "ascii") or name.startswith(("iso8859", "cp125", "koi8", "mac", "cp437", "cp850")))


def _blocks(files: DataFrame, block: int) -> DataFrame:
    """(path, length) -> a row per block (path, length, start), dealt out evenly."""
    # fixed: the number of tasks must not be lowered at run time, the rows are few and the work behind each is large
    n = max(1, int(files.agg(F.sum(F.ceil(F.col("length") / block))).first()[0] or 1))
    tasks = min(n, 64 * files.sparkSession.sparkContext.defaultParallelism)
    cut = files.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))))
    return cut.repartition(tasks, "path", "start")


def _read(stream, start: int, n: int):
    import numpy as np

    stream.seek(start)
    return np.frombuffer(stream.read(n), np.uint8)


def _inside(data, quote: int):
    """For every byte whether an odd number of quotes stands up to and including it."""
    import numpy as np

    return np.logical_xor.accumulate(data == quote) if len(data) else np.zeros(0, bool)


def _counter(quote: str, sep: str, block: int):
    mark, sep_byte = ord(quote), ord(sep) if len(sep) == 1 and ord(sep) < 128 else -1

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for path, start in zip(batch["path"], batch["start"]):
                with seekable(path) as stream:
                    own = _read(stream, start, block)
                    before = _read(stream, start - 1, 1) if start else np.array([10], np.uint8)
                inside, ends = _inside(own, mark), own == 10
                last = np.concatenate((before, own[:-1]))
                # a quote that opens a field stands behind a separator, a line end, or the quote that it doubles
                fit = np.isin(last, [10, 13, mark, sep_byte]) if start else np.isin(last, [10, 13, mark, sep_byte, 0xBF])
                odd = (own == mark) & ~fit
                out.append((path, start, bool(inside[-1]), int((ends & ~inside).sum()), int((ends & inside).sum()), bool((odd & inside).any()), bool((odd & ~inside).any())))
            yield pd.DataFrame(out, columns=["path", "start", "parity", "ends_out", "ends_in", "stray_out", "stray_in"])
    return run


def _line_counter(block: int):
    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, start in zip(batch["path"], batch["start"]):
                with seekable(path) as stream:
                    out.append((path, start, int((_read(stream, start, block) == 10).sum())))
            yield pd.DataFrame(out, columns=["path", "start", "ends"])
    return run


def _first_end(stream, place: int, mark: int | None, quoted: bool, length: int) -> int:
    """The place behind the first true line end from `place` on."""
    while place < length:
        data = _read(stream, place, AHEAD)
        inside = _inside(data, mark) ^ quoted if mark is not None else False
        ends = ((data == 10) & ~inside).nonzero()[0]
        if len(ends):
            return place + int(ends[0]) + 1
        quoted = bool(inside[-1]) if mark is not None else False
        place += len(data)
    return length


def _cutter(quote: str | None, encoding: str, block: int):
    mark, utf8 = ord(quote) if quote else None, codecs.lookup(encoding).name in ("utf-8", "ascii")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, length, start, quoted, row in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "quoted", "row"))):
                with seekable(path) as stream:
                    own = _read(stream, start, block)
                    inside = (_inside(own, mark) ^ quoted) if mark is not None else np.zeros(len(own), bool)
                    ends = np.flatnonzero((own == 10) & ~inside) + 1
                    if start and len(ends) == 0:
                        continue                                             # one record goes over the whole block; it starts before
                    # own are the records that start behind the block's first byte, up to the one at the next block's first byte
                    begin, after, tail = int(ends[0]) if start else 0, start + len(own), b""
                    if after < length:
                        stop = _first_end(stream, after, mark, bool(inside[-1]), length)
                        tail = _read(stream, after, stop - after).tobytes()
                data = own[begin:].tobytes() + tail
                offs = np.concatenate(([0], ends[ends > begin] - begin, [len(data)])).astype(np.int64)
                offs = offs[:-1] if offs[-1] == offs[-2] else offs
                if len(offs) < 2:
                    continue
                numbers = row + np.arange(len(offs) - 1)
                for s in range(0, len(numbers), 100_000):
                    o = offs[s:s + 100_001]
                    if utf8:
                        text = pa.StringArray.from_buffers(len(o) - 1, pa.py_buffer((o - o[0]).astype(np.int32).tobytes()), pa.py_buffer(data[o[0]:o[-1]]))
                    else:
                        text = pa.array([data[a:b].decode(encoding, "replace") for a, b in zip(o[:-1], o[1:])], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(text), pa.string()), pa.array(numbers[s:s + 100_000], pa.int64()), text], ["path", "row", "record"])
    return run


def records(files: DataFrame, quote: str | None = None, encoding: str = "utf-8", sep: str = ",", block: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(path, row, record) of all records of `files` (path, length), row counted from 0 in each file, line ends taken off.

    quote: a character between two of which line breaks belong to the record; without one every line is a record. The second result
    lists files (path) in which a quote stands inside a field that it does not open: there the count of quotes says nothing, so they are
    not among the records and have to be read from their start. It is None where no file can be like that.
    Empty lines are records too. One block's bytes, and the longest record, are what a task holds.
    """
    block = block or BLOCK
    blocks, by_file, strays = _blocks(files, block), Window.partitionBy("path").orderBy("start"), None
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    if quote:
        seen = durable(blocks.mapInPandas(_counter(quote, sep, block), "path string, start long, parity boolean, ends_out long, ends_in long, stray_out boolean, stray_in boolean"))
        state = seen.withColumn("quoted", F.coalesce(F.bit_xor(F.col("parity").cast("int")).over(before), F.lit(0)) == 1)
        state = state.withColumn("ends", F.when(F.col("quoted"), F.col("ends_in")).otherwise(F.col("ends_out")))
        wrong = state.where(F.when(F.col("quoted"), F.col("stray_in")).otherwise(F.col("stray_out"))).select("path").distinct()
        strays = durable(wrong)
        state = state.join(strays, "path", "left_anti")
    else:
        state = blocks.mapInPandas(_line_counter(block), "path string, start long, ends long").withColumn("quoted", F.lit(False))
        state = durable(state)
    # the record that a block's first line end closes started before it, so the block's own first record is one further
    placed = state.withColumn("row", F.coalesce(F.sum("ends").over(before), F.lit(0)) + F.when(F.col("start") > 0, 1).otherwise(0))
    placed = durable(placed.join(files, "path").select("path", "length", "start", "quoted", "row"))
    tasks = max(1, min(placed.count(), 64 * files.sparkSession.sparkContext.defaultParallelism))
    cut = placed.repartition(tasks, "path", "start").mapInArrow(_cutter(quote, encoding, block), "path string, row long, record string")
    return cut.withColumn("record", F.regexp_replace("record", r"\r?\n\z", "")), strays
