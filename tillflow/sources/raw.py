"""Raw institution files, every column text, and the export spec that describes them."""
from __future__ import annotations

import codecs
import csv
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillflow.sources.records import can_be_cut, records
from tillflow.sources.stores import opened

# ---- fixed values: texts a raw file uses for "no value" ----
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class ExportSection:
    """How one kind of raw file is read: files, csv options, names of the needed columns, formats and label words."""

    files: tuple
    columns: dict
    read_csv: dict = field(default_factory=dict)
    date_format: str = "%Y-%m-%d"
    time_format: str = "%H:%M:%S"
    decimal: str = "."
    require: tuple = ()
    labels: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, section: dict) -> "ExportSection":
        known = {k: v for k, v in section.items() if k in cls.__dataclass_fields__}
        known["files"], known["require"] = tuple(known.get("files", ())), tuple(known.get("require", ()))
        return cls(**known)

    @property
    def needed(self) -> list[str]:
        return list(dict.fromkeys([*self.columns.values(), *self.require]))


def missing_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in df.columns])


# ---- fixed values: Java's names of encodings that Python writes in another way ----
JAVA_NAMES = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf-16-be": "utf-16be", "utf-16-le": "utf-16le"}
OPTIONS = {"sep", "encoding", "on_bad_lines", "quotechar", "escapechar", "comment", "multi_line", "skiprows", "header", "names"}


def heads(files: DataFrame, encoding: str = "utf-8", comment: str | None = None, skip: int = 0, header: bool = True) -> DataFrame:
    """(path, length) -> (path, length, header, first): every file's header line and the number of its first line of data.

    `skip` lines and then the lines of comment come before the header; without one the first line of data is given in its place.
    """
    def run(batches):
        import io

        import pandas as pd

        for batch in batches:
            lines, firsts = [], []
            for path in batch["path"]:
                with opened(path) as stream, io.TextIOWrapper(stream, encoding=encoding, errors="replace", newline="\n") as text:
                    for _ in range(skip):
                        text.readline()
                    n, line = skip, text.readline()
                    while comment and line.startswith(comment):
                        n, line = n + 1, text.readline()
                lines.append(line.rstrip("\r\n").removeprefix("\ufeff"))
                firsts.append(n + header)
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "header": lines, "first": firsts})

    return files.mapInPandas(run, "path string, length long, header string, first long")


def own_names(names) -> list[str]:
    """A doubled name keeps its first column; the others get names of their own."""
    return [c if c not in names[:i] else f"{c}.{i}" for i, c in enumerate(names)]


def files_of(spark: SparkSession, pattern: str, glob: str | None = None) -> DataFrame:
    """(path, length) of the files that a path, folder or pattern names; names and sizes only."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(pattern).select("path", "length")


def parsed(spark: SparkSession, files: DataFrame, names, options: dict, multi_line: bool, first: int, wanted=None) -> DataFrame:
    """Columns (text) of files that share their columns and their first line of data, with `file` and `row`.

    Files are cut into records by many tasks (see records.records). Those that cannot be cut - packed ones, encodings of several bytes, a
    quote inside a field that it does not open - are read from their start, one task each; their rows are numbered as they come.
    """
    encoding, sep, quote = options.get("encoding", "utf-8"), options.get("sep", ","), options.get("quote", '"')
    comment, escape = options.get("comment"), options.get("escape", quote)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    wanted = list(names) if wanted is None else list(wanted)
    paths = files.select("path", "length").collect()                                        # a name and a size per file
    parallel = {r["path"]: r["length"] for r in paths if can_be_cut(r["path"], encoding) and not (multi_line and (escape != quote or comment))}
    whole = [r["path"] for r in paths if r["path"] not in parallel]
    plain = {"sep": sep, "quote": quote, "escape": escape, "mode": "PERMISSIVE"}
    out = None
    if parallel:
        rows, strays = records(spark.createDataFrame(list(parallel.items()), "path string, length long"), quote if multi_line else None, encoding, sep)
        whole += [r["path"] for r in strays.collect()] if strays is not None else []
        rows = rows.where((F.col("row") >= first) & (F.trim("record") != "") & (~F.col("record").startswith(comment) if comment else F.lit(True)))
        rows = rows.select(F.from_csv("record", F.lit(", ".join(f"`{c}` string" for c in names)), plain).alias("r"),
                           F.col("path").alias("file"), "row")
        out = rows.select(*[F.col("r").getField(c).alias(c) for c in wanted], "file", "row")
    if whole:
        # Spark drops a header by itself; lines before it stand in no column of their own and are dropped by their number
        reader = spark.read.options(**plain).option("encoding", JAVA_NAMES.get(codecs.lookup(encoding).name, encoding)).option("multiLine", True)
        reader = reader.option("comment", comment) if comment else reader
        if first > 1 and not comment:
            raise ValueError(f"lines before the header need files that can be cut into records, not {whole[0]}")
        rows = reader.option("header", first > 0).option("enforceSchema", True).schema(schema).csv(sorted(whole))
        rows = rows.select(*[F.col(f"`{c}`") for c in wanted], F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_raw(spark: SparkSession, section: ExportSection) -> DataFrame:
    """All files of a section as text, only the needed columns, with `seq` (position of the file, then of the row).

    Files are grouped by their header and read by name, so files of one pattern may have their columns in different places. A line
    with too few fields keeps its fields, one with too many loses the surplus, whatever `on_bad_lines` says and whichever columns
    are read. Quoted separators are understood; quoted line breaks need `multi_line: true`, and are found by many tasks at a time.
    `skiprows` lines stand before the header; with `header: null` there is none and `names` lists the columns. An option that is not
    listed in OPTIONS is refused.
    """
    unknown = sorted(set(section.read_csv) - OPTIONS)
    if unknown:
        raise ValueError(f"csv options {unknown} are not supported; known: {sorted(OPTIONS)}")
    given = section.read_csv
    sep, quote, comment, has_header = given.get("sep", ","), given.get("quotechar", '"'), given.get("comment"), given.get("header", 0) is not None
    if not has_header and not given.get("names"):
        raise ValueError("files without a header need names")
    options = {"encoding": given.get("encoding", "utf-8"), "sep": sep, "quote": quote, "escape": given.get("escapechar", quote), "comment": comment}
    out = None
    for position, pattern in enumerate(section.files):
        files = heads(files_of(spark, pattern).where("length > 0"), options["encoding"], comment, int(given.get("skiprows") or 0), has_header)
        groups: dict = {}
        for row in files.collect():                                                         # a name and a header per file
            groups.setdefault((row["header"] if has_header else "", row["first"]), []).append((row["path"], row["length"]))
        for (header, first), members in sorted(groups.items()):
            names = list(given["names"]) if given.get("names") else next(csv.reader([header], delimiter=sep, quotechar=quote))
            missing = [c for c in section.needed if c not in names]
            if missing:
                raise ValueError(f"raw columns {missing} not found in {sorted(members)[0][0]}")
            part = parsed(spark, spark.createDataFrame(members, "path string, length long"), own_names(names), options, bool(given.get("multi_line", False)), first, section.needed)
            seq = F.struct(F.lit(position).alias("list"), "file", "row").alias("seq")
            part = part.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in section.needed], seq)
            out = part if out is None else out.unionByName(part)
    return out
