"""Reading and writing transaction, profile, split and lookup tables."""
from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillflow.functions.expressions import category_of, class_code, code_of, complete, normal_text
from tillflow.functions.quantiles import exact_quantiles
from tillflow.settings import (CLASSES, DEMOGRAPHIC_COLUMNS, DEMOGRAPHIC_TEXT, TIE_BREAKERS, TRANSACTION_COLUMNS)
from tillflow.sources.raw import files_of, heads, own_names, parsed
from tillflow.sources.session import durable


def require_columns(df: DataFrame, columns, source="table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source}: missing columns {missing}")
    return df


# types of the columns that CSV tables are known to have; other columns are read as text
KNOWN_TYPES = {"customer_id": "bigint", "amount": "double", "mcc": "int", "age": "int", "income": "double", "index": "double"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One CSV file, a folder of CSV files, or Parquet. Rows get `seq`, the order in which the files hold them.

    CSV files are taken in once: every file's columns by name (a column that a file lacks is null there, a type in `schema` or
    KNOWN_TYPES counts, a value that does not fit it is null), each row numbered in its file, and kept as Parquet in the shared scratch
    folder, so that later filters and column selections reach the scan. Dates are cast row by row; if any holds a time of day the column
    is a timestamp, else a day. Quoted line breaks belong to their field. Rows that lack a customer are left for the loaders to drop.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df if "seq" in df.columns else df.withColumn(
            "seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    files = heads(files_of(spark, path, "*.csv").where("length > 0")).collect() if _exists(spark, path) else []      # a name and a header per file
    if not files:
        raise FileNotFoundError(f"no CSV files in {path}")
    groups: dict = {}
    for row in files:
        groups.setdefault((row["header"], row["first"]), []).append((row["path"], row["length"]))
    out = None
    for (header, first), members in sorted(groups.items()):
        names = own_names(next(csv.reader([header])))
        part = parsed(spark, spark.createDataFrame(members, "path string, length long"), names, {}, True, first)
        part = part.withColumn("seq", F.struct("file", "row")).drop("file", "row")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields} if schema is not None else KNOWN_TYPES
    wanted = [f.name for f in schema.fields if f.name in out.columns] if schema is not None else [c for c in out.columns if c != "seq"]
    kept = durable(out.select(*[F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in wanted], "seq"))
    if "date" in wanted and "date" not in (kinds if schema is not None else {}):
        timed = kept.where(F.length(F.trim("date")) > 10).limit(1).count() > 0
        kept = kept.withColumn("date", F.trim("date").try_cast("timestamp_ntz" if timed else "date"))
    return kept


def code_table(spark: SparkSession, classes: dict) -> DataFrame:
    """(mcc, mapped) rows of a label map that replaces the default one; `classes` maps a class to its codes.

    A code listed under several classes belongs to the last of them.
    """
    of = {int(code): name for name, codes in classes.items() for code in codes}
    return spark.createDataFrame(list(of.items()), "mcc int, mapped string")


def map_categories(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Add `category` (class name) and `code` (0..3) from the merchant code; unlisted codes are the last class."""
    if codes is None:
        return df.withColumns({"category": category_of("mcc"), "code": code_of("mcc")})
    out = (df.join(codes.withColumnRenamed("mapped", "category"), "mcc", "left")
            .fillna(CLASSES[-1], ["category"]))
    return out.withColumn("code", class_code(F.col("category")))


def load_transactions(raw: DataFrame, codes: DataFrame | None = None, source="transactions") -> DataFrame:
    """Complete purchases with their class. `seq` and `time` order the purchases of one day (see `recency_order`).

    Dates that come as timestamps keep their time of day, which then decides order and ties; other dates become days.
    """
    require_columns(raw, TRANSACTION_COLUMNS, source)
    tie = next((c for c in TIE_BREAKERS if c in raw.columns), None)
    df = raw.where(complete(raw, TRANSACTION_COLUMNS)).select(
        F.col("customer_id").cast("long"), F.col("date").cast("timestamp_ntz" if dict(raw.dtypes)["date"].startswith("timestamp") else "date"),
        (F.col(tie) if tie else F.lit(None).cast("string")).alias("time"),
        F.col("amount").cast("double"), F.col("mcc").cast("int"), F.col("seq"))
    return map_categories(df, codes)


def recency_order() -> list:
    """Most recent purchase first; on one day later times first, purchases without a time last, then file order."""
    return [F.col("date").desc(), F.col("time").desc_nulls_last(), F.col("seq").desc()]


def complete_profiles(raw: DataFrame, key: str = "customer_id") -> DataFrame:
    """The first complete record of every customer, text fields trimmed and in lower case."""
    df = raw.where(complete(raw, DEMOGRAPHIC_COLUMNS))
    order = F.col("seq") if "seq" in df.columns else F.struct(*[F.col(c) for c in DEMOGRAPHIC_COLUMNS])
    rest = [c for c in DEMOGRAPHIC_COLUMNS if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return first.select(F.col(key).cast("long"), F.col("age").cast("int"),
                        *[normal_text(F.col(c)).alias(c) for c in DEMOGRAPHIC_TEXT], F.col("income").cast("double"))


def income_terciles(profiles: DataFrame) -> DataFrame:
    """Add `income_group`: cut at the thirds of the income distribution, right-closed. Equal cut points are an error."""
    edges = exact_quantiles(profiles, "income", [0.0, 1 / 3, 2 / 3, 1.0]).select("q")     # one row
    q = [F.get("q", F.lit(i)) for i in range(4)]
    checked = F.when((q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]), F.col("q")).otherwise(
        F.raise_error(F.lit("income terciles: cut points are not distinct")))
    return (profiles.withColumn("q", edges.select(checked.alias("q")).scalar())
            .withColumn("income_group", F.when(F.col("income") <= q[1], "low").when(F.col("income") <= q[2], "middle")
                        .otherwise("high")).drop("q"))


def load_demographics(raw: DataFrame, source="demographics") -> DataFrame:
    require_columns(raw, DEMOGRAPHIC_COLUMNS, source)
    return income_terciles(complete_profiles(raw))


def deflate(tx: DataFrame, index: DataFrame, base: str) -> DataFrame:
    """Amounts in the prices of month `base`; `index` has the columns month (YYYY-MM) and index.

    A month the index lacks stops the job when it reaches such a row.
    """
    base_value = index.where(F.col("month") == base).agg(F.max("index").alias("_base"))       # one row
    priced = (tx.withColumn("month", F.date_format("date", "yyyy-MM"))
              .join(index.select("month", F.col("index").cast("double").alias("_index")), "month", "left")
              .withColumn("_base", base_value.scalar()))
    missing = F.raise_error(F.concat(F.lit("price index missing for month "), F.col("month"))).cast("double")
    factor = (F.when(F.col("_base").isNull(), F.raise_error(F.lit(f"price index missing for month {base}")).cast("double"))
              .when(F.col("_index").isNull(), missing).otherwise(F.col("_base") / F.col("_index")))
    return priced.withColumn("amount", F.col("amount") * factor).drop("_index", "_base", "month")


def between_dates(tx: DataFrame, first: str, last: str) -> DataFrame:
    """Purchases of one season, both ends included."""
    return tx.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def read_ids(*tables: DataFrame) -> DataFrame:
    """Distinct customer ids of any number of lists."""
    out = tables[0].select("customer_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("customer_id"))
    return out.distinct()


def save_splits(tx: DataFrame, profiles: DataFrame | None, assignment: DataFrame, folder: str) -> None:
    """Purchases and profiles of every split, partitioned by split. A customer may be in several splits."""
    (tx.join(assignment.select("customer_id", "split"), "customer_id")
     .write.mode("overwrite").partitionBy("split").parquet(f"{folder}/transactions"))
    if profiles is not None:
        (profiles.join(assignment.select("customer_id", "split"), "customer_id")
         .write.mode("overwrite").partitionBy("split").parquet(f"{folder}/customers"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame | None]:
    """(transactions, profiles or None) of one split; other splits are never read."""
    tx = spark.read.parquet(f"{folder}/transactions").where(F.col("split") == split).drop("split")
    profiles = spark.read.parquet(f"{folder}/customers").where(F.col("split") == split).drop("split") if _exists(spark, f"{folder}/customers") else None
    return tx, profiles


def write_json(rows: DataFrame, folder: str) -> None:
    """A small summary table as one JSON-lines file."""
    rows.repartition(1).write.mode("overwrite").json(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    """A small result table as one CSV file."""
    rows.repartition(1).write.mode("overwrite").option("header", True).csv(folder)


def read_json_settings(spark: SparkSession, path: str) -> dict:
    """A small settings file (label map, export spec, class shares)."""
    text = spark.read.option("wholetext", True).text(path).first()
    return json.loads(text["value"])


def rank_in_customer(tx: DataFrame, keep: int | None = None) -> DataFrame:
    """The last `keep` purchases (default: all) of every customer with `rn` (1 = most recent).

    The filter on the rank lets Spark cut each map task to `keep` rows per customer before the shuffle.
    """
    w = Window.partitionBy("customer_id").orderBy(*recency_order())
    ranked = tx.withColumn("rn", F.row_number().over(w))
    return ranked if keep is None else ranked.where(F.col("rn") <= keep)
