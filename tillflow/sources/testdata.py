"""The benchmark tables seen as two institutions: orders are bank A, events are bank B, customers are the profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.sources.tables import load_demographics, load_transactions


# schemas as the files hold them, so that reading them starts no inference job
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


ORDER_CODE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 5411 WHEN '2-HIGH' THEN 5651 WHEN '3-MEDIUM' THEN 5541 "
              "WHEN '4-NOT SPECIFIED' THEN 4812 ELSE 5812 END")


def raw_bank_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS customer_id", "CAST(o_orderdate AS DATE) AS date", "o_totalprice AS amount", f"{ORDER_CODE} AS mcc", "o_orderkey AS seq")


def raw_bank_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS customer_id", "CAST(ts AS DATE) AS date", "date_format(ts, 'HH:mm:ss') AS time", "value AS amount",
        "CASE event_type WHEN 'purchase' THEN 5411 WHEN 'click' THEN 5651 WHEN 'signup' THEN 5541 WHEN 'view' THEN 4812 ELSE 5812 END AS mcc",
        "event_id AS seq")


def raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id", "CAST(18 + c_custkey % 60 AS INT) AS age", "IF(c_custkey % 2 = 0, 'male', 'female') AS gender",
        "CASE c_custkey % 3 WHEN 0 THEN 'married' WHEN 1 THEN 'single' ELSE 'divorced or widowed' END AS marital_status",
        "CASE c_nationkey % 5 WHEN 0 THEN 'primary school' WHEN 1 THEN 'middle school' WHEN 2 THEN 'high school' "
        "WHEN 3 THEN 'university' ELSE 'graduate school' END AS education",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'private sector employee' WHEN 'BUILDING' THEN 'public sector employee' "
        "WHEN 'AUTOMOBILE' THEN 'self-employed' WHEN 'HOUSEHOLD' THEN 'not employed' ELSE 'retired' END AS occupation",
        "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS income")


def bank_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_transactions(raw_bank_a(spark, sf_dir))


def bank_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_transactions(raw_bank_b(spark, sf_dir))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_demographics(raw_profiles(spark, sf_dir))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank A printed as a raw all-text file with the usual faults: broken lines, blank texts, untimed rows."""
    two = lambda e: f"lpad(CAST({e} AS STRING), 2, '0')"
    clock = f"concat_ws('.', {two('(o_orderkey % 86400) div 3600')}, {two('(o_orderkey % 86400) div 60 % 60')}, {two('o_orderkey % 86400 % 60')})"
    return table(spark, sf_dir, "orders").selectExpr(
        "IF(o_orderkey % 97 = 0, 'continuation', CAST(o_custkey AS STRING)) AS CUST", "date_format(o_orderdate, 'M/d/yyyy') AS RDAY",
        f"IF(o_orderkey % 5 = 0, ' ', {clock}) AS CLOCK", "replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') AS AMT",
        f"CAST({ORDER_CODE} AS STRING) AS CODE", "IF(o_orderkey % 31 = 0, '', o_orderpriority) AS RTEXT", "o_orderkey AS seq")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer rows printed as raw text, to be read back with an export spec."""
    return table(spark, sf_dir, "customer").selectExpr(
        "IF(c_custkey % 89 = 0, 'continuation', CAST(c_custkey AS STRING)) AS CUST",
        "IF(c_custkey % 41 = 0, 'unknown', CAST(18 + c_custkey % 60 AS STRING)) AS AGE",
        "CASE WHEN c_custkey % 37 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS SEX",
        "CASE c_custkey % 3 WHEN 0 THEN 'Married' WHEN 1 THEN ' Single' ELSE 'Divorced' END AS MARITAL",
        "IF(c_nationkey % 2 = 0, 'College', 'High School') AS SCHOOL", "c_mktsegment AS JOB",
        "CASE WHEN c_acctbal >= 0 THEN replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING), '.', ',') END AS INCOME", "c_custkey AS seq")


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per month of bank A: 100 plus the months since 1995-01."""
    months = raw_bank_a(spark, sf_dir).select(F.trunc("date", "MM").alias("m")).distinct()
    return months.select(F.date_format("m", "yyyy-MM").alias("month"),
                         (100.0 + (F.year("m") - 1995) * 12 + F.month("m") - 1).cast("double").alias("index"))
