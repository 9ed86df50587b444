"""Registered queries: reading, cleaning, cohorts, windows, splits."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillflow.functions.expressions import age_band, class_code, span_band
from tillflow.operators import cleaning, cohort as C, splits as S, windows as W
from tillflow.plans.registry import joined, printed, query
from tillflow.plans.tables import SEASON, both_banks, transactions
from tillflow.settings import DEFAULTS
from tillflow.sources import manifest, tables, testdata as T
from tillflow.sources.raw import ExportSection, read_raw
from tillflow.sources.session import scratch_folder

TX_SECTION = ExportSection(files=(), columns={"customer_id": "CUST", "date": "RDAY", "time": "CLOCK", "amount": "AMT", "mcc": "CODE"},
                           date_format="%m/%d/%Y", time_format="%H.%M.%S", decimal=",", require=("RTEXT",))
CUSTOMER_SECTION = ExportSection(
    files=(), columns={"customer_id": "CUST", "age": "AGE", "gender": "SEX", "marital_status": "MARITAL", "education": "SCHOOL",
                       "occupation": "JOB", "income": "INCOME"}, decimal=",",
    labels={"gender": {"M": "male", "F": "female"},
            "marital_status": {"Married": "married", "Single": "single", "Divorced": "divorced or widowed"},
            "education": {"College": "university", "High School": "high school"},
            "occupation": {"MACHINERY": "private sector employee", "BUILDING": "public sector employee", "*": "other occupation"}})
OVERRIDE = {"Clothing": [5651, 5411], "Gas stations": [4812]}
POOL, TEST_A, DEV_MOD = 400, 100, 7


# ---- reading and cleaning ------------------------------------------------------------------------------------
@query
def load_transactions(spark, d):
    return printed(both_banks(spark, d, lambda tx: tx))


@query
def canonical_order(spark, d):
    """Every purchase with its rank among the customer's purchases."""
    return printed(both_banks(spark, d, lambda tx: tables.rank_in_customer(tx).select("customer_id", "seq", "rn")))


@query
def load_demographics(spark, d):
    return printed(T.profiles(spark, d))


@query
def complete_profiles(spark, d):
    """Two records per customer: the first complete one counts."""
    once = T.raw_profiles(spark, d)
    again = once.withColumns({"age": F.col("age") + 1, "income": F.coalesce("income", F.lit(1.0)), "seq": F.col("customer_id") + 10_000_000})
    return printed(tables.complete_profiles(once.withColumn("seq", F.col("customer_id")).unionByName(again)))


@query
def deflate(spark, d):
    return printed(tables.deflate(T.bank_a(spark, d), T.price_index(spark, d), "1996-04").select("customer_id", "seq", "amount"))


@query
def read_ids(spark, d):
    return tables.read_ids(T.bank_a(spark, d), T.bank_b(spark, d))


@query
def row_fingerprints(spark, d):
    return manifest.row_digests(T.table(spark, d, "orders"), "o_orderkey", ("o_custkey", "o_orderstatus", "o_orderpriority"))


@query
def manifest_diff(spark, d):
    """Two versions of the orders: some rows changed, some gone, some new."""
    orders, key = T.table(spark, d, "orders"), F.col("o_orderkey")
    now = orders.where(key % 77 != 0).withColumn("o_orderstatus", F.when(key % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    digest = lambda df: manifest.row_digests(df, "o_orderkey", ("o_custkey", "o_orderstatus", "o_orderpriority"))
    return manifest.manifest_diff(digest(orders.where(key % 91 != 0)), digest(now), "o_orderkey")


@query
def export_transactions(spark, d):
    return printed(cleaning.export_transactions(T.raw_text(spark, d), TX_SECTION))


@query
def export_rejects(spark, d):
    rows = cleaning.typed_transactions(T.raw_text(spark, d), TX_SECTION)
    return rows.where(F.col("reject").isNotNull()).select("seq", "reject")


@query
def export_report(spark, d):
    return cleaning.export_report(T.raw_text(spark, d), TX_SECTION)


@query
def export_demographics(spark, d):
    return printed(cleaning.export_demographics(T.raw_customers(spark, d), CUSTOMER_SECTION))


@query
def demographics_report(spark, d):
    return cleaning.demographics_report(cleaning.export_demographics(T.raw_customers(spark, d), CUSTOMER_SECTION, check=False))


@query
def unlisted_labels(spark, d):
    """Labels a shorter spec has no word for."""
    words = dict(CUSTOMER_SECTION.labels, marital_status={"Married": "married"}, occupation={"MACHINERY": "private sector employee"})
    section = ExportSection(**{**CUSTOMER_SECTION.__dict__, "labels": words})
    return cleaning.unlisted_labels(T.raw_customers(spark, d), section)


def _folder(spark, name):
    return f"{scratch_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def raw_files(spark, d):
    """Bank A written as raw text files with quoted line breaks and read back as an institution's files."""
    note = F.concat(F.lit("order "), F.col("seq").cast("string"), F.when(F.col("seq") % 3 == 0, "\nsaid 'yes; no'\n").when(F.col("seq") % 3 == 1, "; plain").otherwise(""))
    rows, folder = T.raw_text(spark, d).withColumns({"KEY": F.col("seq").cast("string"), "NOTE": note}).drop("seq"), _folder(spark, "raw-files")
    (rows.write.option("header", True).option("sep", ";").option("quote", "'").option("escape", "'").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(folder))
    section = ExportSection(files=(f"{folder}/part-*",), columns=TX_SECTION.columns, require=("RTEXT", "KEY", "NOTE"), read_csv={"sep": ";", "quotechar": "'", "multi_line": True})
    return read_raw(spark, section).drop("seq")


@query
def csv_folder(spark, d):
    """Bank A as a folder of CSV files, half of them with other columns in another order and dates with a time of day, read by name."""
    raw, folder = T.raw_bank_a(spark, d).drop("seq"), _folder(spark, "csv")
    even = F.col("customer_id") % 2 == 0
    raw.where(even).select("customer_id", "date", "amount", "mcc").write.option("header", True).csv(folder)
    timed = F.date_format(F.to_timestamp("date"), "yyyy-MM-dd 18:30:00")
    raw.where(~even).select("mcc", F.lit("shop, left").alias("note"), "amount", timed.alias("date"), "customer_id").write.mode("append").option("header", True).csv(folder)
    return printed(tables.load_transactions(tables.read_table(spark, folder)).select("customer_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "amount", "mcc", "category"))


@query
def file_manifest(spark, d):
    """Digests of stored files: one of order keys per status."""
    folder = _folder(spark, "keys")
    keys = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey")
    keys.select(F.col("o_orderkey").cast("string"), "o_orderstatus").write.partitionBy("o_orderstatus").text(folder)
    digests = manifest.file_digests(spark, folder).withColumn("status", F.regexp_extract("path", "o_orderstatus=([^/]+)/part-", 1))
    return digests.where("status <> '' and path not like '%.crc'").select("status", "sha256")


@query
def map_categories(spark, d):
    """Default map and a map that replaces it, counted per code."""
    raw = T.raw_bank_a(spark, d)
    default = tables.map_categories(raw).groupBy("mcc", "category").agg(F.count("*").alias("n")).withColumn("map", F.lit("default"))
    other = tables.map_categories(raw, tables.code_table(spark, OVERRIDE)).groupBy("mcc", "category").agg(F.count("*").alias("n"))
    return printed(default.unionByName(other.withColumn("map", F.lit("override"))))


@query
def season_filter(spark, d):
    rows = tables.between_dates(T.bank_a(spark, d), *SEASON)
    return printed(rows.groupBy("category").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))


@query
def age_bands(spark, d):
    return printed(T.profiles(spark, d).groupBy(age_band(F.col("age")).alias("band")).agg(F.count("*").alias("n"), F.min("age").alias("lo"), F.max("age").alias("hi")))


@query
def span_slices(spark, d):
    w = both_banks(spark, d, lambda tx: W.window_shape(W.last_windows(tx, DEFAULTS.train_length)))
    return printed(w.groupBy("bank", span_band(F.col("span_days")).alias("slice")).agg(F.count("*").alias("n"), F.min("span_days").alias("lo"), F.max("span_days").alias("hi")))


@query
def encode_classes(spark, d):
    """Class codes of texts that may be no class."""
    orders = T.table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderpriority")).otherwise(
        F.element_at(F.array(*map(F.lit, ("Clothing", "Gas stations", "Food and grocery", "Other"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return printed(orders.select(name.alias("answer")).withColumn("code", class_code(F.col("answer"))).groupBy("answer", "code").agg(F.count("*").alias("n")))


# ---- cohorts -------------------------------------------------------------------------------------------------
@query
def active_customers(spark, d):
    return both_banks(spark, d, C.active_customers)


@query
def class_shares(spark, d):
    return printed(both_banks(spark, d, C.class_shares))


@query
def eligible_customers(spark, d):
    """All rule variants: on the inputs, with the target, without the diversity filter, with profiles."""
    profiles, out = T.profiles(spark, d), None
    for bank in ("bank_a", "bank_b"):
        tx = transactions(spark, d, bank)
        for rule, kw in (("inputs", {}), ("with target", {"on_inputs": False}), ("three classes", {"min_distinct": 3}),
                         ("unfiltered", {"min_distinct": 1}), ("profiled", {"profiles": profiles})):
            ids = C.eligible_customers(tx, **kw).select("customer_id", F.lit(bank).alias("bank"), F.lit(rule).alias("rule"))
            out = ids if out is None else out.unionByName(ids)
    return out


@query
def tie_report(spark, d):
    return printed(both_banks(spark, d, C.tie_report))


@query
def tied_customers(spark, d):
    return both_banks(spark, d, C.tied_customers)


@query
def single_category_share(spark, d):
    return printed(both_banks(spark, d, lambda tx: C.single_category_share(W.windows_at(tx), ("length",))))


@query
def cohort_funnel(spark, d):
    return both_banks(spark, d, lambda tx: C.cohort_funnel(tx, T.profiles(spark, d)))


@query
def cohort_customers(spark, d):
    keep = ("customer_id", "n_txn", "span_days", "distinct_inputs", "target", "age", "gender", "income_group")
    return printed(both_banks(spark, d, lambda tx: C.cohort_customers(tx, T.profiles(spark, d)).select(*keep)))


# ---- windows -------------------------------------------------------------------------------------------------
@query
def last_windows(spark, d):
    w = both_banks(spark, d, lambda tx: W.last_windows(tx, DEFAULTS.train_length))
    return w.select("bank", "customer_id", joined(F.col("codes")).alias("codes"), joined(F.col("dates")).alias("dates"),
                    joined(F.col("amounts"), 2).alias("amounts"), "ground_truth")


@query
def windows_at_lengths(spark, d):
    w = both_banks(spark, d, W.windows_at)
    return printed(w.select("bank", "customer_id", "length", joined(F.col("codes")).alias("codes"), "target"))


@query
def variable_windows(spark, d):
    w = both_banks(spark, d, lambda tx: W.variable_windows(tx, 4, 14))
    return printed(w.select("bank", "customer_id", "length", joined(F.col("codes")).alias("codes"), "target"))


# ---- draws and splits ------------------------------------------------------------------------------------------
@query
def draw_customers(spark, d):
    return S.draw(C.eligible_customers(T.bank_a(spark, d)), POOL)


@query
def draw_excluding(spark, d):
    ids = C.eligible_customers(T.bank_a(spark, d))
    return S.draw_excluding(ids, 100, ids.where(F.col("customer_id") % 3 == 0))


@query
def train_val_split(spark, d):
    return S.train_val_split(C.eligible_customers(T.bank_a(spark, d)))


def _dev_ids(spark, d):
    return tables.read_ids(T.bank_b(spark, d)).where(F.col("customer_id") % DEV_MOD == 0)


def _assignment(spark, d):
    p, dev = T.profiles(spark, d), _dev_ids(spark, d)
    return S.prepare_splits(T.bank_a(spark, d), p, T.bank_b(spark, d), p, dev, dev, POOL, TEST_A)


@query
def prepare_splits(spark, d):
    return _assignment(spark, d)


@query
def prepare_splits_earlier_rule(spark, d):
    p = T.profiles(spark, d)
    return S.prepare_splits_earlier_rule(T.bank_a(spark, d), p, T.bank_b(spark, d), p, POOL, 50)


@query
def split_summary(spark, d):
    return S.split_summary(_assignment(spark, d))


@query
def split_report(spark, d):
    """Seed, rules and numbers of the splits."""
    p = T.profiles(spark, d)
    eligible = {bank.replace("_", " "): C.eligible_customers(transactions(spark, d, bank), p) for bank in ("bank_a", "bank_b")}
    return S.split_report(_assignment(spark, d), eligible, {"earlier list": _dev_ids(spark, d)})


@query
def split_leakage_check(spark, d):
    return S.leakage_check(_assignment(spark, d), _dev_ids(spark, d))


@query
def splits_table(spark, d):
    return S.splits_table(both_banks(spark, d, lambda tx: tx), _assignment(spark, d))


@query
def filter_counts(spark, d):
    a = _assignment(spark, d)
    return printed(both_banks_by_split(spark, d, a))


def both_banks_by_split(spark, d, assignment):
    parts = [C.filter_counts(transactions(spark, d, bank), assignment.where(F.col("bank") == bank)) for bank in ("bank_a", "bank_b")]
    return parts[0].unionByName(parts[1])


@query
def overlap_check(spark, d):
    ids = C.eligible_customers(T.bank_a(spark, d))
    return printed(S.overlap_of(S.draw(ids, 200, 1), S.draw(ids, 300, 2), 1500))


@query
def id_set_operations(spark, d):
    a, b = C.active_customers(T.bank_a(spark, d)), C.active_customers(T.bank_b(spark, d), 70)
    out = None
    for how in ("union", "intersection", "difference"):
        part = S.combine_ids(a, b, how).withColumn("how", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return out


@query
def cohort_count_check(spark, d):
    """The cohort of bank A against the size an independent count records."""
    from tillflow.operators.description import count_check

    tx, p = T.bank_a(spark, d), T.profiles(spark, d)
    recorded = C.eligible_customers(tx, p).agg(F.count("*").alias("customers")).withColumn("bank", F.lit("bank_a"))
    return count_check(C.cohort_customers(tx, p), recorded, "bank_a")
