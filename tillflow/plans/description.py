"""Registered queries: descriptive tables and drift."""
from __future__ import annotations

from pyspark.sql import functions as F

from tillflow.operators import description as D
from tillflow.operators.cohort import recent_diversity
from tillflow.plans.registry import printed, query
from tillflow.plans.tables import cohort_of, season_cohort
from tillflow.sources import testdata as T
from tillflow.sources.session import durable

USD = {"bank_a": 1.8401, "bank_b": 2.3868}


def _tagged(a, b):
    return a.withColumn("bank", F.lit("bank_a")).unionByName(b.withColumn("bank", F.lit("bank_b")))


@query
def activity_table(spark, d):
    a, b = durable(cohort_of(spark, d, "bank_a")), durable(cohort_of(spark, d, "bank_b"))
    return printed(_tagged(D.activity_table(T.bank_a(spark, d), a, USD["bank_a"]), D.activity_table(T.bank_b(spark, d), b, USD["bank_b"])))


@query
def season_comparison(spark, d):
    return printed(D.season_rows(cohort_of(spark, d, "bank_a"), season_cohort(spark, d)))


@query
def predictability_table(spark, d):
    return printed(_tagged(D.predictability_table(cohort_of(spark, d, "bank_a")), D.predictability_table(cohort_of(spark, d, "bank_b"))))


@query
def reweighted_accuracy(spark, d):
    return printed(D.reweighted_accuracy(cohort_of(spark, d, "bank_a"), cohort_of(spark, d, "bank_b")))


@query
def demographic_shares(spark, d):
    return printed(_tagged(D.demographic_shares(cohort_of(spark, d, "bank_a")), D.demographic_shares(cohort_of(spark, d, "bank_b"))))


@query
def demographic_counts(spark, d):
    """Fixed levels with their counts, zeros present."""
    return printed(_tagged(D.demographic_counts(cohort_of(spark, d, "bank_a")), D.demographic_counts(cohort_of(spark, d, "bank_b"))))


@query
def demographic_comparison(spark, d):
    return printed(D.demographic_comparison(cohort_of(spark, d, "bank_a"), cohort_of(spark, d, "bank_b")))


@query
def mcc_table(spark, d):
    """Codes of all purchases, and of the purchases of active customers."""
    tx = T.bank_a(spark, d)
    ids = recent_diversity(tx).where("active")
    return printed(D.mcc_table(tx).withColumn("of", F.lit("all")).unionByName(D.mcc_table(tx, ids).withColumn("of", F.lit("active"))))


@query
def mcc_top(spark, d):
    return printed(_tagged(D.mcc_top(T.bank_a(spark, d), 1), D.mcc_top(T.bank_b(spark, d), 6)))


@query
def psi_demographics(spark, d):
    a, b = D.demographic_counts(cohort_of(spark, d, "bank_a")), D.demographic_counts(cohort_of(spark, d, "bank_b"))
    both = a.withColumnRenamed("n", "p").join(b.withColumnRenamed("n", "q"), ["variable", "level"])
    return printed(D.psi(both, ("variable",)))


@query
def psi_numeric(spark, d):
    a, b = T.bank_a(spark, d), T.bank_b(spark, d)
    scaled = b.withColumn("amount", F.col("amount") * 1000)
    return printed(D.psi_numeric(a, scaled, "amount"))


@query
def psi_table(spark, d):
    a, b = durable(cohort_of(spark, d, "bank_a")), durable(cohort_of(spark, d, "bank_b"))
    return printed(D.psi_table(T.bank_a(spark, d), a, T.bank_b(spark, d), b, durable(season_cohort(spark, d))))


@query
def ecdf_points(spark, d):
    """All 2,001 points of both cohorts' amounts, purchases per customer, and spans."""
    out = None
    for bank, tx in (("bank_a", T.bank_a(spark, d)), ("bank_b", T.bank_b(spark, d))):
        cohort = durable(cohort_of(spark, d, bank))
        for what, rows, value, weight in (("amount", D.cohort_amounts(tx, cohort), "amount", "n"), ("purchases", cohort, "n_txn", None), ("span", cohort, "span_days", None)):
            part = D.ecdf_points(rows, value, weight=weight).withColumns({"bank": F.lit(bank), "what": F.lit(what)})
            out = part if out is None else out.unionByName(part)
    return printed(out)


@query
def class_share_views(spark, d):
    return printed(D.class_share_views(T.bank_a(spark, d), cohort_of(spark, d, "bank_a"), "bank_a")
                   .unionByName(D.class_share_views(T.bank_b(spark, d), cohort_of(spark, d, "bank_b"), "bank_b")))


@query
def class_totals(spark, d):
    """Every purchase's class total and customer total, merged before they are attached."""
    tx = T.bank_a(spark, d)
    per = tx.groupBy("customer_id", "category").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    total = tx.groupBy("category").agg(F.count("*").alias("class_total"))
    mine = tx.groupBy("customer_id").agg(F.count("*").alias("customer_total"))
    return printed(per.join(total, "category").join(mine, "customer_id"))
