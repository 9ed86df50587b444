"""Registered queries: instruction samples and numbers in texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from tillflow.operators import audit, prompts as Q
from tillflow.operators import windows as W
from tillflow.operators.metrics import classification_metrics
from tillflow.plans import tables as P
from tillflow.plans.registry import printed, query
from tillflow.settings import DEFAULTS, DEMOGRAPHIC_FIELDS
from tillflow.sources import testdata as T


def _profiled(spark, d, bank="bank_a"):
    p = T.profiles(spark, d)
    return W.last_windows(P.transactions(spark, d, bank), DEFAULTS.train_length).join(p.select("customer_id"), "customer_id", "left_semi"), p


def _samples(spark, d, condition="full", drop=None, bank="bank_a"):
    w, p = _profiled(spark, d, bank)
    ctx = Q.prompt_context(condition, drop)
    return Q.build_samples(w, p if ctx.demographics else None, ctx)


@query
def build_samples_full(spark, d):
    return printed(_samples(spark, d).unionByName(_samples(spark, d, bank="bank_b")))


@query
def build_samples_conditions(spark, d):
    """Every condition that is not full, from one table of windows."""
    return printed(Q.build_variants(*_profiled(spark, d), {c: Q.prompt_context(c) for c in Q.CONDITIONS[1:]}, "condition"))


@query
def build_samples_minus_field(spark, d):
    return printed(Q.build_variants(*_profiled(spark, d), {f: Q.prompt_context("full", f) for f in DEMOGRAPHIC_FIELDS}, "dropped"))


@query
def few_shot_examples(spark, d):
    return printed(Q.few_shot_examples(_samples(spark, d, "seq")))


@query
def with_few_shot(spark, d):
    """Bank B's samples with examples from bank A."""
    return printed(Q.with_few_shot(_samples(spark, d, "seq", bank="bank_b"), Q.few_shot_examples(_samples(spark, d, "seq"), 2)))


@query
def chat_messages(spark, d):
    m = Q.chat_messages(_samples(spark, d, "seq"))
    return printed(m.select("customer_id", F.posexplode("messages").alias("turn", "m")).select("customer_id", "turn", "m.role", "m.content"))


@query
def sample_length_guard(spark, d):
    return printed(Q.longest_sample(_samples(spark, d)))


@query
def run_names(spark, d):
    """Run names of every order status, nation and key parity (the three parts come from table columns)."""
    o = T.table(spark, d, "orders")
    field = F.when(F.col("o_orderkey") % 3 == 0, "income_group").when(F.col("o_orderkey") % 3 == 1, "age")
    seed = F.when(F.col("o_orderkey") % 2 == 0, 42).otherwise(2)
    return o.select(Q.run_name(F.lower("o_orderstatus"), F.lit("full"), field, seed).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query
def trace_numbers(spark, d):
    """Decimals of the instruction texts that the table of every customer's lowest and highest price does not hold."""
    texts = _samples(spark, d, "seq+amounts").select("customer_id", "input")
    results = T.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"), F.count("*").alias("n"))
    return printed(audit.trace_numbers(texts, "input", ("customer_id",), results))


@query
def trace_metric_numbers(spark, d):
    """Decimals of bank B's instruction texts that a metric table does not hold."""
    texts = _samples(spark, d, "seq+amounts", bank="bank_b").select("customer_id", "input")
    results = classification_metrics(P.length_predictions(spark, d, "bank_a"))
    return printed(audit.trace_numbers(texts, "input", ("customer_id",), results))
