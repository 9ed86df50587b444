"""Descriptive tables of cohorts and drift between them. A cohort is (tx of all customers, cohort_customers rows)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import age_band, changes
from tillflow.functions.literals import literal_doubles, literal_rows
from tillflow.functions.quantiles import exact_quantiles
from tillflow.operators.baselines import last_code, most_frequent_code
from tillflow.operators.cohort import cohort_class_shares
from tillflow.settings import CLASSES, DEFAULTS, DEMOGRAPHIC_LEVELS, SHORT_NAMES

GAS = CLASSES.index("Gas stations")


def _stack(df: DataFrame, items: dict, by=()) -> DataFrame:
    """One-row-per-group columns to (by, statistic, value) rows; values are doubles."""
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("statistic"), v.cast("double").alias("value"))
                                             for k, v in items.items()])))


def month_count(first: Column, last: Column) -> Column:
    return (F.months_between(F.trunc(last, "MM"), F.trunc(first, "MM")) + 1).cast("int")


def months_observed(tx: DataFrame) -> DataFrame:
    """One row: months between the first and the last purchase, both included."""
    return tx.agg(F.min("date").alias("first"), F.max("date").alias("last")).select(
        "first", "last", month_count(F.col("first"), F.col("last")).alias("months"))


def cohort_amounts(tx: DataFrame, cohort: DataFrame) -> DataFrame:
    """(amount, n) of the purchases of cohort customers. Equal amounts of a customer are merged before the join."""
    merged = tx.groupBy("customer_id", "amount").agg(F.count("*").alias("n"))
    return merged.join(cohort.select("customer_id"), "customer_id", "left_semi")


def activity_table(tx: DataFrame, cohort: DataFrame, usd_rate: float) -> DataFrame:
    """(statistic, value): size, period, purchases per customer, span of the last ten, amounts."""
    period = months_observed(tx)
    dates = (tx.groupBy("customer_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
             .join(cohort.select("customer_id"), "customer_id", "left_semi").agg(F.min("lo").alias("first"), F.max("hi").alias("last")))
    thirds = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    per = cohort.agg(F.count("*").alias("customers"), F.sum("n_txn").alias("transactions"),
                     F.percentile("n_txn", thirds).alias("q_n"), F.percentile("span_days", thirds).alias("q_span"),
                     F.avg((F.col("n_txn") >= 15).cast("double")).alias("at15"), F.avg((F.col("n_txn") >= 20).cast("double")).alias("at20"))
    one = (per.withColumns({"months": period.select("months").scalar(), "first": dates.select("first").scalar(),
                            "last": dates.select("last").scalar(),
                            "q_amount": exact_quantiles(cohort_amounts(tx, cohort), "amount", (0.25, 0.5, 0.75), weight="n").select("q").scalar()}))
    q = lambda c, i: F.get(c, F.lit(i))
    return _stack(one, {
        "customers": F.col("customers"), "transactions": F.col("transactions"),
        "first date (days since 1970)": F.unix_date("first"), "last date (days since 1970)": F.unix_date("last"),
        "months observed": F.col("months"),
        "transactions per customer: median": q("q_n", 1), "transactions per customer: IQR low": q("q_n", 0),
        "transactions per customer: IQR high": q("q_n", 2),
        "transactions per customer per month: median": F.bround(q("q_n", 1) / F.col("months"), 1),
        "customers with at least 15 transactions (%)": F.bround(100 * F.col("at15"), 1),
        "customers with at least 20 transactions (%)": F.bround(100 * F.col("at20"), 1),
        "span of the last 10, days: median": q("q_span", 1), "span of the last 10, days: IQR low": q("q_span", 0),
        "span of the last 10, days: IQR high": q("q_span", 2),
        "amount: median": F.bround(q("q_amount", 1), 1), "amount: IQR low": F.bround(q("q_amount", 0), 1),
        "amount: IQR high": F.bround(q("q_amount", 2), 1), "TL per USD": F.lit(usd_rate),
        "amount, USD: median": F.bround(q("q_amount", 1) / F.lit(usd_rate), 1)})


def season_rows(cohort_a: DataFrame, season_b: DataFrame) -> DataFrame:
    """The same-season window: customers of bank B and the median spans of both."""
    a = cohort_a.agg(F.percentile("span_days", F.lit(0.5)).alias("a"))
    b = season_b.agg(F.count("*").alias("n"), F.percentile("span_days", F.lit(0.5)).alias("b")).withColumn("a", a.scalar())
    return _stack(b, {"same-season window: customers": F.col("n"), "span of the last 10, days: median, bank A": F.col("a"),
                      "span of the last 10, days: median, same-season bank B": F.col("b")})


def target_shares(cohort: DataFrame) -> DataFrame:
    """One row with the share of every class among the targets, n0..n3 and s0..s3."""
    return cohort.agg(*[F.count_if(F.col("target") == k).alias(f"n{k}") for k in range(len(CLASSES))], F.count("*").alias("n")).select(
        "*", *[F.try_divide(F.col(f"n{k}").cast("double"), F.col("n")).alias(f"s{k}") for k in range(len(CLASSES))])


def predictability_table(cohort: DataFrame) -> DataFrame:
    """(statistic, value): how far simple rules and the class mix of the windows go."""
    last, codes = last_code(F.col("codes")), F.transform("steps", lambda s: s["code"])
    pct = lambda c: F.avg(c.cast("double")) * 100
    agg = cohort.agg(
        pct(last == F.col("target")).alias("same_last"), pct(most_frequent_code(F.col("codes")) == F.col("target")).alias("same_mode"),
        *[pct(F.col("distinct_inputs") == d).alias(f"d{d}") for d in (2, 3, 4)], F.avg("distinct_inputs").alias("distinct"),
        F.avg(changes(codes)).alias("changes"), F.avg(F.when(last == GAS, (F.col("target") == GAS).cast("double"))).alias("gas_gas"),
        pct(last == GAS).alias("gas_last"), F.count("*").alias("n"),
        *[F.count_if(F.col("target") == k).alias(f"n{k}") for k in range(len(CLASSES))])
    share = [F.try_divide(F.col(f"n{k}").cast("double"), F.col("n")) for k in range(len(CLASSES))]
    entropy = -sum((F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0))
    r = F.bround
    return _stack(agg, {
        "target equals the last input category (%)": r("same_last", 1), "target equals the most frequent input category (%)": r("same_mode", 1),
        **{f"inputs with {d} distinct categories (%)": r(f"d{d}", 1) for d in (2, 3, 4)},
        "distinct categories among the inputs: mean": r("distinct", 2), "category changes within the 10 transactions: mean": r("changes", 2),
        "target is Gas stations when the last input is (%)": r(100 * F.col("gas_gas"), 1), "last input is Gas stations (%)": r("gas_last", 1),
        "target entropy (bits)": r(entropy, 3)})


def reweighted_accuracy(cohort_a: DataFrame, cohort_b: DataFrame) -> DataFrame:
    """Accuracy of the averaging rule on bank A, plain and with its customers weighted to bank B's target mix."""
    hits = cohort_a.groupBy("target").agg(F.count("*").alias("n"),
                                          F.count_if(most_frequent_code(F.col("codes")) == F.col("target")).alias("hits"))
    a = hits.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))            # four rows
    b = cohort_b.groupBy("target").agg(F.count("*").alias("m"))
    b = b.withColumn("share_b", F.col("m") / F.sum("m").over(Window.partitionBy()))
    w = F.coalesce("share_b", F.lit(0.0)) / F.col("share")
    return a.join(b, "target", "left").agg((F.sum("hits") / F.sum("n")).alias("accuracy"),
                                           (F.sum(F.col("hits") * w) / F.sum(F.col("n") * w)).alias("reweighted_accuracy"))


def profile_view(cohort: DataFrame) -> DataFrame:
    """Customer columns under the names of the demographic tables."""
    return cohort.select("customer_id", "age", age_band(F.col("age")).alias("Age band"), F.col("gender").alias("Gender"),
                         F.col("marital_status").alias("Marital status"), F.col("education").alias("Education"),
                         F.col("occupation").alias("Occupation"), F.col("income_group").alias("Income group"))


def level_list(spark) -> DataFrame:
    """(variable, level) of the fixed levels."""
    return literal_rows(spark, [(v, x) for v, xs in DEMOGRAPHIC_LEVELS.items() for x in xs], ("variable", "level"))


def demographic_counts(cohort: DataFrame) -> DataFrame:
    """(variable, level, n) over the fixed levels, zeros present, other levels left out."""
    view, names = profile_view(cohort), list(DEMOGRAPHIC_LEVELS)
    cells = view.groupBy(*names).agg(F.count("*").alias("w"))
    rows = cells.select("w", F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").alias("level")) for v in names])))
    counts = rows.groupBy("variable", "level").agg(F.sum("w").alias("n"))
    return level_list(cohort.sparkSession).join(counts, ["variable", "level"], "left").fillna(0, ["n"])


def demographic_shares(cohort: DataFrame) -> DataFrame:
    """(variable, level, share in %), and the mean age."""
    counts = demographic_counts(cohort)
    shares = counts.select("variable", "level", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("variable"))).alias("share"))
    age = cohort.agg(F.avg("age").alias("share")).select(F.lit("Age").alias("variable"), F.lit("mean").alias("level"), "share")
    return shares.unionByName(age)


def demographic_comparison(cohort_a: DataFrame, cohort_b: DataFrame) -> DataFrame:
    """Both banks side by side, one decimal."""
    a, b = (demographic_shares(c).withColumnRenamed("share", n) for c, n in ((cohort_a, "bank_a"), (cohort_b, "bank_b")))
    return a.join(b, ["variable", "level"]).select("variable", "level", F.bround("bank_a", 1).alias("bank_a"), F.bround("bank_b", 1).alias("bank_b"))


def code_counts(tx: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(category, mcc, transactions). With `ids`, purchases are counted per customer and code before the join."""
    if ids is None:
        return tx.groupBy("category", "mcc").agg(F.count("*").alias("transactions"))
    per = tx.groupBy("customer_id", "category", "mcc").agg(F.count("*").alias("n"))
    return (per.join(ids.select("customer_id"), "customer_id", "left_semi").groupBy("category", "mcc")
            .agg(F.sum("n").alias("transactions")))


def mcc_table(tx: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Codes with their share of all purchases and of their class. Windows run over the counted codes."""
    n = F.col("transactions")
    return code_counts(tx, ids).withColumns({"share_all": 100.0 * n / F.sum(n).over(Window.partitionBy()),
                                             "share_in_class": 100.0 * n / F.sum(n).over(Window.partitionBy("category"))})


def mcc_top(tx: DataFrame, top: int = 6) -> DataFrame:
    """Per class: share, number of codes, and its `top` most frequent codes."""
    table = mcc_table(tx)
    w = Window.partitionBy("category")
    ranked = table.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("transactions"), "mcc")), "codes": F.count("*").over(w),
                                "class_share": F.sum("share_all").over(w)})
    return ranked.where(F.col("rank") <= top).select("category", "class_share", "codes", "rank", "mcc", "share_in_class")


# ---- drift -----------------------------------------------------------------------------------------------------
def psi(counts: DataFrame, by=(), floor: float = DEFAULTS.psi_floor) -> DataFrame:
    """Population stability index from (by, level, p, q): counts or shares of the reference and of the other population."""
    w = Window.partitionBy(*by)
    raised = counts.withColumns({"_p": F.greatest(F.coalesce(F.col("p").cast("double"), F.lit(0.0)), F.lit(floor)),
                                 "_q": F.greatest(F.coalesce(F.col("q").cast("double"), F.lit(0.0)), F.lit(floor))})
    shares = raised.withColumns({"_p": F.col("_p") / F.sum("_p").over(w), "_q": F.col("_q") / F.sum("_q").over(w)})
    return shares.groupBy(*by).agg(F.sum((F.col("_q") - F.col("_p")) * F.ln(F.col("_q") / F.col("_p"))).alias("psi"))


def psi_numeric(a: DataFrame, b: DataFrame, value: str, bins: int = DEFAULTS.psi_bins, weight: str | None = None) -> DataFrame:
    """One-row PSI of a numeric column, binned on the quantiles of `a`; equal edges are one edge, the ends are open."""
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(a, value, probs, weight=weight).select(F.array_distinct("q").alias("e")).scalar()
    n = F.count("*") if weight is None else F.sum(weight)

    def binned(df, name):
        # the edges are found once; a value is in bin k when k edges are at or below it
        with_edges = df.where(F.col(value).isNotNull()).withColumn("_e", edges)
        k = F.size(F.filter("_e", lambda x: x <= F.col(value)))
        return with_edges.select(k.alias("bin"), F.size("_e").alias("_m"), *([weight] if weight else [])).groupBy("bin", "_m").agg(n.alias(name))

    both = binned(a, "p").drop("_m").join(binned(b, "q").drop("_m"), "bin", "full_outer")
    return psi(both.select("bin", "p", "q"))


def class_share_views(tx: DataFrame, cohort: DataFrame, bank: str) -> DataFrame:
    """Class shares in % of all purchases and of the targets of one cohort, one decimal."""
    everything = cohort_class_shares(tx, cohort).agg(*[F.max(F.when(F.col("code") == k, F.col("share"))).alias(f"s{k}") for k in range(len(CLASSES))])
    rows = [(everything, "All transactions"), (target_shares(cohort), "Prediction targets")]
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(view).alias("view"), F.lit(bank).alias("bank"),
                  *[F.bround(100 * F.coalesce(f"s{k}", F.lit(0.0)), 1).alias(s) for k, s in enumerate(SHORT_NAMES)])
        for df, view in rows])


def psi_table(tx_a: DataFrame, cohort_a: DataFrame, tx_b: DataFrame, cohort_b: DataFrame, season_b: DataFrame) -> DataFrame:
    """(dimension, psi) of class shares, activity, spans, amounts and every demographic variable."""
    parts = []
    named = lambda df, name: df.select(F.lit(name).alias("dimension"), F.col("psi"))
    shares = (cohort_class_shares(tx_a, cohort_a).select("code", F.col("n").alias("p"))
              .join(cohort_class_shares(tx_b, cohort_b).select("code", F.col("n").alias("q")), "code"))
    parts.append(named(psi(shares), "Class shares, all transactions"))
    long = lambda c, name: target_shares(c).select(F.inline(F.array(*[F.struct(F.lit(k).alias("code"), F.col(f"n{k}").alias(name)) for k in range(len(CLASSES))])))
    parts.append(named(psi(long(cohort_a, "p").join(long(cohort_b, "q"), "code")), "Class shares, prediction targets"))
    parts.append(named(psi_numeric(cohort_a, cohort_b, "n_txn"), "Transactions per customer"))
    parts.append(named(psi_numeric(cohort_a, cohort_b, "span_days"), "Span of the last 10 transactions"))
    parts.append(named(psi_numeric(cohort_a, season_b, "span_days"), "Span of the last 10 transactions, same-season bank B"))
    parts.append(named(psi_numeric(cohort_amounts(tx_a, cohort_a), cohort_amounts(tx_b, cohort_b), "amount", weight="n"), "Transaction amount"))
    shared = (demographic_shares(cohort_a).withColumnRenamed("share", "p")
              .join(demographic_shares(cohort_b).withColumnRenamed("share", "q"), ["variable", "level"]).where(F.col("variable") != "Age"))
    parts.append(psi(shared, ("variable",)).withColumnRenamed("variable", "dimension"))
    return reduce(DataFrame.unionByName, parts).select("dimension", F.bround("psi", 3).alias("psi"))


def ecdf_points(df: DataFrame, value: str, points: int = 2001, cut=(0.002, 0.998), by=(), weight: str | None = None) -> DataFrame:
    """(by, probability, quantile, median, low, high) of the positive finite values; low and high are the cut quantiles."""
    probs = [i / (points - 1) for i in range(points)]
    ok = df.where((F.col(value) > 0) & (F.col(value) < F.lit(float("inf"))))
    q = exact_quantiles(ok, value, [*probs, 0.5, *cut], by, weight)
    grid = F.arrays_zip(literal_doubles(probs).alias("probability"), F.slice("q", 1, points).alias("quantile"))
    at = lambda i: F.get("q", F.lit(points + i))
    return q.select(*by, F.inline(grid), at(0).alias("median"), at(1).alias("low"), at(2).alias("high"))


def count_check(cohort: DataFrame, recorded: DataFrame, bank: str) -> DataFrame:
    """(bank, cohort, recorded, same): the cohort must have the size the split summary recorded (columns bank, customers)."""
    n = cohort.agg(F.count("*").alias("cohort")).select(F.lit(bank).alias("bank"), "cohort")
    both = n.join(recorded.select("bank", F.col("customers").alias("recorded")), "bank", "left")
    return both.withColumn("same", F.coalesce(F.col("cohort") == F.col("recorded"), F.lit(False)))


def require_counts(check: DataFrame) -> None:
    bad = check.where(~F.col("same")).agg(F.array_join(F.array_sort(F.collect_set("bank")), ", ")).first()[0]
    if bad:
        raise ValueError(f"cohort differs from the recorded split summary: {bad}")
