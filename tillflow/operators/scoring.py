"""From scores or generated texts of any external scorer to prediction rows, and agreement between scorers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import argmax_code, class_name, softmax
from tillflow.settings import CLASSES


def label_scores_to_predictions(scores: DataFrame) -> DataFrame:
    """Rows with `scores` (one log score per class) become prediction and `p`."""
    df = scores.withColumn("p", softmax(F.col("scores")))
    return df.withColumn("prediction", class_name(argmax_code(F.col("p")))).drop("scores")


def clean_answers(generated: DataFrame, words=CLASSES) -> DataFrame:
    """Rows with a generated `answer`: outer space and one final period go, a known word becomes its class, other text stays."""
    text = F.regexp_replace(F.regexp_replace("answer", r"^\s+|\s+$", ""), r"\.$", "")
    out = text
    for word, name in zip(words, CLASSES):
        out = F.when(text == word, F.lit(name)).otherwise(out)
    return generated.withColumn("prediction", out).withColumn("is_category", F.coalesce(text.isin(*words), F.lit(False))).drop("answer")


def scorer_agreement(exact: DataFrame, fast: DataFrame, keys=("customer_id",)) -> DataFrame:
    """One row: prompts, share with the same top class, largest difference of a probability (`scores` on both sides)."""
    a = exact.select(*keys, softmax(F.col("scores")).alias("pa"))
    b = fast.select(*keys, softmax(F.col("scores")).alias("pb"))
    gap = F.array_max(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)))
    return a.join(b, list(keys)).agg(F.count("*").alias("n"), F.avg((argmax_code(F.col("pa")) == argmax_code(F.col("pb"))).cast("double")).alias("argmax_agreement"),
                                     F.max(gap).alias("max_abs_prob_diff"))


def generation_agreement(generated: DataFrame, scored: DataFrame, keys=("split", "model", "length")) -> DataFrame:
    """Generated against scored answers of the same customers: agreement in % and answers that are no category.

    Both tables use the same model name.
    """
    g = generated.select(*keys, "customer_id", F.col("prediction").alias("_g"))
    s = scored.select(*keys, "customer_id", F.col("prediction").alias("_s"))
    return g.join(s, [*keys, "customer_id"]).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("_g").isin(*CLASSES)).alias("not_a_category"),
        (100.0 * F.avg((F.col("_g") == F.col("_s")).cast("double"))).alias("agreement_pct"))


def score_in_batches(windows: DataFrame, scorer, columns=("customer_id", "length", "ground_truth", "codes")) -> DataFrame:
    """Class probabilities from a caller's Python model: `scorer(pandas.DataFrame) -> (n, 4) array`.

    Batches travel as Arrow; spark.sql.execution.arrow.maxRecordsPerBatch sets their size. Nothing is collected.
    """
    kept = windows.select(*columns)
    types = dict(kept.dtypes)
    carried = [c for c in columns if c != "codes"]

    def run(batches):
        for batch in batches:
            if len(batch):
                out = batch[carried].copy()
                out["p"] = list(scorer(batch))
                yield out

    schema = ", ".join([f"{c} {types[c]}" for c in carried] + ["p array<double>"])
    return kept.mapInPandas(run, schema).withColumn("prediction", class_name(argmax_code(F.col("p"))))
