"""Feature tables of the input window (the target is never read)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, array_median, array_sum, changes, count_code, last_seen
from tillflow.settings import SHORT_NAMES
from tillflow.sources.session import durable

PROFILE_LEVELS = ("gender", "marital_status", "education", "occupation", "income_group")


def sequence_features(windows: DataFrame) -> DataFrame:
    """Per class count, share, purchases since it was seen, last-is and second-last-is; and the number of changes."""
    codes, x = F.col("codes"), F.size("codes")
    columns = {}
    for k, s in enumerate(SHORT_NAMES):
        n, seen = count_code(codes, k), last_seen(codes, k)
        columns |= {f"count_{s}": n, f"share_{s}": n / x, f"since_{s}": F.when(seen >= 0, x - 1 - seen).otherwise(x),
                    f"last_is_{s}": (F.element_at(codes, -1) == k).cast("int"),
                    f"second_last_is_{s}": F.when(x >= 2, (F.try_element_at(codes, F.lit(-2)) == k).cast("int")).otherwise(0)}
    columns["switches"] = changes(codes)
    return windows.withColumns(columns)


def sequence_feature_names() -> list[str]:
    return [f"{f}_{s}" for s in SHORT_NAMES for f in ("count", "share", "since", "last_is", "second_last_is")] + ["switches"]


AMOUNT_DATE_NAMES = ["amount_mean", "amount_median", "amount_max", "amount_last", "amount_total",
                     "gap_mean", "gap_last", "span_days", "weekday_last"]


def full_features(windows: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Sequence features plus amounts (log scale), day gaps, weekday of the last input, and the profile.

    A customer without a profile stops the job.
    """
    df = sequence_features(windows)
    positive = F.transform("amounts", lambda a: F.greatest(a, F.lit(0.0)))
    logs = F.transform(positive, lambda a: F.log1p(a))
    n = F.size("dates")
    gaps = F.zip_with(F.slice("dates", F.lit(1), n - 1), F.slice("dates", F.lit(2), n - 1), lambda a, b: F.datediff(b, a))
    last = F.element_at("dates", -1)
    df = df.withColumns({
        "amount_mean": array_sum(logs) / F.size("amounts"), "amount_median": array_median(logs),
        "amount_max": F.array_max(logs), "amount_last": F.element_at(logs, -1), "amount_total": F.log1p(array_sum(positive)),
        "gap_mean": F.try_divide(F.datediff(last, F.get("dates", F.lit(0))), n - 1), "gap_last": F.try_element_at(gaps, F.lit(-1)),
        "span_days": F.datediff(last, F.get("dates", F.lit(0))), "weekday_last": F.weekday(last)})
    return df if profiles is None else join_profiles(df, profiles.select("customer_id", "age", *PROFILE_LEVELS))


def join_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Inner join that refuses a customer without a profile."""
    found = df.join(profiles.withColumn("_found", F.lit(True)), "customer_id", "left")
    lost = F.raise_error(F.concat(F.lit("no profile for customer "), F.col("customer_id").cast("string"))).cast("boolean")
    return found.where(F.when(F.col("_found").isNull(), lost).otherwise(F.lit(True))).drop("_found")


def level_table(train: DataFrame, columns=PROFILE_LEVELS) -> DataFrame:
    """(variable, level, index) of the pairs seen in training, numbered from 0 in the order of their md5; written once.

    The first digits of the md5 deal the levels to 4,096 buckets: their sizes give every bucket's first number, and levels are ranked
    inside their bucket, so no task sorts all levels.
    """
    pairs = (train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])))
             .where(F.col("level").isNotNull()).distinct().withColumn("_h", F.md5(F.concat_ws(":", "variable", "level"))).withColumn("_b", F.substring("_h", 1, 3)))
    sizes = pairs.groupBy("_b").agg(F.count("*").alias("_m"))
    before = sizes.select("_b", F.coalesce(F.sum("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "variable", "level")))
    return durable(ranked.join(F.broadcast(before), "_b").select("variable", "level", (F.col("_before") + F.col("_r") - 1).alias("index")))


BROADCAST_LEVELS = 1_000_000


def one_hot(df: DataFrame, levels: DataFrame, columns=PROFILE_LEVELS) -> DataFrame:
    """The categorical columns as one sparse row `hot`: the sorted indices of the levels that hold; the others are 0.

    Levels are looked up by a join per column, however many there are. A null, or a level not seen in training, has no index.
    """
    few = levels.count() <= BROADCAST_LEVELS
    for i, c in enumerate(columns):
        own = levels.where(F.col("variable") == c).select(F.col("level").alias(f"_level{i}"), F.col("index").alias(f"_hot{i}"))
        df = df.join(F.broadcast(own) if few else own, F.col(c).cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
    names = [f"_hot{i}" for i in range(len(columns))]
    return df.withColumn("hot", F.array_sort(F.array_compact(F.array(*names)))).drop(*names, *columns)


def class_weights(targets: DataFrame, kind: str = "inverse") -> DataFrame:
    """(target, n, weight): "inverse" frequency scaled to sum to the number of classes, "balanced" = n / (4 n_k), "none" = 1."""
    counts = targets.agg(F.count("*").alias("all"), *[F.count_if(F.col("target") == k).alias(f"n{k}") for k in range(N_CLASSES)])
    at_least_one = [F.greatest(F.col(f"n{k}"), F.lit(1)) for k in range(N_CLASSES)]
    total = sum((F.lit(1.0) / c for c in at_least_one), F.lit(0.0))
    weight = {"none": lambda k: F.lit(1.0), "inverse": lambda k: F.lit(1.0) / at_least_one[k] / total * N_CLASSES,
              "balanced": lambda k: F.col("all") / (N_CLASSES * at_least_one[k])}[kind]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("target"), F.col(f"n{k}").alias("n"), weight(k).alias("weight"))
                                            for k in range(N_CLASSES)])))


def padded_sequence(windows: DataFrame, size: int, pad: int, shift: int = 0) -> DataFrame:
    """Add `tokens`: the last `size` input codes plus `shift`, padded on the left with `pad`."""
    kept = F.slice("codes", F.greatest(F.size("codes") - size, F.lit(0)) + 1, F.lit(size))
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size("codes"), F.lit(0)))
    return windows.withColumn("tokens", F.concat(fill, F.transform(kept, lambda c: c + shift)))


IGNORED = -100          # fixed value: a position the training loss skips


def next_step_targets(windows: DataFrame, size: int) -> DataFrame:
    """Add `next_codes`: at each of the last `size` positions the code that follows it, IGNORED at padding."""
    codes = F.transform("steps", lambda s: s["code"])
    following = F.slice(codes, F.greatest(F.size("codes") - size, F.lit(0)) + 2, F.lit(size))
    fill = F.array_repeat(F.lit(IGNORED), F.greatest(F.lit(size) - F.size("codes"), F.lit(0)))
    return windows.withColumn("next_codes", F.concat(fill, following))
