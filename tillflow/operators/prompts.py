"""Instruction samples written from windows and profiles with string expressions."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.expressions import draw_hash, money
from tillflow.operators.features import join_profiles
from tillflow.settings import CLASSES, DEFAULTS, DEMOGRAPHIC_FIELDS

# ---- fixed values: the sentences of the template ----
INSTRUCTION = ("Based on the information about me below, predict the category of my next purchase. "
               "Answer with one of: {labels}.")
NEUTRAL_WORDS = ("A", "B", "C", "D")                 # in code order


@dataclass(frozen=True)
class PromptContext:
    """Which sentences a sample has besides the categories, and whether class names are hidden."""

    amounts: bool = True
    dates: bool = True
    demographics: bool = True
    neutral: bool = False
    drop_field: str | None = None

    @property
    def words(self) -> tuple:
        return NEUTRAL_WORDS if self.neutral else CLASSES

    @property
    def instruction(self) -> str:
        return INSTRUCTION.format(labels=", ".join(self.words))


def prompt_context(condition: str, drop_field: str | None = None) -> PromptContext:
    """`full`, `neutral`, or `seq` followed by any of +amounts, +dates, +demographics in this order (all three = full)."""
    extras = ("amounts", "dates", "demographics")
    if condition == "full":
        ctx = PromptContext()
    elif condition == "neutral":
        ctx = PromptContext(False, False, False, neutral=True)
    else:
        head, *given = condition.split("+")
        ordered = [e for e in extras if e in given]
        if head != "seq" or given != ordered or len(given) == len(extras):
            raise ValueError(f"unknown condition {condition!r}")
        ctx = PromptContext(*[e in given for e in extras])
    if drop_field is not None and drop_field not in DEMOGRAPHIC_FIELDS:
        raise ValueError(f"unknown demographic field {drop_field!r}; choose from {DEMOGRAPHIC_FIELDS}")
    return replace(ctx, drop_field=drop_field)


CONDITIONS = ("full", "seq", "seq+amounts", "seq+dates", "seq+demographics", "seq+amounts+dates",
              "seq+amounts+demographics", "seq+dates+demographics", "neutral")


def demographic_sentences(drop_field: str | None = None) -> Column:
    """The profile as one or two sentences, from the profile columns of the row."""
    person = [F.col(f) for f in ("marital_status", "gender") if f != drop_field]
    parts = [F.concat(F.col("age").cast("string"), F.lit(" years old")) if drop_field != "age" else None,
             F.concat_ws(" ", *person), F.concat("education", F.lit(" graduate")) if drop_field != "education" else None,
             F.col("occupation") if drop_field != "occupation" else None]
    parts = [p for p in parts if p is not None]                           # three or four, never fewer
    text = F.concat(F.lit("I am "), F.concat_ws(", ", *parts[:-1]), F.lit(", and "), parts[-1], F.lit("."))
    if drop_field == "income_group":
        return text
    return F.concat(text, F.lit(" In terms of my income, I belong to the "), "income_group", F.lit(" income group."))


def task_input(ctx: PromptContext) -> Column:
    """The sentences of the input purchases, in the order demographics, categories, dates, amounts."""
    words = F.array(*map(F.lit, ctx.words))
    listed = lambda a: F.array_join(a, ", ")
    sentences = [demographic_sentences(ctx.drop_field)] if ctx.demographics else []
    sentences.append(F.concat(F.lit("I made "), F.size("codes").cast("string"), F.lit(" purchases. Their categories, oldest first: "),
                              listed(F.transform("codes", lambda c: F.element_at(words, c + 1))), F.lit(".")))
    if ctx.dates:
        sentences.append(F.concat(F.lit("Their dates, oldest first: "),
                                  listed(F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd"))), F.lit(".")))
    if ctx.amounts:
        cur = DEFAULTS.currency
        # the sum is rounded, not its parts; six places keep the sum exact and equal in every engine
        total = F.aggregate(F.transform("amounts", lambda a: a.cast("decimal(24,6)")), F.lit(0).cast("decimal(28,6)"),
                            lambda acc, x: (acc + x).cast("decimal(28,6)")).cast("decimal(28,2)")
        sentences.append(F.concat(F.lit("Their amounts, oldest first: "), listed(F.transform("amounts", lambda a: money(a, cur))),
                                  F.lit(f". In total I spent {cur} "), total.cast("string"), F.lit(".")))
    return F.concat_ws(" ", *sentences)


def build_samples(windows: DataFrame, profiles: DataFrame | None, ctx: PromptContext) -> DataFrame:
    """(customer_id, instruction, input, response, target_class), one sample per window."""
    df = windows
    if ctx.demographics:
        if profiles is None:
            raise ValueError("this condition needs demographics, but none were given")
        df = join_profiles(windows, profiles)
    words = F.array(*map(F.lit, ctx.words))
    return df.select("customer_id", F.lit(ctx.instruction).alias("instruction"), task_input(ctx).alias("input"),
                     F.concat(F.element_at(words, F.col("target") + 1), F.lit(".")).alias("response"),
                     F.col("target").alias("target_class"))


def build_variants(windows: DataFrame, profiles: DataFrame | None, contexts: dict, label: str) -> DataFrame:
    """The samples of several contexts with `label` naming them: a row per window and context, written from one join of windows and profiles.

    contexts: name -> PromptContext. Windows are built once, whatever their number.
    """
    df = windows
    if any(ctx.demographics for ctx in contexts.values()):
        if profiles is None:
            raise ValueError("a condition needs demographics, but none were given")
        df = join_profiles(windows, profiles)
    each = []
    for name, ctx in contexts.items():
        words = F.array(*map(F.lit, ctx.words))
        each.append(F.struct(F.lit(ctx.instruction).alias("instruction"), task_input(ctx).alias("input"),
                             F.concat(F.element_at(words, F.col("target") + 1), F.lit(".")).alias("response"),
                             F.col("target").alias("target_class"), F.lit(name).alias(label)))
    return df.select("customer_id", F.inline(F.array(*each)))


def few_shot_examples(samples: DataFrame, per_class: int = DEFAULTS.few_shot_per_class, seed: int = DEFAULTS.seed) -> DataFrame:
    """(position, customer_id, input, response, target_class): `per_class` random samples per class, interleaved.

    Each class keeps its smallest hashes; the rank limit cuts every task to `per_class` rows per class before the shuffle.
    Texts are fetched for the chosen customers only. A class with too few samples stops the job.
    """
    w = Window.partitionBy("target_class").orderBy("_h", "customer_id")
    hashed = samples.select("customer_id", "target_class", draw_hash(f"{seed}:shot", F.col("customer_id")).alias("_h"))
    chosen = hashed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_class)
    n = chosen.groupBy("target_class").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") == per_class).alias("full")).scalar()
    enough = F.when(n == len(CLASSES), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"fewer than {per_class} training samples in a class")).cast("boolean"))
    order = Window.orderBy(draw_hash(f"{seed}:order", F.col("customer_id")), "customer_id")      # per_class x 4 rows
    placed = chosen.withColumn("position", F.row_number().over(order)).where(enough).select("customer_id", "position")
    return samples.join(F.broadcast(placed), "customer_id").select("position", "customer_id", "input", "response", "target_class")


def with_few_shot(samples: DataFrame, examples: DataFrame) -> DataFrame:
    """Samples whose input starts with the numbered worked examples. The examples are one short text for all rows."""
    one = F.concat(F.lit("Example "), F.col("position").cast("string"), F.lit(":\n"), "input", F.lit("\nAnswer: "), "response")
    shots = (examples.select("position", one.alias("t")).agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("s"))
             .select(F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("shots")))
    return samples.withColumn("input", F.concat(F.lit("Examples from other customers:\n\n"), shots.scalar(),
                                                F.lit("\n\nNow my information:\n"), F.col("input")))


def chat_messages(samples: DataFrame, with_answer: bool = True) -> DataFrame:
    """(customer_id, messages): the user turn and, for training, the answer as the assistant turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = [turn("user", F.concat("instruction", F.lit("\n\n"), "input"))]
    if with_answer:
        turns.append(turn("assistant", F.col("response")))
    return samples.select("customer_id", F.array(*turns).alias("messages"))


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def longest_sample(samples: DataFrame, length: Column | None = None) -> DataFrame:
    """One row: samples and the length of the longest one (words unless a length expression is given)."""
    n = length if length is not None else word_count(F.concat_ws(" ", "instruction", "input", "response"))
    return samples.agg(F.count("*").alias("samples"), F.max(n).alias("longest"))


def require_length(samples: DataFrame, maximum: int, length: Column | None = None) -> DataFrame:
    longest = longest_sample(samples, length).collect()[0]["longest"]
    if longest is not None and longest > maximum:
        raise ValueError(f"the longest sample has length {longest}, the limit is {maximum}")
    return samples


def run_name(family: Column, condition: Column, drop_field: Column, seed: Column) -> Column:
    """family-condition[-minus-field][-seed<k>]; the default seed adds nothing, a null field neither."""
    field = F.when(drop_field.isNotNull(), F.concat(F.lit("-minus-"), F.replace(drop_field, F.lit("_"), F.lit("-")))).otherwise("")
    tail = F.when(seed == DEFAULTS.seed, "").otherwise(F.concat(F.lit("-seed"), seed.cast("string")))
    return F.concat(family, F.lit("-"), condition, field, tail)
