"""Raw export: text rows in, typed transactions and profiles out, with a report of what was dropped."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import is_blank, parse_number, parse_when
from tillflow.settings import DEMOGRAPHIC_TEXT
from tillflow.sources.raw import ExportSection

ID_TEXT = r"^\s*\d+\s*$"
DATE_OUT, TIME_OUT = "yyyy-MM-dd", "HH:mm:ss"


def typed_transactions(raw: DataFrame, section: ExportSection) -> DataFrame:
    """Every raw row with its parsed columns and `reject`, the first rule it breaks (null = kept)."""
    col = {k: F.col(f"`{v}`") for k, v in section.columns.items()}
    broken = ~F.coalesce(col["customer_id"].rlike(ID_TEXT), F.lit(False))
    date = parse_when(col["date"], section.date_format, DATE_OUT)
    time = parse_when(col["time"], section.time_format, TIME_OUT) if "time" in col else F.lit(None).cast("string")
    amount, mcc = parse_number(col["amount"], section.decimal), parse_number(col["mcc"])
    df = raw.withColumns({
        "_customer": F.trim(col["customer_id"]).try_cast("long"), "_date": date, "_time": time, "_amount": amount, "_mcc": mcc})
    reject = F.when(broken, "broken line")
    for name in section.require:
        reject = reject.when(is_blank(F.col(f"`{name}`")), f"empty {name}")
    reject = reject.when(F.col("_date").isNull() | F.col("_amount").isNull() | F.col("_mcc").isNull(), "missing value")
    return df.select(F.col("_customer").alias("customer_id"), F.col("_date").alias("date"), F.col("_time").alias("time"),
                     F.col("_amount").alias("amount"), F.col("_mcc").cast("int").alias("mcc"), "seq", reject.alias("reject"))


def export_transactions(raw: DataFrame, section: ExportSection) -> DataFrame:
    kept = typed_transactions(raw, section).where(F.col("reject").isNull())
    return kept.select("customer_id", "date", *(["time"] if "time" in section.columns else []), "amount", "mcc", "seq")


def export_report(raw: DataFrame, section: ExportSection) -> DataFrame:
    """(item, value as text): rows read, dropped per rule in order, untimed, written, customers, first and last date."""
    df, reject = typed_transactions(raw, section), F.col("reject")
    kept = reject.isNull()
    # customers are merged before they are counted, so the distinct count is one row per customer
    per = df.groupBy(F.when(kept, F.col("customer_id")).alias("c")).agg(
        F.count("*").alias("rows"), F.count_if(reject == "broken line").alias("broken"),
        *[F.count_if(reject == f"empty {r}").alias(f"empty_{i}") for i, r in enumerate(section.require)],
        F.count_if(reject == "missing value").alias("missing"),
        F.count_if(F.col("time").isNull() & (kept | (reject == "missing value"))).alias("untimed"),
        F.count_if(kept).alias("written"), F.min(F.when(kept, F.col("date"))).alias("first"),
        F.max(F.when(kept, F.col("date"))).alias("last"))
    total = lambda c: F.sum(c).cast("string")
    items = {"rows read": total("rows"), "dropped: broken line": total("broken")}
    items |= {f"dropped: empty {r}": total(f"empty_{i}") for i, r in enumerate(section.require)}
    if "time" in section.columns:
        items["without a recorded time (kept)"] = total("untimed")
    items |= {"dropped: missing date, amount or code": total("missing"), "rows written": total("written"),
              "customers": F.count("c").cast("string"), "first date": F.min("first"), "last date": F.max("last")}
    agg = per.agg(*[v.alias(f"v{i}") for i, v in enumerate(items.values())])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.col(f"v{i}").alias("value")) for i, k in enumerate(items)])))


def mapped_label(raw, words: dict):
    """The shared word of a raw label; `"*"` stands for every label not listed; blank stays null."""
    text, star = F.when(~is_blank(raw), F.trim(raw)), words.get("*")
    listed = {k: v for k, v in words.items() if k != "*"}
    out = F.lit(star).cast("string")
    for label, word in listed.items():
        out = F.when(text == label, F.lit(word)).otherwise(out)
    return F.when(text.isNotNull(), out)


def unlisted_labels(raw: DataFrame, section: ExportSection) -> DataFrame:
    """(field, label) without a word in the spec, for fields that have no `"*"`."""
    strict = [f for f in DEMOGRAPHIC_TEXT if "*" not in section.labels[f]]
    ok = F.col(f"`{section.columns['customer_id']}`").rlike(ID_TEXT)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f"`{section.columns[f]}`")).alias("label"),
                               F.col(f"`{section.columns[f]}`").isin(*section.labels[f]).alias("_unused")) for f in strict]) if strict else None
    if pairs is None:
        return raw.select(F.lit("").alias("field"), F.lit("").alias("label")).limit(0)
    seen = raw.where(ok).select(F.inline(pairs)).select("field", "label").where(~is_blank(F.col("label"))).distinct()
    known = F.lit(False)
    for f in strict:
        known = known | ((F.col("field") == f) & F.col("label").isin(*section.labels[f]))
    return seen.where(~known)


def require_listed_labels(raw: DataFrame, section: ExportSection) -> None:
    """Stops if a label has no word in the spec; the message names every such label."""
    named = F.concat("field", F.lit(" '"), "label", F.lit("'"))
    bad = unlisted_labels(raw, section).agg(F.array_join(F.array_sort(F.collect_set(named)), ", ")).first()[0]
    if bad:
        raise ValueError(f"the spec lists no word for: {bad}")


def export_demographics(raw: DataFrame, section: ExportSection, check: bool = True) -> DataFrame:
    """One row per raw customer row, incomplete ones included. An unlisted label stops the job before anything is written."""
    if check:
        require_listed_labels(raw, section)
    col = {k: F.col(f"`{v}`") for k, v in section.columns.items()}
    return raw.where(col["customer_id"].rlike(ID_TEXT)).select(
        F.trim(col["customer_id"]).try_cast("long").alias("customer_id"), parse_number(col["age"]).cast("int").alias("age"),
        *[mapped_label(col[f], section.labels[f]).alias(f) for f in DEMOGRAPHIC_TEXT],
        parse_number(col["income"], section.decimal).alias("income"), "seq")


def demographics_report(exported: DataFrame) -> DataFrame:
    """(field, level, n): customers, complete records and the count of every level."""
    complete = ~sum((F.col(c).isNull().cast("int") for c in ("customer_id", "age", *DEMOGRAPHIC_TEXT, "income")), F.lit(0)).cast("boolean")
    cells = exported.groupBy(*DEMOGRAPHIC_TEXT, complete.alias("_complete")).agg(F.count("*").alias("w"))
    rows = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("(missing)")).alias("level")) for f in DEMOGRAPHIC_TEXT]
    rows += [F.struct(F.lit("customers").alias("field"), F.lit("all").alias("level")),
             F.struct(F.lit("customers").alias("field"), F.when(F.col("_complete"), "complete").alias("level"))]
    long = cells.select("w", F.inline(F.array(*rows))).where(F.col("level").isNotNull())
    return long.groupBy("field", "level").agg(F.sum("w").alias("n"))
