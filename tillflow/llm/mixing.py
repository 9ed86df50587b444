"""Mixing sources to target weights by pivotal rounding of fractional copy numbers.

A source's target divided by its size is the number of copies each of its documents should get. Whole copies are given to all;
the fractions are rounded in pairs: mass (words) moves at random from one document to the other until one of the two has none
or a whole copy. The expected number of copies of every document and the taken words of the source are kept by each move. One
unfinished document is left per leaf (some thousands of documents of one source); the leaves' leftovers are rounded together
in the same way, level by level, until one is left per source. It is rounded by its own odds.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillflow.llm.common import WORD, documents, written

WEIGHTS = (5, 2, 1)                # by source in code point order, repeating
MOST = 3                           # copies of a document, times a source's size
LEAF = 4_000                       # documents rounded in one group
FAN = 1_000                        # leftovers rounded in one group
BROADCAST_ROWS = 200_000           # lines of the plan sent to all executors at most


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, n_units) -> with source_no and target: shares of the total by weight, stopped at MOST x source_size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())          # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("source_no"), F.lit(len(WEIGHTS))) + 1)
    table = written(sources.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", weight), "sources")
    cap = F.col("source_size") * float(MOST)
    total, level = table.agg(F.sum("source_size"), F.sum("source_size") / F.sum("weight")).first()
    while total:
        full = cap <= F.col("weight") * level
        capped, free = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        following = (total - capped) / free if free else level
        if not following > level * (1 + 1e-15):
            break
        level = following
    return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level or 0.0))))


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds the fractions p (0 < p < 1) of documents with these sizes; u: a uniform number per document.

    Returns the rounded values and the index of the one that is still a fraction (-1: none).
    """
    p, held = p.copy(), -1
    for j in range(len(p)):
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        to_held = min((1 - p[held]) * a, p[j] * b)                    # most mass that can go from j to the held one
        to_j = min(p[held] * a, (1 - p[j]) * b)
        if u[j] * (to_held + to_j) < to_j:                            # odds that keep every expectation
            held_done, j_done = (1 - p[held]) * a <= p[j] * b, p[j] * b <= (1 - p[held]) * a
            p[held], p[j] = (1.0 if held_done else p[held] + to_held / a), (0.0 if j_done else p[j] - to_held / b)
        else:
            held_done, j_done = p[held] * a <= (1 - p[j]) * b, (1 - p[j]) * b <= p[held] * a
            p[held], p[j] = (0.0 if held_done else p[held] - to_j / a), (1.0 if j_done else p[j] + to_j / b)
        if held_done:
            held = -1 if j_done else j
    return p, held


def _rounder(seed: int, group: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mass", "key"], ascending=[False, True], kind="stable")     # the large first: what stays open is small
        rng = np.random.default_rng([seed, int(rows["source_no"].iloc[0]), int(rows[group].iloc[0])])
        mass = rows["mass"].to_numpy(float)
        p, held = pivot(mass, rows["p"].to_numpy(float), rng.random(len(rows)))
        return rows.assign(p=p, open=np.arange(len(p)) == held)
    return run


def mix_sources(sized: DataFrame, seed: int = 20) -> DataFrame:
    """(doc_id, source, size) rows -> doc_id, source, size, n_rows, source_size, target, copies, n_more; one row per distinct input row.

    Of n_rows equal rows all get `copies` copies and n_more of them one more (at most MOST in all): whatever can be given in whole rows
    is, only what is left over is rounded, as one row's words. Size 0 (null or empty text) takes no part and gets the whole copies of
    its source. A null source is a source of its own, the last in order. Empty in, empty out. The draws hang on seed, source and
    document, not on partitions. A source's last fraction is rounded by its own odds, in every source alike.
    """
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "units")
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units")))
    leaves = F.ceil(F.col("n_units") / LEAF)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
            .withColumn("whole", F.floor(share)).withColumn("_extra", F.when(F.col("size") > 0, (share - F.floor(share)) * F.col("n_rows")).otherwise(0.0))
            .withColumn("more", F.floor("_extra")).withColumn("p", F.col("_extra") - F.floor("_extra")).withColumn("mass", F.col("size"))
            .withColumn("key", F.xxhash64("doc_id", "source", "size")).withColumn("leaf", F.pmod("key", leaves)))
    moving = (F.col("p") > 0) & (F.col("mass") > 0)
    schema = "doc_id long, source string, size long, n_rows long, source_no int, source_size long, target double, whole long, more long, p double, mass long, key long, leaf long, n_units long"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = rows.select(*names)
    first = rows.filter(moving).groupBy("source_no", "leaf").applyInPandas(_rounder(seed, "leaf"), schema + ", open boolean")
    still = rows.filter(~moving).withColumn("p", F.lit(0.0)).withColumn("open", F.lit(False))
    done = written(first.unionByName(still), "leaves")

    # the leftovers, one per leaf: (source_no, leaf) names them on every level
    left = done.filter("open").select("source_no", "leaf", "p", "mass", "key", F.col("leaf").alias("node"))
    decided, level = [], 1
    most = targets.agg(F.max(F.col("n_units"))).first()[0] or 0
    nodes = -(-most // LEAF)
    while nodes > 1:
        grouped = left.withColumn("node", F.expr(f"node div {FAN}")).groupBy("source_no", "node").applyInPandas(
            _rounder(seed + level, "node"), "source_no int, leaf long, p double, mass long, key long, node long, open boolean")
        grouped = written(grouped, "leftovers")
        decided.append(grouped.filter(~F.col("open")).select("source_no", "leaf", "p"))
        left, nodes, level = grouped.filter("open").drop("open"), -(-nodes // FAN), level + 1
    odds = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 53)) / float(1 << 53)
    last = left.select("source_no", "leaf", F.when(odds < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    for d in decided:
        last = last.unionByName(d)
    last = last.select("source_no", "leaf", F.col("p").alias("p_last"), F.lit(True).alias("open"))
    out = done.join(last, ["source_no", "leaf", "open"], "left")
    extra = F.coalesce("p_last", "p").cast("long")
    return out.select("doc_id", "source", "size", "n_rows", "source_size", "target", F.least("whole", F.lit(MOST)).cast("int").alias("copies"),
                      F.when(F.col("whole") < MOST, F.least(F.col("more") + extra, F.col("n_rows"))).otherwise(0).alias("n_more"))


def mixed_documents(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The documents of the mix, each as often as it was drawn, with the columns they came with.

    Of rows with one id, source and size some may be drawn once more than others. They are numbered where they lie: each part of the
    table numbers its own behind those of the parts before, so that a row that is there a million times is not gathered.
    """
    sized = docs.withColumn("_size", word_count())
    plan = written(mix_sources(sized.select("doc_id", "source", F.col("_size").alias("size")), seed).filter("copies > 0 or n_more > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), F.col("copies").alias("_copies"), F.col("n_rows").alias("_rows"), F.col("n_more").alias("_more")), "plan")
    # a row per document, so never sent to all executors; it meets the texts once, in one shuffle of them
    single = _drawn(sized, plan.filter("_rows = 1 or _more in (0, _rows)").hint("merge")).withColumn("_times", F.col("_copies") + F.when(F.col("_more") > 0, 1).otherwise(0))
    out = single.select(*docs.columns, "_times")
    shared = plan.filter("_rows > 1 and _more not in (0, _rows)")
    n = shared.count()
    if n:
        out = out.unionByName(_numbered(sized, F.broadcast(shared) if n <= BROADCAST_ROWS else shared).select(*docs.columns, "_times"))
    return out.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)


def _drawn(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their line of the plan."""
    return sized.join(plan, sized["doc_id"].eqNullSafe(plan["_id"]) & sized["source"].eqNullSafe(plan["_source"]) & (sized["_size"] == plan["_words"]))


def _numbered(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of which some are drawn once more than others, with `_times`."""
    several = written(_drawn(sized, plan).withColumn("_part", F.spark_partition_id()), "several")
    unit = ["_id", "_source", "_words"]
    sizes = several.groupBy(*unit, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"{c}_") for c in (*unit, "_part")], "_before")
    matched = several["_part"] == before["_part_"]
    for c in unit:
        matched = matched & several[c].eqNullSafe(before[f"{c}_"])
    numbered = several.join(before, matched).withColumn("_nth", F.col("_before") + F.row_number().over(Window.partitionBy(*unit, "_part").orderBy(F.xxhash64("text"))))
    return numbered.withColumn("_times", F.col("_copies") + F.when(F.col("_nth") <= F.col("_more"), 1).otherwise(0))


def op8_mixture(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"))
    out = mix_sources(sized).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    out = out.withColumn("copies", F.col("copies") + F.when(F.col("_row") <= F.col("n_more"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
