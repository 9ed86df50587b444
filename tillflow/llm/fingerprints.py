"""Document fingerprints by consistent weighted sampling.

A text is a bag of words (A-Z lower-cased), weighted by how often they occur. For each of K samples every word draws gamma variables
from a hash of itself and the sample's number; the word with the smallest value, with its quantised weight, is the sample. Two bags
give the same sample with a probability equal to their generalised Jaccard similarity (sum of minima by sum of maxima), so the share
of equal samples estimates it. A fingerprint is the samples' 16-bit hashes in hexadecimal digits.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import documents, mix, text_chunks, words

K = 64


def log_values(term: np.ndarray, weight: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For each weighted term and sample: log of the value to be smallest, and the quantised log weight."""
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    one = mix(term[:, None] ^ salt)
    two = mix(one + np.uint64(0xD1B54A32D192ED03))
    low, unit = np.uint64(0xFFFFFF), np.float32(2.0 ** -24)
    part = lambda x, shift: ((x >> np.uint64(shift)) & low).astype(np.float32) * unit + unit / 2
    r = -np.log(part(one, 0) * part(one, 24))                                                # gamma(2, 1)
    c = -np.log(part(two, 0) * part(two, 24))
    beta = ((one >> np.uint64(48)) * np.uint64(65536) + (two >> np.uint64(48))).astype(np.float32) * np.float32(2.0 ** -32)
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + beta)
    return np.log(c) - r * (t - beta) - r, t


def signatures(texts: pa.Array, k: int = K) -> np.ndarray:
    """rows x k samples (uint16). A text without words has samples 0."""
    out = np.zeros((len(texts), k), np.uint16)
    number = np.arange(k, dtype=np.uint64) << np.uint64(40)
    for first, end, data, offs in text_chunks(texts):
        h, row, _, _ = words(data, offs)
        if not len(h):
            continue
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
        weight = np.diff(np.concatenate((start, [len(h)])))
        h, row = h[start], row[start]
        both = h + np.minimum(weight, 1 << 20).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)      # a weighted term, once per chunk
        _, where, place = np.unique(both, return_index=True, return_inverse=True)
        spans = np.searchsorted(row, np.arange(end - first + 1))
        step = 20_000                                                                       # weighted terms valued at a time
        value, quant = np.empty((len(where), k), np.float32), np.empty((len(where), k), np.int16)
        for s in range(0, len(where), step):
            value[s:s + step], quant[s:s + step] = log_values(h[where[s:s + step]], weight[where[s:s + step]], k)
        for i in range(end - first):
            a, b = spans[i], spans[i + 1]
            if b > a:
                own = place[a:b]
                win = own[value[own].argmin(0)]
                sample = mix(h[where[win]] + quant[win, np.arange(k)].astype(np.int64).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + number)
                out[first + i] = np.maximum(sample & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def hexed(sig: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sig]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(1)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint of each row of `docs` (doc_id, text); a null text counts as empty, equal texts have equal fingerprints."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(hexed(signatures(b.column("text"), k)), pa.string())], ["doc_id", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by doc_id ranges and sorted in each; the last row of a range is a copy (`tail`) of the first row of the
    next one, of the last range a copy of the very first row: each row's successor stands below it in the same partition.

    Ties of doc_id follow a hash of the text; null ids come first. The text is shuffled once. The driver sees one id per partition.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(-2**63)).alias("_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c <= F.col("_id"))).cast("int")
    docs = docs.withColumn("_part", part)
    heads = sorted((r["_part"], r["m"]) for r in docs.groupBy("_part").agg(F.min(F.struct("_id", "_tie")).alias("m")).collect())   # a row per range
    parts = [p for p, _ in heads]
    extra = F.lit(None).cast("int")
    for i, (p, m) in enumerate(heads):
        extra = F.when((F.col("_part") == p) & (F.col("_id") == m["_id"]) & (F.col("_tie") == m["_tie"]), F.lit(parts[i - 1])).otherwise(extra) if len(heads) <= 64 else extra
    if len(heads) > 64:                                                                    # as a table, where the expression would be long
        table = spark.createDataFrame([(p, m["_id"], m["_tie"], parts[i - 1]) for i, (p, m) in enumerate(heads)], "_part int, _id long, _tie long, _before int")
        docs = docs.join(F.broadcast(table), ["_part", "_id", "_tie"], "left")               # a row per partition: bounded by n
        extra = F.col("_before")
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("tail"))
    before = F.struct(extra.alias("part"), F.lit(True).alias("tail"))
    docs = docs.withColumn("_to", F.explode(F.when(extra.isNull(), F.array(own)).otherwise(F.array(own, before))))
    return (docs.select("doc_id", "text", "_id", "_tie", F.col("_to.part").alias("_part"), F.col("_to.tail").alias("tail"))
            .repartitionById(n, F.col("_part")).sortWithinPartitions("_part", "tail", "_id", "_tie"))


def _compare(k: int):
    def run(batches):
        held = None
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, min(1000, b.num_rows - s))
                ids, texts, tails = (part.column(c).to_pylist() for c in ("doc_id", "text", "tail"))
                if held:
                    ids, texts, tails = [held[0], *ids], [held[1], *texts], [held[2], *tails]
                held = ids[-1], texts[-1], tails[-1]
                at = [i for i in range(len(ids) - 1) if not tails[i]]
                if not at:
                    continue
                new = [edited(texts[i], texts[i + 1]) for i in at]
                both = [x for i, t in enumerate(texts) for x in (t, edited(t, texts[i + 1]) if i + 1 < len(texts) else "")]
                both = signatures(pa.array(both, pa.large_string()), k)                       # side by side: shared words are valued once
                sig, own, other = both[::2], both[::2][at], both[1::2][at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), pa.array(hexed(own), pa.string()),
                    pa.array(hexed(other), pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, sig[[i + 1 for i in at]]))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return run


def edit_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, in order of doc_id."""
    return in_order(docs).mapInArrow(_compare(k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark, sf_dir):
    return edit_report(documents(spark, sf_dir))
