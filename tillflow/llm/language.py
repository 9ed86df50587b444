"""Language identification by a byte convolutional network.

Filters of two, three and four bytes slide over fixed-length windows of UTF-8 text (A-Z lower-cased), the strongest answer of each
filter in a window (max pooling) feeds a softmax over the languages seen in training. Windows overlap by the widest filter less one,
so every place of a text is seen. A document's answer is the mean of its windows' probabilities, weighted by their bytes.

Trained in numpy on the driver, on a bounded sample: per language the PER_LANGUAGE labelled documents with the smallest hash of
their id, up to WINDOWS windows each. Everything is predicted in Arrow batches where the texts are.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillflow.llm.common import _LOWER, documents, text_chunks, written

LENGTH = 128                       # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 8                        # of each width
STRIDE = LENGTH - max(WIDTHS) + 1
PER_LANGUAGE = 800
WINDOWS = 4


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x LENGTH bytes, row of each, bytes of text in each) of the rows of a chunk; an empty row has none."""
    sizes = np.diff(offs)
    count = np.where(sizes > 0, -(-np.maximum(sizes - LENGTH, 0) // STRIDE) + 1, 0)
    row = np.repeat(np.arange(len(sizes)), count)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    held = np.minimum(sizes[row] - at, LENGTH)
    padded = np.concatenate((_LOWER[data], np.zeros(LENGTH, np.uint8)))
    x = padded[(offs[row] + at)[:, None] + np.arange(LENGTH)]
    x[np.arange(LENGTH) >= held[:, None]] = 0
    return x, row, held


class ByteNetwork:
    """tables[w][i]: what byte i of a filter of width w adds (256 x FILTERS)."""

    def __init__(self, labels: list[str], seed: int = 20):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest answer of each filter and its place (training)."""
        best, place = [], []
        for w in WIDTHS:
            n = LENGTH - w + 1
            z = sum(self.tables[w][i][x[:, i:i + n]] for i in range(w))
            p = z.argmax(1)
            best.append(np.take_along_axis(z, p[:, None], 1)[:, 0])
            place.append(p)
        return np.concatenate(best, 1), np.concatenate(place, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.02) -> ByteNetwork:
        rng = np.random.default_rng(len(y))
        params = [*self.tables.values(), self.shift, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                rows = order[s:s + batch]
                xb, m = x[rows], len(rows)
                pooled, place = self._pool(xb)
                act = np.maximum(pooled + self.shift, 0)
                z = act @ self.dense + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(m), y[rows]] -= 1
                p /= m
                back = (p @ self.dense.T) * (act > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    g = np.zeros_like(self.tables[w])
                    for i in range(w):
                        np.add.at(g[i], (np.take_along_axis(xb, place[:, own] + i, 1), np.arange(FILTERS)), back[:, own])
                    grads.append(g)
                grads += [back.sum(0), act.T @ p, p.sum(0)]
                step += 1
                for q, g, a, b in zip(params, grads, first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        return self

    def compile(self) -> ByteNetwork:
        """Sums the filters' tables over byte pairs, so that a place costs two look-ups."""
        one = np.arange(65536)
        a, b = one & 255, one >> 8
        t2, t3, t4 = (self.tables[w] for w in WIDTHS)
        self.pair = np.concatenate((t2[0][a] + t2[1][b], t3[0][a] + t3[1][b], t4[0][a] + t4[1][b]), 1)
        self.rest = np.concatenate((t3[2][a], t4[2][a] + t4[3][b]), 1)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for s in range(0, len(x), 512):
            part = x[s:s + 512]
            pairs = part[:, :-1].astype(np.uint16) | (part[:, 1:].astype(np.uint16) << 8)        # place t: bytes t, t + 1
            z = self.pair[pairs]                                                              # rows x 127 x filters
            n3, n4 = LENGTH - 2, LENGTH - 3
            rest = self.rest[np.concatenate((pairs[:, 2:], part[:, -1:].astype(np.uint16)), 1)]   # the last place has one byte left
            z3 = z[:, :n3, FILTERS:2 * FILTERS] + rest[:, :, :FILTERS]
            z4 = z[:, :n4, 2 * FILTERS:] + rest[:, :n4, FILTERS:]
            pooled = np.concatenate((z[:, :, :FILTERS].max(1), z3.max(1), z4.max(1)), 1)
            y = np.maximum(pooled + self.shift, 0) @ self.dense + self.bias
            y = np.exp(y - y.max(1, keepdims=True))
            out[s:s + 512] = y / y.sum(1, keepdims=True)
        return out


def _sample_windows(batches):
    for b in batches:
        langs = b.column("lang").to_pylist()
        for first, end, data, offs in text_chunks(b.column("text")):
            x, row, held = windows(data, offs)
            n = np.bincount(row, minlength=end - first)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            some = np.flatnonzero(nth % np.maximum(1, -(-n // WINDOWS))[row] == 0)             # spread over the text
            yield pa.RecordBatch.from_arrays([pa.array([langs[first + r] for r in row[some]], pa.string()),
                                              pa.array([r.tobytes() for r in x[some]], pa.binary())], ["lang", "bytes"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """A network from (doc_id, text, lang) rows; rows without label or text do not count; None without any.

    The driver gets per_language x WINDOWS windows of LENGTH bytes per language at most.
    """
    docs = labelled.filter("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("_hash"))
    # the cut of each language from its hashes alone: every task keeps per_language of them before the shuffle
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("_hash"))
    cuts = written(docs.select("lang", "_hash", rank.alias("_rank")).filter(F.col("_rank") <= per_language).groupBy("lang").agg(F.max("_hash").alias("_cut")), "cuts")
    few = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts                           # a row per language
    sample = docs.join(few, "lang").filter("_hash <= _cut").dropDuplicates(["lang", "_hash"]).select("lang", "text")
    rows = sample.mapInArrow(_sample_windows, "lang string, bytes binary").toArrow()
    order = sorted(zip(rows.column("lang").to_pylist(), rows.column("bytes").to_pylist()))    # not the order of arrival
    if not order:
        return None
    labels = sorted({r[0] for r in order})
    x = np.frombuffer(b"".join(r[1] for r in order), np.uint8).reshape(-1, LENGTH)
    return ByteNetwork(labels).fit(x, np.array([labels.index(r[0]) for r in order]))


def _predict(net: ByteNetwork | None, columns: list[str]):
    def run(batches):
        if net is not None:
            net.compile()
        for b in batches:
            letters = np.asarray(b.column("_letters").fill_null(False))
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for first, end, data, offs in text_chunks(b.column("text")) if net is not None else ():
                x, row, held = windows(data, offs)
                p = net.probabilities(x) * held[:, None]
                mean = np.stack([np.bincount(row, p[:, k], end - first) for k in range(p.shape[1])], 1).astype(float)
                mean /= np.maximum(mean.sum(1, keepdims=True), 1e-30)
                best[first:end], score[first:end] = mean.argmax(1), mean.max(1)
            known = letters & (best >= 0)
            names = pa.array([net.labels[k] if ok else "und" for k, ok in zip(best, known)] if net is not None else ["und"] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], names, pa.array(np.where(known, np.clip(score, 0, 1), 0.0))],
                                             [*columns, "lang_pred", "score"])
    return run


def identify_language(docs: DataFrame, net: ByteNetwork | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred and score (0 to 1), from the text alone.

    A null text, or one without a letter, is `und` with score 0; so is everything if there is no network. Columns of `docs` with
    the names of the results are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    rows = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])], F.col("text").rlike(r"\p{L}").alias("_letters"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(_predict(net, keep), f"{schema}, lang_pred string, score double")


def held_out(modulus: int, remainder: int):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def understood(docs: DataFrame, net: ByteNetwork | None, least: float = 0.3) -> DataFrame:
    """The documents whose language is recognised with a score of `least` or more, with their columns."""
    return identify_language(docs, net, docs.columns).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)


def op5_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    net = train(docs.filter(~held_out(4, 2)))
    out = identify_language(docs, net, ["doc_id"])
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
