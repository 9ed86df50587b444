"""Ranked lexical search: the best documents of every benchmark item, by dense blocked matrix products.

A term is a maximal run of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased. A document's score for an item
is a sum over the item's terms of w (rarity of the term) times the term's impact in the document, all in whole numbers.

1. The items' terms are dealt to blocks of at most POSTINGS (item, term) pairs. A block's vocabulary is small; only its terms matter.
2. One pass over the whole texts turns each document into its length and the counts of the block's terms, and adds up on the way, per
   part of the table, how many documents there are, their length and how many hold each term: a row for each part, summed by Spark.
3. A second pass over these small rows works on tiles: DOCS documents by the terms of ITEMS items that occur in them, a dense matrix of
   impacts, times a dense matrix of weights. Both hold whole numbers in float64; a tile has so few terms that its sums stay below 2^53,
   so BLAS adds them exactly in any order. Tiles are added up as 64-bit integers.
4. Each tile hands on, per item, all documents that are not below its k-th largest score, ties included, and the part keeps the best k
   by (score, smaller doc_id). Parts are merged by Spark in two steps, at most k rows per item and part.

Nothing but the vocabulary and its counts comes to the driver, a block at a time; more items make more passes, not larger ones.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.common import CHUNK, documents, forget, text_chunks, words, written

BEST = 10
DOCS = 512                         # documents of a tile
ITEMS = 256                        # items of a tile
TERMS = 2048                       # terms of a tile at most; fewer where sums could pass 2^53
POSTINGS = 1 << 19                 # (item, term) pairs of a block
LOTS = 64                          # lots that the parts' rows of an item are merged in first
EXACT = 1 << 53
LAST = np.int64(2**63 - 1)

_GAP = np.ones(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _GAP[_low:_high + 1] = False


def pieces(texts: pa.Array):
    """(first row, bytes, offsets) of about CHUNK bytes each; a longer text comes in several pieces, cut between terms."""
    for first, end, data, offs in text_chunks(texts):
        if end - first > 1 or len(data) <= CHUNK:
            yield first, data, offs
            continue
        start = 0
        while start < len(data):
            stop = min(start + CHUNK, len(data))
            while stop < len(data) and not _GAP[data[stop]]:
                following = np.flatnonzero(_GAP[data[stop:stop + CHUNK]])
                stop = stop + int(following[0]) if len(following) else min(stop + CHUNK, len(data))
            yield first, data[start:stop], np.array([0, stop - start], np.int64)
            start = stop


def _item_terms(batches):
    for b in batches:
        found = [(first + row, h) for first, data, offs in pieces(b.column("text")) for h, row, _, _ in [words(data, offs, gap=_GAP)]]
        if found:
            row, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            both = np.unique(np.rec.fromarrays([row, h], names="row,h"))
            rows = pa.array(both["row"].astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("item").take(rows), b.column("item_id").take(rows), pa.array(both["h"].view(np.int64))], ["item", "item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term) for every distinct term of every item; `item` tells rows of one id and different texts apart."""
    rows = items.select(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    return rows.mapInArrow(_item_terms, "item long, item_id long, term long")


class Block:
    """Some items: their terms, sorted by hash, and for each item the places of its terms."""

    def __init__(self, pairs: pa.Table):
        item, term = (np.asarray(pairs.column(c), np.int64) for c in ("item", "term"))
        self.terms, place = np.unique(term.view(np.uint64), return_inverse=True)
        self.items, first, row = np.unique(item, return_index=True, return_inverse=True)
        self.item_id = pairs.column("item_id").take(pa.array(first))
        order = np.argsort(row, kind="stable")
        self.places = np.split(place[order], np.searchsorted(row[order], np.arange(1, len(self.items))))


def _counts(shared):
    def run(batches):
        terms = shared.value.terms
        holding, total, n_docs = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            length, own = np.zeros(b.num_rows, np.int64), []
            for first, data, offs in pieces(b.column("text")):
                h, row, _, _ = words(data, offs, gap=_GAP)
                length[first:first + len(offs) - 1] += np.bincount(row, minlength=len(offs) - 1)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = terms[at] == h
                pair, times = np.unique((first + row[hit]) * len(terms) + at[hit], return_counts=True)
                own.append((pair, times))
            pair, times = (np.concatenate([o[i] for o in own]) if own else np.zeros(0, np.int64) for i in (0, 1))
            pair, back = np.unique(pair, return_inverse=True)                    # pieces of one text come together
            times = np.bincount(back, weights=times, minlength=len(pair)).astype(np.int64)
            row, place = pair // len(terms), pair % len(terms)
            holding += np.bincount(place, minlength=len(terms))
            total += int(length.sum())
            n_docs += int((length > 0).sum())
            spans = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(spans, pa.array(x, pa.int64())) for x in (place, times)]
            yield pa.RecordBatch.from_arrays([pa.array([False] * b.num_rows), b.column("doc_id"), pa.array(length), *lists], ["is_sum", "doc_id", "n", "terms", "times"])
        there = np.flatnonzero(holding)
        spans = pa.array([0, len(there) + 1], pa.int32())
        lists = [pa.ListArray.from_arrays(spans, pa.array(x, pa.int64())) for x in (np.append(there, -1), np.append(holding[there], n_docs))]
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([total], pa.int64()), *lists], ["is_sum", "doc_id", "n", "terms", "times"])
    return run


def rarity(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """Weight of terms that so many of the documents hold."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Impact of a term that occurs so many times in a document of n terms."""
    if len(n) and int(n.max()) * 90 * n_docs > LAST:
        share = np.array([90 * int(x) * n_docs // total for x in n], np.int64)
    else:
        share = 90 * n * n_docs // max(total, 1)
    return 1_000_000_000 * times // (1000 * times + 8 * (100 - 90 + share))


def products(row: np.ndarray, place: np.ndarray, impact: np.ndarray, n_rows: int, own: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Scores of a tile: documents by items. row, place, impact: the tile's terms; own: places of each item's terms; weight by place."""
    scores = np.zeros((n_rows, len(own)), np.int64)
    wanted = np.intersect1d(np.unique(place), np.concatenate(own)) if own else place[:0]
    if not len(wanted):
        return scores
    step = int(min(TERMS, max(1, (EXACT - 1) // max(1, int(weight[wanted].max()) * int(impact.max())))))
    item = np.repeat(np.arange(len(own)), [len(o) for o in own])
    flat = np.concatenate(own)
    for s in range(0, len(wanted), step):
        tile = wanted[s:s + step]
        left, right = np.zeros((n_rows, len(tile))), np.zeros((len(tile), len(own)))
        at = np.minimum(np.searchsorted(tile, place), len(tile) - 1)
        hit = tile[at] == place
        left[row[hit], at[hit]] = impact[hit]
        at = np.minimum(np.searchsorted(tile, flat), len(tile) - 1)
        hit = tile[at] == flat
        right[at[hit], item[hit]] = weight[flat[hit]]
        scores += (left @ right).astype(np.int64)
    return scores


class Best:
    """The k best documents of each item so far: rows of (item, score, unknown id, id), the best of an item first."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((4, 0), np.int64)

    def take(self, scores: np.ndarray, first_item: int, ids: np.ndarray, unknown: np.ndarray) -> None:
        least = np.maximum(np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k], 1) if len(scores) > self.k else np.ones(scores.shape[1], np.int64)
        held = self.rows[0] - first_item
        mine = (held >= 0) & (held < scores.shape[1])
        full = np.bincount(held[mine], minlength=scores.shape[1]) >= self.k
        lowest = np.full(scores.shape[1], LAST)
        np.minimum.at(lowest, held[mine], self.rows[1][mine])
        least = np.where(full, np.maximum(least, lowest), least)
        doc, item = np.nonzero(scores >= least)                                # ties stay in
        new = np.stack([item + first_item, scores[doc, item], unknown[doc], ids[doc]])
        rows = np.concatenate([self.rows[:, mine], new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        start = np.searchsorted(rows[0], rows[0])
        self.rows = np.concatenate([self.rows[:, ~mine], rows[:, np.arange(rows.shape[1]) - start < self.k]], axis=1)


def _ranked(shared, k: int):
    def run(batches):
        block, weight, n_docs, total = shared.value
        best = Best(k)
        for b in batches:
            length = np.asarray(b.column("n"), np.int64)
            doc = b.column("doc_id")
            unknown, ids = np.asarray(doc.is_null().to_numpy(zero_copy_only=False), np.int64), np.asarray(doc.fill_null(0), np.int64)
            lists = [b.column(c) for c in ("terms", "times")]
            spans = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            place, times = (np.asarray(x.flatten(), np.int64) for x in lists)
            row = np.repeat(np.arange(b.num_rows), np.diff(spans))
            impact = impacts(times, length[row], n_docs, total)
            for s in range(0, b.num_rows, DOCS):
                e = min(s + DOCS, b.num_rows)
                x, y = spans[s], spans[e]
                for i in range(0, len(block.places), ITEMS):
                    scores = products(row[x:y] - s, place[x:y], impact[x:y], e - s, block.places[i:i + ITEMS], weight)
                    best.take(scores, i, ids[s:e], unknown[s:e])
        item, score, unknown, ids = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(block.items[item]), block.item_id.combine_chunks().take(pa.array(item)),
                                          pa.array(np.full(len(item), TaskContext.get().partitionId(), np.int64)),
                                          pa.array(ids, mask=unknown.astype(bool)), pa.array(score)], ["item", "item_id", "part", "doc_id", "score"])
    return run


def _block_ranking(docs: DataFrame, block: Block, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    table = written(docs.select("doc_id", "text").mapInArrow(_counts(context.broadcast(block)), "is_sum boolean, doc_id long, n long, terms array<long>, times array<long>"), "terms")
    sums = table.filter("is_sum")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = dict(map(tuple, sums.select(F.explode(F.arrays_zip("terms", "times")).alias("x")).groupBy("x.terms").agg(F.sum("x.times")).collect()))   # a row per term of the block
    n_docs = held.pop(-1, 0)
    holding = np.zeros(len(block.terms), np.int64)
    holding[list(held.keys())] = list(held.values())
    shared = context.broadcast((block, rarity(n_docs, holding), n_docs, total))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = (table.filter("not is_sum and size(terms) > 0").drop("is_sum").mapInArrow(_ranked(shared, k), "item long, item_id long, part long, doc_id long, score long")
            .withColumn("rank", F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(LOTS))).orderBy(*order))).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k))
    rows = written(rows.select("item_id", "rank", "doc_id", "score"), "ranked")
    forget(table)
    return rows


def ranking(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of `docs` (doc_id, text) for each row of `items` (item_id, text), scores above 0 only.

    Null and empty texts hold no terms; such an item has no rows. Equal scores follow doc_id, a null doc_id after all others; repeated
    document rows are ranked each. Equal item rows count once, rows of one item_id with different texts are ranked each for itself.
    An empty table on either side gives no rows. Other columns do not matter.
    """
    pairs = written(item_terms(items), "item-terms")
    blocks = -(-pairs.count() // POSTINGS)
    out = None
    for i in range(blocks):
        block = Block(pairs.filter(F.pmod("item", F.lit(blocks)) == i).toArrow())
        if len(block.items):
            rows = _block_ranking(docs, block, k)
            out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_lexical(spark, sf_dir):
    return ranking(documents(spark, sf_dir), spark.read.schema("item_id long, text string").parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS g FROM benchmark),
s AS (SELECT count(*) AS nd, sum(len(u))::BIGINT AS l FROM t WHERE len(u) > 0),
tf AS (SELECT doc_id, g, n, count(*) AS tf FROM (SELECT doc_id, len(u) AS n, unnest(u) AS g FROM t) GROUP BY ALL),
w AS (SELECT g, floor(1000 * ln((2 * any_value(s.nd) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY g),
sc AS (SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * tf.n * s.nd) // s.l))))::BIGINT AS score
       FROM q JOIN tf USING (g) JOIN w USING (g), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc WHERE score > 0) WHERE rank <= 10
"""
