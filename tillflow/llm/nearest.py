"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

1. Equal vectors are one class, so copies cost one code; the smallest ids of a class stand for it.
2. Codes. Several rotations are learned on a bounded sample (iterative quantisation: turn the vectors so that their signs lose least),
   and the signs of the turned vectors make BITS bits. Vectors get one more component that makes all lengths equal, so that a small
   angle means a large inner product with a query, which gets 0 there.
3. A query's radius is the Hamming distance within which about WANTED codes lie, as the sample's codes tell. Codes are cut into
   substrings of 16 bits and every block of codes indexes each of them. Two codes within radius r of each other must be within t_s in
   some substring s as soon as the sum of all (t_s + 1) exceeds r; so the substrings are probed with such thresholds, and no code within
   the radius is missed. A probe looks up all values within its threshold, or goes through the block's own values where they are fewer.
4. What the probes hit is checked by the whole code, then ranked by the exact inner product in double precision.
5. A query that still has too few neighbours is searched again with a wider radius, up to all bits, that is all rows.

Queries travel to the rows' tasks in groups of GROUP distinct vectors; more queries make more passes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.common import written

BITS = 256
PART = 16                          # bits of a substring
NEAREST = 20
EVERY = 20                         # rows whose id is divisible by this are queries
WANTED = 1000                      # codes within a query's radius
SAMPLE = 1 << 14                   # vectors that the rotations are learned from, about
JUDGES = 1 << 16                   # codes that the radius is read from, about
AT_LEAST = 8                       # of these, to be within the radius
STEPS = 30                         # of learning a rotation
GROUP = 1 << 13                    # distinct query vectors sent to the tasks at a time
BROADCAST_ROWS = 1_000_000

#: All values of a substring by the number of bits set, and how many have at most so many.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)), kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)), minlength=PART + 1))


# ---- codes -------------------------------------------------------------------------------------------------------------
class Coder:
    """Rotations learned from some vectors (rows), and the longest length among all vectors."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, seed: int = 12):
        rng = np.random.default_rng(seed)
        self.longest, self.bits = longest, bits
        x = self.lengthened(sample)
        _, _, axes = np.linalg.svd(x, full_matrices=False) if len(x) <= x.shape[1] else (None, None, np.linalg.eigh(x.T @ x)[1][:, ::-1].T)
        axes = axes[:bits].T                                               # the widest directions
        turned, parts, left = x @ axes, [], bits
        while left > 0:
            rotation = np.linalg.qr(rng.normal(size=(turned.shape[1],) * 2))[0]
            for _ in range(STEPS):
                u, _, v = np.linalg.svd(turned.T @ np.where(turned @ rotation > 0, 1.0, -1.0))
                rotation = u @ v
            parts.append((axes @ rotation)[:, :left])
            left -= parts[-1].shape[1]
        self.turn = np.concatenate(parts, axis=1)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """Vectors of equal length: one more component makes up for what is missing."""
        return np.concatenate([x, np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))[:, None]], axis=1)

    def _signs(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.turn > 0, axis=1).view(np.uint64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self._signs(self.lengthened(x))

    def query_codes(self, x: np.ndarray) -> np.ndarray:
        return self._signs(np.concatenate([x, np.zeros((len(x), 1))], axis=1))


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def thresholds(radius: int, parts: int) -> np.ndarray:
    """How far each substring is probed (-1: not at all): codes within the radius agree so far in one of them, by the pigeonhole rule."""
    base, more = divmod(radius - parts + 1, parts)
    return np.where(np.arange(parts) < more, base + 1, base)


class Index:
    """The substrings of a block of codes, each with the rows of every value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = np.ascontiguousarray(codes.view(np.uint16).T)
        self.order = np.argsort(self.parts, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.parts, self.order, axis=1)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        hit, own = np.zeros(len(self.codes), bool), code.view(np.uint16)
        for s, t in enumerate(thresholds(radius, len(self.parts))):
            if t < 0:
                continue
            t = min(int(t), PART)
            if _WITHIN[t] * 16 < len(hit):                                 # few values: look each of them up
                values = own[s] ^ _MASKS[:_WITHIN[t]]
                low, high = (np.searchsorted(self.sorted[s], values, side=x) for x in ("left", "right"))
                for a, b in zip(low[high > low], high[high > low]):
                    hit[self.order[s, a:b]] = True
            else:
                hit |= np.bitwise_count(self.parts[s] ^ own[s]) <= t
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], code) <= radius]


# ---- search ------------------------------------------------------------------------------------------------------------
def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _search(shared, k: int):
    """The k best classes of each query in this part of the table, ties by the smallest id of a class."""
    def run(batches):
        coder, keys, vectors, codes, radius = shared.value
        score = np.full((len(keys), k), -np.inf)
        least = np.full((len(keys), k), np.inf)
        at = np.full((len(keys), k), -1, np.int64)
        names: list[np.ndarray] = []
        seen = 0
        for b in batches:
            x = _vectors(b.column("vector"))
            smallest = np.asarray(b.column("least").cast(pa.float64()).fill_null(np.inf))
            names.append(np.asarray(b.column("key").to_pylist(), object))
            index = Index(coder.codes(x))
            for q in range(len(keys)):
                rows = index.within(codes[q], int(radius[q]))
                if not len(rows):
                    continue
                value = (x[rows] * vectors[q]).cumsum(axis=1)[:, -1]        # added up from the first component on
                s, m, a = np.concatenate([score[q], value]), np.concatenate([least[q], smallest[rows]]), np.concatenate([at[q], rows + seen])
                best = np.lexsort((m, -s))[:k]
                score[q], least[q], at[q] = s[best], m[best], a[best]
            seen += b.num_rows
        q, place = np.nonzero(at >= 0)
        if len(q):
            flat = np.concatenate(names)
            yield pa.RecordBatch.from_arrays([pa.array(keys[q], pa.string()), pa.array(flat[at[q, place]], pa.string()), pa.array(score[q, place])], ["query", "key", "score"])
    return run


def vector_rows(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, key, vector): rows that take part, equal rows once; key: digest of the vector. All have the commonest number of components."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).filter(
        "size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    top = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    rows = rows.filter(F.size("vector") == (top["n"] if top else 0)).withColumn("key", F.md5(F.col("vector").cast("string").cast("binary")))
    return rows.groupBy("id", "key").agg(F.first("vector").alias("vector"))


def _some(classes: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n classes, by their digests."""
    return classes if n <= most else classes.filter(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") < int(most / n * 2**32))


def _radius(codes: np.ndarray, judges: np.ndarray, n: int, wanted: int) -> np.ndarray:
    """For each query code the distance within which about `wanted` of n codes lie."""
    place = min(len(judges), max(AT_LEAST, -(-wanted * len(judges) // n))) - 1
    return np.array([np.partition(distances(judges, c), place)[place] for c in codes], np.int64)


def nearest(table: DataFrame, k: int = NEAREST, every: int = EVERY, wanted: int = WANTED, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k rows of largest inner product that were found.

    Rows take no part if their vector is null, empty, zero, or holds a null or an endless or undefined number, or has another number of
    components than most have. A query's own id is no answer to it. Equal rows count once; rows of one id with different vectors are
    rows of their own, also as queries. Equal scores follow the id, a row without an id comes after them; it is never a query. With k
    rows or fewer all are found. Empty tables give no rows; other columns do not matter. While there are no more than `wanted` distinct
    vectors the search is exact.
    """
    spark = table.sparkSession
    rows = written(vector_rows(table, id_column, vector_column), "vectors")
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("id"))
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    members = written(first, "members")
    classes = members.filter("place = 1").select("key", F.col("id").alias("least"), "vector")
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()
    asking = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("key").alias("query"))
    shape = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], shape)
    coder = Coder(_vectors(_some(classes, n, SAMPLE).select("vector").toArrow().column("vector")), longest)
    judges = coder.codes(_vectors(_some(classes, n, JUDGES).select("vector").toArrow().column("vector")))
    queries = written(classes.join(asking.select(F.col("query").alias("key")).distinct(), "key", "left_semi").select("key", "vector"), "queries")
    groups = -(-queries.count() // GROUP)
    found = None
    for i in range(groups):
        group = queries.filter(F.pmod(F.xxhash64("key"), F.lit(groups)) == i).toArrow()
        keys, vectors = np.asarray(group.column("key").to_pylist(), object), _vectors(group.column("vector"))
        if not len(keys):
            continue
        codes = coder.query_codes(vectors)
        radius = _radius(codes, judges, n, wanted)
        while len(keys):
            shared = spark.sparkContext.broadcast((coder, keys, vectors, codes, radius))
            hits = classes.mapInArrow(_search(shared, k + 1), "query string, key string, score double")
            hits = written(hits.join(members.select("key", "id", "place"), "key").withColumn(
                "rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= k + 1), "hits")
            short = {r[0] for r in hits.groupBy("query").count().filter(F.col("count") > k).select("query").collect()}
            again = np.array([key not in short and r < coder.bits for key, r in zip(keys, radius)], bool)
            done = hits if not again.any() else hits.join(spark.createDataFrame([(key,) for key in keys[again]], "query string"), "query", "left_anti")
            found = done if found is None else found.unionByName(done)
            keys, vectors, codes, radius = keys[again], vectors[again], codes[again], np.minimum(2 * radius[again] + PART, coder.bits)
    if found is None:
        return spark.createDataFrame([], shape)
    found = found.select("query", "id", "score")
    found = F.broadcast(found) if queries.count() * (k + 1) <= BROADCAST_ROWS else found
    out = asking.join(found, "query").filter(~F.col("id").eqNullSafe(F.col("query_id"))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"))))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_nearest(spark, sf_dir):
    return nearest(spark.read.schema("vec_id long, embedding array<float>").parquet(f"{sf_dir}/embeddings.parquet"))


# The exact search; the query equals it while there are no more than WANTED distinct vectors.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20
"""
