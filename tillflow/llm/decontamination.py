"""Benchmark decontamination, in DataFrame functions only.

Texts and benchmark items become words (lower case, letters and digits) and hashed shingles of five words. Every item has its own
length in words; the windows looked at in a document have the lengths of items, at every place inside the text; a text shorter than
an item is one window as a whole. A window can only reach the similarity asked for if enough of its shingles occur in items of its
length, so windows with fewer are left out; no other window is. Each window gets a 64-bit SimHash of its shingles. Fingerprints are cut into
four blocks of 16 bits: two that differ in RADIUS bits at most differ in NEAR bits at most of some block. Items list all values within NEAR
bits of each of their blocks, so an equality join on (window length, block, bits of the block) finds every such pair, and about one
unrelated pair in 24; each pair is kept at its first near block only. Candidates are verified by the exact weighted similarity of their
shingles: sum of the smaller by sum of the larger counts.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import documents, written

SHINGLE = 5
RADIUS = 15
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
NEAR = RADIUS // BLOCKS            # bits in which some block of such a pair differs at most
NEIGHBOURS = sum(math.comb(BLOCK_BITS, k) for k in range(NEAR + 1))
LEAST = 0.8
BROADCAST_ROWS = 1_000_000         # a table of a few longs per row is sent to all executors up to here, and joined by shuffle beyond


def word_hashes(text: Column) -> Column:
    spoken = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(spoken, lambda w: F.xxhash64(w))


def shingles_of(words: Column) -> Column:
    """Hashes of SHINGLE words each; none if there are fewer words."""
    last = F.size(words) - (SHINGLE - 1)
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), at)).otherwise(F.array().cast("array<long>"))


def simhash(shingles: str) -> Column:
    """Bit b: whether more shingles have bit b than not (each occurrence counts)."""
    votes = f"aggregate({shingles}, 0, (s, h) -> s + if((shiftright(h, b) & 1L) = 1L, 1, -1))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(if({votes} > 0, 1L, 0L), b))")


def shared(a: str, b: str) -> Column:
    """Shingles that two arrays share, with repetition; only where a shingle repeats are occurrences counted one by one."""
    return F.expr(f"""if(size(array_distinct({a})) = size({a}) or size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})),
        aggregate(array_intersect({a}, {b}), 0, (s, g) -> s + least(size(filter({a}, x -> x = g)), size(filter({b}, x -> x = g)))))""")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def starts(least: float) -> Column:
    """First words of the windows with enough shingles, from p (sorted places of the shingles that occur in items of n_words words) and n.

    With `need` shingles of the window among p, the window whose first such shingle is p[i] starts after p[i - 1], not after p[i], and
    not before p[i + need - 1] would fall out of it.
    """
    own = f"(least(n, n_words) - {SHINGLE - 1})"
    need = f"greatest(1, int(ceil({least} * ({own} + n_words - {SHINGLE - 1}) / (1 + {least}) - 1e-9)))"
    low = f"greatest(0, if(i = 0, 0, p[i - 1] + 1), p[i + {need} - 1] - {own} + 1)"
    high = "least(p[i], greatest(n - n_words, 0))"
    return F.expr(f"""flatten(transform(if(size(p) < {need}, array(), sequence(0, size(p) - {need})),
        i -> if({low} <= {high}, sequence({low}, {high}), array())))""")


def _block(j) -> str:
    return f"(shiftright({{}}, {j} * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L)"


def blocks(df: DataFrame) -> DataFrame:
    """A row per block of the fingerprint."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("bits", F.expr(_block("block").format("fingerprint")))


def neighbours(df: DataFrame) -> DataFrame:
    """A row per block of the fingerprint and value within NEAR bits of it."""
    masks = F.expr(f"filter(sequence(0L, {(1 << BLOCK_BITS) - 1}L), m -> bit_count(m) <= {NEAR})")
    return blocks(df).withColumn("_mask", F.explode(masks)).withColumn("bits", F.col("bits").bitwiseXOR(F.col("_mask"))).drop("_mask")


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(text_key, item_id, similarity, first_word, n_words): the best window of each text for each item it contains.

    Of equally similar windows the earliest is given, then the shortest. n_words is the window's.
    text_key is md5 of the text (null: of the empty text), so equal texts are found together. Items of fewer than SHINGLE words hold
    no shingle and match nothing; null texts likewise; an item without an id matches like others; repeated item rows count once; an empty table on either side gives no rows.
    """
    items = items.select("item_id", word_hashes(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n_words"), shingles_of(F.col("w")).alias("shingles"))
    items = written(items.filter(F.size("shingles") > 0).withColumn("fingerprint", simhash("shingles"))
                    .withColumn("item_key", F.xxhash64("item_id", "shingles")).dropDuplicates(["item_key"]), "items")
    known = written(items.select("n_words", F.explode("shingles").alias("shingle")).distinct(), "known")
    n_known = known.count()

    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.md5(text.cast("binary")).alias("text_key"), word_hashes(F.col("text")).alias("w"))
    found = (texts.select("text_key", F.size("w").alias("n"), F.posexplode(shingles_of(F.col("w"))).alias("at", "shingle"))
             .join(_sized(known, n_known), "shingle")
             .groupBy("text_key", "n", "n_words").agg(F.sort_array(F.collect_set("at")).alias("p")))
    laid = written(found.select("text_key", "n_words", F.explode(starts(least)).alias("first_word")), "windows")
    per_text = laid.groupBy("text_key").agg(F.collect_list(F.struct("first_word", "n_words")).alias("laid"))
    windows = (texts.join(_sized(per_text, laid.count()), "text_key").dropDuplicates(["text_key"])
               .select("text_key", shingles_of(F.col("w")).alias("all"), F.explode("laid").alias("x"))
               .select("text_key", "x.first_word", "x.n_words", F.expr(f"slice(all, x.first_word + 1, x.n_words - {SHINGLE - 1})").alias("shingles"))
               .withColumn("fingerprint", simhash("shingles")))
    windows = written(windows, "fingerprints")

    left = blocks(windows.select("text_key", "first_word", "n_words", "fingerprint"))
    right = neighbours(items.select("item_key", "n_words", F.col("fingerprint").alias("item_print"), F.col("fingerprint")))
    right = right.select("item_key", "n_words", "item_print", "block", "bits")
    # Spark's own size check does not see that rows multiply, so a larger table is never sent whole
    right = F.broadcast(right) if items.count() * BLOCKS * NEIGHBOURS <= BROADCAST_ROWS else right.hint("merge")
    near = (left.withColumnRenamed("fingerprint", "own_print").join(right, ["n_words", "block", "bits"])
            .withColumn("apart", F.expr("own_print ^ item_print"))
            .filter(f"bit_count(apart) <= {RADIUS}")
            .filter(f"block = 0 or forall(sequence(0, block - 1), j -> bit_count({_block('j').format('apart')}) > {NEAR})"))
    both = (near.select("text_key", "first_word", "n_words", "item_key")
            .join(windows.select("text_key", "first_word", "n_words", F.col("shingles").alias("sa")), ["text_key", "first_word", "n_words"])
            .join(items.select("item_key", "item_id", F.col("shingles").alias("sb")), "item_key")
            .withColumn("common", shared("sa", "sb"))
            .withColumn("similarity", F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).filter(F.col("similarity") >= least))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("place"), (-F.size("sa") - F.lit(SHINGLE - 1)).alias("words"))).alias("b")
    return both.groupBy("text_key", "item_id").agg(best).select(
        "text_key", "item_id", "b.similarity", (-F.col("b.place")).alias("first_word"), (-F.col("b.words")).alias("n_words"))


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words for every document that contains an item. Null ids and repeated rows are kept."""
    found = leaks(docs, items, least)
    return docs.select("doc_id", text_key().alias("text_key")).join(found, "text_key").drop("text_key")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that contain no item, with their columns."""
    found = leaks(docs, items, least).select(F.col("text_key").alias("_leak")).distinct()
    return docs.join(found, text_key() == F.col("_leak"), "left_anti")


def benchmark(spark, sf_dir: str) -> DataFrame:
    return spark.read.schema("item_id long, text string").parquet(f"{sf_dir}/benchmark.parquet")


def op7_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


# Every item-sized window (or whole shorter text) that shares a shingle with an item, compared exactly; no fingerprints.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: {'at': i - 1, 'g': array_to_string(w[i:i + 4], ' ')})) AS x FROM dw),
iz AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: {'at': i - 1, 'g': array_to_string(w[i:i + 4], ' ')})) AS x FROM iw),
d AS (SELECT doc_id, n, x.at AS at, x.g AS g FROM ds), i AS (SELECT item_id, n, x.at AS at, x.g AS g FROM iz),
met AS (SELECT DISTINCT d.doc_id, i.item_id, d.at AS place, d.n AS text_words, i.n AS item_words, least(d.n, i.n) AS n FROM d JOIN i ON d.g = i.g),
win AS (SELECT DISTINCT doc_id, item_id, item_words, n, unnest(range(greatest(0, place - n + 5), least(place, greatest(text_words - item_words, 0)) + 1)) AS s FROM met),
b AS (SELECT item_id, g, count(*) AS c FROM i GROUP BY ALL),
a AS (SELECT win.doc_id, win.item_id, item_words, s, win.n, d.g, b.c AS item_c, count(*) AS c FROM win JOIN d ON d.doc_id = win.doc_id AND d.at BETWEEN s AND s + win.n - 5
      JOIN b ON b.item_id = win.item_id AND b.g = d.g GROUP BY ALL),
j AS (SELECT doc_id, item_id, item_words, s, n, sum(least(c, item_c))::BIGINT AS common FROM a GROUP BY ALL),
k AS (SELECT *, common / (n - 4 + item_words - 4 - common)::DOUBLE AS similarity FROM j)
SELECT doc_id, item_id, similarity, s AS first_word, n::INTEGER AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s, n) AS r FROM k WHERE similarity >= 0.8) WHERE r = 1
"""
