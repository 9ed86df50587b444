"""N-gram join, components, mixing and sharding against plain versions."""
import collections
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tillflow.llm import mixing, ngram_join, sharding
from tillflow.llm.components import components

from .conftest import ROWS


def shingles(text, k):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def plain_components(rows, k, percent):
    """Smallest id reachable by links, per row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[find(j)] = find(i)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [(d, len(sets[i]), best.get(find(i), None)) for i, (d, _) in enumerate(rows)]


def near_copies():
    """Chains and groups of edited copies round the threshold, sharing one passage with many others."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([6, 15, 40, 120]))] + (passage if g % 2 else [])
        for _ in range(rnd.choice([1, 2, 6, 15])):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                base[rnd.randrange(len(base))] = word()
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, k, percent):
    rows = near_copies()
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows, k, percent))


def test_order_of_prefixes_bears_on_work_only(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(ngram_join, "ORDER_SHARE", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows, 3, 90))


def passage_groups(groups=6, copies=20):
    """Groups of copies that share most words with the other groups, below the threshold: every pair across them is close."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(200)], []
    for _ in range(groups):
        base = passage + [word() for _ in range(19)]
        for _ in range(copies):
            edited = list(base)
            edited[rnd.randrange(200, 219)] = word()
            rows.append((len(rows), " ".join(edited)))
    return rows


@pytest.mark.parametrize("block, known", [(512, 64), (7, 1)])
def test_groups_that_nearly_link_make_rows_in_proportion_to_their_classes(spark, monkeypatch, block, known):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "KNOWN", known)
    rows, made, links = passage_groups(), [], []
    across, candidates = ngram_join.Verifier.across, ngram_join.block_candidates

    def seen(members, classes, percent):
        made.append((members.count(), members.groupBy("tile").count().toPandas()["count"].tolist(), candidates(members, classes, percent).count()))
        return candidates(members, classes, percent)

    def kept(self, rows):
        links.append(across(self, rows))
        return links[-1]
    monkeypatch.setattr(ngram_join, "block_candidates", seen)
    monkeypatch.setattr(ngram_join.Verifier, "across", kept)
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 86).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows, 3, 86))
    members, tiles, n = made[0]
    assert 0 < n <= sum(t * -(-t // block) for t in tiles)
    if block == 512:
        assert n <= members                                        # not once per pair
    assert links[0].count() <= len(rows) * (1 if block == 512 else 20)


def test_a_pair_counts_in_its_first_common_tile():
    h = np.unique(ngram_join.mix(np.arange(1, 101, dtype=np.uint64)))
    bits = [ngram_join._bitmap(np.delete(h, k)).tobytes() for k in range(4)]
    tiles = [[1, 5, 9], [5, 9], [5, 9, 11], [9]]
    rows = [(t, 0, 0, 0, k, 99, k, bits[k], tiles[k]) for t in (1, 5, 9, 11) for k in range(4) if t in tiles[k]]
    names = ["tile", "i", "j", "block", "node", "n", "root", "bits", "known"]
    got = pa.Table.from_batches(ngram_join._blocks(90)([pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))])).to_pylist()
    assert sorted((r["tile"], r["node"]) for r in got) == [(5, 0), (5, 1), (5, 2), (9, 0), (9, 1), (9, 2), (9, 3)]


def test_links_of_a_block_are_a_forest():
    """All pairs of a group link: as many links come out as join them."""
    h = np.unique(ngram_join.mix(np.arange(1, 101, dtype=np.uint64)))
    sets = [np.delete(h, k) for k in range(30)]
    batch = pa.RecordBatch.from_pydict({"tile": [1] * 30, "i": [0] * 30, "j": [0] * 30, "block": [0] * 30, "node": list(range(30)), "root": [k // 3 for k in range(30)],
                                        "shingles": [s.tobytes() for s in sets]})
    got = pa.Table.from_batches(ngram_join._spanning(90)([batch]))
    assert got.num_rows == 9


def test_join_of_odd_rows(odd, nothing):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(odd).collect()]
    assert sorted(got, key=key) == sorted(plain_components([r[:2] for r in ROWS], 3, 90), key=key)
    assert ngram_join.similarity_components(nothing).count() == 0
    kept = ngram_join.one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "9", "None"]


def test_bitmap_bound_is_an_upper_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(1, 2600)).astype(np.uint64)) for _ in "ab")
        bound = ngram_join.overlap_bound(len(a), ngram_join._bitmap(a), len(b), ngram_join._bitmap(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 24, 100, 1000, 65537])
def test_feistel_is_a_bijection(n):
    p = sharding.permute(np.arange(n), n, 3)
    assert sorted(p) == list(range(n)) and (sharding.unpermute(p, n, 3) == np.arange(n)).all()
    assert n < 100 or (sharding.permute(np.arange(n), n, 4) != p).any()


def test_shards_of_odd_rows(spark, odd, nothing):
    got = sharding.shard_table(odd, 4).collect()
    assert len(got) == len(ROWS) and sharding.shard_table(nothing).count() == 0
    per = collections.defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shard_table(odd.repartition(7), 4).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert sharding.assign_shards(odd, 3).columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]


def test_one_row_in_a_third_of_all_places(spark):
    df = spark.range(3000).selectExpr("if(id < 1000, 1, id) AS doc_id", "if(id < 1000, 'x', concat('t', id)) AS text")
    got = sharding.shard_table(df, 24).collect()
    per = collections.Counter(r["shard"] for r in got)
    assert set(per.values()) == {125} and len({(r["shard"], r["slot"]) for r in got}) == 3000


def test_pivot_keeps_mass_and_odds():
    rng = np.random.default_rng(0)
    size, p = np.array([5.0, 3.0, 8.0, 1.0, 2.0, 2.0]), np.array([0.3, 0.6, 0.5, 0.9, 0.2, 0.5])
    seen = np.zeros(6)
    for _ in range(4000):
        q, held = mixing.pivot(size, p, rng.random(6))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-9
        assert all(v in (0.0, 1.0) for i, v in enumerate(q) if i != held)
        seen += q
    assert np.abs(seen / 4000 - p).max() < 0.04


def test_targets_by_plain_sharing(spark):
    sizes = {"a": 100, "b": 5000, "c": 10, "d": 700, None: 40, "é": 900}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_units long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in names) and abs(sum(got.values()) - total) < 1e-6


def test_mixture_comes_near_its_targets(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "cast(1 + (id * id) % 90 AS long) AS size")
    for leaf, fan in ((4000, 1000), (40, 3)):
        monkeypatch.setattr(mixing, "LEAF", leaf)
        monkeypatch.setattr(mixing, "FAN", fan)
        copies = lambda rows: rows.withColumn("copies", rows["copies"] + rows["n_more"]).toPandas()          # every row is a unit here
        got = copies(mixing.mix_sources(df))
        per = got.groupby("source").apply(lambda g: (g["size"] * g["copies"]).sum() - g["target"].iloc[0], include_groups=False)
        assert len(got) == 3000 and per.abs().max() <= 90 and got["copies"].max() <= 3
        assert ((got["copies"] - got["target"] / got["source_size"]).abs() < 1 + 1e-9).all()
        assert copies(mixing.mix_sources(df.repartition(5))).sort_values("doc_id")["copies"].tolist() == got.sort_values("doc_id")["copies"].tolist()


def test_mixture_of_odd_rows(odd, nothing):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    sized = odd.select("doc_id", "source", mixing.word_count().alias("size"))
    plan = mixing.mix_sources(sized).collect()
    assert sum(r["n_rows"] for r in plan) == len(ROWS)
    assert out.count() == sum(r["n_rows"] * r["copies"] + r["n_more"] for r in plan)
    assert mixing.mixed_documents(nothing).count() == 0


def test_repeated_rows_are_split_and_every_draw_comes_near(spark):
    """A source of ten-word rows, half of them one repeated row, beside a source that takes from it."""
    hot = [(i if i < 1500 else 7777, "a", 10) for i in range(3000)]
    df = spark.createDataFrame(hot + [(10_000 + i, "b", 10) for i in range(3000)], "doc_id long, source string, size long")
    for seed in range(4):
        plan = mixing.mix_sources(df, seed).toPandas()
        taken = (plan["size"] * (plan["n_rows"] * plan["copies"] + plan["n_more"])).groupby(plan["source"]).sum()
        target = plan.groupby("source")["target"].first()
        assert (taken - target).abs().max() <= 10
        one = plan[plan["doc_id"] == 7777].iloc[0]
        assert one["n_rows"] == 1500 and 0 < one["n_more"] < 1500 and abs(one["n_rows"] * one["copies"] + one["n_more"] - 1500 * one["target"] / one["source_size"]) < 1
    docs = df.select("doc_id", spark_repeat("size"), "source").withColumns({"lang": lit(None).cast("string"), "n_chars": lit(0).cast("long"), "copies": lit("x")})
    out = mixing.mixed_documents(docs.repartition(6))
    plan = mixing.mix_sources(docs.select("doc_id", "source", mixing.word_count().alias("size"))).toPandas()
    assert out.columns == docs.columns
    count = out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = (plan["n_rows"] * plan["copies"] + plan["n_more"]).groupby(plan["doc_id"]).sum()
    assert count.to_dict() == want[want > 0].to_dict()


def test_texts_meet_the_plan_once(spark):
    """One shuffle of the texts, whatever Spark takes the plan's size for, and none for rows that are not repeated."""
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 9 + cast(id % 5 AS int)) AS text", "if(id % 2 = 0, 'a', 'b') AS source", "0L AS n_chars")
    out = mixing.mixed_documents(docs)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
    given = mixing.mix_sources(docs.select("doc_id", "source", mixing.word_count().alias("size"))).collect()
    assert out.count() == sum(r["n_rows"] * r["copies"] + r["n_more"] for r in given) > 0


def spark_repeat(size):
    from pyspark.sql import functions as F

    return F.repeat(F.lit("word "), F.col(size).cast("int")).alias("text")


def lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_filter_holds_every_shared_tile():
    rng = np.random.default_rng(3)
    tiles = rng.integers(-2**63, 2**63, 5000, dtype=np.int64)
    bits = 1 << 17
    bitmap = np.zeros(bits // 8, np.uint8)
    for at in ngram_join._places(tiles[:2500], bits):
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    kept = ngram_join._let_through(tiles, bitmap)
    assert set(tiles[:2500]) <= set(kept) and len(kept) < 2800


def test_shared_tiles_are_those_of_several_classes(spark):
    texts = [f"alpha beta gamma delta epsilon w{i // 2} zeta eta theta iota" for i in range(40)] + ["one text like no other at all here"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    send = spark.sparkContext.broadcast
    frequent = send(ngram_join.frequent_shingles(docs, 3))
    bitmap = ngram_join.shared_tiles(docs, 3, 50, frequent)
    seen, bands = {}, ngram_join.Bands(50)
    for h in ngram_join.shingle_sets(pa.array(texts), 3):
        for t in ngram_join._tiles(h, bands, frequent.value):
            seen.setdefault(int(t), set()).add(ngram_join._node(h))
    shared = np.array([t for t, nodes in seen.items() if len(nodes) > 1], np.int64)
    single = np.array([t for t, nodes in seen.items() if len(nodes) == 1], np.int64)
    assert len(shared) and len(single) and len(ngram_join._let_through(shared, bitmap)) == len(shared)
    assert len(ngram_join._let_through(single, bitmap)) < max(2, 0.2 * len(single))
