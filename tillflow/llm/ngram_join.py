"""N-gram Jaccard join: documents whose sets of word shingles are alike, as components of the link graph.

1. Each document becomes a set of hashed shingles. Documents with equal sets are one class, so copies cost one row.
2. Tiles. Linked sets have at least the threshold's share of the larger one in common, so under any common order of the shingles their
   prefixes (the first n - ceil(t n) + 1 shingles) meet. A tile is (size band, prefix shingle): a class goes to the tiles of its own
   band, and to those of the band below if a set of that band can be large enough to link with it. No link is lost. The order puts
   frequent shingles last, so that a passage that many documents share makes no tile unless it is nearly all of a document; how
   frequent a shingle is, is estimated, and bears on the work only, not on the result. Most tiles hold one class only and are of no use:
   a first pass over the texts finds the tiles with several classes and keeps them as a filter of a bounded size, so that a second pass
   makes rows for these only. What the filter lets through by mistake costs work, not results.
3. In each tile the hub (the class that shares most tiles) is compared with the members: bitmaps of hashed shingles first, whose bits
   set on one side only bound the overlap from above, then exact intersection of the sorted arrays. Links are contracted to components.
4. Tiles that still hold several components are cut into blocks of BLOCK classes; every pair of blocks is one small task that runs over
   the bitmaps and lets through only classes that could link with one of another component, each pair in the first tile it shares.
   These meet once more by blocks, with their shingles: a pair is intersected exactly unless it is joined by then, and what comes out is
   as many links as join the components, which are contracted again. No pairs of a group are listed: copies in thousands cost one
   comparison each, and groups that nearly link cost rows in proportion to their classes.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import documents, forget, mix, row_spans, text_chunks, words, written
from tillflow.llm.components import components

BITS = 1024                        # of a signature at least; larger sets have about a bit for each shingle
BROADCAST_ROWS = 1_000_000         # hashes sent to all executors at most; more are joined by shuffle
WIDE = 1.5                         # largest by smallest size of a band
BLOCK = 512                        # classes of a tile that meet in one comparison of blocks
BLOCK_SHINGLES = 1 << 20           # shingles of a block's classes, about (a class may have more)
KNOWN = 64                         # tiles of a class that tell where a pair meets first
ORDER_SHARE = 16                   # one text in so many tells which shingles are frequent
FREQUENT = 1 << 20                 # shingles whose frequency the order knows, at most
FILTER_BITS = 16                   # bits of the filter for each tile with several classes
MOST_BITS = 1 << 29                # bits of the filter at most (64 MB)
PAGE = 1 << 15                     # bits of one row of a bitmap aggregate

_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text, in order: k words each; a text of fewer words is one shingle; no words, none."""
    for first, end, data, offs in text_chunks(texts):
        h, rows, _, _ = words(data, offs)
        spans = row_spans(rows, end - first)
        grams = np.zeros(len(h), np.uint64)
        for i in range(k):
            grams[:len(h) - i] += h[i:] * _ODD[i]
        grams = mix(grams)
        for s, e in zip(spans[:-1], spans[1:]):
            if e - s >= k:
                yield np.unique(grams[s:e - k + 1])
            elif e > s:
                yield mix(np.array([(h[s:e] * _ODD[:e - s]).sum(dtype=np.uint64) + np.uint64(e - s)], np.uint64))
            else:
                yield grams[:0]


class Bands:
    """Size bands; links need `percent` of the union in common."""

    def __init__(self, percent: int, wide: float = WIDE):
        self.percent, self.wide, self.low = percent, max(wide, 100 / percent), [1]

    def top(self, n: int) -> int:
        """Largest size that can link with size n."""
        return n * 100 // self.percent

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(int(self.low[-1] * self.wide) + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def largest(self, band: int) -> int:
        while len(self.low) <= band + 1:
            self.low.append(int(self.low[-1] * self.wide) + 1)
        return self.low[band + 1] - 1

    def schemes(self, n: int) -> list[int]:
        """The bands in whose tiles a set of n shingles can meet partners other than itself."""
        own = self.of(n)
        below = [own - 1] if own and self.top(self.largest(own - 1)) >= n else []
        return [own, *below]

    def prefix(self, n: int) -> int:
        """How many shingles of a set of n must be looked at: linked sets meet in them."""
        return n + self.percent * n // -100 + 1


def _node(h: np.ndarray) -> int:
    """The class of a set: a 64-bit digest of size and shingles."""
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return int(mix(x.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)) * np.uint64(3)).astype(np.int64)[0])


def _tiles(h: np.ndarray, bands: Bands, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tiles of a set; frequent: sorted shingles and their counts."""
    if not len(h):
        return np.zeros(0, np.int64)
    shingle, count = frequent
    first = h
    if len(shingle):
        at = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
        first = h[np.argsort(np.where(shingle[at] == h, count[at], 0), kind="stable")]       # ties by hash, as h is sorted
    first = first[:bands.prefix(len(h))]
    return np.concatenate([mix(first ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for b in bands.schemes(len(h))]).view(np.int64)


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Bit h mod width for each shingle; the width is a power of two, the first one not below the size of the set."""
    width = max(BITS, 1 << max(len(h) - 1, 0).bit_length())
    bits = np.zeros(width, bool)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap that a narrower signature of `size` bytes would have had."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def _some_shingles(k: int):
    def run(batches):
        for b in batches:
            sets = [h for h in shingle_sets(b.column("text"), k)]
            if sets:
                each, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])
    return run


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent shingles of a part of the texts, sorted, with counts. They only shape the order of the prefixes."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0)
    counts = written(some.mapInArrow(_some_shingles(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1"), "counts")
    # the least count that no more than FREQUENT shingles reach, from how often each count occurs
    least, held = 1, 0
    for count, times in sorted(map(tuple, counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1))).collect()), reverse=True):
        held += times
        if held > FREQUENT:
            least = count + 1
            break
    top = counts.filter(F.col("n") >= least).toArrow()
    forget(counts)
    shingle = np.asarray(top.column("shingle"), np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], np.asarray(top.column("n"), np.int64)[order]


def _tile_rows(k: int, percent: int, frequent):
    """Tiles and classes of the texts, each pair once a batch."""
    def run(batches):
        bands = Bands(percent)
        for b in batches:
            seen, tiles, nodes = set(), [], []
            for h in shingle_sets(b.column("text"), k):
                node = _node(h) if len(h) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    tiles.append(_tiles(h, bands, frequent.value))
                    nodes.append(np.full(len(tiles[-1]), node, np.int64))
            if tiles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(nodes))], ["tile", "node"])
    return run


def _places(tile: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a tile among `bits` (a power of two)."""
    x = tile.view(np.uint64)
    return tuple(((x >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64) for shift in (0, 33))


def shared_tiles(docs: DataFrame, k: int, percent: int, frequent) -> np.ndarray:
    """A filter that holds every tile of several classes: bytes of a bitmap with two places per tile."""
    rows = docs.select("text").mapInArrow(_tile_rows(k, percent, frequent), "tile long, node long")
    shared = written(rows.groupBy("tile").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("tile"), "shared")
    bits = min(max(1 << (shared.count() * FILTER_BITS).bit_length(), PAGE), MOST_BITS)
    place = F.explode(F.array(*[F.expr(f"(shiftrightunsigned(tile, {shift}) & {bits - 1}L) + 1") for shift in (0, 33)]))
    pages = shared.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in pages:                                                        # MOST_BITS / PAGE rows at most
        start = (r["page"] - 1) * PAGE // 8
        out[start:start + PAGE // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    forget(shared)
    return out


def _let_through(tiles: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    keep = np.ones(len(tiles), bool)
    for at in _places(tiles, len(bitmap) * 8):
        keep &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return tiles[keep]


def _sketches(k: int, percent: int, frequent, shared):
    def run(batches):
        bands = Bands(percent)
        for b in batches:
            node, n, keys, bits = [], [], [], []
            for h in shingle_sets(b.column("text"), k):
                n.append(len(h))
                node.append(_node(h) if len(h) else None)
                bits.append(_bitmap(h).tobytes())
                keys.append(_let_through(_tiles(h, bands, frequent.value), shared.value))
            offs = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            tiles = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), tiles],
                                             ["doc_id", "text_hash", "n_shingles", "node", "bits", "tiles"])
    return run


def _shingles(k: int):
    def run(batches):
        for b in batches:
            rows = [(_node(h), h.tobytes()) for h in shingle_sets(b.column("text"), k) if len(h)]
            for i in range(0, len(rows), 500):
                part = list(zip(*rows[i:i + 500]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary())], ["node", "shingles"])
    return run


def overlap_bound(n_a: int, bits_a: np.ndarray, n_b: int, bits_b: np.ndarray) -> int:
    """No more shingles than this are common: each bit set on one side only stands for a shingle that the other side lacks."""
    size = min(len(bits_a), len(bits_b))
    a, b = _fold(bits_a, size), _fold(bits_b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _bounded(percent: int):
    """Pairs whose bitmaps leave room for a link."""
    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(f"n_{x}").to_pylist() for x in "ab")
            bits_a, bits_b = (batch.column(f"bits_{x}") for x in "ab")
            view = lambda column, i: np.frombuffer(column[i].as_buffer(), np.uint8)
            keep = [i for i in range(batch.num_rows)
                    if (100 + percent) * overlap_bound(n_a[i], view(bits_a, i), n_b[i], view(bits_b, i)) >= percent * (n_a[i] + n_b[i])]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in "ab"], ["a", "b"])
    return run


def _groups(batches, names: tuple):
    """Key and rows of each comparison of blocks. Rows come sorted by tile and blocks, the first three names."""
    rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in names]))
    for key, group in itertools.groupby(rows, key=lambda r: r[:3]):
        yield key, list(group)


def _stacked(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps folded to the narrowest, a row each, in 64-bit words."""
    size = min(map(len, bitmaps))
    return np.stack([_fold(b, size) for b in bitmaps]).view(np.uint64)


def _could_link(x: int, among: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Places `among` the rows whose sizes and bitmaps leave room for a link with row x."""
    y = np.flatnonzero(among & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
    if not len(y):
        return y
    bound = np.minimum(n[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(1, dtype=np.int64), n[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(1, dtype=np.int64))
    return y[(100 + percent) * bound >= percent * (n[x] + n[y])]


def _met_here(tile: int, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether this tile is the first common one of a class and each of the others (rows of sorted tiles); also if none is known."""
    hit = np.isin(others, own)
    return ~hit.any(1) | (others[np.arange(len(others)), hit.argmax(1)] == tile)


def _blocks(percent: int):
    """Classes of two blocks of a tile that could link with a class of another component, as far as bitmaps tell."""
    names = ("tile", "i", "j", "block", "node", "n", "root", "bits", "known")

    def run(batches):
        for (tile, i, j), group in _groups(batches, names):
            bits = _stacked([np.frombuffer(r[7], np.uint8) for r in group])
            block, n, root = (np.array([r[c] for r in group], np.int64) for c in (3, 5, 6))
            widest = max(len(r[8]) for r in group)
            known = np.array([r[8] + r[8][-1:] * (widest - len(r[8])) for r in group], np.int64)
            place, near = np.arange(len(group)), np.zeros(len(group), bool)
            for x in np.flatnonzero(block == i):
                y = _could_link(x, (root != root[x]) & ((place > x) if i == j else (block == j)), n, bits, percent)
                y = y[_met_here(tile, known[x], known[y])] if len(y) else y
                near[x] |= len(y) > 0
                near[y] = True
            if near.any():
                rows = list(zip(*[group[at][:7] for at in np.flatnonzero(near)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if name in ("i", "j", "block") else pa.int64()) for name, c in zip(names, rows)], list(names[:7]))
    return run


def block_candidates(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(tile, node, n, root) -> (tile, i, j, block, node, n, root): the classes that could link across components, by comparisons of blocks.

    A pair of classes counts in its first common tile only, as far as the KNOWN first tiles of both tell; rows never outnumber the
    members of the blocks. Blocks are the smaller the longer the texts, so that the shingles of two blocks fit into a task.
    """
    sizes = members.groupBy("tile").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    cut = members.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("tile", "node", "n", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    known = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("tile")), 1, KNOWN).alias("known"))
    full = cut.join(classes.select("node", "bits").join(known, "node"), "node").select("tile", "i", "j", "block", "node", "n", "root", "bits", "known")
    return full.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(
        _blocks(percent), "tile long, i int, j int, block int, node long, n long, root long")


def _spanning(percent: int):
    """Links between components of two blocks, by exact intersection; no more than it takes to join what is linked."""
    def run(batches):
        for (_, i, j), group in _groups(batches, ("tile", "i", "j", "block", "node", "root", "shingles")):
            block, node, root = (np.array([r[c] for r in group], np.int64) for c in (3, 4, 5))
            sets = [np.frombuffer(r[6], np.uint64) for r in group]
            n, bits, place, links = np.array([len(h) for h in sets]), _stacked([_bitmap(h) for h in sets]), np.arange(len(group)), []
            for x in np.flatnonzero(block == i):
                for y in _could_link(x, (root != root[x]) & ((place > x) if i == j else (block == j)), n, bits, percent):
                    if root[x] != root[y] and _links(sets[x], sets[y], percent):
                        root[root == root[y]] = root[x]
                        links.append(sorted((node[x], node[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
    return run


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _linked(percent: int):
    """Pairs that link, by exact intersection of their sorted shingles."""
    def run(batches):
        for batch in batches:
            keep = []
            a, b = batch.column("shingles_a"), batch.column("shingles_b")
            for i in range(batch.num_rows):
                if _links(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b)), percent):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in "ab"], ["a", "b"])
    return run


def _beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) with the columns of both classes."""
    of = lambda x: table.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", *[f"{c}_{x}" for x in "ab" for c in columns])


class Verifier:
    """Finds which pairs of classes link. Sorted shingles are made from the texts for those classes only that come past the bitmaps."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent, self.made, self.tables = docs, classes, k, percent, None, []

    def forget(self) -> None:
        """Deletes the shingles."""
        for table in self.tables:
            forget(table)

    def _need(self, nodes: DataFrame) -> None:
        wanted = self.classes.join(nodes if self.made is None else nodes.join(self.made, "node", "left_anti"), "node", "left_semi").select("text_hash")
        wanted = written(wanted.distinct(), "wanted")
        n = wanted.count()
        if n:
            few = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
            new = written(self.docs.join(few, "text_hash", "left_semi").select("text").mapInArrow(_shingles(self.k), "node long, shingles binary")
                          .groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
            self.tables.append(new)
            self.made = new if self.made is None else self.made.unionByName(new)
        forget(wanted)

    def links(self, pairs: DataFrame) -> DataFrame:
        return self.exact(_beside(pairs, self.classes, ["n", "bits"]).mapInArrow(_bounded(self.percent), "a long, b long"))

    def across(self, candidates: DataFrame) -> DataFrame:
        """Links that join components, from `block_candidates`."""
        candidates = written(candidates, "candidates")
        self._need(candidates.select("node").distinct())
        if self.made is None:
            return candidates.select(F.col("node").alias("a"), F.col("node").alias("b"))                # there are none
        full = candidates.join(self.made, "node").select("tile", "i", "j", "block", "node", "root", "shingles")
        links = written(full.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(_spanning(self.percent), "a long, b long"), "links")
        forget(candidates)
        return links

    def exact(self, near: DataFrame) -> DataFrame:
        near = written(near, "near")
        self._need(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        if self.made is None:
            return near
        links = written(_beside(near, self.made, ["shingles"]).mapInArrow(_linked(self.percent), "a long, b long"), "links")
        forget(near)
        return links


def tile_members(classes: DataFrame) -> DataFrame:
    """(node, n, tiles) -> (tile, node, n, degree) of tiles with several classes; of tiles with the same members, one stays.

    degree: in how many of these tiles a class is. The text that others were made from shares more of its tiles than they do.
    """
    flat = classes.select("node", "n", F.explode("tiles").alias("tile"))
    shared = (flat.groupBy("tile").agg(F.count(F.lit(1)).alias("k"), F.bit_xor("node").alias("who"), F.min("node").alias("low")).filter("k > 1")
              .groupBy("k", "who", "low").agg(F.min("tile").alias("tile")))
    members = written(flat.join(shared.select("tile"), "tile"), "members")
    degree = members.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    tiles = written(members.join(degree, "node"), "tiles")
    forget(members)
    return tiles


def similarity_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id per row of `docs` (doc_id, text; other columns are ignored).

    A null or empty text, or one without words, has no shingles, no class, and is its own component. Repeated rows are kept and fall
    into one component. A null doc_id counts as larger than all others and gets the smallest doc_id of its component, null if alone.
    class_id: 64-bit digest of the set. Columns named bits, tile or node in `docs` do not matter.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    send = docs.sparkSession.sparkContext.broadcast
    frequent = send(frequent_shingles(docs, k))
    shared = send(shared_tiles(docs, k, percent, frequent))
    whole = written(docs.mapInArrow(_sketches(k, percent, frequent, shared), "doc_id long, text_hash long, n_shingles long, node long, bits binary, tiles array<long>"), "sketches")
    sketches = written(whole.select("doc_id", "n_shingles", "node"), "documents")
    classes = written(whole.filter("node is not null").groupBy("node").agg(
        F.first("text_hash").alias("text_hash"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("tiles").alias("tiles")), "classes")
    forget(whole)
    members = tile_members(classes)
    verifier = Verifier(docs, classes.drop("tiles"), k, percent)
    hubs = members.groupBy("tile").agg(F.max(F.struct("degree", "node")).alias("h")).select("tile", F.col("h.node").alias("hub"))
    star = members.join(hubs, "tile").filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = verifier.links(star)
    joined = written(components(links), "components")
    placed = (members.join(hubs, "tile").filter("node <> hub").join(joined, "node", "left")                # the hubs' pairs are settled
              .select("tile", "node", "n", F.coalesce("root", "node").alias("root")))
    mixed = placed.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("tile")
    still = written(placed.join(mixed, "tile"), "open")
    forget(members)
    more = verifier.across(block_candidates(still, classes, percent))
    forget(still)
    if not more.isEmpty():
        joined = written(components(links.unionByName(more)), "components")
    verifier.forget()
    forget(classes)

    roots = sketches.select("doc_id", "n_shingles", "node").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return roots.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.col("node").alias("class_id"))


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, with its columns; of repeated rows one stays.

    Rows without a doc_id cannot be told apart by it: they stay.
    """
    found = similarity_components(docs, k, percent)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def op1_ngram_join(spark, sf_dir):
    return similarity_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
flat AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY ALL
"""
