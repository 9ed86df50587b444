"""Multiclass boosted trees for a whole grid of settings at once.

Rows hold dense numbers `x`, indices `hot` of zero-one columns that are 1, the class `target` and the flag `is_val`. Numbers become bins
once. A round grows a tree per class on the gradients of the joint softmax loss, for every setting that has not stopped: one pass over
the stored rows per level of the trees gives the sums of gradients by (tree, node, column, bin), tasks add them up and return the best
cut of every node, the driver sees a row per node. One more pass per round gives the loss on the validation rows and the sums at
the next trees' roots. A setting stops after `patience` rounds without a lower validation loss and keeps the trees up to its best round.
The margins of the rows are stored anew every STORE rounds; in between, passes add the trees grown since.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.expressions import N_CLASSES, argmax_code, class_name
from tillflow.operators.linear import LOTS, _added, _blocks, scores_of
from tillflow.sources.session import durable, forget

BINS = 64                        # at most, of a number
STORE = 8
HOT_WIDTH = 1024                 # zero-one columns whose sums travel in one row
LEAST_HESSIAN = 1e-3             # of a leaf
DIGITS = 9                       # of a gain; sums added in another order must not change a tie
CURVATURE = N_CLASSES / (N_CLASSES - 1)
CUT = "tree int, node int, gain double, col int, at int, g double, h double, n double"


def bin_edges(train: DataFrame, n_numeric: int, bins: int = BINS) -> list[np.ndarray]:
    """Largest values of the bins of every number but the last, from Spark's bounded quantile summary; nulls fall into the last bin."""
    if not n_numeric:
        return []
    shares = [i / bins for i in range(1, bins)]
    one = train.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"e{i}") for i in range(n_numeric)]).first()
    edges = [np.unique(np.array(e or [], np.float64)) for e in one]
    return [e[~np.isnan(e)] for e in edges]


@dataclass
class Tree:
    """Nodes in heap order: `col` of the cut (-1: a leaf), the last bin that goes left, and the leaf's value."""

    col: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def leaves(self, x: np.ndarray, keys: np.ndarray, n_hot: int) -> np.ndarray:
        """The node each row ends in. keys: row * n_hot + index of every zero-one column that is 1, sorted."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            col = self.col[node[rows]]
            rows, col = rows[col >= 0], col[col >= 0]
            right, dense = np.zeros(len(rows), bool), col < x.shape[1]
            right[dense] = x[rows[dense], col[dense]] > self.at[node[rows[dense]]]
            if not dense.all():
                wanted = rows[~dense] * n_hot + col[~dense] - x.shape[1]
                place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                right[~dense] = keys[place] == wanted if len(keys) else False
            node[rows] = 2 * node[rows] + 1 + right
        return node


def _binned(x: np.ndarray, edges) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), len(e), np.searchsorted(e, x[:, i]))
    return out


def _with_trees(margins, x, keys, n_hot, rounds) -> None:
    """Adds the trees of `rounds`, each a dict (setting, class) -> Tree, to margins[row, setting, class]."""
    for trees in rounds:
        for (s, k), tree in trees.items():
            margins[:, s, k] += tree.value[tree.leaves(x, keys, n_hot)]


def _stored(rows: DataFrame, edges, base: np.ndarray) -> DataFrame:
    """The binned rows with the margins every setting starts from."""
    def run(batches):
        import pyarrow as pa

        for x, row, hot, y, val in _blocks(batches, ("target", "is_val")):
            b, lists = _binned(x, edges), np.bincount(row, minlength=len(y))
            m = np.broadcast_to(base.astype(np.float32), (len(y), *base.shape))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in b], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(hot.astype(np.int32))),
                                              pa.array(y.astype(np.int32)), pa.array(val.astype(np.int32)), pa.array([v.tobytes() for v in m], pa.binary())],
                                             ["b", "hot", "target", "is_val", "m"])

    rows = rows.select("x", "hot", "target", F.col("is_val").cast("int").alias("is_val"))
    return durable(rows.mapInArrow(run, "b binary, hot array<int>, target int, is_val int, m binary"))


@dataclass
class _State:
    """What tasks need to know: the sizes and the trees grown since the margins were stored."""

    shape: tuple
    n_hot: int
    n_parts: int                  # of the stored table
    since: list = field(default_factory=list)

    def blocks(self, batches):
        """(bins, keys, row and index of hot, target, is_val, margins, batch) of every batch."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(n, -1)
            row = np.repeat(np.arange(n), batch.column("hot").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            hot = np.asarray(batch.column("hot").flatten(), np.int64)
            keys = np.sort(row * self.n_hot + hot)
            margins = np.frombuffer(b"".join(batch.column("m").to_pylist()), np.float32).reshape(n, *self.shape).astype(np.float64)
            _with_trees(margins, x, keys, self.n_hot, self.since)
            yield x, keys, row, hot, np.asarray(batch.column("target"), np.int64), np.asarray(batch.column("is_val"), bool), margins, batch


def _probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _slopes(margins, y, weight):
    """Gradients and curvatures of the rows' losses, by class."""
    p = _probabilities(margins)
    h = CURVATURE * weight[y][:, None] * p * (1 - p)
    p[np.arange(len(y)), y] -= 1
    return weight[y][:, None] * p, h


def _margins_again(stored: DataFrame, state: _State) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for *_, margins, batch in state.blocks(batches):
            m = pa.array([v.tobytes() for v in margins.astype(np.float32)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("m"), "m", m)

    return durable(stored.mapInArrow(run, stored.schema))


def _round_sums(stored: DataFrame, state: _State, active, weights) -> np.ndarray:
    """Per active setting: loss and number of the validation rows, then gradient, curvature and number of the training rows by class."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((len(active), 2 + 3 * N_CLASSES))
        for x, keys, row, hot, y, val, margins, _ in state.blocks(batches):
            for i, s in enumerate(active):
                p = _probabilities(margins[val, s])
                total[i, 0] -= np.log(np.maximum(p[np.arange(len(p)), y[val]], 1e-300)).sum()
                g, h = _slopes(margins[~val, s], y[~val], weights[s])
                total[i, 1] += val.sum()
                total[i, 2:] += np.stack([g.sum(0), h.sum(0), np.full(N_CLASSES, len(g))], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    parts = stored.mapInArrow(run, "part long, sums binary")
    if state.n_parts > LOTS:
        parts = parts.groupBy(F.pmod("part", F.lit(LOTS)).alias("lot")).applyInArrow(_added, "part long, sums binary")
    sums = parts.sort("part").toArrow().column("sums")                                       # LOTS at most
    return sum(np.frombuffer(v.as_py(), np.float64) for v in sums).reshape(len(active), -1)


def _best_cut(sums, total, least_rows, bins: bool):
    """(gain, column, bin, sums of the left side) of the best cut; sums[column, bin, 3], or [column, 1, 3] of the rows where a column is 1."""
    left = np.cumsum(sums, axis=1)[:, :-1] if bins else total - sums
    right = total - left
    ok = (np.minimum(left[..., 2], right[..., 2]) >= least_rows) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN)
    if not ok.any():
        return None
    score = lambda v: v[..., 0] ** 2 / np.maximum(v[..., 1], LEAST_HESSIAN)
    gain = np.where(ok, np.round(score(left) + score(right) - score(total), DIGITS), -np.inf)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)                                    # the first column and bin on ties
    return (float(gain[i, j]), int(i), int(j), *map(float, left[i, j])) if gain[i, j] > 0 else None


def _cuts(stored: DataFrame, state: _State, growing, frontier, weights, least_rows, n_numeric: int) -> dict:
    """Best cut of every open node. frontier: {(setting, class): {node: its sums}}, all nodes on one level."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        dense, sparse, width = {}, {}, min(HOT_WIDTH, state.n_hot)
        for x, keys, row, hot, y, val, margins, _ in state.blocks(batches):
            train, slopes = ~val, {}
            for (s, k), nodes in frontier.items():
                if s not in slopes:
                    slopes[s] = _slopes(margins[:, s], y, weights[s])
                g, h = slopes[s][0][:, k], slopes[s][1][:, k]
                names = np.array(sorted(nodes))
                leaf = growing[s, k].leaves(x, keys, state.n_hot)
                local = np.minimum(np.searchsorted(names, leaf), len(names) - 1)
                inside = train & (names[local] == leaf)
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                if n_numeric:
                    cell = ((local[at, None] * n_numeric + np.arange(n_numeric)) * BINS + x[at]).ravel()
                    size, each = len(names) * n_numeric * BINS, np.repeat(at, n_numeric)
                    add = np.stack([np.bincount(cell, v, size) for v in (g[each], h[each], None)], axis=1)
                    dense[s, k] = dense.get((s, k), 0) + add.reshape(len(names), n_numeric, BINS, 3)
                on = inside[row]
                if on.any():
                    cell, where = np.unique(local[row[on]] * state.n_hot + hot[on], return_inverse=True)
                    add = np.stack([np.bincount(where, v, len(cell)) for v in (g[row[on]], h[row[on]], None)], axis=1)
                    for c, v in zip(cell.tolist(), add):
                        key = s, k, c % state.n_hot // HOT_WIDTH
                        if key not in sparse:
                            sparse[key] = np.zeros((len(names), width, 3))
                        sparse[key][c // state.n_hot, c % state.n_hot % HOT_WIDTH] += v
        lines = [(s * N_CLASSES + k, -1, v.tobytes()) for (s, k), v in dense.items()]
        lines += [(s * N_CLASSES + k, chunk, v.tobytes()) for (s, k, chunk), v in sparse.items()]
        part = TaskContext.get().partitionId()
        for i in range(0, len(lines), 16):
            some = lines[i:i + 16]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                                             + [pa.array([part % LOTS] * len(some), pa.int32())], ["tree", "chunk", "sums", "lot"])

    def added(rows):
        import pyarrow as pa

        total = sum(np.frombuffer(v.as_py(), np.float64) for v in rows.column("sums"))
        return rows.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    def best(rows):
        import pyarrow as pa

        tree, chunk = (rows.column(c)[0].as_py() for c in ("tree", "chunk"))
        s, k = divmod(tree, N_CLASSES)
        names, found = sorted(frontier[s, k]), []
        sums = sum(np.frombuffer(v.as_py(), np.float64) for v in rows.column("sums")).reshape(len(names), -1, BINS if chunk < 0 else 1, 3)
        for node, own in zip(names, sums):
            cut = _best_cut(own, frontier[s, k][node], least_rows[s], chunk < 0)
            if cut:
                found.append((tree, node, cut[0], cut[1] + (0 if chunk < 0 else n_numeric + chunk * HOT_WIDTH), *cut[2:]))
        types = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(types)], [c.split()[0] for c in CUT.split(", ")])

    parts = stored.mapInArrow(run, "tree int, chunk int, sums binary, lot int")
    if state.n_parts > LOTS:
        parts = parts.groupBy("tree", "chunk", "lot").applyInArrow(added, parts.schema)
    cuts = parts.groupBy("tree", "chunk").applyInArrow(best, CUT)
    if state.n_hot > 1:
        cuts = cuts.groupBy("tree", "node").agg(F.max_by(F.struct("col", "at", "g", "h", "n"), F.struct("gain", -F.col("col"))).alias("c")).select("tree", "node", "c.*")
    return {(*divmod(r["tree"], N_CLASSES), r["node"]): r for r in cuts.collect()}                       # a row per open node


@dataclass
class BoostedModel:
    """The trees of a setting up to its best round."""

    settings: dict
    edges: list
    n_hot: int
    base: np.ndarray
    rounds: list
    loss: float                   # mean log loss on the validation rows
    start_loss: float             # the same with the class shares alone
    tried: int                    # rounds until it stopped

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add `p` and `prediction` to rows with x and hot."""
        return _scored(rows, [self]).withColumn("p", F.get("p", F.lit(0))).withColumn("prediction", class_name(argmax_code(F.col("p"))))


def _scored(rows: DataFrame, models) -> DataFrame:
    """Add `p`: class probabilities of every model."""
    edges, n_hot = models[0].edges, models[0].n_hot
    known = [(m.base, [{(0, k): t for k, t in enumerate(trees)} for trees in m.rounds]) for m in models]

    @F.pandas_udf("array<array<double>>")
    def probabilities(x, hot):
        import pandas as pd

        lengths = hot.map(len).to_numpy()
        row, flat = np.repeat(np.arange(len(x)), lengths), (np.concatenate(hot.to_numpy()) if lengths.sum() else np.zeros(0)).astype(np.int64)
        bins, keys, out = _binned(np.stack(x.to_numpy()).astype(np.float64).reshape(len(x), -1), edges), np.sort(row * n_hot + flat), []
        for base, rounds in known:
            margins = np.tile(base.astype(np.float32).astype(np.float64), (len(x), 1, 1))
            _with_trees(margins, bins, keys, n_hot, rounds)
            out.append(_probabilities(margins[:, 0]))
        return pd.Series(list(map(list, np.stack(out, axis=1).tolist())))

    return rows.withColumn("p", probabilities("x", "hot"))


def grid_scores(models, rows: DataFrame, metric: str = "macro_f1") -> list[float]:
    """Every model's score on the same rows, from one pass."""
    return scores_of(_scored(rows, models), metric)


def _grown(stored, state, roots, settings, weights, n_numeric) -> dict:
    """The trees of one round. roots: {(setting, class): sums of gradient, curvature and rows}."""
    trees = {(s, k): Tree.of_depth(settings[s]["depth"]) for s, k in roots}
    frontier = {t: {0: total} for t, total in roots.items()}
    least = {s: settings[s]["min_rows"] for s, _ in roots}

    def settle(s, k, node, total):
        trees[s, k].value[node] = -settings[s]["step"] * total[0] / max(total[1], LEAST_HESSIAN)

    for t, total in roots.items():
        settle(*t, 0, total)
    for level in range(max(settings[s]["depth"] for s, _ in roots)):
        may = {t: {node: v for node, v in nodes.items() if v[2] >= 2 * least[t[0]]} for t, nodes in frontier.items() if settings[t[0]]["depth"] > level}
        frontier = {t: nodes for t, nodes in may.items() if nodes}
        if not frontier:
            break
        following = {}
        for (s, k, node), c in _cuts(stored, state, trees, frontier, weights, least, n_numeric).items():
            left = np.array([c["g"], c["h"], c["n"]])
            trees[s, k].col[node], trees[s, k].at[node] = c["col"], c["at"]
            for child, total in ((2 * node + 1, left), (2 * node + 2, frontier[s, k][node] - left)):
                settle(s, k, child, total)
                following.setdefault((s, k), {})[child] = total
        frontier = following
    return trees


def fit_grid(rows: DataFrame, settings, n_numeric: int, n_hot: int = 0, rounds: int = 2000, patience: int = 50, bins: int = BINS) -> list[BoostedModel]:
    """A model per setting (step, depth, min_rows, weights: "none" or "balanced"), fitted on the rows that are not `is_val`.

    Ties between cuts go to the first column, then the lowest bin. Null numbers count as the largest. Without validation rows every round is kept.
    """
    if bins > BINS:
        raise ValueError(f"a number has at most {BINS} bins")
    train = rows.where("not is_val")
    edges = bin_edges(train, n_numeric, bins)
    by_class = {r["target"]: r["n"] for r in train.groupBy("target").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([by_class.get(k, 0) for k in range(N_CLASSES)], float)
    if not sizes.sum():
        raise ValueError("no rows to fit on")
    kind = {"none": np.ones(N_CLASSES), "balanced": sizes.sum() / (N_CLASSES * np.maximum(sizes, 1))}
    weights = [kind[s["weights"]] for s in settings]
    shares = [np.maximum(w * sizes, 0.5) for w in weights]
    base = np.array([np.log(v / v.sum()) for v in shares])
    stored = _stored(rows, edges, base)
    state = _State(base.shape, max(n_hot, 1), stored.rdd.getNumPartitions())
    kept, losses, active = [[] for _ in settings], [[] for _ in settings], list(range(len(settings)))
    for done in range(rounds + 1):
        roots = {}
        for s, line in zip(active, _round_sums(stored, state, active, weights)):
            losses[s].append(line[0] / line[1] if line[1] else -float(done))
            stuck = done and all(t.col[0] < 0 for t in kept[s][-1])
            if not stuck and len(losses[s]) - 1 - int(np.argmin(losses[s])) < patience:
                roots |= {(s, k): v for k, v in enumerate(line[2:].reshape(N_CLASSES, 3))}
        active = sorted({s for s, _ in roots})
        if not active or done == rounds:
            break
        trees = _grown(stored, state, roots, settings, weights, n_numeric)
        for s in active:
            kept[s].append([trees[s, k] for k in range(N_CLASSES)])
        state = replace(state, since=[*state.since, trees])
        if len(state.since) == STORE:
            before, stored = stored, _margins_again(stored, state)
            state = replace(state, since=[], n_parts=stored.rdd.getNumPartitions())
            forget(before)
    forget(stored)
    return [BoostedModel(dict(s), edges, state.n_hot, b[None, :], trees[:int(np.argmin(seen))], float(min(seen)), float(seen[0]), len(seen) - 1)
            for s, b, trees, seen in zip(settings, base, kept, losses)]
