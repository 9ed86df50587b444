"""Language-model scoring: a gated recurrent network over words, with a class-factored output.

The corpus gives the words: counts of all training tokens, over all training documents. The most frequent NET words and the end of a
text are the network's own; they are dealt by rank into CLASSES of equal sums of root counts, and the rest, all other words, is one more class, inside which
the corpus counts decide: (c + 0.1) by their sum, with 0.1 for a word never seen. So
    P(word | state) = P(class | state) * P(word | class, state)   or   P(rest | state) * P(word | rest).
The network (one GRU layer) is trained in numpy by truncated backpropagation: streams of documents run in windows, the state goes on
from window to window and is reset at a document's start. It learns from every token of every training document, starting from the
log counts of the whole corpus: in each of ROUNDS rounds every part of the table goes through its whole texts once, from the weights
that all share, and a tree averages what the parts come to, weighted by their tokens; the driver sees one set of weights a round.
Parts are those that the table is read in, so the last digits of scores hang on how its files are cut. Scoring reads whole texts in
the same way, many documents side by side, the state carried across windows, so a text's score does not depend on window borders.

Counts of the most frequent words, DICTIONARY at most, go to the executors (a fixed bound); the other words of a text are looked up by a join.
"""
from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import documents, forget, row_spans, text_chunks, words, written
from tillflow.llm.language import held_out

END = np.uint64(0x5EED0F7E870FE4D5)     # the hash that stands for the end of a text
NET = 4095                              # words of the network, the end among them
CLASSES = 48
DICTIONARY = 1 << 20
HIDDEN = 24
WINDOW = 32                             # tokens of a window
STREAMS = 256                           # documents side by side
LEARNERS = 96                           # documents side by side while learning, at most
ROUNDS = 1                              # times that every training token is learned from
PART_TOKENS = 1 << 18                   # tokens of a part at least, where the table has so many
TAKEN = 1 << 21                         # tokens dealt to streams at a time
FAN_IN = 8                              # sets of weights averaged by one task
EXTRA = 0.1                             # added to each count
BLOCK = 1024                            # rows whose class logits are held at once


def token_table(texts: pa.Array):
    """Per slice of the texts: (first row, end row, token hashes with the ends, where each row's tokens begin)."""
    for first, end, data, offs in text_chunks(texts):
        h, rows, _, _ = words(data, offs)
        spans = row_spans(rows, end - first)
        out = np.empty(len(h) + end - first, np.uint64)
        begin = spans + np.arange(end - first + 1)
        is_end = np.zeros(len(out), bool)
        is_end[begin[1:] - 1] = True
        out[is_end], out[~is_end] = END, h
        yield first, end, out, begin


def _count_batches(batches):
    for b in batches:
        got = [np.unique(t, return_counts=True) for _, _, t, _ in token_table(b.column("text"))]
        if not got:
            continue
        h, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(n, at).astype(np.int64))], ["word", "n"])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word (hash) and the end occur in all texts."""
    return docs.select("text").mapInArrow(_count_batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words, sorted by hash, with counts and the network's numbers (-1: not its own)."""

    def __init__(self, word: np.ndarray, n: np.ndarray, total: int, distinct: int, net: int = NET):
        rank = np.lexsort((word, -n))                                      # most frequent first
        own = [END.view(np.int64)] + [w for w in word[rank[:net]] if w != END.view(np.int64)]
        own = np.array(own[:net], np.int64)
        order = np.argsort(word.view(np.uint64))
        self.word, self.n = word.view(np.uint64)[order], n[order]
        bits = len(word).bit_length() + 1
        self.shift = np.uint64(64 - bits)                                  # hashes are buckets by their first bits: first[b] .. first[b + 1] - 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount((self.word >> self.shift).astype(np.int64), minlength=1 << bits)))).astype(np.int32)
        self.number = np.full(len(word), -1, np.int32)
        at = np.searchsorted(self.word, own.view(np.uint64))
        there = (at < len(self.word)) & (self.word[np.minimum(at, max(len(self.word) - 1, 0))] == own.view(np.uint64)) if len(self.word) else np.zeros(len(own), bool)
        self.size = len(own)
        self.number[at[there]] = np.flatnonzero(there)
        self.counts = np.zeros(self.size)
        self.counts[there] = self.n[at[there]]
        self.total, self.distinct = int(total), int(distinct)
        self.base_norm = self.total + EXTRA * (self.distinct + 1)
        self.rest = self.total - self.counts.sum() + EXTRA * (self.distinct - there.sum() + 1)     # of the counts outside the network

    def look_up(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token in the table, -1 if it is not there."""
        if not len(self.word):
            return np.full(len(tokens), -1)
        bucket = tokens >> self.shift
        at, end = self.first[bucket], self.first[bucket + np.uint64(1)]
        out = np.full(len(tokens), -1)
        open_ = np.flatnonzero(at < end)                                   # few words share a bucket: one or two looks settle most tokens
        while len(open_):
            found = self.word[at[open_]] == tokens[open_]
            out[open_[found]] = at[open_[found]]
            open_ = open_[~found]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def sums_by_word(ids: np.ndarray, rows: np.ndarray, at_once: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The different ids (sorted) and the sums of their rows: the first, second ... row of all ids in turn, what then is left id by id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows.take(order, axis=0)
    at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    n, out = np.diff(at, append=len(ids)), rows.take(at, axis=0)
    for k in range(1, at_once):
        more = np.flatnonzero(n > k)
        out[more] += rows.take(at[more] + k, axis=0)
    for i in np.flatnonzero(n > at_once).tolist():
        out[i] += rows[at[i] + at_once:at[i] + n[i]].sum(0)
    return ids[at], out


class GatedModel:
    """One GRU layer over word numbers 0 .. size-1 and `size` for the rest; number 0, the end, also starts a text."""

    def __init__(self, counts: np.ndarray, rest: float, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 20):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.size, self.hidden = len(counts), hidden
        share = np.cumsum(np.sqrt(np.maximum(counts, EXTRA)))
        edges = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes) if self.size else []
        self.edges = np.unique([0, *edges, self.size])                     # a class's words are edges[k] .. edges[k + 1] - 1
        self.classes = len(self.edges)                                     # the last one is the rest
        self.inputs = rng.normal(0, 0.1, (self.size + 1, 3 * hidden)).astype(f)
        self.recur = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f)
        self.kind_of = (np.searchsorted(self.edges, np.arange(self.size + 1), side="right") - 1).astype(np.int16)
        logs = np.log(np.maximum(counts, EXTRA))
        mass = np.array([np.maximum(counts[a:b], EXTRA).sum() for a, b in zip(self.edges[:-1], self.edges[1:])] + [max(rest, EXTRA)])
        self.kinds, self.words = np.zeros((self.classes, hidden + 1), f), np.zeros((self.size, hidden + 1), f)     # the last column is the bias
        self.kinds[:, hidden], self.words[:, hidden] = np.log(mass / mass.sum()), logs

    NAMES = ("inputs", "recur", "kinds", "words")
    class_out = property(lambda self: self.kinds[:, :-1].T)
    word_out = property(lambda self: self.words[:, :-1])

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return self.kind_of[y]

    def step(self, recur: np.ndarray, x: np.ndarray, h: np.ndarray, g: np.ndarray, gates: np.ndarray, n: np.ndarray, out: np.ndarray):
        """One step of all rows; x: 3 hidden x rows, h: hidden x rows. Fills the recurrent part (of the gates its negative), both gates, the candidate and the next h."""
        d = self.hidden
        np.matmul(recur, h, out=g)
        np.subtract(g[:2 * d], x[:2 * d], out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[d:], g[2 * d:], out=n)
        n += x[2 * d:]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= gates[:d]
        out += n

    def states(self, previous: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None):
        """previous, fresh: rows x steps (the word before; whether a text starts). Returns states rows x steps x hidden, and the last.

        Inside, rows are the last axis, so that every operation runs over whole stretches of memory. What the steps filled is kept in `keep`, if given.
        """
        d, (rows, steps), kind = self.hidden, previous.shape, self.inputs.dtype
        x = self.inputs.take(previous.T, axis=0)
        starts, some = fresh.T, fresh.any(0)
        held = steps if keep is not None else 1
        g, gates, n, out = (np.empty((k, m, rows), kind) for k, m in ((held, 3 * d), (held, 2 * d), (held, d), (steps, d)))
        h, recur = np.ascontiguousarray(h.T, kind), np.concatenate((-self.recur[:, :2 * d].T, self.recur[:, 2 * d:].T))
        if keep is not None:
            keep |= {"g": g, "gates": gates, "n": n, "before": h}
        for t in range(steps):
            if some[t]:
                h = np.where(starts[t], kind.type(0), h)
            k = t % held
            self.step(recur, x[t].T, h, g[k], gates[k], n[k], out[t])
            h = out[t]
        if keep is not None:
            keep["before"] = np.concatenate((keep["before"][None], out[:-1]))
            keep["before"].transpose(0, 2, 1)[starts] = 0
        return out.transpose(2, 0, 1), h.T

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, back: bool = False, shift: bool = False):
        """Natural log of P(y | h) for rows of states; with back also the gradients of the negative sum.

        Logits go to the exponential as they are; should a sum leave the range of numbers, all is done again with shift (less the largest).
        """
        d, f, n, asked = self.hidden, np.result_type(h, self.words), len(y), y
        c = self.class_of(y)
        order = np.argsort(c, kind="stable")                               # rows of one class stand together from here on
        y, c, rows = y[order].astype(np.intp), c[order].astype(np.intp), np.arange(n)
        one = np.ones((n, d + 1), f)                                       # the states, and 1 for the bias
        one[:, :d] = h.take(order, axis=0)
        first = np.append(np.searchsorted(c, np.arange(self.classes)), n)
        at = (y - self.edges[c]) * np.diff(first)[c] + rows - first[c]     # the own word among the logits of its class's rows
        ones, own, sums = np.ones(max(self.size, self.classes), f), np.zeros((2, n), f), np.ones((2, n), f)
        if back:
            up, kinds, words = np.zeros((2, n, d), f), np.zeros((-(-n // BLOCK), *self.kinds.shape), f), np.zeros_like(self.words, f)

        def softmax(k, part, table, at, grads):
            """Logits, one column per row, give their own ones, sums of exponentials and, with back, gradients (those of states times the sum)."""
            x = one[part]
            z = table @ x.T
            if shift:
                z -= z.max(0)
            flat = z.reshape(-1)
            own[k, part] = flat[at]
            np.exp(z, out=z)
            s = np.matmul(ones[:len(table)], z, out=sums[k, part])
            if back:
                flat[at] -= s
                np.matmul(z.T, table[:, :d], out=up[k, part])
                np.matmul(z, x / s[:, None], out=grads)

        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for k, s in enumerate(range(0, n, BLOCK)):
                e = min(s + BLOCK, n)
                softmax(0, slice(s, e), self.kinds, c[s:e] * (e - s) + rows[:e - s], kinds[k] if back else None)
            edges, spans = first.tolist(), self.edges.tolist()
            for k in np.flatnonzero(np.diff(first)[:-1]).tolist():
                part, span = slice(edges[k], edges[k + 1]), slice(spans[k], spans[k + 1])
                softmax(1, part, self.words[span], at[part], words[span] if back else None)
        if not shift and not ((sums > 1e-30) & (sums < 1e30)).all():
            return self.log_probabilities(h, asked, back, True)
        asked_order = np.empty(n, np.intp)
        asked_order[order] = rows
        out = (own - np.log(sums)).sum(0)[asked_order]
        if not back:
            return out
        up /= sums[:, :, None]
        up[0] += up[1]
        return out, up[0].take(asked_order, axis=0), {"kinds": kinds.sum(0), "words": words}

    def window_gradients(self, previous, fresh, target, live, h):
        """Loss, gradients and last state of one window (rows x steps); backpropagation stops at the window's start."""
        keep: dict = {}
        states, last = self.states(previous, fresh, h, keep)
        d, (rows, steps), on = self.hidden, previous.shape, np.flatnonzero(live.T)
        flat = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(-1, d)
        logs, dflat, grads = self.log_probabilities(*((flat, target.T.ravel()) if live.all() else (flat[on], target.T.ravel()[on])), back=True)
        if len(on) < live.size:
            dflat, part = np.zeros_like(flat, dflat.dtype), dflat
            dflat[on] = part
        dh_all = np.ascontiguousarray(dflat.reshape(steps, rows, d).transpose(0, 2, 1))
        before, back = keep["before"], np.concatenate((self.recur[:, 2 * d:], self.recur[:, :2 * d]), axis=1)
        steep = np.empty((steps, 4, d, rows), dflat.dtype)                 # gradients of the candidate's recurrent part, of both gates, of the candidate
        stays, starts, some, carry = np.empty((d, rows), dflat.dtype), fresh.T, fresh.any(0), 0
        for t in reversed(range(steps)):
            dh, n, z, r, (dg, dz, dr, dn) = dh_all[t], keep["n"][t], keep["gates"][t, :d], keep["gates"][t, d:], steep[t]
            dh += carry
            np.subtract(1, z, out=stays)
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= stays
            dn *= dh
            np.multiply(dn, r, out=dg)
            np.subtract(1, r, out=dr)
            dr *= keep["g"][t, 2 * d:]
            dr *= dg
            np.subtract(before[t], n, out=dz)
            dz *= stays
            dh *= z
            dz *= dh
            carry = back @ steep[t, :3].reshape(3 * d, rows)
            carry += dh
            if some[t]:
                carry[:, starts[t]] = 0
        recur = np.matmul(before, steep[:, :3].reshape(steps, 3 * d, rows).transpose(0, 2, 1)).sum(0)
        grads["recur"] = np.concatenate((recur[:, d:], recur[:, :d]), axis=1)
        words = previous.T.ravel().astype(np.uint16 if self.size < 1 << 16 else np.int64)             # short numbers sort faster
        grads["inputs"] = sums_by_word(words, np.ascontiguousarray(steep[:, 1:].reshape(steps, 3 * d, rows).transpose(0, 2, 1)).reshape(-1, 3 * d))
        grads["class_out"] = grads["kinds"][:, :d].T
        spans = [slice(int(a), int(b)) for a, b in zip(self.edges[:-1], self.edges[1:])]
        grads["word_out"] = {k: (span, grads["words"][span, :d]) for k, span in enumerate(spans)}
        return -logs.sum(), grads, last

    def fresh_sums(self) -> dict:
        return {k: np.full_like(getattr(self, k), 1e-4) for k in self.NAMES}

    def pack(self, sums: dict) -> np.ndarray:
        """Weights and Adagrad's sums in one row of numbers."""
        return np.concatenate([x.ravel() for k in self.NAMES for x in (getattr(self, k), sums[k])]).astype(np.float32)

    def unpack(self, state: np.ndarray) -> dict:
        """Takes the weights of `pack` and returns the sums."""
        sums, at = {}, 0
        for k in self.NAMES:
            shape, n = getattr(self, k).shape, getattr(self, k).size
            setattr(self, k, state[at:at + n].reshape(shape).astype(np.float32))
            sums[k] = state[at + n:at + 2 * n].reshape(shape).astype(np.float32)
            at += 2 * n
        return sums

    def fit(self, texts: list[np.ndarray], epochs: int = 2, rows: int = 32, rate: float = 0.08, sums: dict | None = None) -> GatedModel:
        """texts: word numbers with the end. Adagrad on the mean loss per token; `sums` are carried on where given."""
        sums = self.fresh_sums() if sums is None else sums

        def move(s, p, g, n):
            """Weights p and sums s move, in place, by the mean gradient g / n; returns both."""
            g /= n
            s += g * g
            g *= -rate
            g /= np.sqrt(s)
            p += g
            return s, p

        for _ in range(epochs):
            for previous, fresh, target, live, h in windows_of(texts, rows, WINDOW, self):
                _, grads, last = self.window_gradients(previous, fresh, target, live, h["h"])
                h["h"] = last
                n = max(1, int(live.sum()))
                for name in ("recur", "kinds", "words"):
                    for k in range(0, len(grads[name]), BLOCK):            # words without a gradient move by nothing
                        move(*(x[k:k + BLOCK] for x in (sums[name], getattr(self, name), grads[name])), n)
                ids, g = grads["inputs"]
                sums["inputs"][ids], self.inputs[ids] = move(sums["inputs"].take(ids, axis=0), self.inputs.take(ids, axis=0), g, n)
        return self


def windows_of(texts: list[np.ndarray], rows: int, steps: int, model: GatedModel, place: bool = False):
    """Deals texts to streams of nearly equal length and yields their windows: word before, start of a text, word, whether there is one.

    The caller puts the last state into the dict that comes along; rows that have run out fall away. With `place` also the places
    (index into the concatenated texts) of the live tokens, step by step.
    """
    if not texts:
        return
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    heap, lists = [(0, i) for i in range(min(rows, len(texts)))], [[] for _ in range(min(rows, len(texts)))]
    for j in np.argsort(-lengths, kind="stable"):
        n, i = heapq.heappop(heap)
        lists[i].append(j)
        heapq.heappush(heap, (n + int(lengths[j]), i))
    lists.sort(key=lambda js: -int(lengths[js].sum()))
    size = np.array([int(lengths[js].sum()) for js in lists])
    base = np.cumsum(size) - size
    order = np.concatenate([np.asarray(js) for js in lists])                # texts in stream order
    flat = np.concatenate([texts[j] for j in order])
    where = np.concatenate([np.arange(lengths[j]) + begin[j] for j in order]) if place else None
    start = np.zeros(len(flat), bool)
    start[np.cumsum(lengths[order]) - lengths[order]] = True
    before = np.concatenate(([0], flat[:-1]))
    before[start] = 0
    state = {"h": np.zeros((len(lists), model.hidden), np.float32)}
    for s in range(0, int(size[0]), steps):
        active = int(np.searchsorted(-size, -s, side="left"))               # streams longer than s
        state["h"] = state["h"][:active]
        at = base[:active, None] + s + np.arange(steps)
        live = (s + np.arange(steps)) < size[:active, None]
        at = np.where(live, at, 0)
        out = np.where(live, before[at], 0), start[at] & live, flat[at], live, state
        yield (*out, where[at.T[live.T]]) if place else out


def score_texts(model: GatedModel, texts: list[np.ndarray], streams: int = STREAMS, steps: int = WINDOW) -> np.ndarray:
    """log10 probability of every token of the texts, concatenated."""
    out = np.zeros(sum(map(len, texts)))
    for previous, fresh, target, live, h, place in windows_of(texts, streams, steps, model, place=True):
        states, h["h"] = model.states(previous, fresh, h["h"])
        states = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(-1, model.hidden)
        out[place] = model.log_probabilities(states if live.all() else states[live.T.ravel()], target.T[live.T])
    return out / np.log(10)


def _learn(shared):
    """One row per part that has texts: its number, its tokens, and the weights and sums that it comes to."""
    def run(batches):
        v, model, state = shared.value
        model = copy.copy(model)
        sums, texts, held, total = model.unpack(state), [], 0, 0

        def take():
            model.fit(texts, epochs=1, rows=min(max(held >> 14, 32), LEARNERS), sums=sums)

        for b in batches:
            for _, _, t, begin in token_table(b.column("text")):
                at = v.look_up(t)
                y = np.where(at >= 0, v.number[np.maximum(at, 0)] if len(v.number) else -1, -1)
                y = np.where(y < 0, v.size, y).astype(np.int32)
                texts += [y[s:e] for s, e in zip(begin[:-1], begin[1:])]
                held, total = held + len(y), total + len(y)
                if held >= TAKEN:
                    take()
                    texts, held = [], 0
        if texts:
            take()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64()),
                                              pa.array([model.pack(sums).tobytes()], pa.binary())], ["part", "tokens", "state"])
    return run


def _average(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    tokens, total = rows.column("tokens").to_pylist(), 0.0
    for n, state in zip(tokens, rows.column("state")):
        total = total + n * np.frombuffer(state.as_py(), np.float32).astype(np.float64)
    mean = (total / sum(tokens)).astype(np.float32)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py() // FAN_IN], pa.int64()), "tokens": pa.array([sum(tokens)], pa.int64()),
                     "state": pa.array([mean.tobytes()], pa.binary())})


def learned_round(docs: DataFrame, vocabulary: Vocabulary, model: GatedModel, state: np.ndarray) -> tuple[int, np.ndarray]:
    """Tokens learned from, and the state (see GatedModel.pack) after one pass over `docs` (text) from `state`."""
    shared, kinds = docs.sparkSession.sparkContext.broadcast((vocabulary, model, state)), "part long, tokens long, state binary"
    level = written(docs.select("text").mapInArrow(_learn(shared), kinds), "weights")
    parts = level.agg(F.max("part")).first()[0]
    while parts:                                                       # numbers of parts are divided by FAN_IN until only 0 is left
        above = written(level.groupBy(F.expr(f"part div {FAN_IN}").alias("to")).applyInArrow(_average, kinds), "weights")
        forget(level)
        level, parts = above, parts // FAN_IN
    tokens, packed = level.select("tokens", "state").first()
    forget(level)
    return tokens, np.frombuffer(bytes(packed), np.float32)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count, as low as leaves `most` words at most; no sort, only a histogram of 64 levels per doubling.

    A level is in or out as a whole. Its words may be many (those seen once, say); left out, their counts come by the join instead.
    """
    level = F.floor(F.log2(F.col("n")) * 64)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).sort(F.desc("level")).collect()     # 64 x 63 rows at most
    lowest, words = None, 0
    for size in sizes:
        words += size["words"]
        if words > most:
            break
        lowest = size["level"]
    return counts.filter(level >= lowest) if lowest is not None else counts.limit(0)


def train(docs: DataFrame, counts: DataFrame) -> tuple[Vocabulary, GatedModel]:
    """docs: training documents (text); counts: their corpus counts. The driver gets DICTIONARY counts and one set of weights a round."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counts, DICTIONARY).toArrow()
    v = Vocabulary(np.asarray(top.column("word"), np.int64), np.asarray(top.column("n"), np.int64), total, distinct)
    model = GatedModel(v.counts, v.rest)
    state = model.pack(model.fresh_sums())
    for _ in range(ROUNDS if total else 0):
        _, state = learned_round(docs.coalesce(max(1, int(total) // PART_TOKENS)), v, model, state)
    model.unpack(state)
    return v, model


def _score(shared):
    def run(batches):
        v, model = shared.value
        base_log = np.log10((v.n + EXTRA) / v.base_norm) if len(v.n) else np.zeros(1)
        rest_log = np.log10((v.n + EXTRA) / v.rest) if len(v.n) else np.zeros(1)
        for b in batches:
            for s in range(0, b.num_rows, 5000):
                part = b.slice(s, min(5000, b.num_rows - s))
                texts, scalars, tails = [], [], []
                for first, end, t, begin in token_table(part.column("text")):
                    at = v.look_up(t)
                    found = at >= 0
                    own = np.maximum(at, 0)
                    y = np.where(found, v.number[own] if len(v.number) else -1, -1)
                    base = np.where(found, base_log[own], 0.0)
                    rest = np.where(found & (y < 0), rest_log[own], 0.0)
                    y = np.where(y < 0, v.size, y).astype(np.int32)
                    scalars.append(np.stack([np.diff(begin), np.add.reduceat(found, begin[:-1]), np.add.reduceat(base, begin[:-1]), np.add.reduceat(rest, begin[:-1])]))
                    for x, e in zip(begin[:-1], begin[1:]):
                        texts.append(y[x:e])
                        tails.append(np.unique(t[x:e][~found[x:e]], return_counts=True))
                if not texts:
                    continue
                logs = score_texts(model, texts)
                begin = np.cumsum([0, *map(len, texts)])
                n, known, base, rest = np.concatenate(scalars, 1)
                score = np.add.reduceat(logs, begin[:-1]) + rest
                offs = pa.array(np.cumsum([0, *(len(x[0]) for x in tails)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(np.concatenate([x[k] for x in tails]).view(np.int64))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_key"), part.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                                                  pa.array(base), pa.array(score), *lists],
                                                 ["doc_id", "_key", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "tail_n"])
    return run


def score_documents(docs: DataFrame, vocabulary: Vocabulary, model: GatedModel, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of `docs` (doc_id, text, held_out).

    A null text is empty: it has one token, the end. Repeated rows are scored alike. Nothing learned (no training documents): the
    probabilities of a single unknown event.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    rows = docs.select("doc_id", "text", "held_out", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key"))
    rows = written(rows.mapInArrow(_score(shared), "doc_id long, _key long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
                                   "tail array<long>, tail_n array<long>"), "scores")
    # words outside the dictionary: their counts by a join, then back to the documents
    rare = (rows.select("doc_id", "_key", F.explode(F.arrays_zip("tail", "tail_n")).alias("w"))
            .select("doc_id", "_key", F.col("w.tail").alias("word"), F.col("w.tail_n").alias("times")).join(counts, "word", "left"))
    c = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("_key", "doc_id").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum("times").alias("times"),
                                              F.sum(F.col("times") * F.log10(c + F.lit(EXTRA))).alias("logs"))
    scalars = [x for x in rows.columns if x not in ("tail", "tail_n")]
    each = rows.groupBy(*scalars).agg(F.count(F.lit(1)).alias("copies"))
    sums = sums.select(F.col("_key").alias("k"), F.col("doc_id").alias("d"), "more", "times", "logs")
    both = each.join(sums, (F.col("_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    part = lambda x: F.coalesce(F.col(x), F.lit(0)) / F.col("copies")                     # repeated rows: the sum holds each of them
    norm = lambda z: part("logs") - part("times") * float(np.log10(z))
    out = both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.round(part("more"))).cast("long").alias("n_known"),
                      F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + norm(vocabulary.base_norm)).alias("base_score"),
                      (F.col("score") + norm(vocabulary.rest)).alias("score"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def op2_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(10, 0).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    counts = written(corpus_counts(learn), "counts")
    vocabulary, model = train(learn, counts)
    return score_documents(docs, vocabulary, model, counts)
