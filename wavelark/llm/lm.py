"""Gated recurrent language model, scored over complete documents.

A word-level GRU predicts the next word (and the document's end) through an
output softmax factored into classes: first the word's class, then the word
within it. Everything is numpy.

* The vocabulary, the frequency classes and the output biases come from word
  counts over all documents.
* Training is data-parallel truncated back-propagation: in each of ``rounds``
  every task starts from the current model and trains on its own documents of
  that round, picked by a hash of the whole text (equal texts are in the same
  round); by default each document is in one round, so all of them train.
  The models are then averaged, weighted by words, block by block in a
  shuffle.
* A word outside the vocabulary is predicted as "unknown", then spelled: its
  bytes and its end have a probability given the two bytes before, by counts
  over all such words of all documents, interpolated with shorter contexts
  down to the uniform one. So every word has a cost of its own, and a text of
  unseen words isn't a cheap one.
* Scoring carries the recurrent state from window to window to a document's
  end, so a log-likelihood belongs to the complete text. In a batch all
  documents advance together, longest first, so work follows the words.

Defined cases: a null, empty or wordless text has no words, log-likelihood 0
and null ``bits_per_word``; repeated rows are trained on and scored one by
one; equal counts in the vocabulary are ordered by hash; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as tx

END, UNKNOWN = 0, 1
RESULT = "doc_id {} , n_words long, log_likelihood double, bits_per_word double"
BLOCK = 16384
RANGE = 1 << 18
_F = np.float32


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted hashes of known words
    ids: np.ndarray  # and their ids
    bound: np.ndarray  # first id of every class, and the number of ids
    cls: np.ndarray  # class of every id
    count: np.ndarray  # occurrences of every id

    def encode(self, h: np.ndarray) -> np.ndarray:
        if len(self.hashes) == 0:
            return np.full(len(h), UNKNOWN, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], UNKNOWN).astype(np.int32)


#: Symbols of the bytes of folded words: 0 is a word's start or end.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[*range(48, 58), *range(97, 123), *range(128, 256)]] = np.arange(1, 165)
SYMBOLS = 165


def _spelled(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (two before, symbol) codes of each span's bytes and end, and where each span's begin."""
    lens = e - s
    first = np.cumsum(lens + 1) - lens - 1
    sym = np.zeros(int((lens + 1).sum()) + 2, np.int64)  # two starts ahead of all
    pos, at = tx.spans(s, e)
    inside = np.arange(len(pos)) - np.repeat(at - first, lens) + 2
    sym[inside] = _SYMBOL[buf[pos]]
    one, two = sym[1:-1].copy(), sym[:-2].copy()
    begin = first[first < len(one)]
    one[begin] = 0
    two[begin] = 0
    second = begin[lens > 0] + 1
    two[second] = 0
    return (two * SYMBOLS + one) * SYMBOLS + sym[2:], first


def spelling(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probability of every code, given how often codes occurred: contexts of two, one and no symbols, each as much as it was seen."""
    n = np.bincount(codes, counts, SYMBOLS**3).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for c in (n.sum((0, 1)), n.sum(0), n):
        kinds = (c > 0).sum(-1, keepdims=True) + 1.0
        p = (c + kinds * p) / (c.sum(-1, keepdims=True) + kinds)
    return np.log(p).astype(_F).reshape(-1)


def _counts(batches):
    for b in tx.gather(batches, "text"):
        held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        n = 0
        for part in tx.slices(iter([b]), "text"):
            data, offs = tx.flat(part.column("text"))
            buf = tx.fold(data)
            s, e, row = tx.words(buf, offs)
            u, c = np.unique(tx.hashes(buf, s, e), return_counts=True)
            held[0].append(u)
            held[1].append(c)
            n += len(np.unique(row))
        u, inv = np.unique(np.concatenate(held[0]), return_inverse=True)
        c = np.bincount(inv, np.concatenate(held[1]), len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(u, np.uint64(0)).view(np.int64)), pa.array(np.append(c, n))], names=["word", "n"])


def vocabulary(docs: DataFrame, size: int = 4096, classes: int = 32) -> Vocabulary:
    """The ``size`` most frequent words of all documents, in classes of equal mass of the root of the frequency.

    The row of hash 0 counts documents, that is ends.
    """
    store.small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = store.save(counts, "words")
    total = counts.agg(F.sum(F.when(F.col("word") != 0, F.col("n"))), F.max(F.when(F.col("word") == 0, F.col("n")))).first()
    top = counts.where("word <> 0").orderBy(F.desc("n"), "word").limit(max(0, size - 2)).toPandas()
    store.drop(counts)
    known = top["n"].to_numpy(np.int64)
    freq = np.concatenate([[total[1] or 0, (total[0] or 0) - known.sum()], known]).astype(np.float64)
    root = np.cumsum(np.sqrt(freq + 1))
    cls = np.minimum((root / root[-1] * classes).astype(np.int64), classes - 1)
    cls = np.unique(cls, return_inverse=True)[1]
    bound = np.append(np.flatnonzero(np.diff(cls, prepend=-1)), len(cls))
    h = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], (order + 2).astype(np.int32), bound, cls, freq)


def start(v: Vocabulary, width: int, seed: int = 7) -> dict[str, np.ndarray]:
    """A model whose predictions are the class-factored word frequencies."""
    rng, n, c = np.random.default_rng(seed), len(v.cls), len(v.bound) - 1

    def draw(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[-1] if len(shape) < 2 else shape[0])).astype(_F)

    freq = v.count + 1
    mass = np.add.reduceat(freq, v.bound[:-1])
    return {
        "E": draw(n, width), "W": draw(width, 3 * width), "U": draw(width, 3 * width), "b": np.zeros(3 * width, _F),
        "C": np.zeros((width, c), _F), "c": np.log(mass / mass.sum()).astype(_F),
        "O": np.zeros((n, width), _F), "o": np.log(freq / mass[v.cls]).astype(_F),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.exp(np.minimum(np.negative(x), 80))
    x += 1
    return np.reciprocal(x, out=x)


def _cell(px: np.ndarray, h: np.ndarray, U: np.ndarray):
    k = h.shape[1]
    u = h @ U
    rz = _sigmoid(px[:, : 2 * k] + u[:, : 2 * k])
    r, z = rz[:, :k], rz[:, k:]
    n = 2 * _sigmoid(2 * (px[:, 2 * k :] + r * u[:, 2 * k :])) - 1  # tanh
    return n + z * (h - n), r, z, n, u[:, 2 * k :]


def _tame(m: dict) -> bool:
    """Whether no state (each within 1) can make a logit that overflows."""
    return all(float((np.abs(m[w]).sum(axis) + np.abs(m[b])).max(initial=0)) < 80 for w, b, axis in (("C", "c", 0), ("O", "o", 1)))


def _softmax(m: dict, v: Vocabulary, hs: np.ndarray, y: np.ndarray, grad: dict | None = None, tame: bool = False):
    """Log-probability of each target; with ``grad``, its gradients too, returning that for the states. ``tame``: logits can't overflow."""
    rows = np.arange(len(y))
    cls = v.cls[y]
    logit = hs @ m["C"] + m["c"]
    if not tame:
        logit -= logit.max(1, keepdims=True)
    e = np.exp(logit)
    total = e @ np.ones(e.shape[1], _F)
    out = logit[rows, cls] - np.log(total)
    dh = None
    if grad is not None:
        e /= total[:, None]
        e[rows, cls] -= 1
        grad["C"] = hs.T @ e
        grad["c"] = e.sum(0)
        dh = e @ m["C"].T
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(len(v.bound)))
    hs, y = hs[order], y[order]
    pick, total = np.zeros(len(y), hs.dtype), np.ones(len(y), hs.dtype)
    back = np.zeros_like(hs) if grad is not None else None
    for k in range(len(v.bound) - 1):
        a, b = cut[k], cut[k + 1]
        lo, hi = v.bound[k], v.bound[k + 1]
        if a == b or hi - lo == 1:
            continue
        h, w = hs[a:b], m["O"][lo:hi]
        e = h @ w.T
        e += m["o"][lo:hi]
        if not tame:
            e -= e.max(1, keepdims=True)
        i, t = rows[: b - a], y[a:b] - lo
        pick[a:b] = e[i, t]
        np.exp(e, out=e)
        sums = total[a:b] = e @ np.ones(hi - lo, e.dtype)
        if grad is not None:
            e /= sums[:, None]
            e[i, t] -= 1
            grad["O"][lo:hi] = e.T @ h
            grad["o"][lo:hi] = e.sum(0)
            back[a:b] = e @ w
    out[order] += pick - np.log(total)
    if grad is not None:
        dh[order] += back
    return out, dh


def _groups(ids: np.ndarray, offs: np.ndarray, lanes: int):
    """Documents with words, longest first, ``lanes`` at a time: rows, first places and lengths with the end."""
    n = np.diff(offs)
    rows = np.argsort(-n, kind="stable")
    rows = rows[: int((n > 0).sum())]
    for k in range(0, len(rows), lanes):
        r = rows[k : k + lanes]
        yield r, offs[r], n[r] + 1


def _window(ids: np.ndarray, first: np.ndarray, size: np.ndarray, t: int, window: int):
    """Inputs and targets of the lanes alive at step t: arrays of time by lane, and which of them count."""
    live = int(np.searchsorted(-size, -t, "left"))
    w = min(window, int(size[0]) - t) if live else 0
    at = t + np.arange(w)[:, None]
    ok = at < size[None, :live]
    y = np.where(at < size[:live] - 1, ids[np.minimum(first[:live] + at, len(ids) - 1)], END)
    before = ids[np.clip(first[:live] + at - 1, 0, len(ids) - 1)]
    return live, np.where(at > 0, before, END), y, ok


def score(m: dict, v: Vocabulary, ids: np.ndarray, offs: np.ndarray, window: int = 64, lanes: int = 768) -> np.ndarray:
    """Log-likelihood of every whole document; ``m`` may hold the projected embeddings as ``P``."""
    proj = m["P"] if "P" in m else m["E"] @ m["W"] + m["b"]
    out = np.zeros(len(offs) - 1)
    k, tame = m["U"].shape[0], _tame(m)
    for rows, first, size in _groups(ids, offs, lanes):
        h = np.zeros((len(rows), k), _F)
        for t in range(0, int(size[0]), window):
            live, x, y, ok = _window(ids, first, size, t, window)
            h = h[:live]
            hs = np.empty((*x.shape, k), _F)
            for j in range(len(x)):
                h = _cell(proj[x[j]], h, m["U"])[0]
                hs[j] = h
            lane = np.broadcast_to(np.arange(live), ok.shape)[ok]
            lp = _softmax(m, v, hs[ok], y[ok], None, tame)[0]
            out[rows[:live]] += np.bincount(lane, lp.astype(np.float64), live)
    return out


def gradients(m: dict, v: Vocabulary, h: np.ndarray, x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of minus the log-likelihood of a window (time by lane), the ids whose rows of ``E`` they have, and the state after it."""
    k, n, kind = h.shape[1], len(x), h.dtype
    keep = (x != END).astype(kind)[:, :, None]  # a document starts from no state
    used, inv = np.unique(x, return_inverse=True)
    inv = inv.reshape(-1)
    px = (m["E"][used] @ m["W"] + m["b"])[inv].reshape(*x.shape, 3 * k)
    hs, prev, gate = np.empty((n + 1, len(h), k), kind), np.empty((n, len(h), k), kind), np.empty((n, len(h), 2 * k), kind)
    cand, un = np.empty((n, len(h), k), kind), np.empty((n, len(h), k), kind)
    hs[0] = h
    for j in range(n):
        np.multiply(hs[j], keep[j], out=prev[j])
        u = prev[j] @ m["U"]
        gate[j] = _sigmoid(px[j, :, : 2 * k] + u[:, : 2 * k])
        un[j] = u[:, 2 * k :]
        np.tanh(px[j, :, 2 * k :] + gate[j, :, :k] * un[j], out=cand[j])
        hs[j + 1] = cand[j] + gate[j, :, k:] * (prev[j] - cand[j])
    grad = {"O": np.zeros_like(m["O"]), "o": np.zeros_like(m["o"])}
    whole = bool(ok.all())
    _, dh = _softmax(m, v, hs[1:].reshape(-1, k) if whole else hs[1:][ok], y.reshape(-1) if whole else y[ok], grad, _tame(m))
    if whole:
        flat = dh.reshape(n, len(h), k)
    else:
        flat = np.zeros((n, len(h), k), kind)
        flat[ok] = dh
    r, z = gate[:, :, :k], gate[:, :, k:]
    to_c, to_z, to_r = (1 - z) * (1 - cand * cand), (prev - cand) * z * (1 - z), un * r * (1 - r)
    dpx, du, back = np.empty((n, len(h), 3 * k), kind), np.empty((n, len(h), 3 * k), kind), np.zeros((len(h), k), kind)
    turned = np.ascontiguousarray(m["U"].T)
    for j in range(n - 1, -1, -1):
        d = flat[j] + back
        dc = d * to_c[j]
        p, q = dpx[j], du[j]
        p[:, 2 * k :] = dc
        np.multiply(d, to_z[j], out=p[:, k : 2 * k])
        np.multiply(dc, to_r[j], out=p[:, :k])
        q[:, : 2 * k] = p[:, : 2 * k]
        np.multiply(dc, r[j], out=q[:, 2 * k :])
        d *= z[j]
        back = q @ turned
        back += d
        back *= keep[j]
    order = np.argsort(inv, kind="stable")
    dp = np.add.reduceat(dpx.reshape(-1, 3 * k)[order], np.searchsorted(inv[order], np.arange(len(used))), axis=0)
    grad |= {"U": prev.reshape(-1, k).T @ du.reshape(-1, 3 * k), "W": m["E"][used].T @ dp, "b": dp.sum(0), "E": dp @ m["W"].T}
    return grad, used, hs[n]


def _streams(ids: np.ndarray, offs: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents, each followed by END, one after another in up to ``lanes`` streams of about one length: targets, and each stream's start and size, longest first."""
    n = np.diff(offs)
    load = [(0, k) for k in range(min(lanes, int((n > 0).sum())))]
    held: list[list[int]] = [[] for _ in load]
    for row in np.argsort(-n, kind="stable")[: int((n > 0).sum())].tolist():
        words, k = load[0]
        held[k].append(row)
        heapq.heapreplace(load, (words + int(n[row]) + 1, k))
    held = [held[k] for _, k in sorted(load, key=lambda x: (-x[0], x[1]))]
    rows = np.array([r for own in held for r in own], np.int64)
    size = np.array([sum(int(n[r]) + 1 for r in own) for own in held], np.int64)
    at = np.cumsum(n[rows] + 1)
    seq = np.full(int(at[-1]) if len(rows) else 0, END, ids.dtype)
    begin = at - n[rows] - 1
    pos, first = tx.spans(offs[rows], offs[rows + 1])
    seq[np.arange(len(pos)) + np.repeat(begin - first, n[rows])] = ids[pos]
    return seq, np.cumsum(size) - size, size


def train(m: dict, memory: dict, v: Vocabulary, ids: np.ndarray, offs: np.ndarray, rate: float = 0.2, window: int = 16, lanes: int = 192) -> int:
    """One pass of truncated back-propagation over the documents, in place (Adagrad); returns the words seen."""
    seq, first, size = _streams(ids, offs, lanes)
    h = np.zeros((len(size), m["U"].shape[0]), _F)
    for t in range(0, int(size.max(initial=0)), window):
        live = int(np.searchsorted(-size, -t, "left"))
        at = t + np.arange(min(window, int(size[0]) - t))[:, None]
        ok = at < size[None, :live]
        at = np.minimum(first[:live] + at, len(seq) - 1)
        x = np.where(at > first[:live], seq[at - 1], END)
        grad, used, h = gradients(m, v, h[:live], x, seq[at], ok)
        for name, g in grad.items():
            to = used if name == "E" else slice(None)
            g *= _F(1 / lanes)  # not by the lanes alive: the last of a long document aren't worth as much as all
            if name in "WUb":
                np.clip(g, -1, 1, out=g)
            memory[name][to] += g * g
            m[name][to] -= rate * g / np.sqrt(memory[name][to])
    return len(seq)


def _ids(batch, v: Vocabulary, unknown=None) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of a batch's texts, and their offsets by row.

    ``unknown`` is called with (folded bytes, starts, ends, rows) of the words outside the vocabulary.
    """
    ids, per = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for part in tx.slices(iter([batch]), "text"):
        data, offs = tx.flat(part.column("text"))
        buf = tx.fold(data)
        s, e, row = tx.words(buf, offs)
        now = v.encode(tx.hashes(buf, s, e))
        if unknown is not None:
            some = np.flatnonzero(now == UNKNOWN)
            unknown(buf, s[some], e[some], row[some] + sum(map(len, per)))
        ids.append(now)
        per.append(np.bincount(row, minlength=len(offs) - 1))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(per))]).astype(np.int64)


def _pack(m: dict) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(_F)
        at += like[k].size
    return out


def of_round(text: Column, k: int, rounds: int) -> Column:
    """Whether a text trains in round k of ``rounds``, by a hash of all of it."""
    return F.pmod(F.xxhash64(text), F.lit(rounds)) == k


def fit(docs: DataFrame, width: int = 16, size: int = 4096, classes: int = 32, rounds: int = 2, rate: float = 0.2) -> tuple[dict, Vocabulary]:
    """A model of the documents: every document trains in one of ``rounds`` rounds, after each of which the tasks' models are averaged.

    Its entry ``S`` has the log-probabilities of ``spelling``.
    """
    v = vocabulary(docs, size, classes)
    m = start(v, width)
    sc = docs.sparkSession.sparkContext
    codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(rounds):
        held = sc.broadcast((m, v))

        def work(batches, held=held):
            model, voc = held.value
            model, seen = {n: a.copy() for n, a in model.items()}, 0
            memory = {n: np.full_like(a, 0.01) for n, a in model.items()}
            spelled = np.zeros(SYMBOLS**3, np.int64)

            def unknown(buf, s, e, row):
                if len(s):
                    np.add.at(spelled, _spelled(buf, s, e)[0], 1)

            for b in tx.gather(batches, "text"):
                ids, offs = _ids(b, voc, unknown)
                seen += train(model, memory, voc, ids, offs, rate)
            kinds = ["part", "block", "seen", "data", "code", "n"]
            if seen:
                flat = _pack(model)
                n = -(-len(flat) // BLOCK)
                blocks = [(flat[j * BLOCK : (j + 1) * BLOCK]).tobytes() for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([seen] * n, pa.int64()), pa.array(blocks, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=kinds)
            # spelling counts by range of codes, so that each range is added up in one place
            for j, lo in enumerate(range(0, SYMBOLS**3, RANGE)):
                some = np.flatnonzero(spelled[lo : lo + RANGE])
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([j], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([spelled[lo + some].tobytes()], pa.binary())], names=kinds)

        def mean(batches):
            total: dict[int, list] = {}
            counts: dict[int, np.ndarray] = {}
            for b in batches:
                for part, j, w, raw, code, n in zip(*(b.column(i).to_pylist() for i in range(6))):
                    if part:
                        np.add.at(counts.setdefault(j, np.zeros(RANGE, np.int64)), np.frombuffer(code, np.int32), np.frombuffer(n, np.int64))
                    else:
                        a = np.frombuffer(raw, _F).astype(np.float64) * w
                        t = total.setdefault(j, [0, np.zeros(len(a))])
                        t[0] += w
                        t[1] += a
            for part, rows in ((0, [(j, (a / w).astype(_F)) for j, (w, a) in sorted(total.items())]), (1, sorted(counts.items()))):
                for j, a in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([j], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["part", "block", "data"])

        trained = docs.select("text").where(of_round(F.col("text"), k, rounds)).mapInArrow(work, "part int, block int, seen long, data binary, code binary, n binary")
        got = trained.repartition("part", "block").mapInArrow(mean, "part int, block int, data binary").toArrow().sort_by([("part", "ascending"), ("block", "ascending")]).to_pylist()
        blocks = [np.frombuffer(r["data"], _F) for r in got if r["part"] == 0]
        if blocks:
            m = _unpack(np.concatenate(blocks), m)
        for r in got:
            if r["part"]:
                n = np.frombuffer(r["data"], np.int64)
                some = np.flatnonzero(n)
                codes[0].append(some + r["block"] * RANGE)
                codes[1].append(n[some])
        held.unpersist()
    return m | {"S": spelling(np.concatenate(codes[0]), np.concatenate(codes[1]))}, v


def log_likelihood(docs: DataFrame, m: dict, v: Vocabulary) -> DataFrame:
    """Rows (doc_id, n_words, log_likelihood in nats, bits_per_word) for every document; the end counts as a word predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(({"P": m["E"] @ m["W"] + m["b"], **{k: m[k] for k in "UCcOoS" if k in m}}, v))

    def work(batches):
        model, voc = held.value
        table = model.get("S")
        for b in tx.gather(batches, "text"):
            spelled = np.zeros(b.num_rows)

            def unknown(buf, s, e, row, spelled=spelled):
                if len(s):
                    codes, first = _spelled(buf, s, e)
                    cost = np.add.reduceat(table[codes].astype(np.float64), first)
                    np.add(spelled, np.bincount(row, cost, len(spelled)), out=spelled)

            ids, offs = _ids(b, voc, unknown=unknown if table is not None else None)
            lp, n = score(model, voc, ids, offs) + spelled, np.diff(offs)
            bits = np.where(n > 0, -lp / np.log(2) / (n + 1), np.nan)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(lp), pa.array(bits, from_pandas=True)], names=["doc_id", "n_words", "log_likelihood", "bits_per_word"])

    return docs.select("doc_id", "text").mapInArrow(work, RESULT.format(kind))
