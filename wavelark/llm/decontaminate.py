"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The document frequency of every benchmark n-gram is counted over the whole
   corpus.
2. An item's seeds are its rare n-grams: those in at most ``rare`` of the
   documents, and in any case the rarer half of them (so that a leaked
   passage with thousands of copies still has its seeds).
3. A document and an item that share at least two seeds close together (one,
   for items of few n-grams) are aligned word by word around the seeds. Every
   local alignment through a seed lies within the window that is aligned, as
   a longer one would score below zero. The score is the alignment's share
   of the score of a perfect copy.

The benchmark is sent to all tasks, ``most`` items at a time; a larger one
takes several passes with the same result. Documents never move.

Defined cases: a null, empty or wordless text matches nothing; so does an
item without words or with a null id; ids may be of any type and keep it; an
item of fewer than n words is one n-gram of its own length; repeated items
and documents are scored one by one (a row for each pair); of equal
alignments of a pair one counts; without documents or items the result is
empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as tx

MATCH, MISS, GAP = 2, -1, -1


class Items:
    """Words and n-grams of benchmark items (``gram`` sorted, with ``item`` and first word ``at`` of each)."""

    def __init__(self, ids: pa.Array, texts: pa.Array, n: int):
        data, offs = tx.flat(texts)
        buf = tx.fold(data)
        s, e, row = tx.words(buf, offs)
        h = tx.hashes(buf, s, e)
        cut = tx.bounds(row, len(ids))
        self.ids, self.words = ids, [h[cut[k] : cut[k + 1]] for k in range(len(ids))]
        self.size = np.diff(cut)
        self.n = n
        g, r, a, w = [], [], [], []
        for k, x in enumerate(self.words):
            m = min(n, len(x))
            if m:
                own, at = tx.grams(x, np.zeros(len(x), np.int64), m)
                g.append(own)
                r.append(np.full(len(own), k))
                a.append(at)
                w.append(np.full(len(own), m))
        self.gram, self.item, self.at, self.width = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((g, np.uint64), (r, np.int64), (a, np.int64), (w, np.int64)))
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at, self.width = self.gram[order], self.item[order], self.at[order], self.width[order]
        self.distinct = np.unique(self.gram)

    def seeds(self, docs_with: np.ndarray, limit: float) -> None:
        """Keep the rare n-grams only, given each distinct n-gram's document frequency."""
        freq = docs_with[np.searchsorted(self.distinct, self.gram)]
        order = np.lexsort((freq, self.item))
        cut = tx.bounds(self.item[order], len(self.ids))
        size = np.diff(cut)
        middle, some = np.zeros(len(self.ids)), size > 0
        ranked = freq[order]
        middle[some] = (ranked[(cut[:-1] + (size - 1) // 2)[some]] + ranked[(cut[:-1] + size // 2)[some]]) / 2
        keep = (freq <= limit) | (freq <= middle[self.item])
        self.gram, self.item, self.at, self.width = self.gram[keep], self.item[keep], self.at[keep], self.width[keep]
        self.distinct = np.unique(self.gram)


def _hits(items: Items, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words at which a benchmark n-gram begins, and the n-gram's index."""
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(items.distinct) == 0:
        return at[0], found[0]
    for n in np.unique(items.width).tolist():
        g, p = tx.grams(h, row, n)
        i = _find(items.distinct, g)
        at.append(p[i >= 0])
        found.append(i[i >= 0])
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return at[order], found[order]


def _find(table: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table, or -1; a bit filter by the top 22 bits spares most searches."""
    key = (g >> np.uint64(42)).astype(np.int64)
    some = np.zeros(1 << 22, bool)
    some[(table >> np.uint64(42)).astype(np.int64)] = True
    out = np.full(len(g), -1)
    maybe = np.flatnonzero(some[key])
    i = np.minimum(np.searchsorted(table, g[maybe]), len(table) - 1)
    ok = table[i] == g[maybe]
    out[maybe[ok]] = i[ok]
    return out


def _frequency(batches, items: Items):
    total = np.zeros(len(items.distinct), np.int64)
    for b in tx.slices(batches, "text"):
        data, offs = tx.flat(b.column("text"))
        buf = tx.fold(data)
        s, e, row = tx.words(buf, offs)
        at, i = _hits(items, tx.hashes(buf, s, e), row)
        u = np.unique(row[at] * len(total) + i)
        total += np.bincount(u % max(len(total), 1), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])


def align(doc: list[np.ndarray], item: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each pair of word sequences; all pairs advance together."""
    order = np.argsort([-len(x) for x in doc], kind="stable")
    m = max(len(x) for x in item)
    y = np.zeros((len(doc), m), np.uint64)
    real = np.zeros((len(doc), m), bool)
    for k, j in enumerate(order):
        y[k, : len(item[j])] = item[j]
        real[k, : len(item[j])] = True
    size = np.array([len(doc[j]) for j in order])
    x = np.zeros((len(doc), int(size[0])), np.uint64)
    for k, j in enumerate(order):
        x[k, : size[k]] = doc[j]
    slope = (np.arange(m) * -GAP).astype(np.int32)
    last = np.zeros((len(doc), m + 1), np.int32)
    best = np.zeros(len(doc), np.int32)
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))
        same = (y[:live] == x[:live, t, None]) & real[:live]
        new = np.maximum(last[:live, :-1] + np.where(same, MATCH, MISS), last[:live, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, 1) - slope
        last = last[:live]
        last[:, 1:] = new
        np.maximum(best[:live], new.max(1), out=best[:live])
    out = np.zeros(len(doc))
    out[order] = best
    return out


def _windows(items: Items, h: np.ndarray, row: np.ndarray, n_rows: int):
    """Candidate (row, item, first word, end word) around seeds that lie close together."""
    at, i = _hits(items, h, row)
    lo, hi = np.searchsorted(items.gram, items.distinct[i]), np.searchsorted(items.gram, items.distinct[i], "right")
    k, _ = tx.spans(lo, hi)
    at = np.repeat(at, hi - lo)
    item, r = items.item[k], row[at]
    reach = (items.size * (1 - MATCH / GAP)).astype(np.int64)
    order = np.lexsort((at, item, r))
    at, item, r, k = at[order], item[order], r[order], k[order]
    if len(at) == 0:
        return
    cut = np.ones(len(at), bool)
    cut[1:] = (item[1:] != item[:-1]) | (r[1:] != r[:-1]) | (at[1:] - at[:-1] > reach[item[1:]])
    group = np.cumsum(cut) - 1
    kinds = np.bincount(np.unique(np.stack([group, items.at[k]]), axis=1)[0])
    first, end = at[cut], np.append(at[np.flatnonzero(cut)[1:] - 1], at[-1])
    item, r = item[cut], r[cut]
    enough = kinds >= np.where(items.size[item] < 2 * items.n, 1, 2)
    begin, stop = tx.bounds(row, n_rows)[:-1], tx.bounds(row, n_rows)[1:]
    for j in np.flatnonzero(enough):
        w = reach[item[j]]
        yield int(r[j]), int(item[j]), max(int(begin[r[j]]), int(first[j] - w)), min(int(stop[r[j]]), int(end[j] + w + items.n))


def _aligned(batches, items: Items, least: float):
    for b in tx.slices(batches, "text"):
        data, offs = tx.flat(b.column("text"))
        buf = tx.fold(data)
        s, e, row = tx.words(buf, offs)
        h = tx.hashes(buf, s, e)
        todo = list(_windows(items, h, row, b.num_rows))
        todo.sort(key=lambda w: w[2] - w[3])
        best: dict[tuple[int, int], float] = {}
        for k in range(0, len(todo), 128):
            part = todo[k : k + 128]
            got = align([h[lo:hi] for _, _, lo, hi in part], [items.words[i] for _, i, _, _ in part])
            for (r, i, _, _), x in zip(part, got):
                x = float(x) / (MATCH * len(items.words[i]))
                if x >= least and x > best.get((r, i), 0):
                    best[r, i] = x
        if best:
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([r for r, _ in keys])), items.ids.take(pa.array([i for _, i in keys])), pa.array([best[k] for k in keys])], names=["doc_id", "item_id", "score"])


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 0.0005, least: float = 0.4, most: int = 50_000) -> DataFrame:
    """Rows (doc_id, item_id, score) for every document that holds a copy of an item with a score of at least ``least``."""
    spark = docs.sparkSession
    store.small_batches(spark)
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    docs = docs.select("doc_id", "text")
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    n_docs, out = docs.count(), None
    passes = max(1, -(-items.count() // most))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        rows = rows.toArrow().combine_chunks()
        part = Items(*(rows.column(c).combine_chunks() for c in ("item_id", "text")), n)
        held = spark.sparkContext.broadcast(part)
        freq = np.zeros(len(part.distinct), np.int64)
        found = docs.select("text").mapInArrow(lambda b, held=held: _frequency(b, held.value), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        freq[found.column("gram").to_numpy()] = found.column("n").to_numpy()
        part.seeds(freq, max(20, rare * n_docs))
        seeded = spark.sparkContext.broadcast(part)
        found = docs.mapInArrow(lambda b, held=seeded: _aligned(b, held.value, least), f"doc_id {kind}, item_id {item_kind}, score double")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 0.0005, least: float = 0.4) -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item."""
    bad = store.save(leaks(docs, benchmark, n, rare, least).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return store.by_ids(docs, bad, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
