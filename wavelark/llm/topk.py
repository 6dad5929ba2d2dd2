"""Exact k nearest neighbours with a pivot-distance index.

Pivots part the vectors into cells; a vector is keyed by its nearest pivot
and its distance from it. Cells of neighbouring pivots are grouped to blocks
of about ``block_rows`` vectors, each sorted by cell and distance; a larger
cell is cut into annuli, and many vectors at one distance by a hash. Queries
are rows of the same table (all, or those that a condition picks):

1. a query's own block gives k candidates, the k-th of which bounds the
   search;
2. by the triangle inequality a vector x of cell c can only be as near as
   |d(q, c) - d(x, c)|, so of each cell only the annulus of distances within
   the bound is looked at, and cells are skipped whose annulus is empty or
   that lie beyond the bisecting plane between the pivots. Within a block
   cells go from the nearest pivot outward and the bound shrinks as they are
   searched;
3. which blocks a query may need follows from the range of distances of each
   cell in each block, which all tasks get (28 bytes each, so some 4 MB for
   1e9 vectors). Only pairs of a block's queries and a block that one of them
   may need are made, and only for these do vectors move.

No distance is approximated: candidates are found in float32 with a margin
above its rounding error and settled by float64 sums of squared differences.

Defined cases: a null vector, or one with a null, NaN or infinite component
or of another length than most, is neither query nor neighbour, nor is a row
with a null id; ids may be of any type that sorts and keep it; rows of one id
count once (the one that sorts first); a vector isn't its own neighbour but
its copies under other ids are, at distance 0; equal distances order by id;
with fewer than k others all of them are given; an empty table, or no query,
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

PIVOTS = 4096
ANNULI = 256


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(len(col), dim)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances in float64 of rows of x from rows of p."""
    x, p = x.astype(np.float64), p.astype(np.float64)
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(d, 0))


def _fixed(raw: np.ndarray) -> pa.Array:
    """A binary value of each row of a matrix."""
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * width, max(width, 1), dtype=np.int32)[: len(raw) + 1]), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _assign(batches, pivots: np.ndarray):
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            x = _matrix(part.column("embedding"), pivots.shape[1])
            d = _distances(x, pivots)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("asks"), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1)), _fixed(x)], names=["vec_id", "asks", "cell", "dist", "data"])


class _Layout:
    """Which block a (cell, distance) belongs to: cells in an order of neighbourhood, large ones cut at distances."""

    def __init__(self, pivots: np.ndarray, cells: list, block_rows: int):
        total = sum(c["n"] for c in cells)
        lead = _distances(pivots, pivots[: max(1, min(64, total // block_rows))]).argmin(1)
        self.cell, self.low, self.block, at, filled = [], [], [], -1, block_rows
        for c in sorted(cells, key=lambda c: (lead[c["cell"]], c["cell"])):
            parts = min(-(-c["n"] // block_rows), ANNULI)
            if parts > 1 or filled + c["n"] > block_rows:
                at, filled = at + 1, 0
            cuts = [-np.inf, *sorted({c["q"][k * ANNULI // parts] for k in range(1, parts)})]
            for k, low in enumerate(cuts):
                self.cell.append(c["cell"])
                self.low.append(low)
                self.block.append(at + k)
            at, filled = at + len(cuts) - 1, block_rows if len(cuts) > 1 or parts > 1 else filled + c["n"]
        order = np.lexsort((self.low, self.cell))
        self.cell, self.low, self.block = (np.array(a)[order] for a in (self.cell, self.low, self.block))
        self.n, self.first = at + 1, np.searchsorted(self.cell, np.arange(len(pivots) + 1))

    def of(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        at = self.first[cell].copy()
        for k in range(1, int(np.diff(self.first).max(initial=1))):
            up = self.first[cell] + k
            ok = up < self.first[cell + 1]
            ok[ok] = self.low[up[ok]] <= dist[ok]
            at[ok] = up[ok]
        return self.block[at]


def _block(batches):
    """One row a block: its vectors sorted by cell and distance."""
    held: list[pa.RecordBatch] = []

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        cell, dist = (t.column(c).to_numpy() for c in ("cell", "dist"))
        order = np.lexsort((dist, cell))
        t = t.take(pa.array(order))
        ids = t.column("vec_id").combine_chunks()
        one = [cell[order].astype(np.int32), dist[order].astype(np.float64), np.flatnonzero(t.column("asks").to_numpy()).astype(np.int32)]
        data = b"".join(t.column("data").to_pylist())
        return pa.RecordBatch.from_arrays([t.column("block").combine_chunks()[:1], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in one), pa.array([data], pa.binary())], names=["block", "ids", "cells", "dists", "asks", "data"])

    for b in batches:
        key = b.column("block").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for lo, hi in zip(cut, cut[1:]):
            if held and hi > lo and held[-1].column("block")[0].as_py() != key[lo]:
                yield done()
                held.clear()
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield done()


class _Block:
    def __init__(self, b: pa.RecordBatch, row: int, dim: int, prefix: str = ""):
        def raw(name: str) -> bytes:
            return b.column(prefix + name)[row].as_py() or b""

        self.ids = b.column(prefix + "ids")[row].values
        self.cell = np.frombuffer(raw("cells"), np.int32)
        self.dist = np.frombuffer(raw("dists"), np.float64)
        self.x = np.frombuffer(raw("data"), np.float32).reshape(-1, dim)
        self.asks = np.frombuffer(raw("asks"), np.int32) if prefix + "asks" in b.schema.names else None
        self.rank = np.unique(self.ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        self.cells = np.unique(self.cell)
        self.first = np.searchsorted(self.cell, self.cells)
        self.end = np.searchsorted(self.cell, self.cells, "right")

    def queries(self) -> _Block:
        """The rows that are queries; ``asks`` has their places."""
        q = object.__new__(_Block)
        q.ids, q.cell, q.dist, q.x, q.asks = self.ids.take(pa.array(self.asks)), self.cell[self.asks], self.dist[self.asks], self.x[self.asks], self.asks
        return q


def _search(q: _Block, dp: np.ndarray, data: _Block, pivots: np.ndarray, bound: np.ndarray, k: int, own: bool = False, rows: int = 1024):
    """Up to k neighbours in ``data`` for every query (row, place, d2), none farther than its bound. ``own``: the queries are at ``q.asks`` in ``data``."""
    half = np.einsum("ij,ij->i", data.x, data.x, dtype=np.float32)
    norm = np.sqrt(float(half.max(initial=0)))
    apart = _distances(pivots[data.cells], pivots)
    for lo in range(0, len(q.x), rows):
        x = q.x[lo : lo + rows]
        sq = np.einsum("ij,ij->i", x, x, dtype=np.float32)
        slack = 1e-5 * (np.sqrt(sq) + norm) ** 2 + 1e-12
        now, home, d = bound[lo : lo + rows].copy(), q.cell[lo : lo + rows], dp[lo : lo + rows]
        best = np.full((len(x), k), np.inf, np.float32)
        at = np.full((len(x), k), -1, np.int64)
        for c in np.argsort(np.median(d[:, data.cells], 0)):
            b, e = data.first[c], data.end[c]
            near, far = data.dist[b], data.dist[e - 1]
            dq = d[:, data.cells[c]]
            reach = np.sqrt(now * now + slack)
            plane = np.where(home == data.cells[c], 0, (dq * dq - d[np.arange(len(x)), home] ** 2) / (2 * np.maximum(apart[c, home], 1e-30)))
            live = np.flatnonzero((dq - reach <= far) & (dq + reach >= near) & (plane <= reach))
            if len(live) == 0:
                continue
            inner = b + np.searchsorted(data.dist[b:e], (dq - reach)[live].min())
            outer = b + np.searchsorted(data.dist[b:e], (dq + reach)[live].max(), "right")
            if inner >= outer:
                continue
            d2 = sq[live, None] + half[None, inner:outer] - 2 * (x[live] @ data.x[inner:outer].T)
            if own:
                d2[q.asks[lo + live][:, None] == np.arange(inner, outer)[None]] = np.inf
            d2 = np.concatenate([best[live], d2], 1)
            place = np.concatenate([at[live], np.broadcast_to(np.arange(inner, outer), (len(live), outer - inner))], 1)
            # all within rounding of the k-th stay until they are settled exactly
            kth = np.partition(d2, k - 1, 1)[:, k - 1] if d2.shape[1] > k else d2.max(1)
            fit = d2 <= (kth + 2 * slack[live])[:, None]
            need = max(best.shape[1], int(fit.sum(1).max()))
            if need > best.shape[1]:
                grow = need - best.shape[1]
                best = np.concatenate([best, np.full((len(x), grow), np.inf, np.float32)], 1)
                at = np.concatenate([at, np.full((len(x), grow), -1, np.int64)], 1)
            d2[~fit] = np.inf
            if d2.shape[1] < best.shape[1]:
                pad = best.shape[1] - d2.shape[1]
                d2 = np.concatenate([d2, np.full((len(live), pad), np.inf, np.float32)], 1)
                place = np.concatenate([place, np.full((len(live), pad), -1)], 1)
            i = np.argpartition(d2, best.shape[1] - 1, 1)[:, : best.shape[1]] if d2.shape[1] > best.shape[1] else np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
            best[live], at[live] = np.take_along_axis(d2, i, 1), np.take_along_axis(place, i, 1)
            now[live] = np.minimum(now[live], np.sqrt(np.maximum(kth, 0) + slack[live]))
        r, j = np.nonzero(np.isfinite(best))
        p = at[r, j]
        diff = q.x[lo + r].astype(np.float64) - data.x[p].astype(np.float64)
        yield lo + r, p, (diff * diff).sum(1)


def _first(vec: np.ndarray, other: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each vector, ties by ``other``."""
    order = np.lexsort((other, d2, vec))
    v = vec[order]
    return order[np.arange(len(v)) - np.searchsorted(v, v) < k]


def _needed(q: _Block, bound: np.ndarray, pivots: np.ndarray, cells: np.ndarray, near: np.ndarray, far: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Blocks that may hold a neighbour within the bound of one of the queries."""
    hit = np.zeros(len(cells), bool)
    for lo in range(0, len(q.x), 256):
        d = _distances(q.x[lo : lo + 256], pivots)
        wide = bound[lo : lo + 256, None] * (1 + 1e-6) + 1e-9
        home = d[np.arange(len(d)), q.cell[lo : lo + 256]][:, None]
        for a in range(0, len(cells), 16384):
            c = cells[a : a + 16384]
            e = d[:, c]
            apart = _distances(pivots[q.cell[lo : lo + 256]], pivots[c]) if len(d) * len(c) <= 1 << 24 else None
            ok = (e - wide <= far[a : a + 16384]) & (e + wide >= near[a : a + 16384])
            if apart is not None:
                with np.errstate(invalid="ignore"):
                    ok &= (apart == 0) | ((e * e - home * home) <= 2 * apart * wide * (1 + 1e-6) + 1e-6)
            hit[a : a + 16384] |= ok.any(0)
    return np.unique(block[hit])


def neighbours(vectors: DataFrame, k: int = 10, queries: Column | None = None, block_rows: int = 8192, broadcast_mb: int = 64) -> DataFrame:
    """Rows (vec_id, rank, neighbor_id, distance): for every row that ``queries`` picks (default: all) its k nearest others by Euclidean distance.

    If all vectors together have at most ``broadcast_mb``, blocks are broadcast to their pairs; else they are shuffled to them.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks") if queries is not None else F.lit(True).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    out = f"vec_id {kind}, rank int, neighbor_id {kind}, distance double"
    if usual is None or usual.n == 0:
        return spark.createDataFrame([], out)
    dim, total = usual.n, usual["count"]
    rows = rows.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks"))
    n_pivots = int(max(1, min(PIVOTS, round(np.sqrt(total)))))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = np.array([r.embedding for r in chosen], np.float32)
    held = spark.sparkContext.broadcast(pivots)
    placed = store.save(rows.mapInArrow(lambda b: _assign(b, held.value), f"vec_id {kind}, asks boolean, cell int, dist double, data binary"), "cells")

    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", F.array(*[F.lit(j / ANNULI) for j in range(ANNULI)]), 1000).alias("q")).collect()
    layout = spark.sparkContext.broadcast(_Layout(pivots, cells, block_rows))

    def put(batches):
        for b in batches:
            block = layout.value.of(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "dist")))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *b.columns], names=["block", *b.schema.names])

    # many vectors at one distance (copies) don't part by it: a block over twice its size parts by a hash
    in_blocks = placed.mapInArrow(put, f"block long, vec_id {kind}, asks boolean, cell int, dist double, data binary")
    large = in_blocks.groupBy("block").count().where(F.col("count") > 2 * block_rows).collect()
    if large:
        parts = spark.createDataFrame([(r.block, -(-r["count"] // block_rows)) for r in large], "block long, parts long")
        in_blocks = in_blocks.join(parts, "block", "left").withColumn("block", F.col("block") + layout.value.n * F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0))).drop("parts")
    tasks = max(1, -(-total // block_rows))
    schema = f"block long, ids array<{kind}>, cells binary, dists binary, asks binary, data binary"
    blocks = store.save(in_blocks.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_block, schema), "blocks")

    store.drop(placed)

    def ranges(batches):
        for b in batches:
            for j in range(b.num_rows):
                x = _Block(b, j, dim)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[j].as_py()] * len(x.cells), pa.int64()), pa.array(x.cells), pa.array(x.dist[x.first]), pa.array(x.dist[x.end - 1])], names=["block", "cell", "near", "far"])

    t = blocks.mapInArrow(ranges, "block long, cell int, near double, far double").toArrow()
    table = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for c in ("cell", "near", "far", "block")))
    result = f"block long, needs array<long>, vec_id {kind}, neighbor_id {kind}, d2 double, ids array<{kind}>, cells binary, dists binary, data binary, bounds binary"
    names = ["block", "needs", "vec_id", "neighbor_id", "d2", "ids", "cells", "dists", "data", "bounds"]

    def home(batches):
        for b in batches:
            for j in range(b.num_rows):
                block, own = b.column("block")[j].as_py(), _Block(b, j, dim)
                q = own.queries()
                if len(q.x) == 0:
                    continue
                parts = list(_search(q, _distances(q.x, held.value), own, held.value, np.full(len(q.x), np.inf), k, True))
                r, p, d2 = (np.concatenate(a) for a in zip(*parts))
                i = _first(r, own.rank[p], d2, k)
                n = np.bincount(r[i], minlength=len(q.x))
                bound = np.full(len(q.x), np.inf)
                np.maximum.at(last := np.zeros(len(q.x)), r[i], d2[i])
                bound[n >= k] = np.sqrt(last[n >= k])
                for lo in range(0, len(i), 20000):
                    s = i[lo : lo + 20000]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(s), pa.int64()), pa.nulls(len(s), pa.list_(pa.int64())), q.ids.take(pa.array(r[s])), own.ids.take(pa.array(p[s])), pa.array(d2[s]), pa.nulls(len(s), pa.list_(own.ids.type)), *(pa.nulls(len(s), pa.binary()) for _ in range(4))], names=names)
                todo = _needed(q, bound, held.value, *table.value)
                todo = todo[todo != block]
                raw = (pa.array([x.tobytes()], pa.binary()) for x in (q.cell, q.dist, q.x, bound))
                lists = pa.ListArray.from_arrays(pa.array([0, len(todo)], pa.int32()), pa.array(todo, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists, pa.nulls(1, own.ids.type), pa.nulls(1, own.ids.type), pa.nulls(1, pa.float64()), pa.ListArray.from_arrays(pa.array([0, len(q.ids)], pa.int32()), q.ids), *raw], names=names)

    own = store.save(blocks.repartition(tasks).mapInArrow(home, result), "home")
    todo = own.where("bounds is not null").select(F.col("block").alias("q"), F.explode("needs").alias("x"))
    small = total * (dim * 4 + 40) <= broadcast_mb << 20
    n_pairs = todo.count()
    left = own.where("bounds is not null").select(*[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "cells", "dists", "data", "bounds")])
    right = blocks.select(*[F.col(c).alias(f"x_{c}") for c in ("block", "ids", "cells", "dists", "data")])
    work = todo.repartition(max(1, min(n_pairs, 20 * tasks))).join(F.broadcast(left) if small else left, F.col("q") == F.col("q_block")).join(F.broadcast(right) if small else right, F.col("x") == F.col("x_block"))

    def across(batches):
        for b in batches:
            for j in range(b.num_rows):
                q, x = (_Block(b, j, dim, s) for s in ("q_", "x_"))
                bound = np.frombuffer(b.column("q_bounds")[j].as_py(), np.float64) * (1 + 1e-6) + 1e-9
                for r, p, d2 in _search(q, _distances(q.x, held.value), x, held.value, bound, k):
                    i = _first(r, x.rank[p], d2, k)
                    yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(r[i])), x.ids.take(pa.array(p[i])), pa.array(d2[i])], names=["vec_id", "neighbor_id", "d2"])

    found = own.where("bounds is null").select("vec_id", "neighbor_id", "d2").unionByName(work.mapInArrow(across, f"vec_id {kind}, neighbor_id {kind}, d2 double"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.sqrt("d2").alias("distance"))
