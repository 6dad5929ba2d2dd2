"""N-gram Jaccard join of a table of documents with itself.

Word n-gram sets are sketched by min-hashing; bands of rows of the sketch
are shuffled on their hashes, and documents that share a band are verified
on their full n-gram sets. Bands and rows follow from the threshold and the
recall wanted at it (``bands_for``).

Groups of copies grow with the corpus, so their pairs grow with its square.
The join therefore states its result by document: its class (documents of
equal n-gram sets), its group (documents connected by links, a link being a
pair of classes at or over the threshold), how many classes of its group it
is linked to, and its most similar partner. It finds them without listing
all pairs of a bucket or group:

1. documents of equal n-gram sets are one class;
2. in every bucket all classes are verified against one hub, the lowest in
   an order that differs among bands, so that a class meets up to HUBS hubs;
3. the verified pairs are closed to components;
4. in buckets that still hold several components, what could join two of
   them is verified: in one of up to FEW classes every pair across
   components; for the classes of larger ones by prefix filtering, which
   loses no pair: two sets at the threshold share an n-gram among the rarest
   of either (its size less the overlap needed, plus one), so classes with
   but a common passage, which is frequent among them, don't meet;
5. the links inside a group are counted on the full sets, all against all in
   tiles of about TILE classes: each set moves once for each tile of its
   group, and no pair is ever a row.

So no candidate pair that could join two groups goes unverified, the groups
are exactly the components of the graph of all candidate pairs, and within
them the links are all there are, not only those that share a band.

Defined cases: a null, empty or wordless text has no n-grams and no partner;
a text of fewer than n words has one n-gram, all its words; a row whose
doc_id is null has no partner; ids may be of any type that sorts and keep it;
rows of one doc_id with different texts are documents of their own, repeated
rows of one doc_id and text are one (they stay or go together); ties among
partners go to the lowest doc_id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from . import text as tx

HUBS = 3
FEW = 64
TILE = 128
_rng = np.random.Generator(np.random.PCG64(977))
_MUL = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, 1024, dtype=np.uint64)
_NONE = np.iinfo(np.uint64).max


def bands_for(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """Bands and rows that find a pair at ``threshold`` with probability ``recall``: the most rows that ``hashes`` min-hashes allow."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, sorted by row and hash, and the row of each."""
    buf = tx.fold(data)
    s, e, row = tx.words(buf, offs)
    h = tx.hashes(buf, s, e)
    count = np.bincount(row, minlength=len(offs) - 1)
    g, at = tx.grams(h, row, n)
    r = row[at]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = tx.bounds(row, len(offs) - 1)
        whole = np.array([tx.mix(np.add.reduce(h[first[k] : first[k] + count[k]] * tx._GRAM[: count[k]], keepdims=True) + np.uint64(count[k]))[0] for k in few], np.uint64)
        g, r = np.concatenate([g, whole]), np.concatenate([r, few])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new]


def _sketch(batches, n: int, bands: int, rows: int):
    for b in tx.slices(batches, "text"):
        data, offs = tx.flat(b.column("text"))
        g, r = _sets(data, offs, n)
        full, first = np.unique(r, return_index=True)
        if len(full) == 0:
            continue
        size = np.diff(np.append(first, len(g))).astype(np.uint64)
        s1 = tx.mix(np.add.reduceat(g, first) + size)
        s2 = tx.mix(np.add.reduceat(tx.mix(g ^ _XOR[0]), first) + size)
        out = np.zeros((bands, len(full)), np.uint64)
        for k in range(bands):
            for j in range(rows):
                i = k * rows + j
                out[k] += tx.mix(np.minimum.reduceat((g ^ _XOR[i]) * _MUL[i], first)) * tx._GRAM[j]
            out[k] = tx.mix(out[k] + np.uint64(k))
        flat = pa.array(out.T.reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), flat)
        at = pa.array(full)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("h").take(at), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], names=["doc_id", "h", "s1", "s2", "bands"])


def _grams_of(batches, n: int):
    for b in tx.slices(batches, "text"):
        data, offs = tx.flat(b.column("text"))
        g, r = _sets(data, offs, n)
        cut = tx.bounds(r, len(offs) - 1) * 8
        binary = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.append(cut[: len(offs) - 1], len(g) * 8).astype(np.int32)), pa.py_buffer(g.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("cid"), binary], names=["cid", "grams"])


def _views(col: pa.Array) -> list[np.ndarray]:
    """The n-gram sets of a binary column, not copied."""
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [np.frombuffer(raw[a:b], np.uint64) for a, b in zip(offs[:-1], offs[1:])]


def _share(p: np.ndarray, q: np.ndarray) -> float:
    if len(p) > len(q):
        p, q = q, p
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
    return both / max(1, len(p) + len(q) - both)


def _similar(batches):
    for b in batches:
        out = [_share(p, q) for p, q in zip(_views(b.column("x")), _views(b.column("y")))]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])
        del b
    tx.trim()


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full n-gram sets have at least ``threshold`` in common."""
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("y")), "b")
    both = both.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """The lowest id (``root``) that every node of the edges (a, b) is connected to: rows (node, root)."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = store.save(both, "edges")
    now = store.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = now.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = step.join(jump, "root").select("node", "was", F.least("root", "far").alias("root"))
        new = store.save(new, "roots")
        store.drop(now)
        now = new.select("node", "root")
        now._wavelark_path = new._wavelark_path
        if new.where("root <> was").isEmpty():
            store.drop(both)
            return now


def _explode_grams(batches):
    for b in batches:
        sets = _views(b.column("grams"))
        size = np.array([len(x) for x in sets], np.int64)
        row = pa.array(np.repeat(np.arange(len(sets)), size))
        grams = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("cid").take(row), b.column("root").take(row), pa.array(np.repeat(size, size)), pa.array(grams.view(np.int64))], names=["cid", "root", "size", "gram"])


def _prefix_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``members`` (cid, root) of different roots that share one of the rarest n-grams of either: none at the threshold is missing."""
    rows = sets.join(members, "cid").select("cid", "root", "grams").mapInArrow(_explode_grams, "cid long, root long, size long, gram long")
    rows = store.save(rows, "open-grams")
    freq = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    ranked = rows.join(freq, "gram")
    # the place of an n-gram in its set by (frequency, hash); those that only one root has take places but join nothing
    place = F.row_number().over(Window.partitionBy("cid").orderBy("n", "gram"))
    last = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    kept = ranked.withColumn("place", place).where((F.col("place") <= last) & (F.col("lo") < F.col("hi")))
    kept = store.save(kept.select("gram", "cid", "root"), "prefixes")
    x, y = (kept.select("gram", F.col("cid").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return x.join(y, "gram").where("a < b and ra <> rb").select("a", "b").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets have in common."""
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    g, row = every[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    out = np.diag(size).astype(np.int64)
    total = np.zeros((len(sets), len(sets)), np.int64)
    cut = np.searchsorted(col, np.arange(0, int(col[-1]) + 4097, 4096)) if len(col) else [0]
    for lo, hi in zip(cut[:-1], cut[1:]):
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[lo:hi], col[lo:hi] % 4096] = 1
        total += np.rint(x @ x.T).astype(np.int64)
    np.fill_diagonal(total, 0)
    return out + total


def _tile_links(t: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """For each class of a tile pair its links within it, and the best one's similarity and doc_id."""
    # by doc_id, so that of equal similarities the first is that of the lowest id
    t = t.take(pc.sort_indices(t, sort_keys=[("rep", "ascending"), ("cid", "ascending")])).combine_chunks()
    cid = t.column("cid").to_numpy()
    tile, i, j = (t.column(c).to_numpy() for c in ("tile", "i", "j"))
    sets = _views(t.column("grams").chunk(0))
    size = np.array([len(x) for x in sets])
    both = _overlaps(sets)
    near = both / np.maximum(size[:, None] + size[None, :] - both, 1)
    ok = near >= threshold
    if i[0] == j[0]:
        np.fill_diagonal(ok, False)
    else:
        ok &= tile[:, None] != tile[None, :]
    near[~ok] = -1
    some = np.flatnonzero(ok.any(1))
    best = near[some].argmax(1) if len(some) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(ok[some].sum(1)), pa.array(near[some, best]), t.column("rep").combine_chunks().take(pa.array(best))], names=["cid", "n_links", "jaccard", "partner"])


def _links(batches, threshold: float):
    """Runs of rows of one (root, i, j), which may span batches, as tile pairs."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("root", "i", "j")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            part = b.slice(lo, hi - lo)
            if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in ("root", "i", "j")):
                yield _tile_links(pa.Table.from_batches(held), threshold)
                held = []
            held.append(part)
    if held:
        yield _tile_links(pa.Table.from_batches(held), threshold)
    held.clear()
    tx.trim()


def links(nodes: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Rows (cid, n_links, jaccard, partner) of the classes in ``nodes`` (node, root): all links inside a group, counted in tiles."""
    size = nodes.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    rows = nodes.join(size, "root").select(F.col("node").alias("cid"), "root", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"))
    rows = rows.join(classes.select("cid", "rep"), "cid").join(sets, "cid")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    rows = rows.select("cid", "rep", "root", "tile", "grams", other)
    rows = rows.select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "cid", "rep", "grams")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = rows.mapInArrow(lambda b: _links(b, threshold), f"cid long, n_links long, jaccard double, partner {kind}")
    best = F.min(F.struct((-F.col("jaccard")).alias("d"), "partner"))
    return found.groupBy("cid").agg(F.sum("n_links").alias("n_links"), best.alias("m")).select("cid", "n_links", (-F.col("m.d")).alias("jaccard"), F.col("m.partner").alias("partner"))


def _near(docs: DataFrame, threshold: float, recall: float, n: int, hashes: int) -> DataFrame:
    """``near_duplicates`` with the hash ``h`` of each text, and that of the group's first document (``group_h``)."""
    bands, rows = bands_for(threshold, recall, hashes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sig = store.save(docs.mapInArrow(lambda b: _sketch(b, n, bands, rows), f"doc_id {kind}, h long, s1 long, s2 long, bands array<long>"), "sketches")

    low = sig.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h", "bands")).alias("m"), F.count("*").alias("n"))
    low = low.select("s1", "s2", F.col("m.doc_id").alias("rep"), F.col("m.h").alias("rep_h"), F.col("m.bands").alias("bands"), "n")
    low = store.save(low.withColumn("cid", F.monotonically_increasing_id()), "sets")

    hot = low.select("cid", F.posexplode("bands").alias("at", "band"))
    # a band's hub is the lowest class in one of HUBS orders (ids with some bits turned); hot bands are combined before the shuffle
    turn = F.element_at(F.array(*[F.lit(int(_XOR[k] >> np.uint64(1))) for k in range(HUBS)]), F.col("at") % HUBS + 1)
    hot = hot.select("band", "cid", turn.alias("turn"))
    buckets = hot.groupBy("band").agg(F.min(F.col("cid").bitwiseXOR(F.col("turn"))).alias("low"), F.min("turn").alias("turn"), F.count("*").alias("n")).where("n > 1")
    buckets = buckets.select("band", F.col("low").bitwiseXOR(F.col("turn")).alias("hub"), "n")
    hot = store.save(hot.select("band", "cid").join(buckets, "band").select("band", "cid", "hub", "n"), "buckets")

    members = hot.select("cid").distinct().join(low.select("cid", "rep", "rep_h"), "cid").select("cid", F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"))
    members = store.save(members, "candidates")
    sets = store.by_ids(docs, members, "inner", ["doc_id", "h"]).select("cid", "text").mapInArrow(lambda b: _grams_of(b, n), "cid long, grams binary")
    sets = store.save(sets.dropDuplicates(["cid"]), "grams")
    pairs = hot.where("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    first = store.save(_verify(pairs, sets, threshold), "verified")

    root = components(first)
    placed = hot.join(root.select(F.col("node").alias("cid"), "root"), "cid", "left").select("band", "cid", "hub", "n", F.coalesce("root", "cid").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    open_ = store.save(placed.join(mixed, "band", "left_semi"), "open")
    x, y = (open_.where(F.col("n") <= FEW).select("band", F.col("cid").alias(c), F.col("root").alias(f"r{c}"), F.col("hub").alias(f"h{c}")) for c in "ab")
    across = x.join(y, "band").where("a < b and ra <> rb and a <> ha and b <> ha").select("a", "b")
    large = open_.where(F.col("n") > FEW).select("cid", "root").distinct()
    if not large.isEmpty():
        across = across.union(_prefix_pairs(large, sets, threshold))
    second = store.save(_verify(across.distinct(), sets, threshold), "verified")
    if not second.isEmpty():
        store.drop(root)
        root = components(first.union(second))

    linked = links(root, low, sets, threshold, kind).join(root.select(F.col("node").alias("cid"), "root"), "cid")
    found = linked = store.save(linked, "links")
    group = linked.join(low.select("cid", "rep", "rep_h"), "cid").groupBy("root").agg(F.min(F.struct("rep", "rep_h")).alias("g"))
    linked = linked.join(group.select("root", F.col("g.rep").alias("group_id"), F.col("g.rep_h").alias("group_h")), "root").drop("root")
    classes = low.drop("bands").join(linked, "cid", "left").where("n > 1 or group_id is not null")
    classes = classes.withColumns({"group_h": F.when(F.col("group_id").isNull(), F.col("rep_h")).otherwise(F.col("group_h")), "group_id": F.coalesce("group_id", "rep"), "n_links": F.coalesce("n_links", F.lit(0))})
    classes = store.save(classes, "classes")
    # equal sets: every member's partner is the lowest of them, whose own partner is the next
    same = sig.select("doc_id", "h", "s1", "s2").join(classes.where("n > 1"), ["s1", "s2"]).where("doc_id <> rep or h <> rep_h").dropDuplicates(["doc_id", "h"])
    same = store.save(same.select("doc_id", "h", "cid", "group_id", "group_h", F.col("rep").alias("class_id"), F.col("rep").alias("partner_id"), F.lit(1.0).alias("jaccard"), "n_links"), "copies")
    second_id = same.groupBy("cid").agg(F.min("doc_id").alias("next"))
    firsts = classes.join(second_id, "cid", "left").where("next is not null or partner is not null")
    firsts = firsts.select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"), "group_id", "group_h", F.col("rep").alias("class_id"), F.coalesce("next", "partner").alias("partner_id"), F.when(F.col("next").isNotNull(), 1.0).otherwise(F.col("jaccard")).alias("jaccard"), "n_links")
    out = store.save(firsts.unionByName(same.drop("cid")), "near")
    for t in (open_, first, second, hot, members, sets, root, sig, low, found, classes, same):
        store.drop(t)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.5, recall: float = 0.95, n: int = 3, hashes: int = 192) -> DataFrame:
    """Rows (doc_id, group_id, class_id, partner_id, jaccard, n_links) for every document with a partner.

    ``group_id`` and ``class_id`` are the lowest doc_ids of the group and of the class, ``partner_id`` the most similar document of another class, or one of its own with
    ``jaccard`` 1, ``n_links`` the number of other classes at or over the threshold.
    """
    return _near(docs, threshold, recall, n, hashes).select("doc_id", "group_id", "class_id", "partner_id", "jaccard", "n_links")


def drop_duplicates(docs: DataFrame, threshold: float = 0.5, recall: float = 0.95, n: int = 3, hashes: int = 192) -> DataFrame:
    """``docs`` with one document of each group, that of the lowest doc_id."""
    found = _near(docs, threshold, recall, n, hashes)
    key = store.unused(docs, "h")
    gone = found.where("doc_id <> group_id or h <> group_h").select("doc_id", F.col("h").alias(key)).distinct()
    gone = store.save(gone, "duplicates")
    store.drop(found)
    kept = store.by_ids(docs.withColumn(key, F.xxhash64("text")), gone, "left_anti", ["doc_id", key])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
