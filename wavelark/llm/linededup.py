"""Line deduplication with a log-template tree.

A line is split at white space; tokens that hold a digit are variable from
the start. The tree has a fixed depth: lines part by token count, then by
their first LEAD tokens that aren't variable (and the places of these), and
in a leaf a line joins the most similar template (share of equal tokens at
equal places, at least ``similarity``), whose differing places become
variable, or else founds a new one. A template that recurs in many documents
is boilerplate and its lines are dropped. Lines are combined before the
shuffle, and in a leaf an index of segments finds the templates that a line
can join, so that a leaf of many templates isn't searched whole.

Copies of one document also repeat its lines, but they are no boilerplate:
which copy stays is for the near-duplicate join to say. So what is counted
are distinct documents, copies and near copies of one another being one:

1. templates with at least ``min_docs`` occurrences in documents, copies
   included, are candidates;
2. each document that holds a candidate is signed twice, by the lowest
   trigram hash in each of BINS ranges: of all its text, and of that outside
   all candidates' lines. If the latter is at most ``OUTSIDE`` of its tokens
   (a whole copy has none), all its text stands for it: documents with more
   than that apart can't reach a similarity of 0.5, those with less may well
   be near copies;
3. two documents are copies if the text outside of either agrees with all
   the other's in COPY of the ranges that either has, and a template recurs
   if ``min_docs`` of its documents are no copies of one another.

Every task passes on up to ``min_docs`` such documents of each template, and
these are thinned out once more by groups of tasks, so a line in most
documents doesn't make a skewed partition. Where similarity
isn't transitive (A like B, B like C, A not like C) which documents are met
first can decide; such groups are near the limit COPY. Documents with more
than 1 - OUTSIDE of their tokens in common lines count as copies.

A template with fewer than half of its tokens fixed says nothing of what the
lines have in common (rows of numbers, say), and is none.

Defined cases: a null text stays null, an empty one empty; a line of fewer
than ``min_tokens`` tokens (blank ones among them) is never dropped; a line
repeated within one document counts once; equal similarity goes to the
template founded first, templates being founded in order of falling document
count, then line hash; a document whose every line is dropped has the text
''; repeated rows stay, and count as copies; empty tables give empty results;
other columns are carried along, whatever their names, but for columns named
as the counts ``n_lines`` and ``n_dropped``, which are replaced (none is with
``counts=False``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from . import text as tx

BINS = 64
COPY = 1 / 10
OUTSIDE = 1 / 3
LEAD = 3
FIXED = 0.5
STEP = 1 << 14
_WILD = np.uint64(0x5BD1E995)
LINES = "leaf long, line long, tokens binary, n_docs long"


class Lines:
    """The lines of a batch: row, bounds, token count, leaf, hash and 16-bit token fingerprints of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        buf = tx.fold(data)
        nl = np.flatnonzero(buf == 10)
        cut = np.unique(np.concatenate([offs, nl, nl + 1]))
        self.start, self.end = tx.runs(buf != 10, cut)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        s, e = tx.inks(buf, cut)
        h = tx.hashes(buf, s, e)
        if len(s):
            digits = np.concatenate([[0], np.cumsum(tx.IS_DIGIT[buf])])
            h[digits[e] > digits[s]] = _WILD
        self.print = (h >> np.uint64(48)).astype(np.uint16)
        self.print[self.print == 0] = 1
        self.print[h == _WILD] = 0
        of = np.searchsorted(self.start, s, "right") - 1
        n = len(self.start)
        self.first = np.searchsorted(of, np.arange(n))
        self.count = np.bincount(of, minlength=n)
        at = np.arange(len(s)) - self.first[of] if len(s) else np.zeros(0, np.int64)
        term = tx.mix(h + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        size = self.count.astype(np.uint64)
        self.line = tx.mix(total[self.first + self.count] - total[self.first] + size)
        fixed = h != _WILD
        before = np.concatenate([[0], np.cumsum(fixed)])
        lead = fixed & (before[:-1] - before[self.first[of]] < LEAD) if len(s) else fixed
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(lead, term, np.uint64(0)), dtype=np.uint64)])
        self.leaf = tx.mix(total[self.first + self.count] - total[self.first] + size * np.uint64(0xFF51AFD7ED558CCD))
        self.hash, self.of = h, of

    def signatures(self, n_rows: int, hot: np.ndarray) -> np.ndarray:
        """For every row with a line in ``hot``, 8 bits of the lowest trigram hash in each range, 0 if there is none: of all its text and of that outside ``hot``."""
        total = np.bincount(self.row, self.count, n_rows)
        part = total - np.bincount(self.row[hot], self.count[hot], n_rows)
        g, at = tx.grams(self.hash, self.of, 3)
        line = self.of[at]
        row = self.row[line]
        far = (part > OUTSIDE * total) & (np.bincount(row[~hot[line]], minlength=n_rows) > 0)
        some = (np.bincount(self.row[hot], minlength=n_rows) > 0)[row]
        none = np.iinfo(np.uint64).max

        def lowest(use: np.ndarray) -> np.ndarray:
            low = np.full(n_rows * BINS, none, np.uint64)
            np.minimum.at(low, row[use] * BINS + (g[use] >> np.uint64(58)).astype(np.int64), g[use])
            out = np.maximum(low & np.uint64(0xFF), 1).astype(np.uint8)
            out[low == none] = 0
            return out.reshape(n_rows, BINS)

        return np.concatenate([lowest(some), lowest(some & ~(hot[line] & far[row]))], axis=1)


def _occurrences(batches, min_tokens: int):
    """Rows of LINES, combined over each batch."""
    kind = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("tokens", pa.binary()), ("n_docs", pa.int64())])
    for b in tx.gather(batches, "text"):
        held = []
        for part in tx.slices(iter([b]), "text"):
            data, offs = tx.flat(part.column("text"))
            x = Lines(data, offs)
            ok = np.flatnonzero(x.count >= min_tokens)
            _, i = np.unique(np.stack([x.row[ok].astype(np.uint64), x.line[ok]]), axis=1, return_index=True) if len(ok) else (None, np.zeros(0, np.int64))
            ok = ok[np.sort(i)]
            u, i, inv = np.unique(x.line[ok], return_index=True, return_inverse=True)
            raw = tx.ragged(x.print, x.first[ok[i]], x.first[ok[i]] + x.count[ok[i]])
            held.append((x.leaf[ok[i]], u, x.count[ok[i]], raw, inv))
        if not held:
            continue
        size = np.cumsum([0] + [len(h[1]) for h in held])
        leaf, line, count = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
        raw = np.concatenate([h[3] for h in held])
        begin = np.cumsum(count) - count
        occ = np.concatenate([h[4] + s for h, s in zip(held, size)]).astype(np.int64)
        u, i, inv = np.unique(line, return_index=True, return_inverse=True)
        if len(u) == 0:
            continue
        occ = inv[occ]
        n_docs = np.bincount(occ, minlength=len(u))
        tokens = tx.ragged(raw, begin[i], begin[i] + count[i])
        at = np.concatenate([[0], np.cumsum(count[i]) * 2]).astype(np.int64)
        step = 20000
        for lo in range(0, len(u), step):
            hi = min(lo + step, len(u))
            o = at[lo : hi + 1]
            binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((o - o[0]).astype(np.int32)), pa.py_buffer(tokens[o[0] // 2 : o[-1] // 2].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(leaf[i][lo:hi].view(np.int64)), pa.array(u[lo:hi].view(np.int64)), binary, pa.array(n_docs[lo:hi])], schema=kind)


def _alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of ``p``, whether it is alike the same row of ``q``; up to 255 columns."""
    both, either = ((q == p) & (p > 0)).view(np.uint8), ((q | p) > 0).view(np.uint8)
    return both.sum(1, dtype=np.uint8) >= COPY * either.sum(1, dtype=np.uint8)


def _copies(sign: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the documents of rows ``a`` of ``sign`` are copies of those of rows ``b``."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), STEP):
        p, q = sign[a[lo : lo + STEP]], sign[b[lo : lo + STEP]]
        out[lo : lo + STEP] = _alike(p[:, BINS:], q[:, :BINS]) | _alike(p[:, :BINS], q[:, BINS:])
    return out


def templates(tokens: np.ndarray, similarity: float, indexed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The template of each line (rows of equal length, 0 = variable), in the order in which they come, and all templates.

    A line that a template takes differs from it in at most (1 - ``similarity``) of the places, so of one segment more than that number at least one is equal in all
    places and none of these variable. An index of the templates' segments gives all that can take a line. A template with too many variable places takes no line any more and is
    left out, as is the search for a line with too many. ``indexed`` = False compares with every template, with the same result.
    """
    size = tokens.shape[1]
    made = np.zeros((4, size), np.uint16)
    n, out = 0, np.zeros(len(tokens), np.int64)
    # places where all lines agree (the leaf's leading tokens are) tell nothing apart
    cols = np.flatnonzero((tokens != tokens[:1]).any(0))
    need = int(np.ceil(similarity * size - 1e-9))
    # nor do places that are variable in all lines, and none is equal there
    count = int((tokens > 0).any(0).sum()) - need + 1
    every = not indexed
    indexed = indexed and len(tokens) > 64 and len(cols) >= count > 0
    fixed = (tokens > 0).sum(1).tolist()
    live: dict[int, int] = {}  # templates that can take a line, in the order in which they were founded, and the number of their fixed places
    cuts = np.linspace(0, len(cols), count + 1).astype(int).tolist() if indexed else []
    parts = list(zip(range(count), cuts[:-1], cuts[1:]))
    index: dict[tuple, list[int]] = {}
    for k, t in enumerate(tokens):
        best = -1
        if every:
            some = np.arange(n)
        elif fixed[k] < need:
            some = np.zeros(0, np.int64)
        elif indexed:
            raw = t[cols]
            found: set[int] = set()
            for j, lo, hi in parts:
                found.update(index.get((j, raw[lo:hi].tobytes()), ()))
            some = np.array(sorted(found), np.int64)
        else:
            some = np.fromiter(live, np.int64, len(live))
        if len(some):
            same = ((made[some] == t) & (t > 0)).sum(1)
            at = int(same.argmax())
            if same[at] >= similarity * size:
                best = int(some[at])
        if best < 0:
            if n == len(made):
                made = np.concatenate([made, np.zeros_like(made)])
            made[n], best, n = t, n, n + 1
            if fixed[k] < need:
                out[k] = best
                continue
            live[best] = fixed[k]
            if indexed:
                for j, lo, hi in parts:
                    if raw[lo:hi].all():
                        index.setdefault((j, raw[lo:hi].tobytes()), []).append(best)
        else:
            changed = made[best] != t
            if not every and changed.any():
                live[best] -= int((made[best][changed] > 0).sum())
                full = live[best] < need
                if indexed:
                    # what becomes variable is in no equal segment any more
                    old = made[best][cols]
                    for j, lo, hi in parts:
                        if (full or changed[cols[lo:hi]].any()) and old[lo:hi].all():
                            index[j, old[lo:hi].tobytes()].remove(best)
                if full:
                    del live[best]
            made[best][changed] = 0
        out[k] = best
    return out, made[:n]


def _leaf(line, tokens, n_docs, min_docs, similarity) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines of one leaf whose template is a candidate, and the template's: the lowest of its lines."""
    u, i, inv = np.unique(line, return_index=True, return_inverse=True)
    docs = np.bincount(inv, n_docs).astype(np.int64)
    rank = np.lexsort((u, -docs))
    t = np.zeros(len(u), np.int64)
    t[rank], made = templates(np.stack([np.frombuffer(tokens[i[k]], np.uint16) for k in rank]), similarity)
    ok = ((made != 0).mean(1) >= FIXED) & (np.bincount(t, docs, len(made)) >= min_docs)
    first = np.full(len(made), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(first, t, u)
    return u[ok[t]], first[t[ok[t]]]


def _candidates(batches, min_docs: int, similarity: float):
    """Hashes of candidates' lines and templates from rows of LINES sorted by leaf; a leaf may span batches."""

    def done(t: pa.Table):
        t = t.combine_chunks()
        if t.num_rows == 0:
            return
        leaf = t.column("leaf").to_numpy()
        n_docs = t.column("n_docs").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        stop = np.append(start[1:], len(leaf))
        line = t.column("line").to_numpy().view(np.uint64)
        some = np.add.reduceat(n_docs, start) >= min_docs
        for lo, hi in zip(start[some], stop[some]):
            p = t.slice(lo, hi - lo)
            got, of = _leaf(line[lo:hi], p.column("tokens").to_pylist(), n_docs[lo:hi], min_docs, similarity)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(of.view(np.int64))], names=["line", "template"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        leaf = b.column("leaf").to_numpy(zero_copy_only=False)
        lo = int(np.searchsorted(leaf, leaf[-1]))
        if lo:
            yield from done(pa.Table.from_batches([*held, b.slice(0, lo)]))
            held = [b.slice(lo)]
        elif held and held[-1].column("leaf")[0].as_py() != leaf[0]:
            yield from done(pa.Table.from_batches(held))
            held = [b]
        else:
            held.append(b)
    if held:
        yield from done(pa.Table.from_batches(held))


def _binary(signs: np.ndarray) -> pa.Array:
    signs = np.ascontiguousarray(signs)
    width = 2 * BINS
    return pa.Array.from_buffers(pa.binary(), len(signs), [None, pa.py_buffer(np.arange(0, (len(signs) + 1) * width, width, dtype=np.int32)), pa.py_buffer(signs.tobytes())])


def _thinned(of: np.ndarray, sign: np.ndarray, min_docs: int) -> np.ndarray:
    """Places of up to ``min_docs`` signatures of each template no two of which are copies; equal ones are one, and the order of the rows doesn't matter."""
    key = tx.mix((sign * tx._power(2 * BINS)[: 2 * BINS]).sum(1, dtype=np.uint64)) if len(of) else np.zeros(0, np.uint64)
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    order, of = order[new], of[new]
    # all templates at once: the first document left of each stays, and its copies go
    left, keep = np.arange(len(of)), np.zeros(len(of), bool)
    for _ in range(min_docs):
        if len(left) == 0:
            break
        first = np.concatenate([[True], of[left[1:]] != of[left[:-1]]])
        keep[left[first]] = True
        own = left[first][np.cumsum(first) - 1]
        own, left = own[~first], left[~first]
        left = left[~_copies(sign, order[own], order[left])]
    return order[keep]


def _signed(batches, line: np.ndarray, template: np.ndarray, min_docs: int):
    """Arrays (template, sign) of a task: up to ``min_docs`` documents of each batch for each template in them, no two of them copies. ``line`` is sorted."""
    for b in tx.gather(batches, "text"):
        of, signs = [np.zeros(0, np.int64)], [np.zeros((0, 2 * BINS), np.uint8)]
        for part in tx.slices(iter([b]), "text"):
            data, offs = tx.flat(part.column("text"))
            x = Lines(data, offs)
            if len(x.line) == 0 or len(line) == 0:
                continue
            at = np.minimum(np.searchsorted(line, x.line), len(line) - 1)
            hot = line[at] == x.line
            pair = np.unique(np.stack([template[at[hot]], x.row[hot]]), axis=1)
            of.append(pair[0])
            signs.append(x.signatures(len(offs) - 1, hot)[pair[1]])
        of, sign = np.concatenate(of), np.concatenate(signs)
        at = _thinned(of, sign, min_docs)
        yield of[at], sign[at]


def _combined(parts, min_docs: int):
    """One batch of rows (template, sign) from a task's arrays, which are thinned out whenever they have doubled: work in proportion to the rows."""
    held, size, most = [(np.zeros(0, np.int64), np.zeros((0, 2 * BINS), np.uint8))], 0, 4 * STEP

    def thinned() -> tuple[np.ndarray, np.ndarray]:
        of, sign = (np.concatenate(x) for x in zip(*held))
        at = _thinned(of, sign, min_docs)
        return of[at], sign[at]

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            held = [thinned()]
            size = len(held[0][0])
            most = max(4 * STEP, 2 * size)
    of, sign = thinned()
    yield pa.RecordBatch.from_arrays([pa.array(of), _binary(sign)], names=["template", "sign"])


def _gathered(batches):
    for b in batches:
        raw = b.column("sign").to_pylist()
        yield b.column("template").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 2 * BINS)


def _counted(batches, min_docs: int):
    """Templates with ``min_docs`` documents that are no copies of one another, of rows that hold all of a template."""
    of, sign = [np.zeros(0, np.int64)], [np.zeros((0, 2 * BINS), np.uint8)]
    for t, s in _gathered(batches):
        of.append(t)
        sign.append(s)
    of, sign = np.concatenate(of), np.concatenate(sign)
    u, n = np.unique(of[_thinned(of, sign, min_docs)], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(u[n >= min_docs])], names=["template"])


def _found(batches):
    """Rows (key, line) of all lines."""
    for b in tx.slices(batches, "text"):
        data, offs = tx.flat(b.column("text"))
        x = Lines(data, offs)
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(x.row)), pa.array(x.line.view(np.int64))], names=["key", "line"])


GROUPS = 64


def recurring_lines(docs: DataFrame, min_docs: int = 5, similarity: float = 0.7, min_tokens: int = 3, broadcast_lines: int = 2_000_000) -> DataFrame:
    """Hashes (column ``line``) of the lines whose template recurs across the documents.

    Up to ``broadcast_lines`` candidates' lines (32 MB) are broadcast; more are joined with the documents' lines.
    """
    store.small_batches(docs.sparkSession)
    docs = docs.select("text")
    rows = docs.mapInArrow(lambda b: _occurrences(b, min_tokens), LINES)
    rows = rows.repartition("leaf").sortWithinPartitions("leaf")
    lines = store.save(rows.mapInArrow(lambda b: _candidates(b, min_docs, similarity), "line long, template long"), "candidate-lines")
    if lines.count() <= broadcast_lines:
        t = lines.toArrow()
        line, of = t.column("line").to_numpy().view(np.uint64), t.column("template").to_numpy()
        order = np.argsort(line)
        held = docs.sparkSession.sparkContext.broadcast((line[order], of[order]))
        signed = docs.mapInArrow(lambda b: _combined(_signed(b, *held.value, min_docs), min_docs), "template long, sign binary")
    else:
        # a key by content: of texts with one key each gets the other's candidates too, which it doesn't hold
        keyed = docs.select(F.xxhash64("text").alias("key"), "text")
        found = keyed.mapInArrow(_found, "key long, line long").distinct().join(lines, "line")
        found = found.groupBy("key").agg(F.collect_list("line").alias("lines"), F.collect_list("template").alias("templates"))

        def sign(batches):
            for b in batches:
                line, of = (b.column(c).flatten().to_numpy() for c in ("lines", "templates"))
                line, i = np.unique(line.view(np.uint64), return_index=True)
                yield from _signed(iter([b.select(["text"])]), line, of[i], min_docs)

        signed = keyed.join(found, "key").select("text", "lines", "templates").mapInArrow(lambda b: _combined(sign(b), min_docs), "template long, sign binary")
    # by groups of tasks first
    some = signed.withColumn("group", F.spark_partition_id() % GROUPS).repartition("template", "group")
    some = some.select("template", "sign").mapInArrow(lambda b: _combined(_gathered(b), min_docs), "template long, sign binary")
    return lines.join(some.repartition("template").mapInArrow(lambda b: _counted(b, min_docs), "template long"), "template").select("line")


def _strip(batches, names: list[str], hot: np.ndarray, counts: tuple[str, str]):
    """``names`` of the batches' first columns, the text among them, and the counts."""
    for b in batches:
        b = pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names)
        for part in tx.slices(iter([b]), "text"):
            data, offs = tx.flat(part.column("text"))
            x = Lines(data, offs)
            at = np.minimum(np.searchsorted(hot, x.line), max(len(hot) - 1, 0))
            bad = hot[at] == x.line if len(hot) else np.zeros(len(x.line), bool)
            n_lines, n_bad = np.bincount(x.row, minlength=part.num_rows), np.bincount(x.row[bad], minlength=part.num_rows)
            col = part.column("text")
            if bad.any():
                raw, cut, new = data.tobytes(), tx.bounds(x.row, part.num_rows), col.to_pylist()
                for r in np.flatnonzero(n_bad):
                    new[r] = _without(raw, offs[r], offs[r + 1], x, bad, cut[r], cut[r + 1])
                col = pa.array(new, pa.string())
            cols = [col if c == "text" else part.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines), pa.array(n_bad)], names=[*names, *counts])


def _without(raw: bytes, lo: int, hi: int, x: Lines, bad: np.ndarray, first: int, last: int) -> str:
    gone = {int(x.start[k]) for k in range(first, last) if bad[k]}
    kept, at = [], int(lo)
    for line in raw[lo:hi].split(b"\n"):
        if at not in gone or not line:
            kept.append(line)
        at += len(line) + 1
    return b"\n".join(kept).decode() if any(kept) else ""


def drop_lines(docs: DataFrame, recurring: DataFrame, broadcast_lines: int = 2_000_000, counts: bool = True) -> DataFrame:
    """``docs`` without the lines in ``recurring``, with ``n_lines`` (not blank) and ``n_dropped``; ``n_chars``, if there is one, follows the text.

    Up to ``broadcast_lines`` hashes (16 MB) are broadcast; more are joined with the documents' lines, with the same result.
    """
    own = ("n_lines", "n_dropped") if counts else (store.unused(docs, "n_lines"), store.unused(docs, "n_dropped"))
    names = [c for c in docs.columns if c not in own]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in own)])
    if recurring.count() <= broadcast_lines:
        hot = recurring.toArrow().column("line").to_numpy().view(np.uint64)
        held = docs.sparkSession.sparkContext.broadcast(np.unique(hot))
        out = docs.mapInArrow(lambda b: _strip(b, names, held.value, own), schema)
    else:
        # a key by content: equal texts lose equal lines, and texts that only share a key hold none of each other's recurring lines or lose them rightly
        key, lines = store.unused(docs, "key"), store.unused(docs, "lines")
        keyed = docs.withColumn(key, F.xxhash64("text"))
        found = keyed.select(F.col(key).alias("key"), "text").mapInArrow(_found, "key long, line long").distinct()
        found = found.join(recurring.distinct(), "line").groupBy("key").agg(F.collect_list("line").alias(lines)).withColumnRenamed("key", key)
        both = keyed.join(found, key, "left").select(*[F.col(f"`{c}`") for c in names], lines)

        def strip(batches):
            for b in batches:
                hot = b.column(len(names)).drop_null().flatten()
                yield from _strip(iter([b]), names, np.unique(np.asarray(hot).view(np.uint64)) if len(hot) else np.zeros(0, np.uint64), own)

        out = both.mapInArrow(strip, schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out if counts else out.drop(*own)


def dedup_lines(docs: DataFrame, min_docs: int = 5, similarity: float = 0.7, min_tokens: int = 3, counts: bool = True) -> DataFrame:
    """All documents, each without its recurring lines; with ``n_lines`` and ``n_dropped`` unless ``counts`` is false."""
    hot = store.save(recurring_lines(docs, min_docs, similarity, min_tokens), "recurring")
    out = drop_lines(docs, hot, counts=counts)
    return out
