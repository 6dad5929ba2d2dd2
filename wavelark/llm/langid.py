"""Language identification by prediction by partial matching.

Every language has a byte context tree of variable order, its statistics
frozen after training. The probability of a byte in a context is its count
over the context's total plus its number of distinct bytes; a byte not seen
there escapes to the next shorter context, with the bytes already ruled out
excluded, down to a uniform order below zero. So each tree is a proper
distribution and the sum of its code lengths is exact. All trees share one
set of context nodes, and as nothing adapts while scoring, the code length
of every (node, byte, language) is one entry of a table.

Defined cases: a null or empty text (or one of white space alone) has
language ``und``, zero bytes and is rejected; equal code lengths go to the
language that sorts first; repeated rows are scored one by one; an empty
table, or one without labels, gives ``und`` for every row; other columns
are carried along by ``identify`` and ``accept`` (columns named like the
results are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import store
from . import text as tx

RESULT = "pred_lang string, n_bytes long, bits_per_byte double, margin double, accepted boolean"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Model:
    langs: list[str]
    order: int
    symbol: np.ndarray  # 256 -> symbol; 0 for bytes never seen
    child: np.ndarray  # node * size + symbol -> node, or -1
    cost: np.ndarray  # node * size + symbol -> bits by language
    size: int


def _symbols(data: np.ndarray, offs: np.ndarray, symbol: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``order`` line ends ahead of every text, and the places of the texts' own bytes."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.arange(len(data)) + order * (row + 1)
    out = np.full(len(data) + order * (len(offs) - 1), symbol[10], np.int32)
    out[at] = symbol[tx.fold(data)]
    return out, at


def _contexts(s: np.ndarray, at: np.ndarray, k: int, size: int) -> np.ndarray:
    """The number of the ``k`` symbols before each place, the nearest first."""
    return sum((s[at - j].astype(np.int64) * size ** (j - 1) for j in range(1, k + 1)), np.zeros(len(at), np.int64))


def fit(texts: dict[str, list[str]], order: int = 4, min_count: int = 6) -> Model:
    """Context trees of ``order`` from texts by language; a context needs ``min_count`` occurrences in one language."""
    langs = sorted(texts)
    flat = [tx.flat(pa.array(texts[k], pa.large_string())) for k in langs]
    seen = np.zeros(256, bool)
    seen[10] = True
    for data, _ in flat:
        seen[np.unique(tx.fold(data))] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    size, unseen = int(seen.sum()) + 1, int((~seen).sum())
    coded = [_symbols(d, o, symbol, order) for d, o in flat]

    uniform = np.full(size, 1 / 256)
    uniform[0] = max(unseen, 1) / 256
    uniform /= uniform.sum()
    # the tree's nodes, level by level: contexts seen often enough in one language, below kept ones
    keys, ups, first, nodes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0], 1
    child = [np.full((1, size), -1, np.int32)]
    for k in range(1, order + 1):
        kept = [np.zeros(0, np.int64)]
        for s, at in coded:
            u, c = np.unique(_contexts(s, at, k, size), return_counts=True)
            kept.append(u[c >= min_count])
        kept = np.unique(np.concatenate(kept))
        up = np.minimum(np.searchsorted(keys[-1], kept % size ** (k - 1)), max(len(keys[-1]) - 1, 0))
        ok = keys[-1][up] == kept % size ** (k - 1) if len(keys[-1]) else np.zeros(len(kept), bool)
        kept, up = kept[ok], up[ok]
        child[-1][up, kept // size ** (k - 1)] = nodes + np.arange(len(kept))
        keys.append(kept)
        ups.append(up + first[-1])
        first.append(nodes)
        child.append(np.full((len(kept), size), -1, np.int32))
        nodes += len(kept)
    # probabilities of one language and level at a time, in the table that becomes that of costs
    cost = np.empty((nodes, size, len(langs)), np.float32)
    for j, (s, at) in enumerate(coded):
        for k, own in enumerate(keys):
            if len(own) == 0:
                break
            here = slice(first[k], first[k] + len(own))
            parent = cost[ups[k], :, j] if k else uniform[None].astype(np.float32)
            x = _contexts(s, at, k, size)
            i = np.minimum(np.searchsorted(own, x), len(own) - 1)
            ok = own[i] == x
            count = np.bincount(i[ok] * size + s[at][ok], minlength=len(own) * size).reshape(-1, size).astype(np.float32)
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True, dtype=np.float32)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(count > 0, np.float32(0), parent)
                p *= kinds / (total + kinds) / p.sum(1, keepdims=True)
                np.copyto(p, count / (total + kinds), where=count > 0)
            cost[here, :, j] = np.where(total == 0, parent, p)
    np.log2(np.maximum(cost, np.float32(1e-30), out=cost), out=cost)
    np.negative(cost, out=cost)
    cost[:, 0] += np.log2(max(unseen, 1))
    return Model(langs, order, symbol, np.concatenate(child).reshape(-1), cost.reshape(nodes * size, len(langs)), size)


def code_lengths(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of every text under every language."""
    n, out = len(offs) - 1, np.zeros((len(offs) - 1, len(model.langs)))
    if len(data) == 0:
        return out
    s, at = _symbols(data, offs, model.symbol, model.order)
    node = np.zeros(len(at), np.int32)
    alive = np.ones(len(at), bool)
    for j in range(1, model.order + 1):
        to = model.child[node * np.int32(model.size) + s[at - j]]
        alive &= to >= 0
        node = np.where(alive, to, node)
    cell = node * np.int32(model.size) + s[at]
    full = np.flatnonzero(np.diff(offs) > 0)
    for k in range(len(model.langs)):
        out[full, k] = np.add.reduceat(model.cost[:, k][cell].astype(np.float64), offs[:-1][full])
    return out


def train(docs: DataFrame, sample_docs: int = 150, order: int = 4, min_count: int = 6) -> Model:
    """Fit on the ``sample_docs`` labelled documents of every language whose ids hash lowest."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= sample_docs).select("doc_id").distinct()
    texts: dict[str, list[str]] = {}
    # at most sample_docs a language
    kept = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    for r in sorted(kept.collect()):
        texts.setdefault(r.lang, []).append(r.text)
    return fit({k: v for k, v in texts.items() if any(x.strip() for x in v)}, order, min_count)


def identify(docs: DataFrame, model: Model, max_bits: float = 5.0, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Score whole texts. A text is accepted if its best language codes it in at most ``max_bits`` bits a byte.

    ``keep`` names the columns to carry along (default: all that the result doesn't name itself); ``prefix`` goes ahead of the result's names.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    fields = [T.StructField(prefix + f.name, f.dataType) for f in T._parse_datatype_string(RESULT).fields]
    own = [f.name for f in fields]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    held = spark.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = T.StructType([picked.schema[c] for c in keep] + fields)

    def score(batches):
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for b in tx.slices(batches, "text"):
            data, offs = tx.flat(b.column("text"))
            n = np.diff(offs)
            best, bits, margin = np.full(len(n), len(m.langs)), np.full(len(n), np.nan), np.full(len(n), np.nan)
            ink = np.concatenate([[0], np.cumsum(~_SPACE[data])])
            full = (ink[offs[1:]] - ink[offs[:-1]]) > 0
            if m.langs and full.any():
                each = code_lengths(m, data, offs) / np.maximum(n, 1)[:, None]
                order = np.sort(each, axis=1)
                best = np.where(full, each.argmin(1), best)
                bits = np.where(full, order[:, 0], bits)
                margin = np.where(full, order[:, 1] - order[:, 0] if len(m.langs) > 1 else np.inf, margin)
            cols = [b.column(c) for c in keep]
            cols += [pa.array(names[best]), pa.array(n), pa.array(bits, from_pandas=True), pa.array(margin, from_pandas=True), pa.array((bits <= max_bits) & full)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *own])

    return picked.mapInArrow(score, schema)


def accept(docs: DataFrame, model: Model, max_bits: float = 5.0) -> DataFrame:
    """The documents that ``identify`` accepts, in their own columns."""
    prefix = ""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = identify(docs, model, max_bits, docs.columns, prefix)
    return found.where(F.col(f"`{prefix}accepted`")).select(*[F.col(f"`{c}`") for c in docs.columns])
