"""Sequence packing: shortest pack first over the length histogram.

Documents become pieces of at most ``size`` token ids. The plan needs their
length histogram alone: lengths are placed longest first, each into the
shortest pack that there is (the one with most room) if it fits, else into a
new one; equal packs are one pattern with a count, so planning takes time by
lengths and patterns, not by documents. Patterns are joined back to pieces
by the piece's rank among those of its length.

Ranks come from counts by (length, bucket), prefix sums of these, and a
row number within a bucket, so no length is one partition however common.

Defined cases: a null or empty text has no ids and gets one row with length
0 and null pack and offset; a text longer than ``size`` is cut into pieces
(none is dropped); repeated rows are packed one by one; pieces of equal
length rank by bucket, doc_id and piece; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, tokens


def plan(histogram: dict[int, int], size: int, most: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths longest first) that place every length of the histogram; ``most`` limits the lengths of a pack."""
    by_fill: dict[int, Counter] = {}
    full: Counter = Counter()

    def put(pattern: tuple[int, ...], n: int) -> None:
        fill = sum(pattern)
        if fill >= size or (most and len(pattern) >= most):
            full[pattern] += n
        else:
            by_fill.setdefault(fill, Counter())[pattern] += n

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        left = histogram[length]
        while left > 0:
            fill = min(by_fill, default=size)
            if fill + length > size:
                put((length,), left)
                # what is new is the shortest now, unless two of them fit together
                if 2 * length > size or (most == 1):
                    break
                old, left = left, 0
                one = by_fill[length]
                one[(length,)] -= old
                each = min(size // length, most or size)
                for k, n in ((each, old // each), (old % each, 1)):
                    if k and n:
                        put((length,) * k, n)
                if one[(length,)] == 0:
                    del one[(length,)]
                if not by_fill.get(length, True):
                    del by_fill[length]
                break
            packs = by_fill[fill]
            pattern = min(packs)
            n = min(left, packs[pattern])
            packs[pattern] -= n
            if not packs[pattern]:
                del packs[pattern]
            if not packs:
                del by_fill[fill]
            put((*pattern, length), n)
            left -= n
    for packs in by_fill.values():
        full.update(packs)
    return [(n, p) for p, n in sorted(full.items(), reverse=True)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, packs, first pack, offset): the ranks of a length that a slot of a pattern takes."""
    used: Counter = Counter()
    out, pack = [], 0
    for n, lengths in patterns:
        at = 0
        for length in lengths:
            out.append((length, used[length], used[length] + n, n, pack, at))
            used[length] += n
            at += length
        pack += n
    return out


def pieces(lengths: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, piece, start, length): documents of ``n_ids`` cut at multiples of ``size``."""
    last = F.greatest(F.ceil(F.col("n_ids") / size), F.lit(1)).cast("long") - 1
    out = lengths.select("doc_id", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    begin = F.col("piece") * size
    return out.select("doc_id", "piece", begin.alias("start"), F.least(F.col("n_ids") - begin, F.lit(size).cast("long")).alias("length"))


def pack_lengths(lengths: DataFrame, size: int = 2048, most: int | None = None, bucket_rows: int = 500_000) -> DataFrame:
    """Rows (doc_id, piece, start, length, pack_id, pack_offset) for rows (doc_id, n_ids)."""
    spark = lengths.sparkSession
    cut = pieces(lengths, size)
    total = cut.count()
    buckets = max(1, -(-total // bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = store.save(cut.where("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    rows = sorted(slots(plan(histogram, size, most)))
    table = np.array(rows, np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(table)

    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.where("length > 0").withColumn("rank", F.row_number().over(own).cast("long") - 1).join(F.broadcast(base), ["length", "bucket"]) if buckets == 1 else cut.where("length > 0").withColumn("rank", F.row_number().over(own).cast("long") - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches):
        import pyarrow as pa

        t = held.value
        key = t[:, 0] * (1 << 44) + t[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            pack = t[i, 4] + rank - t[i, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(pack), pa.array(t[i, 5])], names=["doc_id", "piece", "start", "length", "pack_id", "pack_offset"])

    kind = lengths.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, pack_id long, pack_offset long"
    none = cut.where("length = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("long").alias("pack_id"), F.lit(None).cast("long").alias("pack_offset"))
    return ranked.mapInArrow(place, schema).unionByName(none)


def pack(docs: DataFrame, size: int = 2048, most: int | None = None, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Pack the token ids of every document's whole text into sequences of ``size``."""
    counted = store.save(tokens.lengths(docs, "doc_id", vocabulary), "n_ids")
    return pack_lengths(counted, size, most)
