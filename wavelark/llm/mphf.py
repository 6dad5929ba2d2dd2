"""Token-id shards with a minimal perfect hash index.

Every task encodes its documents' whole texts and appends the raw ids
(little-endian, 16 bits each, or 32 for larger vocabularies) to a shard file
of its own; only the index entries (key, shard, offset, number of ids) are
shuffled, to segments by a hash of the key. In each segment a minimal perfect
hash is built by pilots: keys fall into small buckets, and bucket by bucket,
largest first, the lowest pilot is found that sends its keys to free slots.
A slot holds a fingerprint of its key, so a lookup also tells that a key is
absent.

The index is binary too. Up to SEGMENTS consecutive segments make up a file: a
table of their places, then for each its pilots and its slots (fingerprint,
shard, offset, number of ids), all of fixed width. A lookup hashes the key
and reads, by position, one place, one pilot, one slot and the ids: a
constant number of reads however many keys there are, and no Spark job.

Files are named by task and attempt, and the entries (a table in the shared
folder, written before the index is built) name the file they belong to: a
repeated or speculative task leaves at worst a file that nothing points to.

Defined cases: a null or empty text is an entry of no ids; a row with a null
key has no entry; keys are integers or strings and keep their type; of rows
with one key the index keeps that with the most ids, of these the one whose
ids hash lowest; two strings of one 64-bit hash are an error (``seed``
changes it); an empty table has an index of no segments; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, tokens
from . import text as tx

KEYS_PER_SEGMENT = 2048
KEYS_PER_BUCKET = 4
SEGMENTS = 1024
PLACE = np.dtype([("at", "<u8"), ("n", "<u8")])
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_ids", "<u8")])
_SLOT = np.uint64(0x9FB21C651E98DF25)


def key_hash(keys: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of integer or string keys; those of integers all differ."""
    salt = np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed) * _SLOT
    if pa.types.is_integer(keys.type):
        return tx.mix(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + salt)
    data, offs = tx.flat(keys)
    out = np.zeros(len(keys), np.uint64)
    full = np.flatnonzero(np.diff(offs) > 0)
    out[full] = tx.hashes(data, offs[full], offs[full + 1])
    return tx.mix(out + salt)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(max(segments, 1))).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (tx.mix(h ^ _SLOT) >> np.uint64(33)).astype(np.int32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (tx.mix(h + _SLOT) % np.uint64(max(1, -(-n // KEYS_PER_BUCKET)))).astype(np.int64)


def slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (tx.mix(h ^ tx.mix(pilot.astype(np.uint64) * _SLOT + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the buckets, and each key's slot, for distinct key hashes."""
    n = len(h)
    b = _bucket(h, n)
    pilots = np.zeros(max(1, -(-n // KEYS_PER_BUCKET)), np.int32)
    order = np.argsort(b, kind="stable")
    size = np.bincount(b, minlength=len(pilots))
    first = np.cumsum(size) - size
    taken, out = np.zeros(n, bool), np.zeros(n, np.int64)
    for k in np.argsort(-size, kind="stable"):
        if size[k] == 0:
            break
        at = order[first[k] : first[k] + size[k]]
        lo, step = 0, 32
        while True:
            tries = np.arange(lo, lo + step)
            s = slot(h[at][None, :], tries[:, None], n)
            free = ~taken[s].any(1)
            if len(at) > 1:
                t = np.sort(s, 1)
                free &= (t[:, 1:] != t[:, :-1]).all(1)
            if free.any():
                i = int(free.argmax())
                pilots[k], out[at] = lo + i, s[i]
                taken[s[i]] = True
                break
            lo += step
            step = min(step * 2, 4096)
    return pilots, out


def _shards(batches, base: str, vocabulary: str, segments: int, seed: int):
    enc = tokens.encoder(vocabulary)
    task = TaskContext.get()
    name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
    system, path = fs.FileSystem.from_uri(base)
    out, at = None, 0
    try:
        for b in tx.slices(batches, "text"):
            key = b.column("doc_id")
            ids, offs = enc.encode(*tx.flat(b.column("text")))
            h = key_hash(key, seed)
            full = np.flatnonzero(np.diff(offs) > 0)
            digest = np.zeros(len(key), np.uint64)
            if len(full):
                raw = ids.view(np.uint8)
                w = ids.itemsize
                digest[full] = tx.hashes(raw, offs[full] * w, offs[full + 1] * w)
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}")
                out.write(raw.tobytes())
            yield pa.RecordBatch.from_arrays([key, pa.array(segment_of(h, segments)), pa.array([name] * len(key)), pa.array(at + offs[:-1] * ids.itemsize), pa.array(np.diff(offs).astype(np.int32)), pa.array(digest.view(np.int64))], names=["doc_id", "segment", "shard", "offset", "n_ids", "digest"])
            at += len(ids) * ids.itemsize
    finally:
        if out is not None:
            out.close()


def _segment(t: pa.Table, seed: int, shards: dict[str, int]) -> tuple[bytes, int, pa.RecordBatch]:
    """A segment's part of the index file, its number of keys, and rows of them by slot."""
    n_ids, digest = t.column("n_ids").to_numpy(), t.column("digest").to_numpy()
    key = pc.rank(t.column("doc_id"), "ascending", tiebreaker="dense").to_numpy()
    at = np.lexsort((digest, -n_ids, key))
    first = np.ones(len(at), bool)
    first[1:] = key[at][1:] != key[at][:-1]
    t = t.take(pa.array(at[first]))
    h = key_hash(t.column("doc_id").combine_chunks(), seed)
    if len(np.unique(h)) < len(h):
        raise ValueError("two keys have one hash: choose another seed")
    pilots, s = build(h)
    rows = np.empty(len(h), np.int64)
    rows[s] = np.arange(len(h))
    t = t.take(pa.array(rows))
    entry = np.zeros(len(h), ENTRY)
    entry["print"] = fingerprint(h)[rows]
    entry["shard"] = [shards[x] for x in t.column("shard").to_pylist()]
    entry["offset"], entry["n_ids"] = t.column("offset").to_numpy(), t.column("n_ids").to_numpy()
    cols = [t.column("doc_id"), t.column("segment"), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(entry["print"].astype(np.int32)), t.column("shard"), t.column("offset"), t.column("n_ids")]
    batch = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["doc_id", "segment", "slot", "fingerprint", "shard", "offset", "n_ids"])
    return pilots.astype("<i4").tobytes() + entry.tobytes(), len(h), batch


def _indexed(batches, base: str, seed: int, shards: dict[str, int], length: int):
    """Writes an index file for every run of ``length`` segments in rows sorted by segment, which may span batches; yields the rows of their keys."""
    system, path = fs.FileSystem.from_uri(base)
    attempt = TaskContext.get().taskAttemptId()
    held: list[pa.RecordBatch] = []
    parts: dict[int, tuple[bytes, int]] = {}
    rows: list[pa.RecordBatch] = []
    run = -1

    def close():
        at, out = length * PLACE.itemsize, []
        table = np.zeros(length, PLACE)
        for seg, (raw, n) in sorted(parts.items()):
            table[seg % length] = at, n
            out.append(raw)
            at += len(raw)
        name = f"index-{run:06d}-{attempt}.bin"
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(table.tobytes() + b"".join(out))
        for b in rows:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name] * b.num_rows)], names=[*b.schema.names, "file"])
        parts.clear()
        rows.clear()

    def done():
        raw, n, batch = _segment(pa.Table.from_batches(held).combine_chunks(), seed, shards)
        parts[held[0].column("segment")[0].as_py()] = raw, n
        rows.append(batch)

    for b in batches:
        seg = b.column("segment").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)]
        for lo, hi in zip(cut, cut[1:]):
            if hi == lo:
                continue
            if held and held[-1].column("segment")[0].as_py() != seg[lo]:
                done()
                held = []
            if parts and seg[lo] // length != run:
                yield from close()
            run = int(seg[lo]) // length
            held.append(b.slice(lo, hi - lo))
    if held:
        done()
        yield from close()


@dataclass
class Shards:
    path: str
    segments: int
    length: int
    width: int
    seed: int
    names: list[str]
    index: DataFrame

    def entries(self) -> DataFrame:
        """Rows (doc_id, segment, slot, fingerprint, shard, offset, n_ids), one a key."""
        return self.index.drop("file")

    def reader(self) -> Reader:
        files = {int(r.file.split("-")[1]): r.file for r in self.index.select("file").distinct().collect()}
        return Reader(self.path, self.segments, self.length, self.width, self.seed, self.names, files)


class Reader:
    """Keyed access by positional reads; needs no Spark. Up to ``most`` files stay open."""

    def __init__(self, path: str, segments: int, length: int, width: int, seed: int, names: list[str], files: dict[int, str], most: int = 64):
        self.segments, self.length, self.width, self.seed, self.names, self.files, self.most = segments, length, width, seed, names, files, most
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.open: dict = {}
        self.reads = 0

    def _read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        self.reads += 1
        return self.open[name].read_at(size, at)

    def get(self, key: int | str) -> np.ndarray | None:
        """The document's ids, or None if its fingerprint isn't in the index."""
        h = key_hash(pa.array([key]), self.seed)
        seg = int(segment_of(h, self.segments)[0])
        file = self.files.get(seg // self.length)
        if file is None:
            return None
        at, n = np.frombuffer(self._read(file, seg % self.length * PLACE.itemsize, PLACE.itemsize), PLACE)[0]
        if n == 0:
            return None
        pilots = max(1, -(-int(n) // KEYS_PER_BUCKET))
        pilot = np.frombuffer(self._read(file, int(at) + 4 * int(_bucket(h, int(n))[0]), 4), "<i4")
        s = int(slot(h, pilot, int(n))[0])
        e = np.frombuffer(self._read(file, int(at) + 4 * pilots + s * ENTRY.itemsize, ENTRY.itemsize), ENTRY)[0]
        if int(e["print"]) != int(fingerprint(h)[0]):
            return None
        kind = "<u2" if self.width == 2 else "<u4"
        return np.frombuffer(self._read(self.names[e["shard"]], int(e["offset"]), int(e["n_ids"]) * self.width), kind) if e["n_ids"] else np.zeros(0, kind)


def write_shards(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, path: str | None = None, keys_per_segment: int = KEYS_PER_SEGMENT, seed: int = 0) -> Shards:
    """Write the ids of all documents to shards under ``path`` (default: a new folder in the shared one) and index them."""
    spark: SparkSession = docs.sparkSession
    path = path or f"{store.shared_dir(spark)}/wavelark/ids-{uuid.uuid4().hex}"
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    segments = -(-docs.count() // keys_per_segment)
    schema = f"doc_id {kind}, segment long, shard string, offset long, n_ids int, digest long"
    entries = store.save(docs.mapInArrow(lambda b: _shards(b, path, vocabulary, segments, seed), schema), "entries")
    names = sorted(r[0] for r in entries.select("shard").distinct().collect())
    held = spark.sparkContext.broadcast({x: k for k, x in enumerate(names)})
    # a file's segments are in one task, in order; small tables have shorter files, so that all tasks have some
    length = min(SEGMENTS, max(1, -(-segments // spark.sparkContext.defaultParallelism)))
    ranged = entries.withColumn("run", F.floor(F.col("segment") / F.lit(length))).repartition("run").sortWithinPartitions("segment").drop("run")
    schema = f"doc_id {kind}, segment long, slot int, fingerprint int, shard string, offset long, n_ids int, file string"
    index = store.save(ranged.mapInArrow(lambda b: _indexed(b, path, seed, held.value, length), schema), "index")
    store.drop(entries)
    return Shards(path, segments, length, np.dtype(tokens.encoder(vocabulary).kind).itemsize, seed, names, index)
