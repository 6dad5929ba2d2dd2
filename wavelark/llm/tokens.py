"""Byte-pair token ids of whole texts, computed batch-wise.

The split into pieces (letters, digits, other marks, white space; a space
joins the piece after it; English contractions) is done on code-point
arrays for a batch at once. Equal pieces are encoded once a process: a cache
of at most ``CACHE`` pieces maps their 64-bit hashes to ids.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa

from . import store
from . import text as tx

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 700_000
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_KIND: list[np.ndarray] = []
_ENCODERS: dict[str, Encoder] = {}


def _kinds() -> np.ndarray:
    """Of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    if not _KIND:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kind[c] = 1
            elif k == "N":
                kind[c] = 2
        kind[_SPACES] = 3
        _KIND.append(kind)
    return _KIND[0]


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the pieces of all texts, and each one's row."""
    if len(data) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at_byte = np.append(lead, len(data))
    cut = np.searchsorted(lead, np.unique(offs[:-1][np.diff(offs) > 0]))
    kind = _kinds()[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[cut] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == 3
    last = np.zeros(n, bool)  # the last white space before ink in one text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last
    joins = np.flatnonzero(last & (cp == 32)) + 1
    start[joins] = False
    quote = np.flatnonzero((cp[:-1] == 39) & (kind[1:] == 1) & start[:-1] & ~first[1:n])
    for q in quote:
        a, b = int(cp[q + 1]), int(cp[q + 2]) if q + 2 < n and not first[q + 2] else 0
        size = 1 if a in (100, 109, 115, 116) else 2 if (a, b) in ((108, 108), (118, 101), (114, 101)) else 0
        if size:
            start[q + 1] = False
            if q + 1 + size < n:
                start[q + 1 + size] = True
    begin = at_byte[np.flatnonzero(start)]
    row = np.searchsorted(offs, begin, "right") - 1
    return np.append(begin, len(data)), row


class Encoder:
    """Ids by byte-pair merges from a ranks file."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._one = self.plain._core_bpe.encode_single_piece
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.hash, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _learn(self, raw: bytes, h: np.ndarray, b: np.ndarray, e: np.ndarray) -> None:
        if len(self.hash) > CACHE:
            self.forget()
        got = [self._one(raw[i:j]) for i, j in zip(b.tolist(), e.tolist())]
        count = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((x for g in got for x in g), self.kind, int(count.sum()))
        first = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        both = np.concatenate([self.hash, h])
        order = np.argsort(both, kind="stable")
        self.hash, self.first, self.count = both[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]

    def places(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the cache's ids and number of ids of every piece, and its row."""
        bounds, row = pieces(data, offs)
        if len(row) == 0:
            return (np.zeros(0, np.int64),) * 3
        h = tx.hashes(data, bounds[:-1], bounds[1:])
        u, i, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, u), max(len(self.hash) - 1, 0))
        new = self.hash[at] != u if len(self.hash) else np.ones(len(u), bool)
        if new.any():
            if len(self.hash) + new.sum() > CACHE:
                self.forget()
                new[:] = True
            self._learn(data.tobytes(), u[new], bounds[:-1][i[new]], bounds[1:][i[new]])
            at = np.searchsorted(self.hash, u)
        return self.first[at][inv], self.count[at][inv], row

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their offsets by row."""
        first, count, row = self.places(data, offs)
        per = np.bincount(row, count, len(offs) - 1).astype(np.int64)
        return tx.ragged(self.ids, first, first + count), np.concatenate([[0], np.cumsum(per)])

    def count_ids(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        _, count, row = self.places(data, offs)
        return np.bincount(row, count, len(offs) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.plain.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def encoder(path: str = VOCABULARY) -> Encoder:
    """The process's encoder for this ranks file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def lengths(docs, key: str = "doc_id", vocabulary: str = VOCABULARY):
    """Rows (key, n_ids long): ids in every document's text; a null text has none."""
    store.small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        enc = encoder(vocabulary)
        for b in tx.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(enc.count_ids(*tx.flat(b.column("text"))))], names=[key, "n_ids"])

    return docs.select(key, "text").mapInArrow(count, f"`{key}` {kind}, n_ids long")
