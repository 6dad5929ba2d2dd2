"""Main-text extraction from HTML by flat text blocks and a decision tree.

A page is cut into a flat sequence of text blocks at block-level tags. A
block is described by its word count and link density and those of its two
neighbours, and a decision tree, trained on the labelled table ``LABELLED``
by information gain, says whether it is content. The extracted text is the
content blocks, one a line.

Defined cases: a null or empty page, or one without text, has the text ''
and no blocks; unclosed and unknown tags, comments and broken markup are
read as browsers do (a '<' that begins no tag is text; an unclosed script,
style or comment runs to the end); repeated rows are extracted one by one; a
block at either end has an empty neighbour; a leaf of even votes is content;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")

#: Word count, link density, those of the block before and of the one after; 1 for content. Made by hand from common page shapes.
LABELLED = [
    # menus and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0), (3, 1.0, 2, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 7, 0.0, 0),
    (4, 1.0, 3, 1.0, 5, 1.0, 0), (6, 1.0, 4, 1.0, 6, 1.0, 0), (9, 1.0, 8, 1.0, 10, 1.0, 0), (12, 0.9, 9, 1.0, 11, 1.0, 0), (8, 0.75, 12, 1.0, 3, 1.0, 0),
    (2, 1.0, 45, 0.0, 2, 1.0, 0), (1, 1.0, 30, 0.02, 1, 1.0, 0), (3, 1.0, 60, 0.0, 9, 0.3, 0), (5, 0.8, 2, 1.0, 40, 0.0, 0), (15, 0.7, 10, 0.9, 14, 0.8, 0),
    (25, 0.6, 15, 0.7, 20, 0.8, 0), (22, 0.9, 30, 0.9, 18, 1.0, 0), (11, 0.5, 9, 0.5, 12, 0.6, 0), (7, 0.45, 3, 1.0, 4, 1.0, 0), (40, 0.55, 20, 0.6, 3, 1.0, 0),
    # advertisements, notices and footers, beside links or page ends
    (5, 0.0, 1, 1.0, 8, 0.0, 0), (7, 0.0, 1, 1.0, 11, 0.0, 0), (8, 0.0, 2, 1.0, 9, 0.0, 0), (6, 0.0, 1, 1.0, 4, 0.0, 0), (9, 0.0, 1, 1.0, 6, 0.0, 0),
    (4, 0.0, 35, 0.0, 1, 1.0, 0), (3, 0.0, 50, 0.0, 0, 0.0, 0), (5, 0.0, 28, 0.0, 0, 0.0, 0), (6, 0.2, 40, 0.0, 0, 0.0, 0), (8, 0.1, 1, 1.0, 0, 0.0, 0),
    (7, 0.0, 2, 1.0, 0, 0.0, 0), (10, 0.3, 2, 1.0, 0, 0.0, 0), (4, 0.0, 1, 1.0, 3, 1.0, 0), (3, 0.0, 4, 1.0, 2, 1.0, 0), (2, 0.0, 5, 1.0, 5, 1.0, 0),
    (9, 0.3, 3, 1.0, 2, 1.0, 0), (2, 0.0, 0, 0.0, 1, 1.0, 0), (5, 0.0, 0, 0.0, 2, 1.0, 0), (3, 0.0, 0, 0.0, 4, 0.9, 0), (12, 0.4, 6, 0.5, 0, 0.0, 0),
    (4, 0.0, 3, 0.0, 1, 1.0, 0), (6, 0.0, 2, 1.0, 7, 0.6, 0), (1, 0.0, 1, 1.0, 1, 0.0, 0), (3, 0.0, 20, 0.6, 4, 0.5, 0), (8, 0.0, 1, 1.0, 2, 0.0, 0),
    # copyright lines that end a page, longer than most headings and shorter than most paragraphs
    (7, 0.0, 40, 0.0, 0, 0.0, 0), (8, 0.0, 25, 0.0, 0, 0.0, 0), (9, 0.1, 60, 0.0, 0, 0.0, 0), (10, 0.0, 15, 0.0, 0, 0.0, 0), (11, 0.0, 48, 0.0, 0, 0.0, 0),
    (12, 0.0, 33, 0.0, 0, 0.0, 0), (13, 0.0, 90, 0.0, 0, 0.0, 0), (14, 0.0, 20, 0.0, 0, 0.0, 0), (15, 0.2, 55, 0.0, 0, 0.0, 0), (16, 0.0, 8, 0.0, 0, 0.0, 0),
    (17, 0.0, 30, 0.0, 0, 0.0, 0), (9, 0.0, 5, 0.0, 0, 0.0, 0), (12, 0.0, 120, 0.0, 0, 0.0, 0), (11, 0.0, 6, 0.0, 0, 0.0, 0), (15, 0.0, 210, 0.0, 0, 0.0, 0),
    # the last link of a menu, before a heading or a paragraph
    (1, 1.0, 1, 1.0, 43, 0.0, 0), (2, 1.0, 1, 1.0, 60, 0.0, 0), (1, 1.0, 2, 1.0, 8, 0.0, 0), (3, 1.0, 1, 1.0, 120, 0.0, 0), (1, 1.0, 1, 1.0, 25, 0.0, 0),
    (2, 1.0, 2, 1.0, 14, 0.0, 0), (1, 1.0, 1, 1.0, 5, 0.0, 0), (4, 1.0, 3, 1.0, 35, 0.0, 0),
    # the last link of a page's end, and single links between paragraphs
    (1, 1.0, 1, 1.0, 0, 0.0, 0), (2, 1.0, 3, 1.0, 0, 0.0, 0), (3, 1.0, 40, 0.0, 50, 0.0, 0), (1, 1.0, 60, 0.0, 12, 0.0, 0), (1, 1.0, 0, 0.0, 0, 0.0, 0),
    # paragraphs that end a page
    (24, 0.0, 40, 0.0, 0, 0.0, 1), (40, 0.0, 12, 0.0, 0, 0.0, 1), (75, 0.0, 90, 0.0, 0, 0.0, 1), (22, 0.0, 60, 0.0, 0, 0.0, 1), (30, 0.1, 20, 0.0, 0, 0.0, 1),
    # paragraphs
    (45, 0.0, 30, 0.0, 50, 0.0, 1), (60, 0.02, 8, 0.0, 70, 0.0, 1), (120, 0.01, 80, 0.0, 90, 0.03, 1), (25, 0.0, 40, 0.0, 35, 0.0, 1), (18, 0.0, 22, 0.0, 30, 0.0, 1),
    (80, 0.1, 60, 0.05, 3, 1.0, 1), (35, 0.15, 50, 0.0, 0, 0.0, 1), (55, 0.25, 40, 0.1, 45, 0.1, 1), (200, 0.0, 0, 0.0, 0, 0.0, 1), (30, 0.0, 1, 1.0, 45, 0.0, 1),
    (70, 0.0, 2, 1.0, 0, 0.0, 1), (16, 0.0, 1, 1.0, 60, 0.0, 1), (28, 0.3, 35, 0.1, 40, 0.0, 1), (22, 0.0, 50, 0.0, 1, 1.0, 1), (17, 0.05, 40, 0.0, 2, 1.0, 1),
    (300, 0.05, 5, 0.0, 20, 0.5, 1), (40, 0.0, 4, 0.0, 1, 1.0, 1), (33, 0.0, 6, 0.0, 6, 0.0, 1), (90, 0.0, 0, 0.0, 1, 1.0, 1), (14, 0.0, 60, 0.0, 25, 0.0, 1),
    # headings and short paragraphs between paragraphs
    (8, 0.0, 9, 0.0, 9, 0.0, 1), (7, 0.0, 8, 0.0, 60, 0.0, 1), (5, 0.0, 40, 0.0, 55, 0.0, 1), (3, 0.0, 70, 0.0, 45, 0.0, 1), (9, 0.0, 7, 0.0, 30, 0.0, 1),
    (4, 0.0, 35, 0.0, 28, 0.0, 1), (11, 0.0, 8, 0.0, 11, 0.0, 1), (2, 0.0, 90, 0.0, 80, 0.0, 1), (12, 0.0, 20, 0.0, 33, 0.0, 1), (10, 0.0, 5, 0.0, 10, 0.0, 1),
    (6, 0.0, 6, 0.0, 40, 0.0, 1), (5, 0.0, 12, 0.0, 5, 0.0, 1), (13, 0.1, 30, 0.0, 8, 0.0, 1), (6, 0.0, 60, 0.0, 5, 0.0, 1), (4, 0.0, 5, 0.0, 22, 0.0, 1),
    (9, 0.2, 25, 0.0, 30, 0.1, 1), (1, 0.0, 44, 0.0, 38, 0.0, 1), (7, 0.0, 25, 0.1, 12, 0.0, 1), (11, 0.0, 45, 0.0, 9, 0.0, 1), (10, 0.0, 33, 0.0, 18, 0.0, 1),
]

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<[!?][^>]*>", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = frozenset(("title", "head"))
_SPACE = re.compile(r"\s+")


def tree(rows: list[tuple], depth: int = 5, least: int = 2):
    """A decision tree by information gain: (feature, limit, below, above) or a leaf's share of content."""
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)

    def entropy(p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return -p * np.log2(p) - (1 - p) * np.log2(1 - p)

    def grow(at: np.ndarray, left: int):
        share = float(y[at].mean())
        if left == 0 or share in (0.0, 1.0):
            return share
        best = None
        for f in range(x.shape[1]):
            order = at[np.argsort(x[at, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
                if i < least or len(at) - i < least:
                    continue
                cost = (i * entropy(c[i - 1] / i) + (len(at) - i) * entropy((c[-1] - c[i - 1]) / (len(at) - i))) / len(at)
                if best is None or cost < best[0] - 1e-12:
                    best = (float(cost), f, float(v[i - 1] + v[i]) / 2)
        if best is None or best[0] >= entropy(share) - 1e-9:
            return share
        _, f, limit = best
        low = x[at, f] <= limit
        return (f, limit, grow(at[low], left - 1), grow(at[~low], left - 1))

    return grow(np.arange(len(y)), depth)


def classify(node, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is content."""
    out = np.zeros(len(x), bool)

    def walk(node, at):
        if not isinstance(node, tuple):
            out[at] = node >= 0.5
        elif len(at):
            low = x[at, node[0]] <= node[1]
            walk(node[2], at[low])
            walk(node[3], at[~low])

    walk(node, np.arange(len(x)))
    return out


def blocks(page: str) -> list[tuple[str, int, int]]:
    """Flat text blocks of a page: text, words and words inside links."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = at = 0
    link = hidden = False

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                out.append((text, n, min(linked, n)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            if link:
                linked += len(text.split())

    for m in _TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            link = not m[2]
        elif name in _HIDDEN:
            close()
            hidden = not m[2]
        elif name == "body":
            close()
            hidden = False
        elif name not in _INLINE:
            close()
    add(page[at:])
    close()
    return out


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """A row of FEATURES for every block."""
    own = np.array([(n, k / n) for _, n, k in found], float).reshape(-1, 2)
    pad = np.zeros((1, 2))
    return np.concatenate([own, np.concatenate([pad, own[:-1]])[: len(own)], np.concatenate([own[1:], pad])[: len(own)]], 1)


def extract(pages: DataFrame, labelled: list[tuple] | None = None, depth: int = 5) -> DataFrame:
    """Rows (page_id, text, n_blocks, n_content) for every page."""
    model = tree(labelled or LABELLED, depth)
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = [blocks(p or "") for p in part.column("html").to_pylist()]
                x = [features(f) for f in found]
                ok = classify(model, np.concatenate(x))
                at, text, kept = 0, [], []
                for f in found:
                    own = ok[at : at + len(f)]
                    at += len(f)
                    text.append("\n".join(t for (t, _, _), k in zip(f, own) if k))
                    kept.append(int(own.sum()))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(text, pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "text", "n_blocks", "n_content"])

    return pages.select("page_id", "html").mapInArrow(work, f"page_id {kind}, text string, n_blocks long, n_content long")
