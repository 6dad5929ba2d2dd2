"""Corpus operators against brute force, and their defined cases."""

import os
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelark.llm import decontaminate, html, jaccard, langid, licenses, linededup, lm, mphf, packing, queries, tokens, topk
from wavelark.llm import text as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words="the of and to in it was for on as with that this from have not are but had his".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "ing", "er", "s"]) for _ in range(n))


def docs(spark, texts, extra=None):
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)
    return df.withColumn(extra, F.lit("clash")) if extra else df


def odd(spark, extra):
    """Null, empty, blank, repeated and very long texts, a null id, a null language and a clashing column."""
    long = prose(random.Random(5), 60000)
    rows = [(0, None, "en"), (1, "", "en"), (2, "  \n ", None), (3, "one two three four five", "en"), (3, "one two three four five", "en"), (None, "one two three four five", "fr"), (4, long, "en"), (5, "x", "fr")]
    return spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], DOCS).withColumn(extra, F.lit("clash"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark):
    rng = random.Random(1)
    fr = "le la les un une et est dans pour que qui sur pas avec".split()
    rows = [(k, prose(rng, 80) if k % 2 else prose(rng, 80, fr), "en" if k % 2 else "fr", "s", 0) for k in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    m = langid.train(df.where("doc_id < 40"))
    got = langid.identify(df.where("doc_id >= 40"), m).collect()
    assert all(r.pred_lang == r.lang and r.accepted for r in got)
    junk = "".join(chr(random.Random(k).randrange(33, 126)) for k in range(600))
    assert not langid.identify(docs(spark, [junk]), m).first().accepted
    # code lengths are those of the definition: escape to shorter contexts, exclusion, uniform at the end
    small = langid.fit({"a": ["abab", "abc"]}, order=1, min_count=1)
    total = 0.0
    for j in range(256):
        b = bytes([97, j]) if j < 128 else None
        if b is not None and not (65 <= j <= 90):
            d, o = np.frombuffer(b, np.uint8), np.array([0, 2])
            first = langid.code_lengths(small, d[:1], np.array([0, 1]))[0, 0]
            total += 2 ** -(langid.code_lengths(small, d, o)[0, 0] - first)
    assert 0.5 < total <= 1.001
    r = langid.identify(odd(spark, "accepted"), m).collect()
    assert [x.pred_lang for x in r if not (x.text or "").strip()] == ["und"] * 3 and len(r) == 8
    assert langid.identify(empty(spark), m).count() == 0
    assert {x.pred_lang for x in langid.identify(odd(spark, "margin"), langid.train(empty(spark))).collect()} == {"und"}
    assert langid.accept(df, m).columns == df.columns


def brute_ppm(texts, alphabet, order, min_count, nodes, text):
    """Bits of a text under one language's tree, byte by byte with dictionaries: escape to the next shorter context, bytes seen there ruled out."""
    def pad(t):
        return b"\n" * order + t.lower().encode()

    n = {}
    for t in map(pad, texts):
        for i in range(order, len(t)):
            for k in range(order + 1):
                n.setdefault(t[i - k : i], Counter())[t[i]] += 1
    unseen = 256 - len(alphabet)

    def p(ctx, x):
        """Of every seen byte and of one unseen."""
        if ctx is None:
            return 1 / 256
        shorter = p_all(ctx[1:] if ctx else None)
        c = n.get(ctx)
        if not c:
            return shorter[x]
        total, kinds = sum(c.values()), len(c)
        if x in c:
            return c[x] / (total + kinds)
        return kinds / (total + kinds) * shorter[x] / sum(q for y, q in shorter.items() if y not in c)

    cache = {}

    def p_all(ctx):
        if ctx not in cache:
            if ctx is None:
                cache[ctx] = {y: 1 / 256 for y in alphabet} | {"unseen": max(unseen, 1) / 256}
                total = sum(cache[ctx].values())
                cache[ctx] = {y: q / total for y, q in cache[ctx].items()}
            else:
                cache[ctx] = {y: p(ctx, y) for y in [*alphabet, "unseen"]}
        return cache[ctx]

    bits, t = 0.0, pad(text)
    for i in range(order, len(t)):
        ctx = b""
        for k in range(1, order + 1):
            if t[i - k : i] not in nodes:
                break
            ctx = t[i - k : i]
        x = t[i] if t[i] in alphabet else "unseen"
        bits -= np.log2(p_all(ctx)[x]) - (np.log2(max(unseen, 1)) if x == "unseen" else 0)
    return bits


def brute_nodes(texts, order, min_count):
    """The bytes seen, and the contexts of the tree."""
    alphabet = sorted({b for own in texts.values() for t in own for b in t.lower().encode()} | {10})
    nodes = {b""}
    for k in range(1, order + 1):
        kept = set()
        for own in texts.values():
            c = Counter()
            for t in own:
                raw = b"\n" * order + t.lower().encode()
                c.update(raw[i - k : i] for i in range(order, len(raw)))
            kept |= {ctx for ctx, x in c.items() if x >= min_count}
        nodes |= {ctx for ctx in kept if ctx[1:] in nodes}
    return alphabet, nodes


def test_language_brute_force():
    rng = random.Random(20)
    texts = {"en": [prose(rng, 30) for _ in range(6)], "fr": [prose(rng, 30, "le la une été où garçon dans".split()) for _ in range(6)]}
    order, min_count = 3, 4
    m = langid.fit(texts, order, min_count)
    alphabet, nodes = brute_nodes(texts, order, min_count)
    tests = [prose(rng, 20), "où est le GARÇON", "\x01漢字 zz", "a"]
    got = langid.code_lengths(m, *tx.flat(pa.array(tests)))
    for k, t in enumerate(tests):
        for j, lang in enumerate(m.langs):
            assert abs(got[k, j] - brute_ppm(texts[lang], alphabet, order, min_count, nodes, t.lower() if t.isascii() else t.replace("GARÇON", "garçon"))) < 1e-3 * max(1, len(t))


def test_language_ties(spark):
    same = {"b": ["one two three"], "a": ["one two three"]}
    r = langid.identify(docs(spark, ["one two"]), langid.fit(same, 2, 1)).first()
    assert r.pred_lang == "a" and r.margin == 0


def test_line_dedup(spark):
    rng = random.Random(2)
    texts = [prose(rng, 30) + "\n" + f"Posted on day {k} by user {k * 7} in the forum\n" + prose(rng, 30) + "\n\nend" for k in range(12)]
    out = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert out[k].text == re.sub(r"Posted on day.*\n", "", t) and out[k].n_dropped == 1 and out[k].n_chars == len(out[k].text)
    # whole copies keep their lines: the near-duplicate join decides on them
    body = "\n".join(prose(rng, 12) for _ in range(6))
    assert all(r.n_dropped == 0 for r in linededup.dedup_lines(docs(spark, [body] * 20)).collect())
    # rows of numbers have no fixed words in common
    numbers = [prose(rng, 30) + "\n" + " ".join(str(rng.randrange(1000)) for _ in range(6)) + "\n" + prose(rng, 30) for _ in range(12)]
    assert all(r.n_dropped == 0 for r in linededup.dedup_lines(docs(spark, numbers)).collect())
    # the joined way gives the same as the broadcast one
    d = docs(spark, texts)
    hot = linededup.recurring_lines(d)
    a, b = (sorted(map(tuple, linededup.drop_lines(d, hot, n).collect())) for n in (1000, 0))
    assert a == b
    got = linededup.dedup_lines(odd(spark, "n_lines2")).collect()
    assert len(got) == 8 and [r.text for r in got if r.doc_id == 0] == [None] and linededup.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("clash", ["_key", "key", "line", "lines", "_hot", "n_lines", "N_Dropped"])
def test_line_dedup_clashes(spark, clash):
    rng = random.Random(16)
    d = docs(spark, [prose(rng, 30) + f"\nPosted on day {k} by user {k * 7} in the forum" for k in range(12)], clash)
    hot = linededup.recurring_lines(d)
    a, b = (sorted(map(tuple, linededup.drop_lines(d, hot, n, counts=False).collect())) for n in (1000, 0))
    assert a == b and linededup.dedup_lines(d, counts=False).columns == d.columns and all(r[-1] == "clash" and "Posted" not in r[1] for r in a)


def brute_lines(texts, min_docs=5, similarity=0.7, min_tokens=3):
    """Plain strings: the tree line by line, and documents that are copies by the trigrams of what is outside candidates."""
    def tokens(line):
        return tuple("*" if any(c.isdigit() for c in t) else t for t in line.lower().split())

    held = {}
    for k, text in enumerate(texts):
        for t in {tokens(x) for x in (text or "").split("\n")}:
            if len(t) >= min_tokens:
                held.setdefault(t, set()).add(k)
    leaves = {}
    for t in held:
        leaves.setdefault((len(t), tuple([(i, x) for i, x in enumerate(t) if x != "*"][:3])), []).append(t)
    made = []  # template, lines
    order = {t: int(linededup.Lines(*tx.flat(pa.array([" ".join("0" if x == "*" else x for x in t)]))).line[0]) for t in held}
    for lines in leaves.values():
        own = []
        for t in sorted(lines, key=lambda t: (-len(held[t]), order[t])):
            same = [sum(a == b and b != "*" for a, b in zip(m, t)) for m, _ in own]
            if same and max(same) >= similarity * len(t):
                m = own[same.index(max(same))]
                m[0][:] = [a if a == b else "*" for a, b in zip(m[0], t)]
                m[1].append(t)
            else:
                own.append((list(t), [t]))
        made += own
    some = [m for m in made if sum(x != "*" for x in m[0]) >= 0.5 * len(m[0]) and sum(len(held[t]) for t in m[1]) >= min_docs]
    cand = {t for m in some for t in m[1]}

    def grams(k, outside):
        rows = [tokens(x) for x in texts[k].split("\n")]
        flat = [(i, x) for i, r in enumerate(rows) for x in r]
        out = {tuple(x for _, x in flat[j : j + 3]) for j in range(len(flat) - 2) if flat[j][0] == flat[j + 2][0] and not (outside and rows[flat[j][0]] in cand)}
        n = sum(len(r) for r in rows), sum(len(r) for r in rows if r not in cand)
        return grams(k, False) if outside and n[1] * 3 <= n[0] else out

    def copies(i, j):
        return any(a and len(a & b) >= 0.1 * len(a | b) for a, b in ((grams(i, True), grams(j, False)), (grams(i, False), grams(j, True))))

    gone = set()
    for _, lines in some:
        apart = []
        for k in sorted(set().union(*(held[t] for t in lines))):
            if not any(copies(k, j) for j in apart):
                apart.append(k)
        if len(apart) >= min_docs:
            gone |= set(lines)
    return ["\n".join(x for x in t.split("\n") if not x.split() or tokens(x) not in gone) for t in texts]


def test_line_dedup_brute_force(spark):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4000)]
    sites = [f"Visit our site {a} {b} for the latest news today" for a, b in zip(words[:40], words[40:80])]
    texts = []
    for k in range(60):
        body = [prose(rng, rng.randint(4, 14), words) for _ in range(6)]
        body.insert(rng.randrange(6), rng.choice(sites))
        if k % 3 == 0:
            body.insert(rng.randrange(6), f"{k} 12:{k} posted by {rng.choice(words[:5])} in thread {k * 3}")
        if k % 9 == 0:
            body += ["a rare footer of six words", ""]
        if k % 20 == 0:
            body.append("only three have this line here")
        texts.append("\n".join(body))
    texts += [texts[7]] * 9 + [prose(rng, 40, words) + "\n" + f"single {k}" for k in range(3)]
    want = brute_lines(texts)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[k].strip("\n") for k in range(len(texts))] == [t.strip("\n") for t in want] and sum(a != b for a, b in zip(texts, want)) >= 60


def test_templates_index():
    """The index of segments changes nothing; equal similarity goes to the template founded first."""
    rng = np.random.default_rng(18)
    for size in (3, 4, 8, 12, 30):
        base = rng.integers(1, 60, (30, size)).astype(np.uint16)
        t = base[rng.integers(0, 30, 600)].copy()
        t[rng.random(t.shape) < 0.2] = 0
        other = rng.random(t.shape) < 0.15
        t[other] = rng.integers(1, 60, int(other.sum()))
        t[:, 0] = 7
        a, b = linededup.templates(t, 0.7), linededup.templates(t, 0.7, False)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(a[1]) > 20
    tie = np.array([[1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [1, 2, 3, 4, 5, 6, 17, 18, 19, 20], [1, 2, 3, 4, 5, 6, 7, 8, 19, 20]], np.uint16)
    assert linededup.templates(tie, 0.7)[0].tolist() == [0, 1, 0]


def test_templates_full():
    """Lines and templates with too many variable places for any line are left out of the search, which changes nothing."""
    rng = np.random.default_rng(23)
    for size, variable in ((5, 1), (10, 2), (10, 4), (20, 3)):
        t = rng.integers(1, 6, (400, size)).astype(np.uint16)
        t[:, 1 : 1 + variable] = 0
        t[rng.random(t.shape) < 0.05] = 0
        a, b = linededup.templates(t, 0.7), linededup.templates(t, 0.7, False)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_line_dedup_thinning(monkeypatch):
    """Signatures that come in many batches are thinned out in work in proportion to their number, with the result of comparing one by one."""
    rng = np.random.default_rng(24)
    n = 60_000
    sign = rng.integers(1, 250, (n, linededup.BINS)).astype(np.uint8)
    sign[n // 2 :] = sign[: n // 2]
    sign = np.concatenate([sign, sign], axis=1)
    of = np.tile(rng.integers(0, n // 8, n // 2), 2)
    seen, thinned = [], linededup._thinned
    monkeypatch.setattr(linededup, "_thinned", lambda of, sign, most: seen.append(len(of)) or thinned(of, sign, most))
    (out,) = linededup._combined(((of[k : k + 500], sign[k : k + 500]) for k in range(0, n, 500)), 5)
    assert sum(seen) <= 6 * n
    kinds = Counter(of[: n // 2].tolist())
    assert Counter(out.column("template").to_pylist()) == {t: min(5, c) for t, c in kinds.items()}
    # against one document at a time, in the order of the signatures' hashes
    of, sign = of[:3000] % 40, sign[:3000].copy()
    sign[rng.random(sign.shape) < 0.6] = 0
    order = np.lexsort((tx.mix((sign * tx._power(128)[:128]).sum(1, dtype=np.uint64)), of))
    want = {}
    for k in order:
        kept = want.setdefault(int(of[k]), [])
        alike = [any(((p == q) & (p > 0)).sum() >= 0.1 * ((p > 0) | (q > 0)).sum() for p, q in ((sign[j, 64:], sign[k, :64]), (sign[j, :64], sign[k, 64:]))) for j in kept]
        if len(kept) < 5 and not any(alike):
            kept.append(int(k))
    assert sorted(thinned(of, sign, 5).tolist()) == sorted(k for kept in want.values() for k in kept)


def test_line_dedup_few_trigrams_outside(spark):
    """A document with one trigram outside of a long common line isn't even like itself, and hides no other one."""
    rng = random.Random(25)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]
    line = " ".join(words[-18:])
    texts = ["\n".join([f"{line} {words[k]}", *words[20 * k + 20 : 20 * k + 29], " ".join(words[20 * k + 29 : 20 * k + 32])]) for k in range(12)]
    want = brute_lines(texts)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[k] for k in range(12)] == want and not any(line in t for t in want)


def test_line_dedup_distinct_documents(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    line = "Subscribe to our weekly newsletter today"
    # many copies of one document don't hide a line of unrelated ones
    texts = [prose(rng, 60, words) + "\n" + line for _ in range(10)]
    copied = docs(spark, texts + texts[:1] * 30)
    assert all(r.n_dropped == 1 and line not in r.text for r in linededup.dedup_lines(copied).collect())
    # nor do several lines of one template in a document
    authors = [prose(rng, 60, words) + "".join(f"\nThis article was written by {rng.choice(words)}" for _ in range(3)) for _ in range(12)]
    assert all(r.n_dropped == 3 for r in linededup.dedup_lines(docs(spark, authors)).collect())
    # what other lines recur beside it says nothing
    menu = [prose(rng, 9, words) for _ in range(6)]
    mixed = docs(spark, ["\n".join([*menu, prose(rng, 60, words)]) for _ in range(12)])
    assert all(r.n_dropped == 6 for r in linededup.dedup_lines(mixed).collect())
    # near copies, a tenth of whose words differ, keep their lines
    body = [[rng.choice(words) for _ in range(12)] for _ in range(10)]
    near = ["\n".join(" ".join(rng.choice(words) if rng.random() < 0.1 else w for w in b) for b in body) for _ in range(60)]
    assert all(r.n_dropped == 0 for r in linededup.dedup_lines(docs(spark, near)).collect())
    # joined and broadcast candidates give the same
    a, b = (sorted(r.line for r in linededup.recurring_lines(copied, broadcast_lines=n).collect()) for n in (1000, 0))
    assert a == b and len(a) == 1


def brute_jaccard(texts, threshold, n=3):
    def grams(t):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    g = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(g)):
        for j in range(i):
            if g[i] and len(g[i] & g[j]) >= threshold * len(g[i] | g[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def brute_links(texts, threshold, n=3):
    """For each text, its n-gram set's other sets at the threshold, and the best partner's similarity and row."""
    sets = [None] * len(texts)
    for k, t in enumerate(texts):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else None)
    out = {}
    for k, x in enumerate(sets):
        if x is None:
            continue
        pairs = [(len(x & y) / len(x | y), -j) for j, y in enumerate(sets) if y is not None and j != k]
        linked = {sets[-j] for s, j in pairs if s >= threshold and sets[-j] != x}
        best = max(pairs, default=(0, 0))
        if best[0] >= threshold:
            out[k] = (len(linked), best[0], -best[1])
    return out


def edited(rng, text, changes):
    w = text.split()
    for k in rng.sample(range(len(w)), changes):
        w[k] = "changed%d" % rng.randrange(10**6)
    return " ".join(w)


def test_jaccard(spark, monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(15)]
    for k in range(10):
        texts.append(edited(rng, texts[k], 1))
        texts.append(texts[k].upper())
    texts += [edited(rng, texts[12], rng.randint(1, 8)) for _ in range(30)]
    want, links = brute_jaccard(texts, 0.6), brute_links(texts, 0.6)
    for tile in (128, 7):  # a group in one tile, or in several
        monkeypatch.setattr(jaccard, "TILE", tile)
        rows = {r.doc_id: r for r in jaccard.near_duplicates(docs(spark, texts), 0.6, 0.999).collect()}
        assert [rows[k].group_id if k in rows else k for k in range(len(texts))] == want
        assert {k: (r.n_links, r.jaccard, r.partner_id) for k, r in rows.items()} == links
    assert all(r.class_id == (r.doc_id if r.doc_id < 15 or r.doc_id >= 35 or (r.doc_id - 15) % 2 == 0 else (r.doc_id - 16) // 2) for r in rows.values())
    kept = {r.doc_id for r in jaccard.drop_duplicates(docs(spark, texts), 0.6, 0.999).collect()}
    assert kept == {k for k, r in enumerate(want) if k == r}
    named = docs(spark, texts).withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    assert {int(r.doc_id[1:]): (r.n_links, r.jaccard, int(r.partner_id[1:])) for r in jaccard.near_duplicates(named, 0.6, 0.999).collect()} == links
    b, r = jaccard.bands_for(0.6, 0.97)
    assert 1 - (1 - 0.6**r) ** b >= 0.97 and b * r <= 128
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    assert jaccard.near_duplicates(odd(spark, "jaccard")).count() == 0
    assert jaccard.drop_duplicates(odd(spark, "h")).count() == 8


def test_jaccard_rows(spark):
    """Documents of one id with different texts are documents of their own."""
    rng = random.Random(14)
    x, y = prose(rng, 40), prose(rng, 40)
    rows = spark.createDataFrame([(1, x), (9, x), (9, y)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.drop_duplicates(rows).collect())) == sorted([(1, x), (9, y)])
    assert [(r.doc_id, r.partner_id) for r in jaccard.near_duplicates(rows).orderBy("doc_id").collect()] == [(1, 9), (9, 1)]
    twice = rows.union(rows)
    assert sorted(map(tuple, jaccard.drop_duplicates(twice).collect())) == sorted([(1, x), (9, y)] * 2)


def test_jaccard_common_passage(spark, monkeypatch):
    """Many documents with a common passage and no partner are verified against hubs only; a true pair among them is found."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(20000)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [passage + " " + " ".join(rng.choice(words) for _ in range(45)) for _ in range(2000)]
    texts.append(edited(rng, texts[700], 2))
    seen, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, sets, t: seen.append(pairs.count()) or verify(pairs, sets, t))
    got = sorted((r.doc_id, r.group_id, r.n_links) for r in jaccard.near_duplicates(docs(spark, texts)).collect())
    assert got == [(700, 700, 1), (2000, 700, 1)]
    assert sum(seen) < 12 * len(texts)


def sw(x, y):
    h = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(4)
    xs = [rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    ys = [rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    assert decontaminate.align(xs, ys).tolist() == [sw(x, y) for x, y in zip(xs, ys)]


def test_leaks(spark):
    rng = random.Random(6)
    vocab = ["w%d" % k for k in range(3000)]
    items = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(8)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, "a b c"), (99, None), (98, "")], "item_id long, text string")
    texts = [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(30)]
    texts[3] += " " + items[0].upper()
    edited = items[1].split()
    for k in range(3, 30, 6):
        edited[k] = "other"
    texts[5] = "start " + " ".join(edited[:14] + ["inserted"] + edited[14:]) + " " + texts[5]
    texts += [items[2]] * 25
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert set(got) == {(3, 0), (5, 1), *((k, 2) for k in range(30, 55))} and got[3, 0] == 1.0 and 0.4 <= got[5, 1] < 1
    several = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs(spark, texts), bench, most=3).collect()}
    assert several == got
    assert decontaminate.drop_leaks(docs(spark, texts, "score"), bench).count() == 28
    assert decontaminate.leaks(empty(spark), bench).count() == 0 and decontaminate.leaks(odd(spark, "item_id"), bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd(spark, "item_id"), bench).count() == 0


def test_leaks_brute_force(spark):
    """Every document aligned whole with every item; ids that are strings, repeated items and documents."""
    rng = random.Random(19)
    vocab = ["w%d" % k for k in range(400)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 6, 15, 40]))) for _ in range(25)]
    items += [items[3], "", "w1"]
    texts = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if k % 2:
            leak = rng.choice(items).split()
            for _ in range(rng.randint(0, len(leak) // 6)):
                leak[rng.randrange(len(leak))] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = leak
        texts.append(" ".join(w))
    texts.append(texts[1])
    h = {w: k for k, w in enumerate(vocab)}
    code = lambda t: np.array([h[w] for w in t.split()])
    want = {}
    for d, t in enumerate(texts):
        for i, u in enumerate(items):
            if u and t:
                score = sw(code(t), code(u)) / (2 * len(u.split()))
                if score >= 0.4:
                    want[f"d{d}", f"i{i}"] = score
    d = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    b = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(d, b).collect()}
    # nothing is found that isn't there, and all that keeps two seeds (one of a short item) near each other is
    assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())
    grams = lambda t, n: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    for (x, y), score in want.items():
        t, u = texts[int(x[1:])], items[int(y[1:])]
        shared = grams(t, min(3, len(u.split()))) & grams(u, min(3, len(u.split())))
        if len(shared) >= 3 or (len(u.split()) < 6 and shared):
            assert (x, y) in got
    assert len(got) > 50


def test_packing(spark):
    for seed in range(60):
        rng = random.Random(seed)
        size = rng.choice([5, 16, 64])
        h = Counter(rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 8)), size]) for _ in range(rng.randint(0, 300)))
        packs = []
        for length in sorted(h.elements(), reverse=True):
            short = min((p for p in packs if sum(p) < size), key=sum, default=None)
            packs.append([length]) if short is None or sum(short) + length > size else short.append(length)
        plan = packing.plan(h, size)
        got = Counter()
        for n, p in plan:
            assert n > 0 and sum(p) <= size
            for x in p:
                got[x] += n
        assert got == h and sum(n for n, _ in plan) == len(packs)
    lengths = spark.createDataFrame([(k, random.Random(k).randint(0, 90)) for k in range(300)] + [(7, 5), (None, 4)], "doc_id long, n_ids long")
    for rows in (500_000, 40):
        out = packing.pack_lengths(lengths, 32, bucket_rows=rows).toPandas()
        assert out.length.sum() == sum(r.n_ids for r in lengths.collect())
        filled = out[out.length > 0].sort_values(["pack_id", "pack_offset"])
        for _, g in filled.groupby("pack_id"):
            assert g.pack_offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 32
        assert filled.pack_id.nunique() == filled.pack_id.max() + 1
        assert out[out.length == 0].pack_id.isna().all()
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(odd(spark, "piece")).where("length > 0").count() > 30


def test_tokens():
    enc = tokens.Encoder()
    rng = random.Random(7)
    alphabet = "abc 's't'll\n\n  \té漢字٣²—.!?'’ 😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)] + [None, "", " ", "it's", "x's's"]
    ids, offs = enc.encode(*tx.flat(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == enc.plain.encode_ordinary(t or "")


def test_shards(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 50)) for _ in range(300)]
    for name, kind in (("a", "long"), ("n", "string")):
        for run in (1024, 2):  # segments in one index file
            monkeypatch.setattr(mphf, "SEGMENTS", run)
            d = docs(spark, texts, "segment").withColumn("doc_id", F.col("doc_id").cast(kind))
            s = mphf.write_shards(d, path=str(tmp_path / f"{name}{run}"), keys_per_segment=64)
            e = s.entries().toPandas()
            assert sorted(e.doc_id.astype(int)) == list(range(300)) and s.entries().schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
            assert all(sorted(g.slot) == list(range(len(g))) for _, g in e.groupby("segment"))
            r = s.reader()
            key = int if kind == "long" else str
            assert all(tokens.encoder().decode(r.get(key(k))) == t for k, t in enumerate(texts)) and r.get(key(10**12)) is None
            before = r.reads
            r.get(key(5))
            assert r.reads - before <= 4
            monkeypatch.undo()
    s = mphf.write_shards(odd(spark, "slot"), path=str(tmp_path / "b"))
    assert sorted(s.entries().toPandas().doc_id) == [0, 1, 2, 3, 4, 5] and len(s.reader().get(0)) == 0
    # of one key's texts the one with the most ids, of these the one whose ids hash lowest
    many = spark.createDataFrame([(1, "a b"), (1, "a b c d"), (1, "d c b a"), (2, None), (2, "x")], "doc_id long, text string")
    r = mphf.write_shards(many, path=str(tmp_path / "d")).reader()
    ids = [np.array(tokens.encoder().plain.encode_ordinary(t), np.uint16) for t in ("a b c d", "d c b a")]
    low = min(ids, key=lambda x: int(tx.hashes(x.view(np.uint8), np.array([0]), np.array([x.nbytes])).view(np.int64)[0]))
    assert r.get(1).tolist() == low.tolist() and tokens.encoder().decode(r.get(2)) == "x"
    none = mphf.write_shards(empty(spark), path=str(tmp_path / "c"))
    assert none.entries().count() == 0 and none.reader().get(1) is None


def test_topk(spark):
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate([rng.normal(c, 1, (40, 8)) for c in (0, 6, 12)]), 1).astype(np.float32)
    x = np.concatenate([x, x[:10], x[:1].repeat(15, 0)])
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None, ""), (None, x[0].tolist(), ""), (901, [1.0], ""), (902, [None] * 8, ""), (903, [float("inf")] + [0.0] * 7, ""), (904, [float("nan")] * 8, ""), rows[3]], "vec_id long, embedding array<float>, rank string")
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(k, r): int(j) for k in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[k]))[:5], 1)}
    for block in (8192, 20):
        got = {(r.vec_id, r["rank"]): r.neighbor_id for r in topk.neighbours(df, 5, None, block).collect()}
        assert got == want
        some = {(r.vec_id, r["rank"]): r.neighbor_id for r in topk.neighbours(df, 5, F.col("vec_id") % 7 == 0, block, 0 if block == 20 else 64).collect()}
        assert some == {(q, r): j for (q, r), j in want.items() if q % 7 == 0}
    named = df.where("vec_id < 145").withColumn("vec_id", F.format_string("v%03d", "vec_id"))
    assert {(int(r.vec_id[1:]), r["rank"]): int(r.neighbor_id[1:]) for r in topk.neighbours(named, 5, None, 20).collect()} == want
    assert topk.neighbours(df, 5, F.col("vec_id") > 5000).count() == 0
    assert topk.neighbours(df.limit(0), 5).count() == 0
    assert topk.neighbours(df.where("vec_id < 3"), 5).count() == 6


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"].replace("<year> <holder>", "2020 Some Body").upper().replace("SUBLICENSE", "sub-licence")
    texts = [mit, "intro\n\nReleased under the mit licence!\n\nend", "Licensed under the GPL", None, "", "all rights reserved", "Copyright (c) 2020\nReleased under the MIT License", "RELEASED under the MIT license\nReleased under the MIT License."]
    got = {(r.doc_id, r.unit, r.license, r.n) for r in licenses.scan(docs(spark, texts, "license")).collect()}
    assert got == {(0, "text", "MIT", 1), (1, "paragraph", "MIT-notice", 1), (1, "line", "MIT-notice", 1), (6, "text", "MIT-notice", 1), (6, "paragraph", "MIT-notice", 1), (6, "line", "MIT-notice", 1), (7, "line", "MIT-notice", 2)}
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(odd(spark, "digest")).count() == 0
    # of equal canonical texts the first by name; a null id is kept
    twice = {"B": "Some license text.", "A": "some LICENCE text"}
    null = spark.createDataFrame([(None, "Some license text")], "doc_id long, text string")
    assert {(r.doc_id, r.unit, r.license) for r in licenses.scan(null, twice).collect()} == {(None, u, "A") for u in ("text", "paragraph", "line")}
    # long texts by digest, where this machine has them
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    here = [(k, open(f"{folder}/{f}").read()) for k, f in enumerate(names) if os.path.exists(f"{folder}/{f}")]
    if here:
        long = spark.createDataFrame([(k, t.upper().replace("\n", "\r\n")) for k, t in here], "doc_id long, text string")
        assert {(r.doc_id, r.license) for r in licenses.scan(long).where("unit = 'text'").collect()} == {(k, list(names.values())[k]) for k, _ in here}
        assert all(licenses.whole_digest(t) == licenses.DIGESTS[list(names.values())[k]] for k, t in here)


@pytest.mark.parametrize("name", ["BSD-3-Clause", "BSD-2-Clause with title", "MIT without title", "Unlicense", "GPL-3.0-header", "ISC without title"])
def test_licenses_whole(spark, name):
    text = licenses.KNOWN[name].replace("<year> <holder>", "1999-2024, An Owner").replace(" and ", "  AND\n").replace("http:", "https:")
    assert [(r.license, r.n) for r in licenses.scan(docs(spark, [text])).where("unit = 'text'").collect()] == [(name, 1)]


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About</a></ul></nav><script>var a='<p>no</p>'</script><p>" + "word " * 40 + "<b>bold</b> a < b &amp; c<p>" + "text " * 30 + "<!-- hid <p>den --></p><ul><li><a href=x>Imprint</a></li><li><a href=y>Contact</a></ul>"
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (1, page, "x")], "page_id long, html string, text string")
    got = html.extract(pages).collect()
    assert got[0].text.split("\n") == [("word " * 40 + "bold a < b & c").strip(), ("text " * 30).strip()] and got[0].text == got[4].text
    assert [(r.text, r.n_blocks) for r in got[1:3]] == [("", 0), ("", 0)]
    assert html.extract(pages.limit(0)).count() == 0
    # held-out accuracy of the tree on its labelled table
    rows, hits = html.LABELLED, 0
    for k in range(5):
        model = html.tree([r for i, r in enumerate(rows) if i % 5 != k])
        held = [r for i, r in enumerate(rows) if i % 5 == k]
        hits += int((html.classify(model, np.array([r[:-1] for r in held])) == np.array([r[-1] for r in held], bool)).sum())
    assert hits / len(rows) > 0.85


class Plain(HTMLParser):
    """Blocks of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.parts, self.linked, self.link, self.skip = [], [], 0, False, None

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            n = len(text.split(" "))
            self.found.append((text, n, min(self.linked, n)))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs, end=False):
        if tag in ("script", "style", "template", "noscript", "head", "title"):
            if tag in ("head", "title"):
                self.close_block()
            self.skip = self.skip or tag
        elif tag == "body":
            self.close_block()
            self.skip = None
        elif tag == "a":
            self.link = not end
        elif tag not in html._INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        if self.skip == tag:
            self.skip = None
        elif not self.skip:
            self.handle_starttag(tag, [], True)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            self.linked += len(data.split()) if self.link else 0


def plain_extract(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.close_block()
    rows, kept = [(n, k / n) for _, n, k in p.found], []
    for i, own in enumerate(rows):
        x = (*own, *(rows[i - 1] if i else (0, 0)), *(rows[i + 1] if i + 1 < len(rows) else (0, 0)))
        node = html.tree(html.LABELLED)
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node >= 0.5:
            kept.append(p.found[i][0])
    return "\n".join(kept), len(rows)


def test_html_brute_force(spark, monkeypatch):
    """Whole pages as a plain parser and a walk down the tree have them."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html.tree(html.LABELLED)
    monkeypatch.setattr(html, "tree", lambda *a: model)
    got = {r.page_id: (r.text, r.n_blocks) for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) and sum(got[r.page_id] == plain_extract(r.html) for r in rows) == len(rows)
    # lines that end a page with a copyright sign aren't content
    ends = [html.blocks(r.html)[-1][0] for r in rows]
    assert sum(e.startswith("©") and e in got[r.page_id][0] for e, r in zip(ends, rows)) <= 0.05 * len(rows)


def test_html_long_and_ties(spark):
    page = "<p>" + "word " * 300000 + "</p>" + "<p><a href=x>link</a></p>" * 2000
    r = html.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert r.text == ("word " * 300000).strip() and (r.n_blocks, r.n_content) == (2001, 1)
    even = html.tree([(1, 0.0, 0, 0.0, 0, 0.0, 0), (1, 0.0, 0, 0.0, 0, 0.0, 1)])
    assert even == 0.5 and html.classify(even, np.zeros((1, 6))).tolist() == [True]


def brute_score(m, v, ids):
    """One document word by word with the plain formulas."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, total = np.zeros(m["U"].shape[0]), 0.0
    k = len(h)
    for x, y in zip([lm.END, *ids], [*ids, lm.END]):
        p, u = m["E"][x] @ m["W"] + m["b"], h @ m["U"]
        r, z = sig(p[:k] + u[:k]), sig(p[k : 2 * k] + u[k : 2 * k])
        n = np.tanh(p[2 * k :] + r * u[2 * k :])
        h = (1 - z) * n + z * h
        c = h @ m["C"] + m["c"]
        lo, hi = v.bound[v.cls[y]], v.bound[v.cls[y] + 1]
        w = m["O"][lo:hi] @ h + m["o"][lo:hi]
        total += c[v.cls[y]] - np.log(np.exp(c).sum()) + w[y - lo] - np.log(np.exp(w).sum())
    return total


def brute_spelling(words):
    """Log-probability of spelling each of the words, from the counts over all of them."""
    symbols = {b: k for k, b in enumerate([*range(48, 58), *range(97, 123), *range(128, 256)], 1)}
    n = [Counter(), Counter(), Counter()]
    spelled = [[0, 0, *[symbols[b] for b in w.encode()], 0] for w in words]
    for s in spelled:
        for i in range(2, len(s)):
            for k in range(3):
                n[k][tuple(s[i - k : i + 1])] += 1
    by = [{}, {}, {}]
    for k in range(3):
        for key, c in n[k].items():
            by[k].setdefault(key[:-1], []).append(c)

    def p(ctx, x):
        out = 1 / 165
        for k in range(3):
            own = by[k].get(tuple(ctx[2 - k :]), [])
            kinds = len(own) + 1
            out = (n[k][(*ctx[2 - k :], x)] + kinds * out) / (sum(own) + kinds)
        return out

    return [sum(np.log(p(s[i - 2 : i], s[i])) for i in range(2, len(s))) for s in spelled]


def word_ids(v, text):
    data, offs = tx.flat(pa.array([text]))
    s, e, _ = tx.words(tx.fold(data), offs)
    return v.encode(tx.hashes(tx.fold(data), s, e))


def test_language_model(spark):
    rng = random.Random(10)
    texts = [" ".join("a b c d e f g h".split()[(k + j) % 8] for j in range(rng.randint(5, 150))) for k in range(60)]
    df = docs(spark, texts)
    m, v = lm.fit(df, width=8, size=16, classes=4)
    got = {r.doc_id: r for r in lm.log_likelihood(df, m, v).collect()}
    for k in (0, 7, 31):
        ids = word_ids(v, texts[k])
        assert abs(got[k].log_likelihood - brute_score(m, v, ids)) < 1e-3 * len(ids) and got[k].n_words == len(ids)
    plain = {r.doc_id: r for r in lm.log_likelihood(df, lm.start(v, 8), v).collect()}
    assert sum(r.log_likelihood for r in got.values()) > sum(r.log_likelihood for r in plain.values())
    r = lm.log_likelihood(odd(spark, "n_words"), m, v).collect()
    assert len(r) == 8 and [x.log_likelihood for x in r if x.doc_id in (0, 1, 2)] == [0.0] * 3 and [x.bits_per_word for x in r if x.doc_id == 1] == [None]
    assert lm.log_likelihood(empty(spark), *lm.fit(empty(spark))).count() == 0


def test_language_model_spells(spark):
    """Words outside the vocabulary cost what their spelling does; equal counts keep the words of lowest hash."""
    texts = ["the cat and the dog", "the Été and a catalogue", "and the x", None, ""]
    m, v = lm.fit(docs(spark, texts), width=8, size=4, classes=2)
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    known = {w for t in words for w in t if word_ids(v, w)[0] != lm.UNKNOWN}
    assert known == {"the", "and"}
    out = [w for t in words for w in t if w not in known]
    cost = dict(zip(out, brute_spelling(out)))
    for r in lm.log_likelihood(docs(spark, texts), m, v).collect():
        want = sum(cost.get(w, 0) for w in words[r.doc_id]) + (brute_score(m, v, word_ids(v, texts[r.doc_id])) if words[r.doc_id] else 0)
        assert abs(r.log_likelihood - want) < 1e-3
    tied = lm.vocabulary(docs(spark, ["q r s t u"]), 4, 2)
    h = sorted(tx.hashes(tx.fold(np.frombuffer(b"qrstu", np.uint8)), np.arange(5), np.arange(1, 6)).view(np.int64).tolist())
    assert sorted(tied.hashes.view(np.int64).tolist()) == h[:2]


def test_language_model_trains_on_all(spark):
    rng = random.Random(13)
    head = prose(rng, 100)
    texts = [head + " " + prose(rng, 20) for _ in range(16)]
    # documents with equal heads aren't in or out together, and every one is in one round
    d = docs(spark, texts)
    n = [{r.doc_id for r in d.where(lm.of_round(F.col("text"), k, 2)).collect()} for k in (0, 1)]
    assert n[0] and n[1] and n[0] | n[1] == set(range(16)) and not n[0] & n[1]
    # and the streams that it trains on hold all its words
    ids, offs = np.arange(1, 41), np.array([0, 3, 3, 20, 21, 40])
    for lanes in (1, 3, 9):
        seq, first, size = lm._streams(ids, offs, lanes)
        got = [part for f, n in zip(first, size) for part in re.findall(r"[^|]+", "".join("|" if x == lm.END else chr(x) for x in seq[f : f + n]))]
        assert sorted(got) == sorted("".join(chr(x) for x in ids[a:b]) for a, b in zip(offs, offs[1:]) if b > a) and list(size) == sorted(size, reverse=True)
    # a few documents do train the model, even one alone
    for some in (texts, texts[:1]):
        m, _ = lm.fit(docs(spark, some), width=8, size=32, classes=4)
        assert np.abs(m["C"]).max() > 0 and np.abs(m["O"]).max() > 0


def test_language_model_learns(spark):
    """Trained on a small table's documents, it predicts held-out ones better than class-factored word frequencies."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    held, rest = d.where("doc_id % 10 = 0"), d.where("doc_id % 10 <> 0")
    m, v = lm.fit(rest)
    bits = []
    for model in (m, lm.start(v, 16) | {"S": m["S"]}):
        r = lm.log_likelihood(held, {k: a for k, a in model.items() if k != "S"}, v).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
        bits.append(-r[0] / r[1])
    assert bits[0] < 0.98 * bits[1]


def test_recurrent_gradient():
    """Back-propagation through a window's recurrent steps agrees with finite differences, with lanes that end inside it."""
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.array([0, 2, 5]), np.array([0, 0, 1, 1, 1]), np.ones(5))
    rng = np.random.default_rng(1)
    m = {k: (rng.normal(size=a.shape) * 0.5).astype(np.float64) for k, a in lm.start(v, 3).items()}
    # two documents in the first lane, with a state from before
    y = np.array([[2, 3], [3, 4], [4, 1], [0, 2], [3, 3], [3, 0], [0, 0]])
    x = np.concatenate([[[4, 0]], y[:-1]])
    ok = np.array([[True, t < 6] for t in range(7)])
    h = rng.normal(size=(2, 3))
    grad, used, _ = lm.gradients(m, v, h, x, y, ok)

    def loss():
        state, total = h, 0.0
        for j in range(len(x)):
            state = state * (x[j] != lm.END)[:, None]
            state = lm._cell(m["E"][x[j]] @ m["W"] + m["b"], state, m["U"])[0]
            total -= lm._softmax(m, v, state[ok[j]], y[j][ok[j]])[0].sum()
        return total

    for name, g in grad.items():
        for at in np.ndindex(*g.shape):
            real = (used[at[0]], *at[1:]) if name == "E" else at
            m[name][real] += 1e-5
            up = loss()
            m[name][real] -= 2e-5
            down = loss()
            m[name][real] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_gradient():
    """Back-propagation agrees with finite differences within one window."""
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.array([0, 2, 5]), np.array([0, 0, 1, 1, 1]), np.ones(5))
    rng = np.random.default_rng(0)
    m = {k: (rng.normal(size=a.shape) * 0.5).astype(np.float64) for k, a in lm.start(v, 3).items()}
    hs, y = rng.normal(size=(6, 3)), np.array([0, 1, 2, 3, 4, 2])
    grad = {"O": np.zeros((5, 3)), "o": np.zeros(5)}
    _, dh = lm._softmax(m, v, hs, y, grad)
    for name in ("C", "c", "O", "o"):
        at = tuple(0 for _ in m[name].shape)
        m[name][at] += 1e-5
        up = lm._softmax(m, v, hs, y)[0].sum()
        m[name][at] -= 2e-5
        down = lm._softmax(m, v, hs, y)[0].sum()
        m[name][at] += 1e-5
        assert abs(-(up - down) / 2e-5 - grad[name][at]) < 1e-4
    hs[0, 0] += 1e-5
    up = lm._softmax(m, v, hs, y)[0].sum()
    hs[0, 0] -= 2e-5
    assert abs(-(up - lm._softmax(m, v, hs, y)[0].sum()) / 2e-5 - dh[0, 0]) < 1e-4


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for k in range(500)]
    texts = ["\n".join(" ".join(rng.choice(vocab) for _ in range(15)) for _ in range(5)) for _ in range(30)]
    item = " ".join(rng.choice(vocab) for _ in range(30))
    texts[4] += "\n" + item
    for k in range(10, 20):
        texts[k] = texts[k].replace("\n", f"\nPosted as number {k} in our forum\n", 1)
    texts += [texts[0], texts[1].upper(), "", None, "".join(chr(rng.randrange(0x400, 0x2000)) for _ in range(800))]
    labelled = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 34, F.col("lang")))
    labelled.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs(spark, []).columns
    got, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "packing" or out.columns == columns
        now = spark.createDataFrame(out.collect(), out.schema)
        got.append(now)
    assert {r.doc_id for r in got[0].collect()} == set(range(32))
    assert not any("Posted as" in r.text for r in got[1].collect()) and got[1].count() == 32
    assert {r.doc_id for r in got[2].collect()} == set(range(30))
    assert {r.doc_id for r in got[3].collect()} == set(range(30)) - {4}
    n = {r.doc_id: len(tokens.encoder().plain.encode_ordinary(r.text)) for r in got[3].collect()}
    assert {r.doc_id: r.length for r in got[4].groupBy("doc_id").agg(F.sum("length").alias("length")).collect()} == n
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got[4].collect()))


def test_pipeline_brute_force(spark, tmp_path):
    """Every stage's rows as plain Python has them: code lengths byte by byte, the line tree, all pairs of n-gram sets, whole alignments, ids one text at a time."""
    import corpus_pipeline

    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(1500)]
    items = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(3)]
    texts = []
    for k in range(24):
        body = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(5)]
        if k % 3 == 0:
            body.insert(2, f"Posted on day {k} by member {k + 5} of the forum")
        if k in (5, 11):
            body.append(items[k % 3].upper() if k == 5 else items[k % 3])
        texts.append("\n".join(body))
    texts += [texts[1], edited(rng, texts[2], 3), texts[4].upper(), "".join(chr(rng.randrange(0x3000, 0x9000)) for _ in range(300)), "", None]
    langs = ["en"] * 27 + [None] * 3
    spark.createDataFrame([(k, t, l, "s", len(t or "")) for k, (t, l) in enumerate(zip(texts, langs))], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    known = [t for t, l in zip(texts, langs) if l]
    alphabet, nodes = brute_nodes({"en": known}, 4, 6)
    want = {k: t for k, t in enumerate(texts) if t and brute_ppm(known, alphabet, 4, 6, nodes, t) <= 5 * len(t.encode())}
    stages = [dict(want)]
    want = dict(zip(want, brute_lines(list(want.values()))))
    stages.append(dict(want))
    keys = list(want)
    want = {k: want[k] for k, r in zip(keys, brute_jaccard(list(want.values()), 0.5)) if keys[r] == k}
    stages.append(dict(want))
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in t.lower().split()])
    want = {k: t for k, t in want.items() if all(sw(code(t), code(i)) < 0.4 * 2 * len(i.split()) for i in items)}
    stages.append(dict(want))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, stage), rows in zip(corpus_pipeline.STAGES, [*stages, None]):
        out = stage(spark, now, str(tmp_path))
        now = spark.createDataFrame(out.collect(), out.schema)
        if rows is not None:
            assert {r.doc_id: r.text for r in now.collect()} == rows
    assert len(stages[0]) == 27 and len(stages[2]) == 24 and len(stages[3]) == 22 and stages[1] != stages[0]
    lengths = {k: len(tokens.encoder().plain.encode_ordinary(t)) for k, t in want.items()}
    packed = now.toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths and packed.groupby("pack_id").length.sum().max() <= 2048
    packs = []
    for n in sorted(lengths.values(), reverse=True):
        short = min((p for p in packs if sum(p) < 2048), key=sum, default=None)
        packs.append([n]) if short is None or sum(short) + n > 2048 else short.append(n)
    assert packed.pack_id.nunique() == len(packs)


def test_pipeline_defined_cases(spark, tmp_path):
    """Empty tables, null and repeated ids, and columns named like the stages' own."""
    import corpus_pipeline

    rng = random.Random(21)
    own = ["n_lines", "n_dropped", "accepted", "h", "key", "group_id", "score"]
    bench = spark.createDataFrame([(0, "a b c d e"), (None, "x y z"), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))

    def through(rows):
        now, got = rows, []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            assert name == "packing" or out.columns == rows.columns
            now = spark.createDataFrame(out.collect(), out.schema)
            got.append(now)
        return got

    none = empty(spark)
    for c in own:
        none = none.withColumn(c, F.lit("clash"))
    assert all(d.count() == 0 for d in through(none))
    x, y = prose(rng, 60), prose(rng, 60)
    rows = [(1, x, "en"), (1, x, "en"), (9, x, "en"), (9, y, "en"), (None, x, "en"), (3, None, "en"), (4, "", None), (5, prose(rng, 60), None)]
    d = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], DOCS)
    for c in own:
        d = d.withColumn(c, F.lit("clash"))
    got = through(d)
    assert [g.count() for g in got[:4]] == [6, 6, 5, 5]
    assert sorted((r.doc_id or 0, r.text == x) for r in got[2].collect()) == [(0, True), (1, True), (1, True), (5, False), (9, False)]
    assert all(r[c] == "clash" for r in got[3].collect() for c in own)
    assert got[4].count() == 5 and got[4].columns == ["doc_id", "piece", "start", "length", "pack_id", "pack_offset"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].astype(object).values.tolist())) == sorted(map(str, want[cols].astype(object).values.tolist()))
