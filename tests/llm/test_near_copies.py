import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gramforge.llm import graph, minhash, nearcopies, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(prints):
    """prints: (doc_id, fp); the smallest reachable doc_id by fingerprint."""
    nodes = sorted({f for d, f in prints if d is not None})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", None if d is None else least[find(f)]) for d, f in prints]


def test_simhash_equals_brute_force(cases):
    got = sorted((tuple(r) for r in simhash.report(cases).collect()), key=repr)
    assert got == sorted(brute_components([(r.doc_id, brute_print(r.text)) for r in cases.collect()]), key=repr)
    assert simhash.report(cases.limit(0)).count() == 0


def test_simhash_equals_spark_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert simhash.fingerprint("One  two\nthree") == row.h % (1 << 64)


@pytest.mark.parametrize("split", [4096, 30])
def test_links_of_dense_groups(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (8, 60, 2)).astype(np.uint64)
    codes = (base[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel()
    chain = [np.uint64((1 << 2 * k) - 1) for k in range(20)]
    prints = [(k, int(c)) for k, c in enumerate([*codes, *chain])]
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in prints], "doc_id long, fp long")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((d, c) for d, _, c in brute_components(prints))


def test_index_search():
    rng = np.random.default_rng(0)
    for _ in range(15):
        c = np.unique(rng.integers(0, 1 << 14, 120, dtype=np.uint64) | np.uint64(1 << 40))
        rank = c.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        c = c[np.argsort(rank)]
        got = {p for i, j in simhash.search(c, np.array([0]), step=17) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if bin(int(c[i] ^ c[j])).count("1") <= 2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (5, 5), (200, 100)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100, 200: 100} | {k: 1000 for k in range(1001, 1100)}


def test_keep_one(cases):
    kept = simhash.keep_one(cases)
    assert kept.columns == cases.columns
    rows, report = kept.collect(), brute_components([(r.doc_id, brute_print(r.text)) for r in cases.collect()])
    assert {r.doc_id for r in rows if r.doc_id is not None} == {c for d, _, c in report if d is not None}
    assert sum(r.doc_id is None for r in rows) == 2 and len({(r.doc_id, r.text) for r in rows}) == len(rows)


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        out.append((d, t, t[: len(t) - n] + following[:n], following))
    return out


@pytest.mark.parametrize("size", [2048, 4])
def test_minhash(cases, monkeypatch, size):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", size)
    out = minhash.report(cases).collect()
    want = brute_edits([(r.doc_id, r.text or "") for r in cases.collect()])
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == key((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want)

    def jaccard(a, b):
        x, y = (set(minhash.shingle_hashes(s).tolist()) for s in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    by_hash = {(d, hashlib.sha256(e.encode()).hexdigest()): (jaccard(t, e), jaccard(t, f)) for d, t, e, f in want}
    for r in out:
        a, b = by_hash[r.doc_id, r.edited_sha256]
        assert abs(r.near_edited - a) < 0.25 and abs(r.near_next - b) < 0.25
    prints = {t: minhash.as_text(minhash.signature(t)) for _, t, _, _ in want}
    assert {r.fingerprint for r in out} == set(prints.values())
    assert minhash.report(cases.limit(0)).count() == 0
    assert minhash.report(cases.filter("doc_id = 5")).first().near_next == 1.0


def slow_signature(text):
    """The signature with plain numbers, one hash function after another."""
    words = (text or "").encode().split()
    if not words:
        return "0" * 256
    found = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    codes = [xxhash.xxh32_intdigest(s) for s in found]
    least = [min((a * x + b) % (1 << 64) for x in codes) for a, b in zip(minhash._A.tolist(), minhash._B.tolist())]
    return "".join(f"{(v >> 32) & 0xFFFF:04x}" for v in least)


def test_fingerprints_equal_plain_numbers(cases):
    rows = [(r.doc_id, r.text or "") for r in cases.collect()]
    want = {(d, hashlib.sha256(e.encode()).hexdigest()): (slow_signature(t), slow_signature(e), slow_signature(f)) for d, t, e, f in brute_edits(rows)}
    for r in minhash.report(cases).collect():
        own, changed, following = want[r.doc_id, r.edited_sha256]
        places = lambda s: [s[k : k + 4] for k in range(0, 256, 4)]
        like = lambda a, b: float(a == b) if "0" * 256 in (a, b) else sum(x == y for x, y in zip(places(a), places(b))) / 64
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (own, changed, like(own, changed), like(own, following))


def test_near_copies_of_a_whole_table(spark):
    """Against all pairs by exact similarity: at least 0.9 of the links are within a class, and no class joins what no links join."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.component_id for r in nearcopies.report(docs).collect()}
    texts = {r.doc_id: nearcopies.shingles(r.text) for r in docs.collect()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for a in texts for b in texts if a < b and texts[a] | texts[b] and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links) > 0
    assert all(find(d) == find(c) for d, c in got.items())


def test_near_copies_cases(cases):
    out = nearcopies.report(cases).collect()
    assert len(out) == cases.filter("doc_id IS NOT NULL").count() and all(r.component_id <= r.doc_id for r in out)
    assert nearcopies.report(cases.limit(0)).count() == 0
