import random

import corpus_pipeline
from pyspark.sql import functions as F

from gramforge.llm import mixing, nearcopies, packing, queries, quality, simhash, suffix_dedup


def test_stages_in_turn(spark, cases, tmp_path):
    docs, seen = cases, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == cases.columns
        seen[name], docs = after, after
    good, one, cut, mixed, packed = seen.values()
    assert quality.quality(good).filter("NOT kept").isEmpty()
    ids = simhash.report(one).filter("doc_id IS NOT NULL")
    assert ids.filter("doc_id <> component_id").isEmpty()
    assert suffix_dedup.report(one).filter("n_removed = n_bytes").count() + cut.count() == one.count()
    took = mixing.taken(mixing.sized(cut).select("doc_id", "source", "size")).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == took
    tokens = packing.pieces(mixed, queries.tokenizer("word_bpe_49k.json")).agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == tokens


def test_empty_input(spark, cases):
    docs = cases.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "best-fit packing"]


def test_near_dedup_takes_what_shares_shingles(spark, monkeypatch):
    """Texts at and under a 5-word Jaccard similarity of 0.8, most of them more than 2 bits apart, with and without large groups."""
    from common_cases import passage

    def spoiled(seed, changes):
        words = passage(seed, 300).split()
        for k in range(changes):
            words[10 + 25 * k] = f"changed{seed}x{k}"
        return " ".join(words)

    texts = [t for s in range(500, 520) for t in (passage(s, 300), spoiled(s, s % 12))]
    hub = passage(600, 300).split()
    texts += [" ".join(hub[:k] + [f"new{k}"] + hub[k + 1 :]) for k in range(5, 290, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [nearcopies.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert simhash.keep_one(docs).count() > len(set(root))
    for small in (16, 1):
        monkeypatch.setattr(nearcopies, "SMALL", small)
        kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
        assert kept == set(root)


def test_repeated_lines_keep_no_near_copies_apart(spark):
    """Texts of one large group with the same shingles, of which each repeats others: all pairs reach the threshold and are given."""
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(words + words[5 * k : 5 * k + 5] * 150) for k in range(24)]
    sets = [nearcopies.shingles(t) for t in texts]
    assert all(len(a & b) / len(a | b) >= nearcopies.THRESHOLD for a in sets for b in sets)
    rows = spark.createDataFrame(list(enumerate(texts)), "t long, text string").select("t", nearcopies._sketch("text").alias("s"))
    rows = rows.select(F.lit(1).cast("long").alias("k"), "t", "s.fp", F.col("t").alias("root"), "s.odd", "s.members")
    got = {tuple(sorted(r)) for r in nearcopies._grouped(rows).mapInPandas(nearcopies._second, "u long, v long").collect()}
    assert got == {(a, b) for b in range(24) for a in range(b)}


def test_parity_sketches_lose_no_similar_pair(spark):
    import numpy as np
    from common_cases import passage

    texts = []
    for s in range(700, 712):
        words = passage(s, 40 + 60 * (s % 4)).split()
        texts.append(" ".join(words))
        for k in range(1, 9):
            texts.append(" ".join(w if r % (len(words) // k) else f"{w}{s}x{k}" for r, w in enumerate(words)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", nearcopies._sketch("text").alias("s"))
    rows = sorted(df.collect())
    odd, members = np.frombuffer(b"".join(bytes(r.s.odd) for r in rows), np.uint64).reshape(len(rows), -1), np.array([r.s.members for r in rows])
    sets = [nearcopies.shingles(t) for t in texts]
    i, j = np.triu_indices(len(texts), 1)
    near = np.array([len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in zip(i, j)])
    through = nearcopies.possible(odd, members, i, j)
    assert near.sum() > 10 and through[near].all() and through.sum() < 4 * near.sum() + 60


def test_template_below_the_threshold_gives_few_pairs(spark):
    """Texts that differ from each other in two of sixty words: no two reach 0.8, none is lost, and no pairs are verified in number."""
    from common_cases import passage

    base = passage(800, 60).split()
    texts = [" ".join(w if k not in (a, b) else f"new{a}x{b}x{k}" for k, w in enumerate(base)) for a in range(2, 30, 3) for b in range(30, 59)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [nearcopies.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if root[x] != root[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((root[x], root[y]))
                root = [a if z == b else z for z in root]
    assert {r.doc_id for r in nearcopies.keep_one(docs).collect()} == set(root)
