import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gramforge.llm import toxicity


def corpus(n=600):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = []
    for k in range(n):
        words = [word() for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.2
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["Zorkish", "vilequon"]))
        out.append((k, " ".join(words), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic", F.lit(1).alias("text"))
    out = toxicity.score(df.drop("toxic"), toxicity.train(df.drop("toxic"), labels)).collect()
    truth = {d: y for d, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    flipped = df.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(df, df), toxicity.train(df, flipped)
    assert a.intercept == b.intercept and (a.weight == b.weight).all()


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(None, 1), (2, None)], [(1, 1), (1, 0), (3, 0)]])
def test_cases(spark, cases, labels):
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(cases, toxicity.train(cases, frame)).collect()
    assert len(out) == cases.count() and all(0 <= r.score <= 1 for r in out)
    assert next(r for r in out if r.doc_id is None).held_out
    assert len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(cases.limit(0), toxicity.train(cases, frame)).count() == 0


def slow_buckets(text):
    """The distinct buckets of a text, n-gram by n-gram with plain numbers."""
    text = " " + (text or "").lower().translate({k: " " for k in (*range(9, 14), 32)}) + " "
    out, low = set(), (1 << 32) - 1
    for n in toxicity.ORDERS:
        for k in range(len(text) - n + 1):
            h = 0
            for c in text[k : k + n]:
                h = (h * 0x01000193 + ord(c)) & low
            x = ((h ^ h >> 15) * 0x2C1B3C6D + n) & low
            out.add(((x ^ x >> 12) * 0x297A2D39 & low) >> (32 - toxicity.BUCKET_BITS))
    return out


def test_ratios_and_scores_equal_a_slow_count(spark):
    rows = corpus(150) + [(900, None, 0), (901, "", 1), (902, "É 漢字 " * 40, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    learned = [(slow_buckets(t), y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 5]
    counts = toxicity.Counts.empty()
    for d, t, y in rows:
        if zlib.crc32(str(d).encode()) % 5:
            counts.add(t, bool(y))
    pos, neg = sum(y for _, y in learned), sum(1 - y for _, y in learned)
    r = counts.ratios()
    for b in model.bucket[:: max(1, len(model.bucket) // 200)].tolist():
        p, q = (sum(b in x for x, y in learned if y == k) for k in (1, 0))
        assert abs(r[b] - math.log((p + 0.5) / (pos + 1) / ((q + 0.5) / (neg + 1)))) < 1e-9
    weight = dict(zip(model.bucket.tolist(), model.weight.tolist()))
    want = {d: 1 / (1 + math.exp(-model.intercept - sum(weight.get(b, 0.0) for b in slow_buckets(t)))) for d, t, _ in rows}
    got = {x.doc_id: x.score for x in toxicity.score(df.drop("toxic"), model).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_sample_is_bounded(spark):
    """A doc_id that repeats counts once, whatever its number of rows."""
    rows = [(1, f"text {k}") for k in range(500)] + [(k, f"vilequon {k}" if k % 2 else f"fine {k}") for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, 20)
    assert toxicity.score(df, model).count() == len(rows)
