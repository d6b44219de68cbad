"""Document fingerprints: MinHash over word shingles.

A text's shingles of five words are hashed to 32 bits; PERMUTATIONS universal
hash functions (a * x + b mod 2**64, top bits) are applied to all of them in blocks,
and the signature keeps 16 bits of each function's least value. The likeness of two
signatures, the share of equal places, estimates the Jaccard similarity of the shingle sets.

``report`` also fingerprints each text edited with the beginning of the next
document. Documents are dealt by ranges of doc_id into buckets, each with a copy of the
next bucket's first document, so every text moves once and no task orders them all. A task
sees its bucket as a sorted stream and holds two documents at a time.

``nearcopies`` joins the bands of the signatures and verifies what meets on the shingles.

Defined cases: a null text counts as empty; a text without words has the empty
fingerprint of zeros, alike to itself alone; with fewer than five words all words form the one shingle;
rows of equal doc_id follow each other in order of text; rows without
doc_id come last; a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SHINGLE = 5
PERMUTATIONS = 64
#: Bands of four places each; two texts of similarity 0.8 share one with a probability above 0.999.
BANDS = 16
BUCKET_ROWS = 2048
#: Buckets at most, as their bounds and first documents go through the driver; beyond, buckets get longer, and no task holds one.
MAX_BUCKETS = 1 << 16
_BLOCK = 1024
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(s) for s in shingles), np.uint64, n)


def signature(text: str | None) -> np.ndarray | None:
    """PERMUTATIONS values of 16 bits; None for a text without words."""
    return least_values(shingle_hashes(text))


def least_values(x: np.ndarray) -> np.ndarray | None:
    """The signature of a text with such shingle hashes."""
    if not len(x):
        return None
    least = np.full(PERMUTATIONS, ~np.uint64(0))
    for at in range(0, len(x), _BLOCK):
        block = np.multiply.outer(_A, x[at : at + _BLOCK])
        block += _B[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint16)


def as_text(sig: np.ndarray | None) -> str:
    return sig.astype(">u2").tobytes().hex() if sig is not None else "0" * (4 * PERMUTATIONS)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    cut_off = len(text) // 4
    return text[: len(text) - cut_off] + following[:cut_off]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held, done = None, []
    for df in batches:
        for doc_id, text, bucket, halo in zip(df["doc_id"].array, df["text"], df["bucket"], df["halo"]):
            text = text or ""
            sig = signature(text)
            if held is not None and held[2] == bucket and not held[4]:
                other = edited(held[1], text)
                sig2 = held[3] if other == held[1] else signature(other)
                done.append((held[0], len(held[1]), hashlib.sha256(other.encode()).hexdigest(), as_text(held[3]), as_text(sig2), likeness(held[3], sig2), likeness(held[3], sig)))
            held = (doc_id, text, bucket, sig, halo)
        if len(done) >= 1000:
            yield _frame(done, names)
            done = []
    yield _frame(done, names)


def _frame(done: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(done, columns=names)
    out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], "Int64")
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    last = (1 << 63) - 1
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(last)).alias("id"))
    ids = keyed.select("id")
    n = max(1, min(MAX_BUCKETS, ids.count() // BUCKET_ROWS))
    bounds = np.array(sorted(set(ids.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else [])
    at = lambda s: np.searchsorted(bounds, s.to_numpy(np.float64), "right").astype(np.int32)

    @F.pandas_udf(IntegerType())
    def bucket_of(s: pd.Series) -> pd.Series:
        return pd.Series(at(s))

    # at most MAX_BUCKETS rows
    firsts = sorted((r["b"], r["id"]) for r in ids.groupBy(bucket_of("id").alias("b")).agg(F.min("id").alias("id")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    @F.pandas_udf(IntegerType())
    def halo_of(s: pd.Series) -> pd.Series:
        return pd.Series([before.get(x, -1) for x in s.tolist()], dtype="int32")

    place = lambda b, h: F.struct(b.alias("bucket"), F.lit(h).alias("halo"))
    placed = keyed.withColumn("_b", bucket_of("id")).withColumn("_h", halo_of("id"))
    placed = placed.withColumn("_p", F.explode(F.when(F.col("_h") >= 0, F.array(place(F.col("_b"), 0), place(F.col("_h"), 1))).otherwise(F.array(place(F.col("_b"), 0)))))
    dealt = placed.select("doc_id", "text", "id", "_p.bucket", "_p.halo").repartition("bucket").sortWithinPartitions("bucket", "halo", "id", "text")
    return dealt.select("doc_id", "text", "bucket", "halo").mapInPandas(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
