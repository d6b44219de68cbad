"""Tables of q-grams: counts, corpus frequencies, the rare-first order and its prefixes.

``gram_table`` and what follows from it give the grams themselves. For candidates, ``rare_prefixes`` hashes,
counts and orders the grams of a string within its row, so that only a prefix of each string is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import gram_count, qgrams

#: The order of grams by frequency stands on counts in 2**FREQUENCY_BITS buckets of hashes, which bounds what is sent to all tasks. Any common order is right; a coarse one lets more candidates through.
FREQUENCY_BITS = 20


def gram_table(df: DataFrame, q: int, *keep: str) -> DataFrame:
    """id, the columns in keep, gram, c (how often) and n (grams of the string) for (id, s); strings without grams have no row.

    Counting per (id, gram) rather than numbering repeats keeps a row for each
    distinct gram; the multiset overlap of two strings is the sum of the smaller counts.
    """
    # n is computed below the explode; above it, every gram's row would carry the whole string
    rows = df.select("id", *keep, gram_count(F.col("s"), q).alias("n"), qgrams(F.col("s"), q).alias("_grams")).select("id", *keep, "n", F.explode("_grams").alias("gram"))
    return rows.groupBy("id", *keep, "n", "gram").agg(F.count(F.lit(1)).alias("c"))


def gram_counts(df: DataFrame, q: int) -> DataFrame:
    """gram and df, its occurrences in all strings of (id, s), in one aggregate."""
    return df.select(F.explode(qgrams(F.col("s"), q)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def frequencies(grams: DataFrame) -> DataFrame:
    """gram and df, its occurrences in all strings."""
    return grams.groupBy("gram").agg(F.sum("c").alias("df"))


def ranked(grams: DataFrame, freq: DataFrame) -> DataFrame:
    """grams with before: how many grams of the same string come earlier in the order (df, gram); unknown grams count as rarest."""
    rows = grams.join(freq, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("id").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))


def prefixes(rows: DataFrame, length: Column) -> DataFrame:
    """The rows of ranked grams that begin within a prefix of length."""
    return rows.filter(F.col("before") < length)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q code points."""
    n = max(0, len(code) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n] + np.uint64(1)
    return _scrambled(h)


def bag(s: str, q: int) -> np.ndarray:
    """A hash for each gram of a string, the k-th occurrence of a gram apart from the others: the overlap of two bags is that of sets."""
    h = np.sort(gram_hashes(codes(s), q))
    at = np.arange(len(h))
    again = at - np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[: len(h)], at, 0))
    return np.where(again > 0, _scrambled(h + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), h)


def bucket_counts(df: DataFrame, q: int) -> np.ndarray:
    """How many grams of the strings s fall into each bucket; 2**FREQUENCY_BITS numbers at most reach the driver."""
    shift, size = np.uint64(64 - FREQUENCY_BITS), 1 << FREQUENCY_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for rows in batches:
            for s in rows["s"]:
                total += np.bincount((bag(s, q) >> shift).astype(np.int64), minlength=size) if len(s) > size else 0
                if q <= len(s) <= size:
                    np.add.at(total, (bag(s, q) >> shift).astype(np.int64), 1)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"b": hit.astype(np.int32), "n": total[hit]})

    found = df.select("s").mapInPandas(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["b"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def rare_prefixes(df: DataFrame, q: int, counts: np.ndarray, length: Callable[[int, float], int], *keep: str) -> DataFrame:
    """id, n, the columns in keep, gram (a hash) and pos for the rarest grams of each string of (id, s): length(n, threshold) of them, pos being the place in the order.

    Grams that share a hash count as one, which can only raise an overlap: a filter by
    prefix misses no pair, and what it lets through is verified on the strings. threshold is the column of this name in keep.
    """
    known, shift = df.sparkSession.sparkContext.broadcast(counts), np.uint64(64 - FREQUENCY_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = known.value
        for rows in batches:
            own = rows["threshold"].tolist() if "threshold" in keep else [0.0] * len(rows)
            size, take, grams = [], [], []
            for s, threshold in zip(rows["s"], own):
                h = bag(s, q)
                some = min(len(h), length(len(h), threshold)) if len(h) else 0
                h = h[np.lexsort((h, often[(h >> shift).astype(np.int64)]))[:some]]
                size.append(len(s) - q + 1)
                take.append(len(h))
                grams.append(h)
            if not sum(take):
                continue
            at = np.repeat(np.arange(len(rows)), take)
            pos = np.concatenate([np.arange(k) for k in take])
            out = {"id": rows["id"].to_numpy()[at], "n": np.array(size, np.int32)[at], "gram": np.concatenate(grams).view(np.int64), "pos": pos.astype(np.int32)}
            yield pd.DataFrame(out | {c: rows[c].to_numpy()[at] for c in keep})

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("id", "s", *keep).mapInPandas(run, ", ".join([f"id {types['id']}, n int, gram long, pos int", *(f"{c} {types[c]}" for c in keep)]))
