"""Approximate extraction: the substrings of documents that match a dictionary's entities.

Documents are (doc_id, text), entities (entity_id, entity). Positions are 0-based
code points. Substrings of length 0 are never returned. Every text is scanned once by rolling
hashes; only places whose hash is in a filter over the dictionary's keys, a bit set of fixed size,
leave the scan and meet the dictionary in an equi-join. What meets is verified exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .grams import FREQUENCY_BITS, bucket_counts, codes, gram_hashes
from .similarity import segments

#: A segment's first characters that documents are probed with; the rest is verified.
KEY = 12
#: The filter has 2**FILTER_BITS bits, however large the dictionary: so much goes to all tasks.
FILTER_BITS = 22


def _named(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("entity_id").alias("id"), F.col("entity").alias("s")).filter("s IS NOT NULL AND s <> ''")


def _key_filter(keys: DataFrame) -> np.ndarray:
    """Whether a key with such last bits of h occurs; keys has h."""
    bits = keys.select(F.col("h").bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("b")).distinct().toPandas()["b"]
    out = np.zeros(1 << FILTER_BITS, bool)
    out[bits.to_numpy(np.int64)] = True
    return np.packbits(out)


def _scanned(texts: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, k, p, h): places p of the texts (doc_id, text) whose k characters may be a key's."""
    known = texts.sparkSession.sparkContext.broadcast(_key_filter(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, low = np.unpackbits(known.value).astype(bool), np.uint64((1 << FILTER_BITS) - 1)
        for df in batches:
            at, ks, ps, hs, held = [], [], [], [], 0
            ids = df["doc_id"].to_numpy()
            for i, text in enumerate(df["text"]):
                code = codes(text)
                for k in lengths:
                    h = gram_hashes(code, k)
                    p = np.flatnonzero(there[(h & low).astype(np.int64)])
                    for column, value in zip((at, ks, ps, hs), (np.full(len(p), i), np.full(len(p), k), p, h[p])):
                        column.append(value)
                    held += len(p)
                if held > 200_000 or i == len(ids) - 1:
                    yield pd.DataFrame({"doc_id": ids[np.concatenate(at)], "k": np.concatenate(ks).astype(np.int32), "p": np.concatenate(ps).astype(np.int32), "h": np.concatenate(hs).view(np.int64)})
                    at, ks, ps, hs, held = [], [], [], [], 0

    return texts.mapInPandas(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, k int, p int, h long")


@F.pandas_udf(LongType())
def _key_hash(keys: pd.Series) -> pd.Series:
    return pd.Series([int(gram_hashes(codes(s), len(s)).view(np.int64)[0]) for s in keys], dtype="int64")


def extract_ed(docs: DataFrame, entities: DataFrame, tau: int) -> DataFrame:
    """(doc_id, entity_id, pos, len, dist): every substring within tau edits of an entity.

    Of an entity's tau + 1 segments one occurs unchanged, at most tau places from where
    it belongs. Entities no longer than tau have empty segments; they are held against the
    windows of each admissible length.
    """
    names = _named(entities)
    parts = segments(names.filter(F.length("s") > tau), tau).withColumn("k", F.least(F.length("seg"), F.lit(KEY)))
    parts = parts.select("id", "seg_off", "k", _key_hash(F.col("seg").substr(F.lit(1), F.col("k"))).alias("h"))
    lengths = sorted(r[0] for r in parts.select("k").distinct().collect())  # KEY values at most
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    short = names.filter(F.length("s") <= tau)
    tiny = None if short.isEmpty() else _tiny(texts, short, tau)
    if not lengths:
        return _tiny(texts, short, tau) if tiny is None else tiny
    found = _scanned(texts, parts, lengths).join(parts, ["k", "h"]).select("doc_id", F.col("id").alias("entity_id"), (F.col("p") - F.col("seg_off")).alias("base"))
    starts = found.distinct().join(names.select(F.col("id").alias("entity_id"), F.col("s").alias("entity")), "entity_id").join(texts, "doc_id")
    moves = F.transform(F.sequence(F.lit(-tau), F.lit(tau)), lambda d: d)
    # one window of text for each start, so that the expansion copies no whole text
    starts = starts.withColumn("lo", F.greatest(F.col("base") - tau, F.lit(0))).withColumn("window", F.expr(f"substr(text, lo + 1, length(entity) + {3 * tau} + 1)")).drop("text")
    cases = starts.withColumn("d", F.explode(moves)).withColumn("pos", F.col("base") + F.col("d")).filter("pos >= 0").withColumn("e", F.explode(moves)).withColumn("len", F.length("entity") + F.col("e"))
    cases = cases.filter("len > 0 AND pos - lo + len <= length(window)").dropDuplicates(["doc_id", "entity_id", "pos", "len"])
    cases = cases.withColumn("dist", F.levenshtein(F.expr("substr(window, pos - lo + 1, len)"), F.col("entity"), tau))
    out = cases.filter("dist >= 0").select("doc_id", "entity_id", "pos", "len", "dist")
    return out if tiny is None else out.unionByName(tiny)


def _tiny(texts: DataFrame, names: DataFrame, tau: int) -> DataFrame:
    """Entities no longer than tau. Every window no longer than tau matches every one of them, so the join on the window's length makes at most a few times the rows of the result."""
    from ..functions.strings import qgrams

    windows = None
    for n in range(1, 2 * tau + 1):
        rows = texts.select("doc_id", F.posexplode(qgrams(F.col("text"), n)).alias("pos", "window"), F.lit(n).alias("len"))
        windows = rows if windows is None else windows.unionByName(rows)
    if windows is None:
        windows = texts.select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("window"), F.lit(0).alias("len")).limit(0)
    own = names.select(F.col("id").alias("entity_id"), "s", F.explode(F.sequence(F.greatest(F.length("s") - tau, F.lit(1)), F.length("s") + tau)).alias("len"))
    met = windows.join(own, "len").withColumn("dist", F.levenshtein("window", "s", tau))
    return met.filter("dist >= 0").select("doc_id", "entity_id", "pos", "len", "dist")


def _rare_grams(names: DataFrame, texts: DataFrame, q: int, theta: float) -> DataFrame:
    """(entity_id, h): the hashes of the g - ceil(theta * g) + 1 grams of each entity that are rarest in the texts."""
    known = names.sparkSession.sparkContext.broadcast(bucket_counts(texts.select(F.col("text").alias("s")), q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, shift = known.value, np.uint64(64 - FREQUENCY_BITS)
        for df in batches:
            ids, grams = [], []
            for entity_id, s in zip(df["id"], df["s"]):
                h = gram_hashes(codes(s), q)
                h = h[np.lexsort((h, often[(h >> shift).astype(np.int64)]))]
                h = np.unique(h[: len(h) - math.ceil(theta * len(h) - 1e-8) + 1]).view(np.int64).tolist()
                ids += [entity_id] * len(h)
                grams += h
            if grams:
                yield pd.DataFrame({"entity_id": ids, "h": grams})

    return names.mapInPandas(run, f"entity_id {names.schema['id'].dataType.simpleString()}, h long")


def extract_jaccard(docs: DataFrame, entities: DataFrame, q: int, theta: float) -> DataFrame:
    """(doc_id, entity_id, pos, len, sim): every window whose q-gram bag has a Jaccard similarity of theta (above 0) with the entity's.

    A window of w grams can match an entity of g only for theta * g <= w <= g / theta, and
    holds one of the entity's g - ceil(theta * g) + 1 rarest grams.
    """
    if theta <= 0:
        raise ValueError("theta must be above 0")
    names = _named(entities)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    rare = _rare_grams(names, texts, q, theta)
    hits = _scanned(texts, rare, [q]).join(rare, "h").groupBy("doc_id", "entity_id").agg(F.array_sort(F.collect_set("p")).alias("hits"))
    cases = hits.join(names.select(F.col("id").alias("entity_id"), F.col("s").alias("entity")), "entity_id").join(texts, "doc_id")
    types = {c: cases.schema[c].dataType.simpleString() for c in ("doc_id", "entity_id")}
    return cases.select("doc_id", "entity_id", "hits", "entity", "text").mapInPandas(partial(_windows, q=q, theta=theta), f"doc_id {types['doc_id']}, entity_id {types['entity_id']}, pos int, len int, sim double")


def extract(docs: DataFrame, entities: DataFrame, metric: str = "ed", q: int = 3, threshold: float = 2) -> DataFrame:
    """Extraction by metric: "ed" (threshold edits) or "jaccard" (similarity of q-gram bags from threshold on)."""
    if metric == "ed":
        return extract_ed(docs, entities, int(threshold))
    if metric == "jaccard":
        return extract_jaccard(docs, entities, q, float(threshold))
    raise ValueError("metric: ed or jaccard")


def _starts(hits, own: Counter, text: str, q: int, least: int, hi: int) -> Iterator[int]:
    """Places where a window may start: within hi of a rare gram, and of all places of the entity's grams, in order, least in a row fit a window that starts there.

    A run of places that spans more than hi is passed over as a whole, without a look at windows.
    """
    last, done, k = len(text) - q + 1, 0, 0
    while k < len(hits):
        # one region around rare grams that are close together
        lo = max(done, hits[k] - hi + 1)
        while k + 1 < len(hits) and hits[k + 1] - hits[k] < hi:
            k += 1
        end = min(last, hits[k] + hi)
        places = np.array([p for p in range(max(lo, 0), end) if text[p : p + q] in own], np.int64)
        if len(places) >= least:
            first, final = places[: len(places) - least + 1], places[least - 1 :]
            fits = final - first < hi
            # a window with these places starts after the place before, at or before the first, less than hi before the final
            begin = np.maximum(np.append(lo - 1, first[:-1]) + 1, final - hi + 1)
            for a, b in zip(begin[fits].tolist(), first[fits].tolist()):
                yield from range(max(a, done, 0), b + 1)
                done = max(done, b + 1)
        done = max(done, hits[k] + 1)
        k += 1


def _windows(batches: Iterator[pd.DataFrame], q: int, theta: float) -> Iterator[pd.DataFrame]:
    """The matching windows from every start, gram by gram.

    From a start, grams that don't count only grow; beyond g / theta - g of them no longer window matches.
    """
    for df in batches:
        out = []
        for doc_id, entity_id, hits, entity, text in zip(df["doc_id"].tolist(), df["entity_id"].tolist(), df["hits"], df["entity"], df["text"]):
            own = Counter(entity[k : k + q] for k in range(len(entity) - q + 1))
            g, last = len(entity) - q + 1, len(text) - q + 1
            lo, hi = max(1, math.ceil(theta * g - 1e-8)), math.floor(g / theta + 1e-8)
            spare = g / theta - g + 1e-8
            for pos in _starts(hits.tolist(), own, text, q, lo, hi):
                left, overlap = dict(own), 0
                for w in range(1, min(hi, last - pos) + 1):
                    gram = text[pos + w - 1 : pos + w - 1 + q]
                    if left.get(gram, 0):
                        left[gram] -= 1
                        overlap += 1
                    elif w - overlap > spare:
                        break
                    if w >= lo and overlap / (w + g - overlap) >= theta:
                        out.append((doc_id, entity_id, pos, w + q - 1, overlap / (w + g - overlap)))
        yield pd.DataFrame(out, columns=["doc_id", "entity_id", "pos", "len", "sim"])
