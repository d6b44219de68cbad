"""SimHash near-duplicates by a Gray-ordered hierarchical index.

A fingerprint has 64 bits by majority over the hashes of a text's word shingles.
Equal fingerprints collapse to one node first, so copies cost one row a text and
no pairs. Two fingerprints that differ in at most 2 of 64 bits agree in two of
four 16-bit blocks; so each distinct fingerprint goes to six groups of 32 shared
bits. A group of more than SPLIT members goes on to six subgroups each, of 16 more
shared bits by the same argument, which no more than 65536 distinct fingerprints can share.

Within a group the fingerprints are sorted by Gray rank, and an index is built
over them: an inner node holds the bits on which all codes below agree. The search
walks all queries down at once; a node's differences on its shared bits only add to those of its
ancestors, and whole nodes beyond the limit are pruned. A group gives a spanning
forest of its links, not its pairs; the forests meet in distributed components.

Defined cases: a null or blank text has fingerprint 0, which links like any other;
with fewer words than a shingle all words form the one shingle; repeated rows fall together; a
row without doc_id gets its fingerprint, links nothing and has no component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import carried, cut, restored
from .graph import components

SHINGLE = 3
SEED = 42
MAX_DIFF = 2
SPLIT = 4096
FAN = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode().translate(_LOWER).split()  # splits on blank and \x09-\x0d alone
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
        n = len(words) - size + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        m = min(_BLOCK, n - at)
        codes = np.fromiter((digest(s, SEED) for _, s in zip(range(m), shingles)), np.uint64, m)
        ones += np.unpackbits(codes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, and fp (a signed long)."""
    return docs.select("doc_id", *keep, fingerprint_udf("text").alias("fp"))


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a[i] and b[i] in label, in which every entry names its set's smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _levels(codes: np.ndarray, starts: np.ndarray):
    """Bottom up: (first child, children, pattern, mask, last leaf) of each level's nodes; starts are the groups' first leaves."""
    n = len(codes)
    first, size = np.arange(n), np.ones(n, np.int64)
    low = high = codes
    last, begin = np.arange(n), starts
    out = [(first, size, codes, np.full(n, ~np.uint64(0)), last)]
    while len(low) > len(starts):
        count = np.diff(np.append(begin, len(low)))
        nodes = -(-count // FAN)
        offset = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        first = np.repeat(begin, nodes) + offset * FAN
        size = np.diff(np.append(first, len(low)))
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        last = last[first + size - 1]
        out.append((first, size, low, ~(low ^ high), last))
        begin = np.cumsum(nodes) - nodes
    return out


def search(codes: np.ndarray, starts: np.ndarray, most: int = MAX_DIFF, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one group whose codes differ in at most most bits; groups begin at starts and are sorted by Gray rank."""
    levels = _levels(codes, starts)
    group = np.zeros(len(codes), np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    for at in range(0, len(codes), step):
        query = np.arange(at, min(len(codes), at + step))
        node = group[query]
        for k in range(len(levels) - 1, -1, -1):
            first, size, pattern, mask, last = levels[k]
            if k < len(levels) - 1:
                up_first, up_size = levels[k + 1][0][node], levels[k + 1][1][node]
                query = np.repeat(query, up_size)
                node = np.repeat(up_first, up_size) + np.arange(len(query)) - np.repeat(np.cumsum(up_size) - up_size, up_size)
            near = (last[node] > query) & (np.bitwise_count((codes[query] ^ pattern[node]) & mask[node]) <= most)
            query, node = query[near], node[near]
        yield query, node


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of sorted rows (k, k2, fp): a spanning forest for each group."""
    rest = None

    def links(df: pd.DataFrame) -> pd.DataFrame:
        codes = df["fp"].to_numpy(np.int64).view(np.uint64)
        k, k2 = df["k"].to_numpy(), df["k2"].to_numpy()
        new = np.append(True, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))
        label = np.arange(len(codes))
        for i, j in search(codes, np.flatnonzero(new)):
            connect(label, i, j)
        tied = np.flatnonzero(label != np.arange(len(codes)))
        return pd.DataFrame({"u": codes[tied].view(np.int64), "v": codes[label[tied]].view(np.int64)})

    for df in batches:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        here = (df["k"] == df["k"].iloc[-1]) & (df["k2"] == df["k2"].iloc[-1])
        done = int(here.to_numpy().argmax())
        rest = df.iloc[done:]
        if done:
            yield links(df.iloc[:done])
    if rest is not None and len(rest):
        yield links(rest)


def _shared(bits: int, base, shift: int):
    """Six keys: two of four blocks of so many bits of base, that starts at bit shift."""
    block = lambda j: F.shiftrightunsigned(base, shift + bits * j).bitwiseAND(F.lit((1 << bits) - 1))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*(F.lit(n << 2 * bits) + F.shiftleft(block(i), bits) + block(j) for n, (i, j) in enumerate(pairs))), pairs


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect what differs in at most two bits; nodes holds distinct fp."""
    fp = F.col("fp")
    wide, pairs = _shared(16, fp, 0)
    keyed = nodes.select("fp", F.explode(wide).alias("k"))
    counts = keyed.groupBy("k").count().filter("count > 1")
    keyed = keyed.join(counts, "k")
    small = keyed.filter(F.col("count") <= SPLIT).select("k", F.lit(-1).cast("long").alias("k2"), "fp")
    # the 32 bits outside the shared two blocks, moved together
    block = lambda j: F.shiftrightunsigned(fp, 16 * j).bitwiseAND(F.lit(0xFFFF))
    free = F.lit(None).cast("long")
    for n, pair in enumerate(pairs):
        a, b = (j for j in range(4) if j not in pair)
        free = F.when(F.shiftrightunsigned(F.col("k"), 32) == n, F.shiftleft(block(a), 16) + block(b)).otherwise(free)
    large = keyed.filter(F.col("count") > SPLIT).withColumn("free", free)
    large = large.select("k", F.explode(_shared(8, F.col("free"), 0)[0]).alias("k2"), "fp")
    rank = fp
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    grouped = small.unionByName(large)
    grouped = grouped.repartition("k", "k2").sortWithinPartitions("k", "k2", rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    return grouped.mapInPandas(_forests, "u long, v long")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp and more) with component_id; prints is read several times and should be cut from its lineage."""
    nodes = prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    nodes = cut(nodes)
    roots = components(links(nodes.select("fp")))
    tied = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = tied.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = prints.join(names, prints["fp"] == names["_fp"], "left").drop("_fp")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(cut(fingerprints(docs)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows of lost (_id, and _x as the text's xxhash64); of rows equal in doc_id and text one stays."""
    named = carried(docs, "doc_id", "text").filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_t"), "_doc")
    kept = named.join(lost, (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_x")), "left_anti")
    return restored(kept.dropDuplicates(["doc_id", "_t"]), docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but the smallest doc_id of each component; of rows equal in doc_id and text one stays.

    Rows of one doc_id with several texts stand or fall by their own text; rows without doc_id stay.
    """
    key = F.xxhash64("text")
    prints = cut(fingerprints(docs.select("doc_id", "text", key.alias("_t")), "_t"))
    lost = near_duplicates(prints).filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("_t").alias("_x")).distinct()
    return without(docs, lost)
