"""Pairs of a high Jaccard similarity within one table of distinct long strings, by parts of their grams.

The bag of a string's grams is cut in k parts by ranges of the grams' hashes. Each gram that only one of two
strings has spoils one part at most, so strings of n1 and n2 grams that reach theta agree in all but
D = (n1 + n2) (1 - theta) / (1 + theta) parts. Of its parts each string sends the D + MEET that come first in an order
that the parts' contents fix (many rare grams first); by the prefix principle a pair that reaches theta then has MEET
of them in common, and no such pair is missed. Unrelated strings share a part of several grams far more seldom than a single gram.
k depends on a class of sizes; a string is sent to its own class and to those of the larger strings that it may match,
so a pair meets in the class of its larger string. Pairs are verified on the strings.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import stored
from ..functions.strings import jaccard
from .grams import FREQUENCY_BITS, _scrambled, bag, codes, gram_hashes
from .similarity import common_grams

#: Parts that a pair has in common at least; 1 in classes below SMALL grams, where a part counts MEET times.
MEET, SMALL = 8, 128
#: Parts that a task takes, pairs that a task verifies; parts are sent when a task has gathered so many.
TASK_PARTS, TASK_PAIRS, SEND = 2_000_000, 500, 3_000_000
#: Bits of a part's hash that are kept beside its slot.
KEPT = np.uint64((1 << 36) - 1)
#: Keys up to this number are broadcast, rather than have texts shuffled.
BROADCAST_KEYS = 2_000_000


def most_apart(n: float, theta: float) -> int:
    """Grams that one of two strings of n grams together may have alone."""
    return int(n * (1 - theta) / (1 + theta) + 1e-6)


def part_hashes(h: np.ndarray, weight: np.ndarray, theta: float) -> Iterator[tuple[bool, np.ndarray]]:
    """Whether the class is small, and the hashes of the parts that a sorted bag h sends, for each class."""
    n = len(h)
    c = n.bit_length() - 1
    while n and (1 << c) <= n / theta + 1e-6:
        largest = (2 << c) - 1
        small, apart = largest < SMALL, most_apart(2 * largest, theta)
        k = 1 << 20 if small else int((1.8 if largest < 1024 else 1.125) * apart) + 4 * MEET
        wanted = most_apart(n + min(n / theta + 1e-6, largest), theta) + (1 if small else MEET)
        part = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        value, own = np.add.reduceat(_scrambled(h + np.uint64((c + 1) * 0xD6E8FEB86659FD93 % 2**64)), first), part[first]
        if len(first) > wanted:
            value = value + _scrambled(own + np.uint64(1))
            chosen = np.lexsort((value, -np.add.reduceat(weight, first)))[:wanted]
            yield small, _scrambled(value[chosen])
        else:  # parts without grams come last in the order
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), own)[: wanted - len(first)]
            yield small, _scrambled(np.append(value + _scrambled(own + np.uint64(1)), _scrambled(empty + np.uint64(1)) + np.uint64(c)))
        c += 1


def packed(x: np.ndarray) -> bytes:
    """The bytes of unsigned numbers by place, lowest first, without the places that are 0 in all."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    width = data[at]
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + 1 + n * width


def gram_frequencies(df: DataFrame, q: int) -> np.ndarray:
    """How many grams of the strings s fall into each of 2**FREQUENCY_BITS buckets of hashes; they reach the driver as a few blocks of numbers."""
    shift, size, block = np.uint64(64 - FREQUENCY_BITS), 1 << FREQUENCY_BITS, 1 << 14

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(size, np.int64), [np.zeros(0, np.int64)], 0
        for rows in batches:
            for s in rows["s"]:
                held.append((gram_hashes(codes(s), q) >> shift).astype(np.int64))
                n += len(held[-1])
                if n >= size:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=size)
        blocks = total.reshape(-1, block)
        hit = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"b": hit.astype(np.int32), "n": [blocks[b].tobytes() for b in hit]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": rows["b"].iloc[:1], "n": [sum(np.frombuffer(n, np.int64) for n in rows["n"]).tobytes()]})

    out = np.zeros((size // block, block), np.int64)
    for b, n in df.select("s").mapInPandas(count, "b int, n binary").groupBy("b").applyInPandas(add, "b int, n binary").collect():
        out[b] = np.frombuffer(n, np.int64)
    return out.ravel()


def sent_parts(df: DataFrame, q: int, theta: float, counts: np.ndarray) -> DataFrame:
    """slot, n, least, data: the hashes of the parts of all strings of (id, s) with their ids, sorted and packed. Slots below 0 hold small classes."""
    shift = np.uint64(64 - FREQUENCY_BITS)
    slots = max(1, math.ceil(0.35 * counts.sum() / TASK_PARTS))
    # rarer grams weigh more; any weights that are the same for all strings are right
    share = np.maximum(counts, np.median(counts[counts > 0]) if counts.any() else 1) / max(1, counts.sum())
    # whole numbers, so that sums do not depend on their order
    known = df.sparkSession.sparkContext.broadcast(np.rint(100 * np.maximum(-np.log(share) - 9, 0.1)).astype(np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, held, size = known.value, [], 0

        def out() -> pd.DataFrame:
            value, own = np.concatenate([x[1] for x in held]), np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
            small = np.repeat([x[2] for x in held], [len(x[1]) for x in held])
            slot = (((value >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
            slot, value = np.where(small, -1 - slot, slot), value & KEPT
            order = np.lexsort((value, slot))
            slot, value, own = slot[order], value[order], own[order]
            starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            rows = []
            for a, b in itertools.pairwise([*starts.tolist(), len(slot)]):
                least = own[a:b].min()
                rows.append((int(slot[a]), b - a, int(least), packed(np.diff(value[a:b], prepend=np.uint64(0))) + packed((own[a:b] - least).view(np.uint64))))
            held.clear()
            return pd.DataFrame(rows, columns=["slot", "n", "least", "data"])

        for rows in batches:
            for i, s in zip(rows["id"], rows["s"]):
                h = np.sort(bag(s, q))
                for small, value in part_hashes(h, weight[(h >> shift).astype(np.int64)], theta):
                    held.append((i, value, small))
                    size += len(value)
                if size >= SEND:
                    yield out()
                    size = 0
        if held:
            yield out()

    return df.select("id", "s").mapInPandas(run, "slot long, n long, least long, data binary")


def shared(value: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of own (the smaller, the larger) that share a value, with how many they share; each pair once."""
    order = np.lexsort((own, value))
    value, own = value[order], own[order]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1])))
    size = np.diff(np.append(first, len(value)))
    names, own = np.unique(own, return_inverse=True)
    first, size = first[size > 1], size[size > 1]
    few = size <= 16
    pairs = [np.zeros(0, np.int64)]
    for n in np.unique(size[few]):
        rows = own[first[few & (size == n)][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        pairs.append((rows[:, i].astype(np.int64) * len(names) + rows[:, j]).ravel())
    pairs = np.concatenate(pairs)
    # runs of many: for each member those after it in all its runs
    at = [np.arange(a, a + n) for a, n in zip(first[~few], size[~few])]
    end = np.repeat((first + size)[~few], size[~few])
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    order = np.argsort(own[at], kind="stable")
    at, end = at[order], end[order]
    starts = np.flatnonzero(np.append(True, own[at][1:] != own[at][:-1])) if len(at) else []
    found, held = [], 0
    for a, b in itertools.pairwise([*starts, len(at)]):
        x = own[at[a]]
        y, c = np.unique(np.concatenate([own[s + 1 : e] for s, e in zip(at[a:b], end[a:b])]), return_counts=True) if b - a < 4 else _counted(own, at[a:b], end[a:b])
        found.append((x * len(names) + y, c))
        held += len(y)
    key = np.concatenate([pairs, *(k for k, _ in found)])
    count = np.concatenate([np.ones(len(pairs), np.int64), *(c for _, c in found)])
    key, number = np.unique(key, return_inverse=True)
    count = np.bincount(number, weights=count, minlength=len(key)).astype(np.int64)
    other = key // len(names) != key % len(names)  # a string may send a hash twice
    for a in range(0, len(key), 1_000_000):
        k, c, o = key[a : a + 1_000_000], count[a : a + 1_000_000], other[a : a + 1_000_000]
        yield names[k[o] // len(names)], names[k[o] % len(names)], c[o]


def _counted(own: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = np.concatenate([own[s + 1 : e] for s, e in zip(at, end)])
    if not len(rest) or rest.max() - rest.min() > 8 * len(rest):
        return np.unique(rest, return_counts=True)
    least = rest.min()
    c = np.bincount(rest - least)
    y = np.flatnonzero(c)
    return y + least, c[y]


def candidates(parts: DataFrame) -> DataFrame:
    """id1 < id2 of the pairs that have MEET parts in common."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        values, owns = [], []
        for n, least, data in zip(rows["n"], rows["least"], rows["data"]):
            value, at = unpacked(data, n, 0)
            own, _ = unpacked(data, n, at)
            values.append(np.cumsum(value))
            owns.append(own.view(np.int64) + least)
        times = MEET if rows["slot"].iloc[0] < 0 else 1
        found = [pd.DataFrame({"id1": x, "id2": y, "c": c * times}) for x, y, c in shared(np.concatenate(values), np.concatenate(owns))]
        return pd.concat(found) if found else pd.DataFrame({"id1": [], "id2": [], "c": []})

    met = parts.groupBy("slot").applyInPandas(meet, "id1 long, id2 long, c long")
    return met.groupBy("id1", "id2").agg(F.sum("c").alias("c")).filter(F.col("c") >= MEET).select("id1", "id2")


def overlaps(x: list[int], y: list[int], texts: dict[int, str], q: int) -> np.ndarray:
    """The exact overlaps of the bags of pairs of strings; strings in many pairs are numbered once."""
    out = np.zeros(len(x), np.int64)
    names: dict[tuple[str, int], int] = {}
    known: dict[int, np.ndarray] = {}

    def numbered(i: int) -> np.ndarray:
        if i not in known:
            s, seen, numbers = texts[i], {}, []
            for g in (s[k : k + q] for k in range(len(s) - q + 1)):
                seen[g] = k = seen.get(g, 0) + 1
                numbers.append(names.setdefault((g, k), len(names)))
            known[i] = np.array(numbers, np.int64)
        return known[i]

    order = np.argsort(np.array(x), kind="stable")
    for _, some in itertools.groupby(order.tolist(), key=lambda k: x[k]):
        some = list(some)
        if len(some) < 4:
            for k in some:
                out[k] = common_grams(texts[x[k]], texts[y[k]], q)
            continue
        mine = numbered(x[some[0]])
        others = [numbered(y[k]) for k in some]
        has = np.zeros(len(names), bool)
        has[mine] = True
        for k, o in zip(some, others):
            out[k] = has[o].sum()
    return out


def _among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """df joined to a stored table of ids; texts stay where they are unless the ids are very many."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "id", how)


def near_pairs(df: DataFrame, q: int, theta: float) -> DataFrame:
    """(id1, id2, sim), id1 < id2, with sim >= theta within (id long, s) of distinct strings; theta is above 0.5."""
    pairs = stored(candidates(sent_parts(df, q, theta, gram_frequencies(df, q))))
    both = pairs.select(F.col("id1").alias("id"), F.col("id2").alias("lead")).unionByName(pairs.select(F.col("id2").alias("id"), F.col("id1").alias("lead")))
    # pairs of one group of near copies go to few tasks, so that each text is sent few times
    lead = stored(both.groupBy("id").agg(F.least("id", F.min("lead")).alias("lead")))
    tasks = max(1, math.ceil(pairs.count() / TASK_PAIRS))
    l1, l2 = (lead.select(F.col("id").alias(f"id{k}"), F.col("lead").alias(f"lead{k}")) for k in (1, 2))
    dealt = stored(pairs.join(l1, "id1").join(l2, "id2").select("id1", "id2", F.pmod(F.xxhash64("lead1", "lead2"), F.lit(tasks)).alias("task")))
    needed = dealt.select(F.col("id1").alias("id"), "task").unionByName(dealt.select(F.col("id2").alias("id"), "task")).distinct()
    texts = _among(df.select("id", "s"), lead.select("id"), "left_semi").join(needed, "id").select("id", "s", F.col("task").alias("to"))

    def verify(found: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(rows["id"].tolist(), rows["s"].tolist()))
        x, y = found["id1"].tolist(), found["id2"].tolist()
        n = {i: max(0, len(s) - q + 1) for i, s in text.items()}
        return pd.DataFrame({"id1": x, "id2": y, "n1": [n[i] for i in x], "n2": [n[i] for i in y], "o": overlaps(x, y, text, q)})

    found = dealt.groupBy("task").cogroup(texts.groupBy("to")).applyInPandas(verify, "id1 long, id2 long, n1 long, n2 long, o long")
    return found.withColumn("sim", jaccard(F.col("o"), F.col("n1"), F.col("n2"))).filter(F.col("sim") >= theta).select("id1", "id2", "sim")


def near_pairs_and_copies(df: DataFrame, members: DataFrame, q: int, theta: float) -> DataFrame:
    """(id1, id2, sim) within (id, s): the pairs of distinct strings, each by its smallest id, and that id with each of its copies; members is what ``membership`` gives."""
    copies = stored(members.filter("id <> rep"))
    own = _among(df.filter(F.length("s") >= q), copies.select("id"), "left_anti")
    same = _among(df.filter(F.length("s") >= q).select("id"), copies, "inner")
    return near_pairs(own, q, theta).unionByName(same.select(F.col("rep").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("sim")))
