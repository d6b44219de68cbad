"""Similarity search and joins under a Jaccard or edit-distance threshold.

Candidates come from an equi-join on grams, restricted to each string's rarest
grams: two strings that match share one of them. The length bounds are residual
predicates of that join; of a pair's shared grams the first place and the number bound the overlap that
is still possible, and pairs below the least overlap are dropped. What is left is verified
on the strings. A gram that many strings have is spread over tasks. Strings that are
null take no part; strings shorter than q have no grams and match under Jaccard
only for a threshold of 0, where every pair does.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.order import stored
from ..functions.strings import deletions, gram_count, jaccard, overlap_bound, t_bound
from .grams import bucket_counts, codes, gram_hashes, gram_table, rare_prefixes

STRATEGIES = ("prefix", "count", "brute")
#: Rows of one gram that a task may get at least, and the share of all rows beyond which they are spread.
SPREAD_ROWS = 20_000
SPREAD_SHARE = 500
#: For an edit distance of 1 or 0, strings of at most so many characters meet by what is left of them without one character; longer ones by grams.
DELETION_CHARS = 64


def common_grams(a: str, b: str, q: int) -> int:
    """Size of the multiset intersection of the grams of two strings, exactly."""
    x, y = codes(a), codes(b)
    hx, hy = gram_hashes(x, q), gram_hashes(y, q)
    values, number = np.unique(np.append(hx, hy), return_inverse=True)
    # equal hashes have to be equal grams
    first = np.zeros(len(values), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    starts = np.append(np.arange(len(hx)), len(x) + np.arange(len(hy)))
    both = np.append(x, y)
    if any((both[starts + k] != both[starts[first[number]] + k]).any() for k in range(q)):
        grams = [a[k : k + q] for k in range(len(hx))] + [b[k : k + q] for k in range(len(hy))]
        names: dict[str, int] = {}
        number = np.array([names.setdefault(g, len(names)) for g in grams])
    size = int(number.max(initial=-1)) + 1
    return int(np.minimum(np.bincount(number[: len(hx)], minlength=size), np.bincount(number[len(hx) :], minlength=size)).sum())


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, q: int) -> DataFrame:
    """id1, id2, o (the overlap) and the rest of the candidate pairs."""

    @F.pandas_udf(LongType())
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_grams(x, y, q) for x, y in zip(a, b)], dtype="int64")

    a, b = left.select(F.col("id").alias("id1"), F.col("s").alias("s1")), right.select(F.col("id").alias("id2"), F.col("s").alias("s2"))
    return pairs.join(a, "id1").join(b, "id2").withColumn("o", overlap("s1", "s2")).drop("s1", "s2")


def _meeting(a: DataFrame, b: DataFrame, near: Column) -> DataFrame:
    """Rows of two stored prefix tables (id, n, gram, pos and more on the left) that share a gram; those of a common gram are spread over tasks."""
    many = b.groupBy("gram").count()
    fair = max(SPREAD_ROWS, b.count() // SPREAD_SHARE)
    hot = stored(many.filter(F.col("count") > fair).select(F.col("gram").alias("_hot"), F.ceil(F.col("count") / fair).cast("int").alias("_parts")))  # fewer than SPREAD_SHARE rows
    a = a.withColumnsRenamed({c: f"{c}1" for c in ("id", "n", "pos")})
    b = b.select(*(F.col(c).alias(f"{c}2") for c in ("id", "n", "pos")), F.col("gram").alias("_g"))
    on = F.col("gram") == F.col("_g")
    if not hot.isEmpty():
        parts, hot = F.coalesce("_parts", F.lit(1)), F.broadcast(hot)
        a = a.join(hot, a["gram"] == hot["_hot"], "left").withColumn("_own", F.pmod(F.xxhash64("id1"), parts)).drop("_hot", "_parts")
        b = b.join(hot, b["_g"] == hot["_hot"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
        on = on & (F.col("_own") == F.col("_part"))
    return a.join(b, on & near)


def _prefix_tables(left: DataFrame, right: DataFrame, q: int, first: Callable[[int, float], int], second: Callable[[int, float], int], *keep: str) -> tuple[DataFrame, DataFrame]:
    counts = bucket_counts(right, q)
    b = stored(rare_prefixes(right, q, counts, second))
    return b if left is right and not keep else stored(rare_prefixes(left, q, counts, first, *keep)), b


def jaccard_candidates(a: DataFrame, b: DataFrame, near: Column, theta: Column, *keep: str) -> DataFrame:
    """id1, id2, n1, n2 and keep of the pairs of two stored prefix tables whose overlap may reach theta."""
    n1, n2 = F.col("n1"), F.col("n2")
    met = _meeting(a, b, near)
    # grams shared up to the last place are all in both prefixes; those after it are as many as the shorter rest
    rest = lambda f: F.least(n1 - 1 - f("pos1"), n2 - 1 - f("pos2"))
    pairs = met.groupBy("id1", "id2", "n1", "n2", *keep).agg(F.count(F.lit(1)).alias("_c"), rest(F.min).alias("_first"), rest(F.max).alias("_last"))
    need = overlap_bound(n1, n2, theta)
    return pairs.filter((F.col("_first") + 1 >= need) & (F.col("_c") + F.col("_last") >= need)).select("id1", "id2", "n1", "n2", *keep)


def jaccard_pairs(left: DataFrame, right: DataFrame, q: int, theta: float | None = None, self_join: bool = False, strategy: str = "prefix") -> DataFrame:
    """(id1, id2, sim) with sim >= theta for (id, s) on both sides; left may have a threshold of its own for each row.

    Every left row is held against every right row; self_join keeps id1 < id2.
    A threshold of 0 or less matches all pairs, which then are the result.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy: one of {STRATEGIES}")
    own = "threshold" in left.columns
    if own:
        least = left.agg(F.min("threshold")).first()[0]
        theta = 0.0 if least is None else least
    if theta is None:
        raise ValueError("theta, or a column threshold on the left")
    same = left is right
    right = right.filter("s IS NOT NULL")
    left = right if same else left.filter("s IS NOT NULL")
    limit = (lambda c="threshold": F.col(c)) if own else (lambda c="": F.lit(float(theta)))
    if strategy == "brute" or theta <= 0:
        return _jaccard_brute(left, right, q, limit, self_join)
    keep = ("threshold",) if own else ()
    n1, n2 = F.col("n1"), F.col("n2")
    near = (n2 >= limit() * n1) & (n1 >= limit() * n2)
    if self_join:
        near = near & (F.col("id1") < F.col("id2"))
    names = ("id", "n", "c")
    if strategy == "count":
        g1, g2 = gram_table(left, q, *keep), gram_table(right, q)
        a = g1.select(*(F.col(c).alias(f"{c}1") for c in names), "gram", *keep)
        b = g2.select(*(F.col(c).alias(f"{c}2") for c in names), F.col("gram").alias("_g"))
        met = a.join(b, (F.col("gram") == F.col("_g")) & near)
        found = met.groupBy("id1", "id2", "n1", "n2", *keep).agg(F.sum(F.least("c1", "c2")).alias("o"))
    else:
        some = lambda n, t: n - math.ceil(t * n - 1e-8) + 1
        a, b = _prefix_tables(left, right, q, (lambda n, t: some(n, t)) if own else (lambda n, _: some(n, theta)), lambda n, _: some(n, theta), *keep)
        pairs = jaccard_candidates(a, b, near, limit(), *keep)
        found = verified(pairs, left, right, q)
    return found.withColumn("sim", jaccard(F.col("o"), n1, n2)).filter(F.col("sim") >= limit()).select("id1", "id2", "sim")


def _jaccard_brute(left: DataFrame, right: DataFrame, q: int, limit, self_join: bool) -> DataFrame:
    """All pairs; for tests on small tables, and for thresholds of 0, whose result is all pairs."""
    from ..functions.strings import multiset_overlap, qgrams

    a = left.withColumn("g1", qgrams(F.col("s"), q)).withColumnRenamed("id", "id1").drop("s")
    b = right.select(F.col("id").alias("id2"), qgrams(F.col("s"), q).alias("g2"))
    rows = a.crossJoin(b)
    rows = rows.filter("id1 < id2") if self_join else rows
    rows = rows.withColumn("sim", jaccard(multiset_overlap(F.col("g1"), F.col("g2")), F.size("g1"), F.size("g2")))
    return rows.filter((F.col("sim") >= limit()) & ((F.size("g1") > 0) & (F.size("g2") > 0) | (limit() <= 0))).select("id1", "id2", "sim")


def jaccard_search(queries: DataFrame, data: DataFrame, q: int, strategy: str = "prefix") -> DataFrame:
    """(query_id, id, sim) for queries (query_id, query, threshold) and data (id, s)."""
    left = queries.select(F.col("query_id").alias("id"), F.col("query").alias("s"), "threshold")
    found = jaccard_pairs(left, data, q, strategy=strategy)
    return found.select(F.col("id1").alias("query_id"), F.col("id2").alias("id"), "sim")


def t_occurrence(queries: DataFrame, data: DataFrame, q: int) -> DataFrame:
    """(query_id, id, cnt): shared grams, where a query's grams of a string reach the bound T of its threshold."""
    g1 = gram_table(queries.select(F.col("query_id").alias("id"), F.col("query").alias("s"), "threshold"), q, "threshold")
    g2 = gram_table(data, q)
    least = data.filter(gram_count(F.col("s"), q) > 0).agg(F.min(gram_count(F.col("s"), q)).alias("least"))
    a = g1.select(F.col("id").alias("query_id"), F.col("n").alias("n1"), "threshold", "gram", F.col("c").alias("c1"))
    met = a.join(g2.select("id", "gram", F.col("c").alias("c2")), "gram").groupBy("query_id", "n1", "threshold", "id").agg(F.sum(F.least("c1", "c2")).alias("cnt"))
    met = met.crossJoin(F.broadcast(least))  # one row
    return met.filter(F.col("cnt") >= t_bound(F.col("n1"), F.col("least"), F.col("threshold"))).select("query_id", "id", "cnt")


def _segment(n: Column, k: Column, tau: int) -> tuple[Column, Column]:
    """Offset and length of segment k of tau + 1 of a string of length n; the first n mod (tau + 1) are longer by one."""
    short, longer = F.floor(n / (tau + 1)).cast("int"), (n % (tau + 1)).cast("int")
    return (k * short + F.least(k, longer)).cast("int"), (short + F.when(k < longer, 1).otherwise(0)).cast("int")


def segments(df: DataFrame, tau: int) -> DataFrame:
    """(id, seg_no, seg_off, seg): each string of (id, s) in tau + 1 nearly equal parts; of them one is left whole by tau edits."""
    rows = df.filter("s IS NOT NULL").withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.lit(tau))))
    off, size = _segment(F.length("s"), F.col("seg_no"), tau)
    return rows.select("id", "seg_no", off.alias("seg_off"), F.col("s").substr(off + 1, size).alias("seg"))


def _short_pairs(left: DataFrame, right: DataFrame, tau: int) -> DataFrame:
    """Candidates among strings too short for grams: by a shared segment near its place, and by length alone where no longer than tau."""
    r = right.withColumn("len", F.length("s"))
    keyed = segments(r.filter(F.col("len") > tau), tau).join(r.select("id", "len"), "id").select(F.col("id").alias("id2"), "len", "seg_no", "seg")
    probe = left.withColumn("len", F.explode(F.sequence(F.greatest(F.length("s") - tau, F.lit(tau + 1)), F.greatest(F.length("s") + tau, F.lit(tau + 1)))))
    probe = probe.filter(F.abs(F.col("len") - F.length("s")) <= tau)
    probe = probe.withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.lit(tau)))).withColumn("d", F.explode(F.sequence(F.lit(-tau), F.lit(tau))))
    off, size = _segment(F.col("len"), F.col("seg_no"), tau)
    probe = probe.withColumn("at", off + F.col("d")).withColumn("size", size).filter("at >= 0 AND at + size <= length(s)")
    probe = probe.select(F.col("id").alias("id1"), "len", "seg_no", F.expr("substr(s, at + 1, size)").alias("seg")).distinct()
    by_segment = probe.join(keyed, ["len", "seg_no", "seg"]).select("id1", "id2")
    tiny = r.filter(F.col("len") <= tau).select(F.col("id").alias("id2"), "len")
    reach = left.filter(F.length("s") <= 2 * tau).select(F.col("id").alias("id1"), F.explode(F.sequence(F.greatest(F.length("s") - tau, F.lit(0)), F.length("s") + tau)).alias("len"))
    return by_segment.unionByName(reach.join(tiny, "len").select("id1", "id2"))


def _deletion_pairs(left: DataFrame, right: DataFrame, tau: int) -> DataFrame:
    """Candidates for tau of 0 or 1: two strings within one edit are equal once each has lost one character at most. Only hashes and ids move."""
    keyed = lambda df, name: df.select(F.col("id").alias(name), F.explode(deletions(F.col("s"), tau)).alias("_left")).select(name, F.xxhash64("_left").alias("_key"))
    return keyed(left, "id1").join(keyed(right, "id2"), "_key").select("id1", "id2")


def _ed_pairs_of_grams(left: DataFrame, right: DataFrame, q: int, tau: int) -> DataFrame:
    few = lambda n, _: q * tau + 1
    a, b = _prefix_tables(left, right, q, few, few)
    return ed_candidates(a, b, left, right, q, tau)


def ed_candidates(a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame, q: int, tau: int) -> DataFrame:
    """id1, id2 of the pairs that share a gram of two stored prefix tables, and of short strings that share a segment."""
    pairs = _meeting(a, b, F.abs(F.col("n1") - F.col("n2")) <= tau).select("id1", "id2")
    short = F.length("s") <= q * tau + q - 1
    return pairs.unionByName(_short_pairs(left.filter(short), right.filter(short), tau))


def ed_pairs(left: DataFrame, right: DataFrame, q: int, tau: int, self_join: bool = False, strategy: str = "prefix") -> DataFrame:
    """(id1, id2, dist) with an edit distance of tau or less for (id, s) on both sides; self_join keeps id1 < id2.

    tau edits change q * tau grams at most, so strings with more grams share one of
    their q * tau + 1 rarest; strings of at most q * tau + q - 1 characters may
    share none and are matched by segments. Where tau is 1 or 0, strings of up to
    DELETION_CHARS characters meet by their deletions instead: grams of names that count
    are all common, so nearly every pair would share one.
    """
    same = left is right
    right = right.select("id", "s").filter("s IS NOT NULL")
    left = right if same else left.select("id", "s").filter("s IS NOT NULL")
    s1, s2 = left.select(F.col("id").alias("id1"), F.col("s").alias("s1")), right.select(F.col("id").alias("id2"), F.col("s").alias("s2"))
    if strategy == "brute":
        rows = s1.crossJoin(s2)
    else:
        if tau > 1:
            pairs = _ed_pairs_of_grams(left, right, q, tau)
        else:  # of a pair both are within DELETION_CHARS + tau, or both are beyond DELETION_CHARS
            brief, long = F.length("s") <= DELETION_CHARS + tau, F.length("s") > DELETION_CHARS
            pairs = _deletion_pairs(left.filter(brief), right.filter(brief), tau)
            if not (left.filter(long).isEmpty() or right.filter(long).isEmpty()):
                r = right.filter(long)
                pairs = pairs.unionByName(_ed_pairs_of_grams(r if same else left.filter(long), r, q, tau))
        pairs = (pairs.filter("id1 < id2") if self_join else pairs).distinct()
        rows = pairs.join(s1, "id1").join(s2, "id2")
    rows = rows.filter("id1 < id2") if self_join else rows
    return rows.withColumn("dist", F.levenshtein("s1", "s2", tau)).filter("dist >= 0").select("id1", "id2", "dist")


def ed_search(queries: DataFrame, data: DataFrame, q: int, tau: int, strategy: str = "prefix") -> DataFrame:
    """(query_id, id, dist) for queries (query_id, query) and data (id, s)."""
    found = ed_pairs(queries.select(F.col("query_id").alias("id"), F.col("query").alias("s")), data, q, tau, strategy=strategy)
    return found.select(F.col("id1").alias("query_id"), F.col("id2").alias("id"), "dist")
