"""A stored index of strings for many searches under different thresholds.

``build`` writes, for strings (id, s), the rarest grams of each with their places in the rare-first order, as far as
the smallest threshold needs them, dealt to folders by the gram's hash; the counts that define the
order; the distinct strings; and every row's representative among them. A search reads the folders that its queries' grams fall into, cuts the prefixes to its own
threshold, and goes on as the joins in ``similarity`` do; what it finds is given for every row, so its rows are the same.

Defined cases: null strings are left out of the index and null queries find nothing; an empty table gives an index
that finds nothing; a threshold beyond what the index was built for is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import stored
from ..functions.strings import every_row, jaccard, membership, representatives
from .grams import FREQUENCY_BITS, bucket_counts, rare_prefixes
from .similarity import ed_candidates, jaccard_candidates, verified

#: Folders that the grams are dealt to, unless build is told otherwise; more of them let a small search read less of a large index.
SLOTS = 32


def build(data: DataFrame, q: int, path: str, theta: float = 0.5, tau: int = 2, slots: int = SLOTS) -> GramIndex:
    """Writes an index of (id, s) under path, for Jaccard thresholds from theta on and edit distances up to tau; path must not exist."""
    if not 0 < theta <= 1 or tau < 0:
        raise ValueError("theta above 0, at most 1; tau from 0 on")
    spark = data.sparkSession
    representatives(data).select("id", "s").write.parquet(f"{path}/strings")
    membership(data).write.parquet(f"{path}/rows")
    strings = spark.read.parquet(f"{path}/strings")
    counts = bucket_counts(strings, q)
    hit = np.flatnonzero(counts)
    spark.createDataFrame([(q, float(theta), tau, slots, hit.astype(np.int32).tobytes(), counts[hit].tobytes())], "q int, theta double, tau int, slots int, buckets binary, counts binary").coalesce(1).write.parquet(f"{path}/order")
    some = lambda n, _: max(n - math.ceil(theta * n - 1e-8) + 1, q * tau + 1)
    grams = rare_prefixes(strings, q, counts, some).withColumn("slot", F.pmod("gram", F.lit(slots)).cast("int"))
    # a slot's rows are split over tasks where they are many
    grams.hint("rebalance", "slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/grams")
    return GramIndex.load(spark, path)


@dataclass(frozen=True)
class GramIndex:
    strings: DataFrame
    rows: DataFrame
    grams: DataFrame
    counts: np.ndarray
    q: int
    theta: float
    tau: int
    slots: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GramIndex:
        strings = spark.read.parquet(f"{path}/strings")
        kind = strings.schema["id"].dataType.simpleString()
        grams = spark.read.schema(f"id {kind}, n int, gram long, pos int, slot int").parquet(f"{path}/grams")
        known = spark.read.parquet(f"{path}/order").first()
        counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
        counts[np.frombuffer(known["buckets"], np.int32)] = np.frombuffer(known["counts"], np.int64)
        return cls(strings, spark.read.parquet(f"{path}/rows"), grams, counts, known["q"], known["theta"], known["tau"], known["slots"])

    def _near(self, asked: DataFrame, most) -> DataFrame:
        """The stored grams in the slots of asked, of prefixes whose length most gives."""
        slots = [r[0] for r in asked.select(F.pmod("gram", F.lit(self.slots)).cast("int")).distinct().collect()]  # self.slots values at most
        return self.grams.filter(F.col("slot").isin(slots) & (F.col("pos") < most)).select("id", "n", "gram", "pos")

    def jaccard_search(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, sim) for queries (query_id, query, threshold)."""
        left = queries.select(F.col("query_id").alias("id"), F.col("query").alias("s"), "threshold").filter("s IS NOT NULL")
        least = left.agg(F.min("threshold")).first()[0]
        least = self.theta if least is None else least
        if least < self.theta:
            raise ValueError(f"the index serves thresholds from {self.theta} on")
        a = stored(rare_prefixes(left, self.q, self.counts, lambda n, t: n - math.ceil(t * n - 1e-8) + 1, "threshold"))
        b = self._near(a, F.col("n") - F.ceil(least * F.col("n") - F.lit(1e-8)) + 1)
        n1, n2, limit = F.col("n1"), F.col("n2"), F.col("threshold")
        pairs = jaccard_candidates(a, b, (n2 >= limit * n1) & (n1 >= limit * n2), limit, "threshold")
        found = verified(pairs, left, self.strings, self.q).withColumn("sim", jaccard(F.col("o"), n1, n2))
        return every_row(found.filter(F.col("sim") >= limit).select(F.col("id1").alias("query_id"), F.col("id2").alias("id"), "sim"), self.rows)

    def ed_search(self, queries: DataFrame, tau: int) -> DataFrame:
        """(query_id, id, dist) for queries (query_id, query)."""
        if not 0 <= tau <= self.tau:
            raise ValueError(f"the index serves distances up to {self.tau}")
        left = queries.select(F.col("query_id").alias("id"), F.col("query").alias("s")).filter("s IS NOT NULL")
        few = self.q * tau + 1
        a = stored(rare_prefixes(left, self.q, self.counts, lambda n, _: few))
        pairs = ed_candidates(a, self._near(a, F.lit(few)), left, self.strings, self.q, tau).distinct()
        rows = pairs.join(left.select(F.col("id").alias("id1"), F.col("s").alias("s1")), "id1").join(self.strings.select(F.col("id").alias("id2"), F.col("s").alias("s2")), "id2")
        return every_row(rows.withColumn("dist", F.levenshtein("s1", "s2", tau)).filter("dist >= 0").select(F.col("id1").alias("query_id"), F.col("id2").alias("id"), "dist"), self.rows)
