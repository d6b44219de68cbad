"""Infix search on names, autocompletion, and suffix arrays with common prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import with_rank
from ..functions.strings import chars, let, qgrams

K = 10


def first_suffix(name: Column, keyword: str) -> Column:
    """The smallest suffix of the name that begins with the keyword; the name itself for an empty keyword, null if there is none."""
    if not keyword:
        return name
    n = F.length(name)
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(name, i, F.lit(len(keyword))) == keyword)
    return F.when(F.contains(name, F.lit(keyword)), F.array_min(F.transform(at, lambda i: F.substr(name, i, n))))


def infix_search(places: DataFrame, keyword: str, k: int = K) -> DataFrame:
    """The first k places (id, name and more) whose name contains the keyword literally, by smallest matching suffix and id."""
    found = places.filter(F.contains(F.col("name"), F.lit(keyword))).withColumn("suffix", first_suffix(F.col("name"), keyword))
    return found.orderBy("suffix", "id").limit(k)


def containing(places: DataFrame, words: DataFrame) -> DataFrame:
    """(keyword, id, name) of the places (id, name) that contain a word (keyword, distinct, not empty) literally.

    A name and a word meet by the word's first one to three characters; three wherever the word has them.
    """
    sizes = [r[0] for r in words.select(F.least(F.length("keyword"), F.lit(3)).alias("q")).distinct().collect()]  # three values at most
    keyed = words.select("keyword", F.substring("keyword", 1, 3).alias("gram"))
    if not sizes:
        return keyed.select("keyword").join(places.select("id", "name"), F.lit(False))
    grams = F.array_distinct(F.flatten(F.array(*(qgrams(F.col("name"), q) for q in sorted(sizes)))))
    named = places.filter("name IS NOT NULL").select("id", "name", F.explode(grams).alias("gram"))
    return named.join(keyed, "gram").filter(F.contains(F.col("name"), F.col("keyword"))).select("keyword", "id", "name")


def autocomplete(places: DataFrame, keyword: str, k: int = K) -> DataFrame:
    """One row: suggestions, the names that infix_search finds, in its order."""
    rows = infix_search(places, keyword, k)  # k rows at most
    ordered = F.array_sort(F.collect_list(F.struct("suffix", "id", "name")))
    return rows.agg(F.transform(ordered, lambda r: r["name"]).alias("suggestions"))


def suffixes(df: DataFrame) -> DataFrame:
    """(id, pos, suffix) of (id, s); positions are 0-based."""
    rows = df.filter("s IS NOT NULL AND s <> ''")
    return rows.select("id", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1)).alias("pos")).select("id", "pos", F.expr("substr(s, pos + 1)").alias("suffix"))


def suffix_array(df: DataFrame) -> DataFrame:
    """(rank, id, pos, suffix): all suffixes in order of (suffix, id, pos), from rank 0."""
    return with_rank(suffixes(df), "suffix", "id", "pos").select(F.col("rank").cast("long").alias("rank"), "id", "pos", "suffix")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    differ = let(F.zip_with(chars(a), chars(b), lambda x, y: ~x.eqNullSafe(y)), lambda d: F.array_position(d, F.lit(True)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, F.length(a)).otherwise(differ - 1).cast("int")


def lcp_array(df: DataFrame) -> DataFrame:
    """(rank, id, pos, lcp): each suffix's common prefix with the one before it in order; 0 for the first."""
    sa = suffix_array(df)
    before = sa.select((F.col("rank") + 1).alias("rank"), F.col("suffix").alias("_s"))
    return sa.join(before, "rank", "left").select("rank", "id", "pos", F.coalesce(common_prefix(F.col("suffix"), F.col("_s")), F.lit(0)).alias("lcp"))
