"""The place service: one request, or many, against a table of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import stored
from ..operators.infix import K, containing, infix_search
from ..operators.spatial import dist2, keyword_nearest, nearest_batch

REPLY = ["lat", "lng", "addr", "name", "pcode"]
#: Keywords that so many places have at most are looked up; for others the grid finds near places fast.
RARE = 2000


def search(places: DataFrame, q: str, lat: float | None = None, lng: float | None = None, k: int = K) -> DataFrame:
    """The k nearest places whose name contains q if a position is given, else the first k by matching suffix."""
    if lat is not None and lng is not None:
        return keyword_nearest(places, lat, lng, q, k).select("id", *REPLY)
    return infix_search(places, q, k).select("id", *REPLY)


def _first(rows: DataFrame, k: int, *order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("req_id").orderBy(*order))).filter(F.col("rank") <= k).select("req_id", "id", "rank")


def _near(places: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest places of each request (req_id, lat, lng, keyword) whose name has the keyword.

    Requests with a rare keyword meet its places alone, so the grid is asked for keywords only that many places have, or for none.
    """
    words = asked.filter("keyword <> ''").select("keyword").distinct()
    found = containing(places, words)
    counts = stored(words.join(found.groupBy("keyword").count(), "keyword", "left").select("keyword", F.coalesce("count", F.lit(0)).alias("n")))
    rare = counts.filter(F.col("n") <= RARE).select("keyword")
    few = containing(places, rare).join(places.select("id", "lat", "lng"), "id").filter("lat IS NOT NULL AND lng IS NOT NULL").withColumnsRenamed({"lat": "_lat", "lng": "_lng"})
    here = asked.join(few, "keyword").withColumn("dist2", dist2(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng")))
    rest = asked.join(rare, "keyword", "left_anti").filter("keyword IS NOT NULL")
    return _first(here, k, "dist2", "id").unionByName(nearest_batch(places, rest, k, F.contains(F.col("name"), F.col("keyword"))).select("req_id", "id", "rank"))


def answer(places: DataFrame, requests: DataFrame, k: int = K) -> DataFrame:
    """(req_id, rank, id, lat, lng, addr, name, pcode) for requests (req_id, qt, lat, lng, keyword) of either kind.

    Requests without a position meet the places by their keyword's first characters; of what a
    keyword finds each task keeps the first k. An empty keyword has the first k names of all.
    """
    near = _near(places, requests.filter("qt = 0 AND lat IS NOT NULL AND lng IS NOT NULL").select("req_id", "lat", "lng", "keyword"), k)
    asked = requests.filter("qt <> 0 AND keyword IS NOT NULL").select("req_id", "keyword")
    words = asked.filter("keyword <> ''").select("keyword").distinct()
    n, m = F.length("name"), F.length("keyword")
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr("name", i, m) == F.col("keyword"))
    met = containing(places, words).withColumn("suffix", F.array_min(F.transform(at, lambda i: F.substr("name", i, n))))
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("keyword").orderBy("suffix", "id"))).filter(F.col("rank") <= k).select("keyword", "id", "rank")
    every = places.filter("name IS NOT NULL").select("id", "name").orderBy("name", "id").limit(k)
    every = every.withColumn("rank", F.row_number().over(Window.orderBy("name", "id"))).select(F.lit("").alias("keyword"), "id", "rank")  # k rows
    found = asked.join(first.unionByName(every), "keyword").select("req_id", "id", "rank")
    return near.unionByName(found).join(places, "id").select("req_id", "rank", "id", *REPLY)
