"""Points in the plane: rectangles, nearest neighbours and keyword predicates.

Points have columns id, lat and lng. Distances are squared and planar; ties go to
the smaller id. Rectangles are closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import shared_cut

K = 10
#: Parts of the points in the last round of a batch.
SHARES = 64


def dist2(lat: Column, lng: Column, lat0, lng0) -> Column:
    return (lat - lat0) * (lat - lat0) + (lng - lng0) * (lng - lng0)


def mbr_dist2(lat: Column, lng: Column, min_lat: Column, min_lng: Column, max_lat: Column, max_lng: Column) -> Column:
    """Squared distance of a point to a rectangle, 0 inside."""
    dx = F.greatest(min_lat - lat, F.lit(0.0), lat - max_lat)
    dy = F.greatest(min_lng - lng, F.lit(0.0), lng - max_lng)
    return dx * dx + dy * dy


def mbr_valid(box: DataFrame) -> Column:
    return (box["min_lat"] <= box["max_lat"]) & (box["min_lng"] <= box["max_lng"])


def mbr(points: DataFrame, *keys: str) -> DataFrame:
    """The least rectangle around the points of each group; of the whole table without keys."""
    lat, lng = F.col("lat"), F.col("lng")
    return points.groupBy(*keys).agg(F.min(lat).alias("min_lat"), F.min(lng).alias("min_lng"), F.max(lat).alias("max_lat"), F.max(lng).alias("max_lng"))


def in_rectangle(points: DataFrame, min_lat: float, min_lng: float, max_lat: float, max_lng: float) -> DataFrame:
    """The points of a rectangle; plain range predicates that reach the scan."""
    return points.filter(F.col("lat").between(min_lat, max_lat) & F.col("lng").between(min_lng, max_lng))


def _cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def mbr_pairs(boxes: DataFrame, cell: float) -> DataFrame:
    """(id1, id2), id1 < id2, of rectangles (id, min_lat, min_lng, max_lat, max_lng) that meet: an equi-join on grid cells, then the exact test.

    A rectangle lies on the first level whose cells, of cell * 2**level, are no smaller than it is, and so
    covers four of them at most. Two meet on the coarser one's level, to which the other is lifted; levels are a few dozen.
    A pair is taken only in the cell of its intersection's lower corner, so no distinct is needed.
    """
    extent = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lng") - F.col("min_lng"))
    own = boxes.filter(mbr_valid(boxes)).withColumn("level", F.greatest(F.ceil(F.log2(F.greatest(extent / cell, F.lit(1.0)))), F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in own.select("level").distinct().collect())  # one for each doubling
    names = ("id", "level", "min_lat", "min_lng", "max_lat", "max_lng")

    def gridded(rows: DataFrame, at: Column, k: int) -> DataFrame:
        rows = rows.withColumn("at", at).withColumn("size", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("at")))
        rows = rows.withColumn("cx", F.explode(_cells(F.col("min_lat"), F.col("max_lat"), F.col("size")))).withColumn("cy", F.explode(_cells(F.col("min_lng"), F.col("max_lng"), F.col("size"))))
        return rows.select("at", "cx", "cy", *(F.col(c).alias(f"{c}{k}") for c in names), *(["size"] if k == 2 else []))

    lifted = gridded(own, F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("level"))), 1)
    met = lifted.join(gridded(own, F.col("level"), 2), ["at", "cx", "cy"]).filter("level1 < level2 OR id1 < id2")
    met = met.filter("id1 <> id2 AND min_lat1 <= max_lat2 AND min_lat2 <= max_lat1 AND min_lng1 <= max_lng2 AND min_lng2 <= max_lng1")
    size = F.col("size")
    corner = (F.floor(F.greatest("min_lat1", "min_lat2") / size) == F.col("cx")) & (F.floor(F.greatest("min_lng1", "min_lng2") / size) == F.col("cy"))
    return met.filter(corner).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))


def nearest(points: DataFrame, lat: float, lng: float, k: int = K, where: Column | None = None) -> DataFrame:
    """The k points nearest to a place among those that pass where, with dist2; planned as one take-ordered."""
    rows = points if where is None else points.filter(where)
    d = dist2(F.col("lat"), F.col("lng"), F.lit(float(lat)), F.lit(float(lng)))
    return rows.filter("lat IS NOT NULL AND lng IS NOT NULL").withColumn("dist2", d).orderBy("dist2", "id").limit(k)


def keyword_nearest(places: DataFrame, lat: float, lng: float, keyword: str, k: int = K) -> DataFrame:
    """The k nearest places whose name contains the keyword literally; an empty keyword passes all."""
    return nearest(places, lat, lng, k, F.contains(F.col("name"), F.lit(keyword)))


def nearest_batch(points: DataFrame, requests: DataFrame, k: int = K, where: Column | None = None) -> DataFrame:
    """(req_id, id, dist2, rank): the k nearest points of every request (req_id, lat, lng; where may use both sides' columns).

    Requests look in the 3 x 3 grid cells around them. Those that find k points
    no farther than the block's rim are done; the rest try again with cells of twice the
    size, until a block covers all points. No request is held against all points before that; then
    the points are dealt to SHARES parts, and the requests that are left ask each part for its k nearest.
    """
    pts = points.filter("lat IS NOT NULL AND lng IS NOT NULL")
    box = pts.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in ("lat", "lng") for f in (F.min, F.max))).first()
    rest = requests.filter("lat IS NOT NULL AND lng IS NOT NULL").withColumnsRenamed({"lat": "lat0", "lng": "lng0"})
    if not box["n"]:
        return rest.select("req_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist2"), F.lit(0).alias("rank")).limit(0)
    span = max(box["lat_max"] - box["lat_min"], box["lng_max"] - box["lng_min"], 1e-9)
    cell = span / max(1.0, (box["n"] / max(k, 1)) ** 0.5)
    cell_of = lambda lat, lng, size: (F.floor((F.col(lat) - box["lat_min"]) / size), F.floor((F.col(lng) - box["lng_min"]) / size))
    done = None
    while True:
        cx, cy = cell_of("lat", "lng", cell)
        qx, qy = cell_of("lat0", "lng0", cell)
        last = cell >= span
        grid = pts.withColumn("cx", cx).withColumn("cy", cy)
        if last:
            grid = pts.withColumn("cx", F.pmod(F.xxhash64("id"), F.lit(SHARES))).withColumn("cy", F.lit(0))
            asked = rest.withColumn("cx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))).withColumn("cy", F.lit(0))
        else:
            asked = rest.withColumn("cx", F.explode(F.sequence(qx - 1, qx + 1))).withColumn("cy", F.explode(F.sequence(qy - 1, qy + 1)))
        met = asked.withColumnsRenamed({"cx": "_x", "cy": "_y"}).join(grid, (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")))
        met = met if where is None else met.filter(where)
        met = met.withColumn("dist2", dist2(F.col("lat"), F.col("lng"), F.col("lat0"), F.col("lng0"))).select("req_id", "id", "dist2")
        top = met.withColumn("rank", F.row_number().over(Window.partitionBy("req_id").orderBy("dist2", "id"))).filter(F.col("rank") <= k)
        if last:
            return top if done is None else done.unionByName(top)
        # the block reaches one cell beyond the request's own at least
        sure = top.groupBy("req_id").agg(F.max("dist2").alias("far"), F.count(F.lit(1)).alias("n")).filter((F.col("n") == k) & (F.col("far") < cell * cell)).select("req_id")
        sure = shared_cut(sure)
        settled = top.join(sure, "req_id", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        rest = rest.join(sure, "req_id", "left_anti")
        if rest.isEmpty():
            return done
        cell *= 2
