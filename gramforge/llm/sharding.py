"""Sharding by extendible hashing.

The directory is indexed by leading bits of a document's hash. A bucket whose
bytes exceed the limit splits on its next bit, and only such a bucket; its
shard is the leaf that is reached. Rather than one pass for each bit, the first round sums
the bytes of buckets that are a quarter to an eighth of the limit on average (a map-side combined
aggregate, never a collected group) and settles all splits down to them; so its rows grow with the
number of shards. Further rounds, of STEP bits each, go on over the oversized buckets alone.

Defined cases: a null text has 0 bytes; a null doc_id hashes as an empty string;
a document larger than the limit gets a shard alone; rows that repeat one hash
cannot be split by bits, so beyond the limit they are cut in order of size into
numbered parts of that leaf, PART_ROWS rows or so at a time; other columns are carried along by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, cut, met, restored, stored

BITS = 60
STEP = 6
LIMIT = 128 << 10
#: Rows of one repeated hash that are sorted together to be cut into parts.
PART_ROWS = 50_000


def hashed(docs: DataFrame) -> DataFrame:
    """docs with h, the first 60 bits of md5 of the id, and bytes."""
    code = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    return docs.withColumn("h", code).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))


def directory(keys: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Leaves (depth, prefix, bytes, docs): prefix holds the first depth bits of the hashes; keys has h and bytes.

    A leaf is over the limit only where all its rows share one hash.
    """
    leaves, parents, top = None, None, 0
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    deep = min(BITS, max(1, (total // limit).bit_length() + 2))
    while True:
        part = lambda d: F.shiftright("h", BITS - d)
        open_keys = keys
        if parents is not None:
            open_keys = keys.join(parents.select(F.col("prefix").alias("_p")), part(top) == F.col("_p"), "left_semi")
        sums = open_keys.groupBy(part(deep).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        levels = F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("p", deep - d).alias("prefix")) for d in range(top, deep + 1)))
        level = sums.select(F.inline(levels), "bytes", "docs", "h0", "h1").groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        # a bucket goes on splitting while it is too large and holds several hashes
        level = cut(level.withColumn("over", (F.col("bytes") > limit) & (F.col("h0") < F.col("h1"))))
        up = level.filter("over").select((F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_q"))
        reached = level.join(up, (F.col("depth") == F.col("_d")) & (F.shiftright("prefix", 1) == F.col("_q")), "left_semi")
        if top == 0:
            reached = reached.unionByName(level.filter("depth = 0"))
        found = reached.filter("NOT over").select("depth", "prefix", "bytes", "docs")
        leaves = found if leaves is None else leaves.unionByName(found)
        parents = cut(reached.filter(F.col("over") & (F.col("depth") == deep)).select("prefix"))
        if deep == BITS or parents.isEmpty():
            return leaves
        top, deep = deep, min(BITS, deep + STEP)


def assign(keys: DataFrame, leaves: DataFrame, limit: int = LIMIT) -> DataFrame:
    """keys with shard (the leaf's bits as a string, "root" for no bits), depth, part and shard_bytes.

    A hash meets its leaf by an equi-join on (depth, prefix): it is tried at the depths that the directory
    has, of which exactly one matches. Only hashes are tried, each once; keys meet what was found for theirs,
    so no other column is repeated for the depths.
    """
    keys = keys.drop("shard", "depth", "part", "shard_bytes")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # 61 values at most
    if not depths:
        return keys.withColumns({"shard": F.lit(""), "depth": F.lit(0), "part": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long")})
    tries = F.array(*(F.struct(F.lit(d).alias("_d"), F.shiftright("h", BITS - d).alias("_p")) for d in sorted(depths)))
    hashes = keys.groupBy("h").agg(F.count(F.lit(1)).alias("_n"))
    tried = hashes.withColumn("_t", F.explode(tries)).select("h", "_n", "_t._d", "_t._p")
    there = leaves.select(F.col("depth").alias("_d"), F.col("prefix").alias("_p"), F.col("depth").alias("depth"), F.col("prefix").alias("_q"), F.col("bytes").alias("_all"), F.col("docs").alias("n"))
    bits = F.when(F.col("depth") == 0, F.lit("root")).otherwise(F.expr("lpad(bin(_q), depth, '0')"))
    homes = stored(met(tried, there, ["_d", "_p"]).select("h", F.col("_n").alias("n"), "_all", bits.alias("shard"), "depth"))
    fit = met(keys, homes, ["h"]).filter(F.col("_all") <= limit).withColumn("part", F.lit(0).cast("long")).withColumn("shard_bytes", F.col("_all"))
    # leaves of one repeated hash: sizes in order, next-fit by sum, in runs of bounded length; only these rows are sorted
    # and their runs are stored, as rows of another run of a task would be numbered anew
    names = [*keys.columns, "shard", "depth", "part", "shard_bytes"]
    if leaves.filter(F.col("bytes") > limit).isEmpty():
        return fit.select(*names)
    runs = F.ceil(F.col("n") / PART_ROWS)
    rest = met(keys, stored(homes.filter(F.col("_all") > limit)), ["h"]).withColumn("_run", F.pmod(F.monotonically_increasing_id(), runs))
    rest = stored(rest)
    own = Window.partitionBy("h", "_run")
    order = own.orderBy("bytes")
    most = F.max("bytes").over(own)
    room = F.greatest(F.lit(limit) - most, F.lit(1))
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = F.when(most >= limit, F.row_number().over(order).cast("long") - 1).otherwise(F.floor((upto - F.col("bytes")) / room))
    rest = rest.withColumn("part", F.shiftleft(F.col("_run"), 32) + local)
    rest = rest.withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("h", "part")))
    return fit.select(*names).unionByName(rest.select(*names))


def places(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, h, bytes, shard, depth, part and shard_bytes of docs; texts are read once, for their sizes, and go no further."""
    keys = stored(hashed(docs).select("doc_id", "h", "bytes"))
    return assign(keys, directory(keys, limit), limit)


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with h, bytes, shard, depth, part and shard_bytes, which replace columns of these names; every shard's bytes are within limit unless it is a single document."""
    keys = hashed(docs)
    return assign(keys, directory(stored(keys.select("h", "bytes")), limit), limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes docs under path, a folder _shard=name for each shard and part (with more underscores where docs has such a column); a shard is one file."""
    names = docs.columns
    folder = "_shard"
    while folder in names:
        folder = f"_{folder}"
    out = shard(carried(docs, "doc_id", "text"), limit).select("_doc", F.concat_ws("-", "shard", "part").alias("_to"))
    out = out.repartition("_to").select(F.struct("_doc.*", F.col("_to").alias(folder)).alias("_doc"))
    restored(out, [*names, folder]).write.partitionBy(folder).parquet(path)


def shard_sql(limit: int = LIMIT, bits: int = 40) -> str:
    """The same by running sums over every prefix length up to bits.

    Leaves of one repeated hash don't occur in it, nor deeper ones: of n documents with ids of their own some two
    share 40 bits with a probability of n * n / 2**41, below a ten-thousandth for 10,000.
    """
    sums = ", ".join(f"sum(bytes) OVER (PARTITION BY h >> {BITS - d}) AS s{d}" for d in range(bits + 1))
    pick = " ".join(f"WHEN s{d} <= {limit} THEN {d}" for d in range(bits + 1))
    size = " ".join(f"WHEN {d} THEN s{d}" for d in range(bits + 1))
    return f"""
WITH k AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {BITS // 4}) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
s AS (SELECT *, {sums} FROM k), d AS (SELECT *, CASE {pick} END AS depth FROM s)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN 'root' ELSE substr(lpad(bin(h), {BITS}, '0'), 1, depth) END AS shard, depth, CAST(0 AS BIGINT) AS part, CAST(CASE depth {size} END AS BIGINT) AS shard_bytes FROM d
"""
