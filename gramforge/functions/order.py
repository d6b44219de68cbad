"""Global ranks without a single-task window, and tables kept in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, StructType, TimestampNTZType, TimestampType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all run on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="gramforge-")
    sc.setCheckpointDir(folder)
    return folder


def shared_cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/gramforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, *keys, name: str = "rank") -> DataFrame:
    """df with its 0-based place in the order of keys, a total order.

    The rows are range-partitioned and sorted; a row's rank is its place in
    its partition plus the sizes of the partitions before, of which there is one row each.
    """
    rows = shared_cut(df.orderBy(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    base = sizes.select(F.col("_p").alias("_q"), "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    return rows.join(base, F.col("_p") == F.col("_q")).withColumn(name, F.col("_base") + F.col("_i") - F.col("_first")).drop("_p", "_q", "_i", "_first", "_base")


#: Rows of one key that a task may get at least, and the share of all rows beyond which a key's rows are spread.
SPREAD_ROWS = 50_000
SPREAD_SHARE = 500


def _row_hash(df: DataFrame) -> Column:
    """A hash of a row's plain values and of those in its structs.

    The same on every run of a task, unlike a random number or a row's place in its partition, so a task
    that is run again after an executor's loss sends each row where it went before.
    """
    plain = lambda f: isinstance(f.dataType, (NumericType, StringType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType))
    names = [f"`{f.name}`" for f in df.schema if plain(f)]
    names += [f"`{f.name}`.`{g.name}`" for f in df.schema if isinstance(f.dataType, StructType) for g in f.dataType if plain(g)]
    return F.xxhash64(*map(F.col, names))


def met(rows: DataFrame, info: DataFrame, keys: list[str], how: str = "inner", least: int = SPREAD_ROWS) -> DataFrame:
    """rows with the columns of info, which has one row a key and n, the key's rows in rows (or a bound of them).

    A key that holds more than a SPREAD_SHARE-th of all rows is spread over several tasks by its rows' hashes
    (rows that are equal in all plain values stay together): its row of info is repeated for each. Fewer than SPREAD_SHARE keys are, so their names are broadcast.
    info is read three times and should be cut from its lineage.
    """
    total, most = info.agg(F.sum("n"), F.max("n")).first()
    fair = max(least, (total or 0) // SPREAD_SHARE)
    other = info.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in info.columns if c not in keys))
    on = lambda side: [rows[k] == side[f"_{k}"] for k in keys]
    names = [*rows.columns, *(c for c in info.columns if c not in keys)]
    if (most or 0) <= fair:
        return rows.join(other, on(other), how).select(*names)
    parts = F.ceil(F.col("n") / fair).cast("int")
    hot = info.filter(F.col("n") > fair).select(*(F.col(k).alias(f"_{k}") for k in keys), parts.alias("__salts"))
    own = rows.withColumn("__hash", _row_hash(rows)).join(F.broadcast(hot), on(hot), "left").select(*rows.columns, F.coalesce(F.pmod("__hash", "__salts").cast("int"), F.lit(0)).alias("__own"))
    other = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return own.join(other, [*(own[k] == other[f"_{k}"] for k in keys), own["__own"] == other["__salt"]], how).select(*names)
