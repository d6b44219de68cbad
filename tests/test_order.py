from collections import Counter

from pyspark.sql import functions as F

from gramforge.functions import order


def test_a_hot_key_is_spread_alike_on_every_run(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("k"), "id", F.struct(F.col("id").alias("x"), F.create_map(F.lit("a"), "id").alias("m")).alias("_doc"))
    info = order.shared_cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
    top = {r.k: r.top for r in info.collect()}
    for given in (rows, rows.repartition(3, "id"), rows.orderBy(F.desc("id"))):
        df = order.met(given, info, ["k"], least=100)
        assert Counter((r.k, r.id, r.top) for r in df.collect()) == Counter((r.k, r.id, top[r.k]) for r in rows.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in plan and "xxhash64" in plan


def test_row_hash_depends_on_the_row_alone(spark):
    df = spark.createDataFrame([(k, None if k % 2 else f"t{k}", (k, [k])) for k in range(50)], "id long, s string, d struct<v: long, a: array<long>>")
    a = {r.id: r.h for r in df.withColumn("h", order._row_hash(df)).collect()}
    moved = df.repartition(5).orderBy(F.desc("id"))
    assert a == {r.id: r.h for r in moved.withColumn("h", order._row_hash(moved)).collect()}
    assert len(set(a.values())) == 50
