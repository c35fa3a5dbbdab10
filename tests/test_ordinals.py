import random

from pyspark.sql import functions as F

from runlens.operators.ordinals import with_ordinal


def test_ordinals_of_groups_and_of_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(200), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, n long").repartition(5)
    found = with_ordinal(df, [F.col("x"), "n"], ["g"]).withColumn("part", F.spark_partition_id())
    got = {r.n: r.ordinal for r in found.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {n: k for k, (_, x, n) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert got == want
    every = with_ordinal(df, ["x", "n"]).collect()
    assert {r.n: r.ordinal for r in every} == {n: k for k, (_, _, n) in enumerate(sorted(rows, key=lambda r: r[1:]))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_of_one_key_are_spread_and_numbered_once(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(4000).select(F.lit(7).alias("x"), "id")
    found = with_ordinal(df, ["x"])
    assert sorted(r.ordinal for r in found.collect()) == list(range(4000))
    assert found.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x long")
    assert with_ordinal(df, ["x"], ["g"]).count() == 0 and with_ordinal(df, ["x"]).columns == ["g", "x", "ordinal"]
