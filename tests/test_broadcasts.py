"""What may be copied to the driver: no table on the strength of its size as a Parquet file."""

from pyspark.sql import functions as F

from curbline.session import cut


def _ran(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan.toString()


def test_compressed_tables_are_not_broadcast(spark):
    # under 1 MB as Parquet, over 60 MB as rows
    wide = cut(spark.range(200000).select(F.col("id").alias("k"), F.lit("W HICKORY AVENUE " * 20).alias("street")))
    many = cut(spark.range(400000).select((F.col("id") % 200000).alias("k"), F.col("id").alias("v")))
    joined = many.join(wide, "k").agg(F.sum("v").alias("v"), F.max(F.length("street")).alias("n"))
    assert "BroadcastHashJoin" not in _ran(joined)
    assert tuple(joined.first()) == (400000 * 399999 // 2, 340)


def test_small_tables_still_are(spark):
    few = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = cut(spark.range(100000).select((F.col("id") % 7).alias("k"), "id")).join(few, "k").agg(F.sum("n").alias("n"))
    assert "BroadcastHashJoin" in _ran(joined)
    assert joined.first()[0] == sum((15 if k < 2 else 14) * (100000 // 7 + (k < 100000 % 7)) for k in range(7))
