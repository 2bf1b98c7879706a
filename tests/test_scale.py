import pytest
from pyspark.sql import functions as F

from fumikura.operators import scale


@pytest.mark.parametrize("skewed", [False, True])
def test_large_lookup_side_is_joined_once_per_row(spark, skewed):
    right = spark.range(300_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    left = spark.range(50_000).select((F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") * 6) if skewed else F.col("id") * 6).alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark's own choice is not under test
    try:
        joined = scale.lookup_join(left, right, ["k"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "BroadcastExchange" not in plan
        got = joined.agg(F.count("*"), F.count("v"), F.sum(F.col("v") - 2 * F.col("k"))).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tuple(got) == (50_000, left.where("k < 300000").count(), 0)


def test_bytes_are_weighed_in_nested_values(spark):
    rows = spark.range(20).select("id", F.array(F.repeat(F.lit("x"), 100_000)).alias("v"), F.struct(F.repeat(F.lit("y"), 10)).alias("s"))
    assert scale.is_small(rows) and not scale.is_small(rows, size=1_000_000)
    assert not scale.is_small(rows, rows=19) and scale.is_small(rows.select("id"), rows=20)
