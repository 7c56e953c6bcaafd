"""The salted join against a plain one."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.skew import salted_join


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("least_hot", [10, 100_000])
def test_equals_a_plain_join(spark, how, least_hot):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), ("4", 4), (None, 5), ("none", 6)], "k string, w int")
    got = sorted(map(repr, salted_join(rows, table, ["k"], how, least_hot).collect()))
    assert got == sorted(map(repr, rows.join(table, ["k"], how).collect()))


def test_hot_keys_are_dealt_over_several_salts(spark):
    rows = spark.range(2000).select(F.lit("hot").alias("k"), "id")
    table = spark.createDataFrame([("hot", 1)], "k string, w int")
    plan = salted_join(rows, table, ["k"], "left", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan
    assert salted_join(rows, table, ["k"], "left", 100).where("w = 1").count() == 2000


def test_empty_sides(spark):
    rows = spark.createDataFrame([], "k string, v int")
    table = spark.createDataFrame([("a", 1)], "k string, w int")
    assert salted_join(rows, table, ["k"]).collect() == []
    assert salted_join(table, rows, ["k"]).collect()[0]["v"] is None
