"""Light tables are written by few tasks, however many partitions a shuffle has."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.llm import components, minhash


@pytest.fixture
def many_partitions(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "40")
    spark.conf.set(keys[1], "false")
    yield max(spark.sparkContext.defaultParallelism, 1)
    for k, v in before.items():
        spark.conf.set(k, v)


def most_files(root, since, names):
    """Of the tables written after ``since``, how many files the one with most has."""
    new = [d for d in os.listdir(root) if d not in since and d.rsplit("-", 1)[0] in names]
    assert new
    return max(sum(f.startswith("part-") for f in os.listdir(f"{root}/{d}")) for d in new)


def test_rounds_of_components(spark, many_partitions):
    root = session.scratch_root(spark)
    since = set(os.listdir(root))
    pairs = spark.range(1, 2000).select(F.col("id").alias("a"), F.floor(F.col("id") / 2).alias("b"))
    found = components.components(pairs, rows=2000)
    assert found.count() == 2000 and found.where("component <> 0").count() == 0
    assert most_files(root, since, {"edges", "hooks", "labels"}) <= many_partitions


def test_classes_and_pairs(spark, many_partitions):
    root = session.scratch_root(spark)
    since = set(os.listdir(root))
    words = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), (F.col("id") % 150 * 40 + k).cast("string")))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    assert minhash.near_duplicates(docs).where("kept").count() == 150
    assert most_files(root, since, {"classes", "ids", "pairs"}) <= many_partitions
