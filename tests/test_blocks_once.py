"""Blocks are written once before they become shards, and move once to the ranges in which they are written."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators.order import dense_ordinal
from corpusloom.plans import registry
from corpusloom.sources import shards
from corpusloom.streaming import flows

BLOCKS = "ord bigint, input_ids array<int>, attention_mask array<int>"


def in_file_order(spark, path):
    names = glob.glob(f"{path}/commit=*/shard=*/part-*.parquet")
    names.sort(key=lambda n: (*map(int, re.findall(r"commit=(\d+)/shard=(\d+)", n)[0]), os.path.basename(n)))
    return [r["input_ids"][0] for n in names for r in spark.read.parquet(n).select("input_ids").collect()]


@pytest.mark.parametrize("keys", [[], [5], [0, 3, 1023, 1024, 5000, 1 << 40], list(range(3000))])
def test_ranged_ordinal(spark, keys):
    df = spark.createDataFrame([(k, [k]) for k in reversed(keys)], "at bigint, ids array<bigint>")
    got = dense_ordinal(df, "at", out="ord", ranged=True)
    rows = got.withColumn("part", F.spark_partition_id()).collect()  # partitions one after the other, each sorted
    assert [(r["at"], r["ord"], r["ids"]) for r in rows] == [(k, i, [k]) for i, k in enumerate(keys)]
    # The lists are in one move by ranges, and none by a hash of their bucket.
    moves = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "partitioning" in line]
    assert sum("rangepartitioning" in m for m in moves) >= 1 and not any("__b_ord" in m and "hashpartitioning" in m for m in moves[:1])


def test_ordinals_of_more_buckets_than_are_sent(spark, monkeypatch):
    from corpusloom.operators import order

    monkeypatch.setattr(order, "BROADCAST_BUCKETS", 1)
    df = spark.range(5000).select((F.col("id") * 7).alias("at"))
    rows = dense_ordinal(df, "at", out="ord", ranged=True).collect()
    assert [(r["at"], r["ord"]) for r in rows] == [(7 * i, i) for i in range(5000)]


def test_stored_blocks_are_not_staged_again(spark, tmp_path):
    root = session.scratch_root(spark)
    rows = [(i, [i] * 3, [1] * 3) for i in range(5000)]
    blocks = session.stage(spark.createDataFrame(rows, BLOCKS).repartitionByRange(5, "ord").sortWithinPartitions("ord"))
    since, path = set(os.listdir(root)), str(tmp_path / "s")
    shards.write_incremental(blocks, path, 400, 1700, max_commits=1, stored=True)
    assert [r["rows"] for r in shards.progress(spark, path).collect()] == [1700]
    shards.write_incremental(blocks, path, 400, 1700, resume=True, stored=True)
    assert set(os.listdir(root)) == since
    assert in_file_order(spark, path) == list(range(5000))
    log = shards.progress(spark, path).orderBy("commit").collect()
    assert [(r["rows"], r["rows_done"], r["done"]) for r in log] == [(1700, 1700, False), (1700, 3400, False), (1600, 5000, True)]
    assert shards.read_committed(spark, path).groupBy("shard").count().agg(F.max("count")).head()[0] == 400


def test_no_stored_blocks_are_one_commit(spark, tmp_path):
    blocks = spark.createDataFrame([], BLOCKS)
    shards.write_incremental(blocks, str(tmp_path / "s"), 4, 3, stored=True)
    assert [(r["rows"], r["done"]) for r in shards.progress(spark, str(tmp_path / "s")).collect()] == [(0, True)]


def test_a_stream_writes_shards_in_file_order(spark, tmp_path):
    rows = [(i * 3, [i], [1]) for i in range(4000)]
    df = spark.createDataFrame(rows, "at bigint, input_ids array<int>, attention_mask array<int>").repartition(6)
    sink = flows.StreamShards(str(tmp_path / "s"), "at", 300)
    sink(df.where("at < 6000"), 0)
    sink(df.where("at >= 6000"), 1)
    assert in_file_order(spark, str(tmp_path / "s")) == list(range(4000))


@pytest.mark.parametrize("name", ["shard_incremental", "stream_shards", "stream_append_shards"])
def test_queries_write_their_blocks_once(spark, sf_dir, name):
    root = session.scratch_root(spark)
    since = set(os.listdir(root))
    registry.QUERIES[name](spark, sf_dir)
    made = sorted(d.split("-")[0] for d in set(os.listdir(root)) - since)
    # Before: "blocks" staged, numbered and staged again, up to four times.
    assert made.count("numbered") == 1 and made.count("blocks") == (name != "shard_incremental")
