"""Packing a stream keeps no token list in executors."""

import os

import pytest
from pyspark.sql import DataFrame

from corpusloom import session
from corpusloom.streaming import flows
from tests import models


@pytest.mark.parametrize("batch_size,cuts", [(3, [2, 21]), (7, [9]), (None, [5])])
def test_nothing_is_persisted_and_scratch_tables_go(spark, tmp_path, monkeypatch, batch_size, cuts):
    def refuse(self, *args):
        raise AssertionError("a micro-batch is kept in executors")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    root, before = session.scratch_root(spark), spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    since = set(os.listdir(root))
    packer = flows.StreamPacker(str(tmp_path / "p"), 4, batch_size)
    lists = {5 * i: list(range(i, i + 1 + i % 6)) for i in range(22)}
    keys, edges = sorted(lists), [0, *cuts, 22]
    try:
        for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
            rows = [(k, lists[k]) for k in reversed(keys[lo:hi])]
            df = spark.createDataFrame(rows, "doc_ord bigint, input_ids array<int>")
            packer(df, number)
        packer(df, number)  # a replay changes nothing
        packer.finish(spark)
    finally:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", before)
    got = {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in packer.blocks(spark).collect()}
    assert got == models.pack([lists[k] for k in keys], 4, batch_size)
    assert not [d for d in set(os.listdir(root)) - since if d.split("-")[0] in ("arrived", "pieces")]


def test_a_micro_batch_without_rows(spark, tmp_path):
    packer = flows.StreamPacker(str(tmp_path / "p"), 4, 3)
    df = spark.createDataFrame([(i, [i] * 3) for i in range(4)], "doc_ord bigint, input_ids array<int>")
    for number, part in enumerate((df, df.limit(0), df.limit(0))):
        packer(part, number)
    packer.finish(spark)
    got = {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in packer.blocks(spark).collect()}
    assert got == models.pack([[i] * 3 for i in range(4)], 4, 3)
