"""A run that commits batches moves the texts, not the blocks, and only those it commits."""

import glob
import os
import re

from corpusloom import session
from corpusloom.plans.pretokenize import PretokenizeOptions, pretokenize, pretokenize_to_shards
from corpusloom.sources import shards


def test_an_early_stop_writes_its_own_texts_and_no_blocks(spark, tmp_path):
    rows = [(i % 2, i // 2, "" if i % 9 == 0 else f"text {i} " * (i % 5 + 1)) for i in range(120)]
    docs = spark.createDataFrame(rows, "src_ord int, doc_ord bigint, text string")
    opts, path, root = PretokenizeOptions(block_size=8, batch_size=10), str(tmp_path / "s"), session.scratch_root(spark)
    since = set(os.listdir(root))
    pretokenize_to_shards(docs, path, opts, 20, batches_per_commit=3, max_commits=1)
    new = set(os.listdir(root)) - since
    assert [os.listdir(f"{root}/{d}") and sorted(n for n in os.listdir(f"{root}/{d}") if n.startswith("part=")) for d in new if d.startswith("ordered-")] == [["part=0"]]
    assert [r["done"] for r in shards.progress(spark, path).collect()] == [False]
    pretokenize_to_shards(docs, path, opts, 20, batches_per_commit=3, resume=True)
    assert not [d for d in set(os.listdir(root)) - since if d.startswith("blocks-")]

    wanted = [r["input_ids"] for r in pretokenize(docs, opts).orderBy("batch_id", "block_ord").collect()]
    names = glob.glob(f"{path}/commit=*/shard=*/part-*.parquet")
    names.sort(key=lambda n: (*map(int, re.findall(r"commit=(\d+)/shard=(\d+)", n)[0]), os.path.basename(n)))
    got = [r["input_ids"] for n in names for r in spark.read.parquet(n).select("input_ids").collect()]
    assert got == wanted
    assert [r["done"] for r in shards.progress(spark, path).orderBy("commit").collect()][-1]
