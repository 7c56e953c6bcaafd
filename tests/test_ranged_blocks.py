"""Blocks are cut in one pass over ordered rows and written where they are made."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import tokens
from corpusloom.operators import pack
from corpusloom.plans.pretokenize import PretokenizeOptions, pretokenize, pretokenize_numbered, pretokenize_to_shards
from corpusloom.sources import shards


def documents(spark, n=230):
    rows = [(i % 3, i // 3, ["", f"text {i} " * (i % 7 + 1), "é𝄞" * (i % 90), None, "x\ny"][i % 5]) for i in range(n)]
    return spark.createDataFrame(rows, "src_ord int, doc_ord bigint, text string")


@pytest.mark.parametrize("opts", [PretokenizeOptions(8, 10, truncate=None), PretokenizeOptions(8, 7, truncate=9, tokenizer="byte", eos_id=None), PretokenizeOptions(8, None)])
def test_numbered_blocks_are_the_packed_blocks_in_order(spark, opts):
    wanted = [(r["input_ids"], r["attention_mask"]) for r in pretokenize(documents(spark), opts).orderBy("batch_id", "block_ord").collect()]
    got = pretokenize_numbered(documents(spark), opts).orderBy("ord").collect()
    assert [(r["input_ids"], r["attention_mask"]) for r in got] == wanted
    assert [r["ord"] for r in got] == list(range(len(wanted)))


def test_one_commit_stages_no_blocks_and_keeps_their_order(spark, tmp_path):
    root, path, opts = session.scratch_root(spark), str(tmp_path / "s"), PretokenizeOptions(8, 10, truncate=None)
    since = set(os.listdir(root))
    pretokenize_to_shards(documents(spark), path, opts, 20)
    assert [d.split("-")[0] for d in set(os.listdir(root)) - since] == ["ordered"]
    names = glob.glob(f"{path}/commit=0/shard=*/part-*.parquet")
    names.sort(key=lambda n: (int(re.findall(r"shard=(\d+)", n)[0]), os.path.basename(n)))
    got = [r["input_ids"] for n in names for r in spark.read.parquet(n).select("input_ids").collect()]
    assert got == [r["input_ids"] for r in pretokenize(documents(spark), opts).orderBy("batch_id", "block_ord").collect()]
    assert shards.read_committed(spark, path).groupBy("shard").count().agg(F.max("count")).head()[0] == 20


@pytest.mark.parametrize("tokenizer", ["codepoint", "codepoint3", "byte"])
@pytest.mark.parametrize("cut", [None, 0, 2])
@pytest.mark.parametrize("eos", [None, tokens.EOS_ID, 10])
def test_token_count_is_the_size_of_the_list(spark, tokenizer, cut, eos):
    texts = spark.createDataFrame([(t,) for t in ["", None, "a", "é𝄞", "ab\n", "abc" * 50, "\n"]], "text string")
    raw = spark.range(1).select(F.decode(F.unhex(F.lit("61FFC3")), "ISO-8859-1").alias("text"))
    both = texts.unionByName(raw).unionByName(spark.range(1).select(F.unhex(F.lit("61E28028FF62C3")).cast("string").alias("text")))
    args = ("text", tokenizer, cut, eos)
    assert both.where(tokens.token_count(*args) != F.size(tokens.tokenize(*args))).count() == 0


def test_cut_blocks_keeps_tails_keys_and_types(spark):
    df = spark.createDataFrame([("a", i, list(range(10 * i, 10 * i + i % 4)) if i != 5 else None) for i in range(12)] + [(None, 0, [7, None, 9])], "k string, ord bigint, input_ids array<bigint>")
    got = pack.cut_blocks(df, 3, 6, by=["k"])
    assert got.dtypes == [("k", "string"), ("batch_id", "bigint"), ("block_ord", "bigint"), ("input_ids", "array<bigint>")]
    rows = {(r["k"], r["batch_id"], r["block_ord"]): r["input_ids"] for r in got.collect()}
    first = [x for i in range(5) for x in range(10 * i, 10 * i + i % 4)]
    second = [x for i in range(6, 12) for x in range(10 * i, 10 * i + i % 4)]
    wanted = {("a", b, k): ids[3 * k : 3 * k + 3] for b, ids in ((0, first), (1, second)) for k in range(-(-len(ids) // 3))}
    assert rows == wanted | {(None, 0, 0): [7, None, 9]}
    # No block is put together from collected pieces.
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
