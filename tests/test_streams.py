import os
import random

import pytest

from corpusloom.functions.tokens import EOS_ID
from corpusloom.sources import files, shards
from corpusloom.streaming import flows
from tests import models

SCHEMA = "src_ord int, doc_ord bigint, text string"


@pytest.fixture
def docs(spark, tmp_path):
    """Six files with rising modification times, so that they stream in this order."""
    rng = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    texts = []
    for i in range(6):
        rows = []
        for _ in range(rng.randint(1, 9)):
            text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))
            rows.append((len(texts) % 2, len(texts), text))
            texts.append(text)
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.link(os.path.join(part, name), folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1000 + i, 1000 + i))
    return str(folder), texts


def stream(spark, folder, **kw):
    schema = spark.read.schema(SCHEMA).parquet(folder).schema
    return files.read_stream(spark, folder, schema, **kw)


def test_stream_equals_batch(spark, docs, tmp_path):
    folder, _ = docs
    flows.run_to_files(
        flows.tokenize_stream(stream(spark, folder), eos_id=EOS_ID), str(tmp_path / "out"), str(tmp_path / "c")
    )
    batch = flows.tokenize_stream(spark.read.schema(SCHEMA).parquet(folder), eos_id=EOS_ID)
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("block,batch_size", [(5, 1), (5, 4), (17, None)])
def test_packing_does_not_depend_on_micro_batches(spark, docs, tmp_path, block, batch_size):
    folder, texts = docs
    packer = flows.StreamPacker(str(tmp_path / "p"), block, batch_size)
    tokens = flows.tokenize_stream(stream(spark, folder, max_files=1))
    flows.run_batches(tokens, packer, str(tmp_path / "c"))
    packer.finish(spark)
    packer.finish(spark)  # nothing waits any more
    got = {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in packer.blocks(spark).collect()}
    lists = [[ord(c) for c in t] for t in texts if t.strip()]
    assert got == models.pack(lists, block, batch_size)


def test_replay_of_a_micro_batch_changes_nothing(spark, docs, tmp_path):
    folder, _ = docs
    packer = flows.StreamPacker(str(tmp_path / "p"), 5, 4)
    tokens = flows.tokenize_stream(spark.read.schema(SCHEMA).parquet(folder))
    early, late = tokens.where("doc_ord < 9"), tokens.where("doc_ord >= 9")
    packer(early, 0)
    packer(late, 1)
    before = sorted(map(str, packer.blocks(spark).collect()))
    packer(late, 1)
    assert sorted(map(str, packer.blocks(spark).collect())) == before


def test_take_over_micro_batches(spark, docs, tmp_path):
    folder, texts = docs
    take = flows.StreamTake(str(tmp_path / "t"), 11, ["doc_ord"])
    flows.run_batches(stream(spark, folder, max_files=1), take, str(tmp_path / "c"))
    assert sorted(r["doc_ord"] for r in take.rows(spark).collect()) == list(range(min(11, len(texts))))


def test_restart_is_exactly_once(spark, docs, tmp_path):
    folder, texts = docs
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "c")
    hidden = [(f"{folder}/{i}.parquet", f"{folder}/_{i}.parquet") for i in (3, 4, 5)]
    for shown, away in hidden:
        os.rename(shown, away)
    flows.run_to_files(stream(spark, folder, max_files=1), out, ckpt)
    for shown, away in hidden:
        os.rename(away, shown)
    flows.run_to_files(stream(spark, folder, max_files=1), out, ckpt)
    got = spark.read.schema(SCHEMA).parquet(out)
    assert sorted(r["doc_ord"] for r in got.collect()) == list(range(len(texts)))


def test_interleaved_stream(spark, docs, tmp_path):
    folder, texts = docs
    whole = stream(spark, folder).drop("src_ord")
    streams = [whole.where(f"doc_ord % 3 = {i}") for i in range(3)]
    mixed = flows.StreamInterleave(str(tmp_path / "m"))
    flows.run_batches(flows.interleave_streams(streams), mixed, str(tmp_path / "c"))
    got = [r["doc_ord"] for r in mixed.rows(spark).orderBy("pos").collect()]
    keys = [[k for k in range(len(texts)) if k % 3 == i] for i in range(3)]
    assert got == models.interleave_all(keys)


def test_stream_of_blocks_to_shards(spark, tmp_path):
    rows = [(i, [i, i], [1, 1]) for i in range(10)]
    df = spark.createDataFrame(rows, "at bigint, input_ids array<int>, attention_mask array<int>")
    sink = flows.StreamShards(str(tmp_path / "s"), "at", 4)
    sink(df.where("at < 6"), 0)
    sink(df.where("at >= 6"), 1)
    sink(df.where("at >= 6"), 1)
    got = shards.read_committed(spark, str(tmp_path / "s")).collect()
    assert sorted((r["shard"], r["input_ids"][0]) for r in got) == [(i // 4, i) for i in range(10)]


@pytest.mark.parametrize("cuts", [[], [1], [0, 4, 5, 17], list(range(1, 20))])
def test_interleaving_does_not_depend_on_micro_batches(spark, tmp_path, cuts):
    rows = [(0 if i % 2 else i % 3, i) for i in range(20)]
    df = spark.createDataFrame(rows, "src_ord int, doc_ord bigint")
    path = str(tmp_path / "m")
    edges = [0, *cuts, 20]
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = df.where((df.doc_ord >= lo) & (df.doc_ord < hi))
        flows.StreamInterleave(path)(part, number)
        flows.StreamInterleave(path)(part, number)  # a replay changes nothing
    got = [r["doc_ord"] for r in flows.StreamInterleave(path).rows(spark).orderBy("pos").collect()]
    assert got == models.interleave_all([[k for s, k in rows if s == i] for i in range(3)])
    assert len(os.listdir(tmp_path / "m" / "_sizes")) <= 2


def test_interleaving_nothing(spark, tmp_path):
    mixed = flows.StreamInterleave(str(tmp_path / "m"))
    with pytest.raises(FileNotFoundError):
        mixed.rows(spark)
    mixed(spark.createDataFrame([], "src_ord int, doc_ord bigint"), 0)
    assert mixed.rows(spark).collect() == []


def test_old_states_go_and_half_written_ones_do_not_count(spark, tmp_path):
    packer = flows.StreamPacker(str(tmp_path / "p"), 5, 4)
    df = spark.createDataFrame([(i, [i]) for i in range(50)], "doc_ord bigint, input_ids array<int>")
    for number in range(5):
        packer(df.where(f"doc_ord div 10 = {number}"), number)
    assert sorted(os.listdir(tmp_path / "p" / "_state")) == ["3", "4"]
    assert sorted(os.listdir(tmp_path / "p" / "_pending")) == ["3", "4"]
    os.mkdir(tmp_path / "p" / "_state" / "5")
    assert packer.last_number(spark) == 4


def test_files_of_the_document_stream_follow_the_partitions(spark, sf_dir):
    """A file is one task's work, so their number grows with that of the partitions."""
    from corpusloom.plans import registry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        path = registry._document_files(spark, sf_dir)
        names = [n for n in os.listdir(path.removeprefix("file:")) if n.endswith(".parquet")]
        assert len(names) == 16 and spark.read.parquet(path).count() == registry.documents(spark, sf_dir).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
