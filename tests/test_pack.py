import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.tokens import EOS_ID
from corpusloom.operators import pack as packing
from corpusloom.operators.pack import collate, pack_blocks
from corpusloom.plans.loading import load_corpus
from corpusloom.plans.pretokenize import PretokenizeOptions, pretokenize, pretokenize_by_language
from tests import models


def frame(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "ord bigint, input_ids array<int>").repartition(3)


def as_dict(blocks):
    rows = blocks.collect()
    assert all(r["attention_mask"] == [1] * len(r["input_ids"]) for r in rows)
    return {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in rows}


def random_lists(seed, n, longest):
    rng = random.Random(seed)
    return [
        None if rng.random() < 0.05 else [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 3, longest]))]
        for _ in range(n)
    ]


@pytest.mark.parametrize("block,batch", [(4, 5), (7, 10), (1, 3), (64, 10), (5, None), (3, 0), (500, None)])
def test_pack_equals_the_model(spark, block, batch):
    lists = random_lists(block, 60, 40)
    assert as_dict(pack_blocks(frame(spark, lists), block, batch)) == models.pack(lists, block, batch)


def test_large_batches_use_running_totals(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_BATCH", 4)
    lists = random_lists(1, 80, 30)
    assert as_dict(pack_blocks(frame(spark, lists), 6, 25)) == models.pack(lists, 6, 25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.integers(0, 9), max_size=12), min_size=1, max_size=25),
    st.integers(1, 9),
    st.one_of(st.none(), st.integers(1, 8)),
)
def test_pack_property(spark, lists, block, batch):
    got = as_dict(pack_blocks(frame(spark, lists), block, batch))
    assert got == models.pack(lists, block, batch)
    kept = sum(map(len, got.values()))
    size = batch or len(lists)
    tails = sum(
        sum(map(len, lists[i : i + size])) % block for i in range(0, len(lists), size)
    )
    assert kept + tails == sum(map(len, lists))


def test_a_row_is_sliced_once_not_copied_per_block(spark):
    """Rows after the explode are documents plus blocks, never tokens."""
    df = frame(spark, [list(range(10_000)), [1, 2, 3]])
    blocks = pack_blocks(df, 100, None)
    assert blocks.count() == 100


def corpus(spark, sources):
    rows = [(s, i, t) for s, texts in enumerate(sources) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "src_ord int, doc_ord bigint, text string").repartition(4)


SOURCES = [
    ["abc", "", "defgh", None, "ij", "klmnopq"] * 4,
    ["中文字", "  ", "　"] * 3,
    [" x y z ", "😀😀"],
]


@pytest.mark.parametrize("stop", ["all", "first"])
@pytest.mark.parametrize("cap", [None, 9])
@pytest.mark.parametrize("batch", [4, None])
def test_pretokenize_equals_the_model(spark, stop, cap, batch):
    opts = PretokenizeOptions(5, batch, stop, cap, truncate=5)
    got = as_dict(pretokenize(corpus(spark, SOURCES), opts))
    assert got == models.pretokenize(SOURCES, 5, batch, 5, EOS_ID, cap, stop)


def test_languages_one_by_one(spark):
    opts = PretokenizeOptions(4, 3, truncate=None, max_documents=29)
    got = pretokenize_by_language(corpus(spark, SOURCES), opts).collect()
    left, expect = 29, {}
    for s, texts in enumerate(SOURCES):
        part = models.pretokenize([texts[: max(0, left)]], 4, 3, None, EOS_ID)
        expect |= {(s, *k): v for k, v in part.items()}
        left -= len(texts)
    assert {(r["src_ord"], r["batch_id"], r["block_ord"]): r["input_ids"] for r in got} == expect


def test_on_the_fly_corpus_has_labels_and_no_eos(spark):
    train, held = load_corpus(corpus(spark, SOURCES), block_size=3, eval_rows=2, overlap=False)
    expect = models.pretokenize(SOURCES, 3, 1000, stop="first")
    got = {(r["batch_id"], r["block_ord"]): r["labels"] for r in train.union(held).collect()}
    assert got == expect and held.count() == 2


def test_text_moves_to_its_batch_before_it_is_tokenized(spark):
    """Two exchanges carry text, none carries token lists."""
    blocks = pretokenize(corpus(spark, SOURCES), PretokenizeOptions(5, 4, truncate=None))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning(batch_id" in x]
    assert len(lines) == 1 and "REPARTITION" in lines[0]


@pytest.mark.parametrize("side", ["left", "right"])
def test_collate(spark, side):
    lists = [[1, 2, 3], [4], [5, 6], [0, 7], [8]]
    got = {r["ord"]: r for r in collate(frame(spark, lists), 2, 0, side).collect()}
    for i, ids in enumerate(lists):
        longest = max(map(len, lists[i // 2 * 2 : i // 2 * 2 + 2]))
        gap = longest - len(ids)
        padded = [0] * gap + ids if side == "left" else ids + [0] * gap
        mask = [0] * gap + [1] * len(ids) if side == "left" else [1] * len(ids) + [0] * gap
        assert got[i]["input_ids"] == padded and got[i]["attention_mask"] == mask
        assert got[i]["labels"] == [-100 if x == 0 else x for x in padded]


def test_bad_settings(spark):
    df = frame(spark, [[1]])
    with pytest.raises(ValueError):
        pack_blocks(df, 0)
    with pytest.raises(ValueError):
        collate(df, 2, 0, "middle")


def test_sentences_pack_to_blocks_without_labels(spark):
    texts = [f"Row {i} of the ledger lists grain, salt and two bolts of linen." for i in range(300)]
    opts = PretokenizeOptions(128, 1000, truncate=128)
    blocks = pretokenize(corpus(spark, [texts]), opts)
    assert blocks.columns == ["batch_id", "block_ord", "input_ids", "attention_mask"]
    sizes = blocks.select(F.size("input_ids")).distinct().collect()
    assert [r[0] for r in sizes] == [128]
