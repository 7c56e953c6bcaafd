"""The dictionary of words and its ids against plain Python."""

from collections import Counter

import pytest

from corpusloom.functions import words
from corpusloom.plans.pretokenize import PretokenizeOptions, pretokenize
from tests import models

TEXTS = ["a b a", None, "", "  \t", "b c\nd", "a " * 3000, "é a  e", "a b a", "　x　y"]


def expected_ids():
    counts = Counter(w for t in TEXTS for w in (t or "").split())
    ranked = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    return {w: i + 3 for i, w in enumerate(ranked)}, counts


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_ord bigint, text string")


def test_dictionary_by_falling_count(spark):
    got = {r["piece"]: (r["id"], r["n"]) for r in words.word_model(frame(spark)).vocab.collect()}
    ids, counts = expected_ids()
    assert got == {w: (i, counts[w]) for w, i in ids.items()}


@pytest.mark.parametrize("least_hot", [50, 100_000])
def test_ids_of_all_rows(spark, least_hot):
    docs = frame(spark)
    got = words.encode_words(docs, words.word_model(docs), least_hot=least_hot).collect()
    ids, _ = expected_ids()
    assert {r["doc_ord"]: r["input_ids"] for r in got} == {
        i: [ids[w] for w in (t or "").split()] for i, t in enumerate(TEXTS)
    }


def test_other_columns_may_have_any_name(spark):
    docs = frame(spark).selectExpr("doc_ord", "text", "'x' AS piece", "doc_ord AS id", "7 AS n", "CAST(NULL AS INT) AS col")
    got = words.encode_words(docs, words.word_model(docs))
    assert got.columns == ["doc_ord", "piece", "id", "n", "col", "input_ids"]
    assert sorted((r["id"], len(r["input_ids"])) for r in got.collect()) == [(i, len((t or "").split())) for i, t in enumerate(TEXTS)]


def test_rare_and_unseen_words_are_unknown(spark):
    docs = frame(spark, ["a a b"])
    model = words.word_model(docs, least=2)
    got = words.encode_words(frame(spark, ["b a new"]), model).first()["input_ids"]
    assert got == [1, 3, 1]


def test_no_rows_and_no_key(spark):
    docs = spark.createDataFrame([], "doc_ord bigint, text string")
    model = words.word_model(docs)
    assert model.vocab.collect() == [] and words.encode_words(docs, model).collect() == []
    with pytest.raises(ValueError, match="key column"):
        words.encode_words(docs.select("text"), model)


def test_by_name_in_the_flow(spark):
    rows = [(0, i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "src_ord int, doc_ord bigint, text string")
    opts = PretokenizeOptions(block_size=4, batch_size=2, tokenizer="whitespace")
    got = {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in pretokenize(docs, opts).collect()}
    ids, _ = expected_ids()
    lists = [[ids[w] for w in t.split()] + [2] for t in TEXTS if t and t.split()]
    assert got == models.pack(lists, 4, 2)


def test_rows_in_many_groups_with_equal_keys_and_unknown_words(spark, monkeypatch):
    """Words are looked up once a group, and no column has to tell the rows apart."""
    monkeypatch.setattr(words, "GROUP_BYTES", 40)
    texts = [f"w{i % 7} w{i % 11}  new{i} w{i % 7}" for i in range(300)] + [None, " "]
    docs = spark.createDataFrame([(0, t) for t in texts], "same int, text string")
    model = words.word_model(docs, least=2)
    ids = {r["piece"]: r["id"] for r in model.vocab.collect()}
    expected = sorted([ids.get(w, 1) for w in (t or "").split()] for t in texts)
    for least_hot in (5, 100_000):
        got = words.encode_words(docs, model, least_hot=least_hot)
        assert sorted(r["input_ids"] for r in got.collect()) == expected
