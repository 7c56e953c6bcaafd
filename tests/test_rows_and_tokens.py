import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, tokens
from corpusloom.operators import rows
from corpusloom.operators.pack import chunk_row


def test_valid_text_keeps_what_has_a_character(spark):
    texts = [None, "oak", "", " \t", "é", "elm tree"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.filter_valid_text(df).collect()] == ["oak", "é", "elm tree"]


def test_blank_agrees_with_python_on_every_bmp_character(spark):
    points = [p for p in range(1, 0x10000) if not 0xD800 <= p <= 0xDFFF]
    df = spark.createDataFrame([(p, chr(p)) for p in points], "p int, text string")
    kept = {r[0] for r in rows.filter_valid_text(df).select("p").collect()}
    assert kept == {p for p in points if chr(p).strip()}


def test_codepoint3_of_the_mixed_texts(spark):
    df = spark.createDataFrame([("oaken",), (None,), ("",), ("é",), (" \t",)], "text string")
    got = [r[0] for r in df.select(tokens.codepoint3_ids()).collect()]
    assert got == [[111, 97, 107], [], [], [233], [32, 9]]


@pytest.mark.parametrize("text", ["", "a", "añ中😀\n\t x", "▁"])
def test_tokenizers_against_python(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(
        tokens.codepoint_ids(), tokens.byte_ids(), tokens.decode_codepoint(tokens.codepoint_ids())
    ).head()
    assert row[0] == [ord(c) for c in text]
    assert row[1] == list(text.encode())
    assert row[2] == text.replace("▁", " ")


def test_eos_after_truncation(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",), ("",), ("abz",)], "text string")
    got = [r[0] for r in df.select(tokens.tokenize(max_length=3, eos_id=ord("z"))).collect()]
    assert got == [[97, 98, 99, 122], [97, 98, 122], [], [97, 98, 122]]
    assert df.select(tokens.tokenize(eos_id=None)).head()[0] == [97, 98, 99, 100, 101, 102]


def test_special_ids_masks_and_types(spark):
    df = spark.createDataFrame([([5, 6], [7])], "a array<int>, b array<int>")
    row = df.select(
        tokens.add_special("a", bos_id=1, eos_id=2),
        tokens.add_special("a", "b", 1, 2),
        tokens.add_special("a", "b", None, None),
        tokens.special_tokens_mask("a", "b", True, True),
        tokens.token_type_ids("a", "b", True, True),
        tokens.existing_special_mask(tokens.add_special("a", "b", 1, 2), [1, 2]),
        tokens.token_type_ids("a"),
    ).head()
    assert row[0] == [1, 5, 6, 2]
    assert row[1] == [1, 5, 6, 2, 1, 7, 2]
    assert row[2] == [5, 6, 7]
    assert row[3] == row[5] == [1, 0, 0, 1, 1, 0, 1]
    assert row[4] == [0, 0, 0, 0, 1, 1, 1]
    assert row[6] == [0, 0, 0]


def test_decode_with_specials(spark):
    b, e = tokens.BOS_ID, tokens.EOS_ID
    names = {b: "<b>", e: "<e>"}
    df = spark.createDataFrame([([b, b, 104, 105, e, 33],)], "ids array<int>")
    row = df.select(
        tokens.decode_codepoint("ids", names),
        tokens.decode_codepoint("ids", names, skip_special=True),
        tokens.decode_codepoint("ids", names, spaces_between=True),
    ).head()
    assert tuple(row) == ("<b><b>hi<e>!", "hi!", "<b> <b> hi <e> !")


def test_array_helpers(spark):
    df = spark.createDataFrame([([7, 0, 8, 0, 0],), ([0, 0],), ([],)], "ids array<int>")
    got = df.select(
        arrays.last_non_pad_index("ids", 0).alias("l"),
        arrays.last_non_pad_index("ids", None).alias("e"),
        arrays.shift_inputs("ids").alias("i"),
        arrays.shift_targets("ids").alias("t"),
        arrays.position_ids("ids", 2).alias("p"),
        chunk_row("ids", 2).alias("c"),
    ).collect()
    assert [r["l"] for r in got] == [2, 0, None]
    assert [r["e"] for r in got] == [4, 1, -1]
    assert [r["i"] for r in got] == [[7, 0, 8, 0], [0], []]
    assert [r["t"] for r in got] == [[0, 8, 0, 0], [0], []]
    assert [r["p"] for r in got] == [[2, 3, 4, 5, 6], [2, 3], []]
    assert [r["c"] for r in got] == [[[7, 0], [8, 0]], [[0, 0]], []]


def test_clamp_and_problem_type(spark):
    df = spark.createDataFrame([(-3, 5), (9, 5), (4, 5)], "x int, n int")
    got = df.select(arrays.clamp_span("x", "n"), arrays.span_ignored("x", "n")).collect()
    assert [tuple(r) for r in got] == [(0, False), (5, True), (4, False)]
    kinds = spark.createDataFrame([(1, True), (4, True), (4, False)], "k int, whole boolean")
    assert [r[0] for r in kinds.select(arrays.infer_problem_type("k", "whole")).collect()] == [
        "regression",
        "single_label_classification",
        "multi_label_classification",
    ]


def test_holdout_and_labels(spark):
    df = spark.range(20).select(F.col("id").alias("ord"), F.array(F.col("id")).alias("input_ids"))
    train, held = rows.holdout(df, 3)
    assert train.count() == 20 and sorted(r["ord"] for r in held.collect()) == [0, 1, 2]
    train, held = rows.holdout(df, 3, overlap=False)
    assert sorted(r["ord"] for r in train.collect()) == list(range(3, 20))
    train, held = rows.holdout_by_ordinal(df, 50, overlap=False)
    assert train.count() == 0 and held.count() == 20
    labelled = rows.add_labels(df)
    assert all(r["labels"] == r["input_ids"] for r in labelled.collect())
    assert rows.add_labels(labelled) is labelled
    assert [r["input_ids_len"] for r in rows.preview(df).collect()] == [1] * 5


def test_required_columns(spark):
    with pytest.raises(ValueError, match="attention_mask"):
        rows.require_columns(spark.createDataFrame([([1],)], "input_ids array<int>"))
    with pytest.raises(ValueError):
        rows.keep_columns(spark.range(1), ["text"])


def test_nonempty(spark):
    df = spark.createDataFrame([([1],), ([],), (None,)], "input_ids array<int>")
    assert [r[0] for r in rows.filter_nonempty(df).collect()] == [[1]]


def test_decoding_goes_over_the_ids_once(spark):
    texts = ["", "".join(map(chr, range(0x900))), "a\U0010ffff é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    ids = df.select("k", tokens.add_special(tokens.codepoint_ids(), eos_id=tokens.EOS_ID).alias("ids"))
    names = {tokens.BOS_ID: "<s>", tokens.EOS_ID: "</s>"}
    back = ids.select("k", tokens.decode_codepoint("ids", names, skip_special=True).alias("back"))
    assert "filter(" not in back._jdf.queryExecution().analyzed().toString()
    assert [r["back"] for r in back.orderBy("k").collect()] == texts
