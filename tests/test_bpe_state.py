"""The training state comes in rows of bounded size, whatever a partition holds."""

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.functions import bpe

LINES = [f"low lower lowest number{i % 40} wide{'r' * (i % 5)} {'x' * 50 if i == 3 else ''}" for i in range(200)]


def test_rows_are_bounded_and_merges_stay(spark, monkeypatch):
    lines = spark.createDataFrame([(t,) for t in LINES], "text string")
    words = bpe.word_counts(lines).repartition(1)
    covered = sorted({c for r in words.collect() for c in r["word"]})
    wanted = [tuple(r) for r in bpe.train_bpe(lines, 360, coverage=1.0)[1].orderBy("rank").collect()]
    whole = {bytes(r["symbols"]) for r in bpe._initial_state(words, covered).collect()}
    monkeypatch.setattr(bpe, "STATE_PLACES", 64)
    rows = [np.frombuffer(bytes(r["symbols"]), np.int32) for r in bpe._initial_state(words, covered).collect()]
    assert max(map(len, rows)) <= 65 and len(rows) > len(whole)
    assert sum(len(r) - 1 for r in rows) == sum(len(w) // 4 - 1 for w in whole)
    assert [tuple(r) for r in bpe.train_bpe(lines, 360, coverage=1.0)[1].orderBy("rank").collect()] == wanted


@pytest.mark.parametrize("limit", [1, 5, 100])
def test_word_groups(limit):
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "é𝄞c", "", "long word"]), pa.array([1, 2, 3, 4])], ["word", "n"])
    groups = [(words, counts.tolist()) for words, counts in bpe.word_groups(batch, limit)]
    assert [w for words, _ in groups for w in words] == ["ab", "é𝄞c", "", "long word"]
    assert [n for _, counts in groups for n in counts] == [1, 2, 3, 4]
    assert all(len(words) == 1 or sum(len(w) + 1 for w in words) <= limit for words, _ in groups)
    assert list(bpe.word_groups(batch.slice(0, 0), limit)) == []
