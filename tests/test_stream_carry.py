"""A continuous stream moves its ids by no ordinal of their own."""

from corpusloom.streaming import flows
from tests import models


def test_ids_are_not_numbered_before_they_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "dense_ordinal", None)  # would move every list once more
    packer = flows.StreamPacker(str(tmp_path / "p"), 4, None)
    keys = [[0, 5, 70_000], [70_001, 1 << 40], [(1 << 40) + 1]]
    lists = {k: list(range(i, i + 3 + i)) for i, k in enumerate(sum(keys, []))}
    for number, step in enumerate(keys):
        rows = [(k, lists[k]) for k in reversed(step)]
        packer(spark.createDataFrame(rows, "doc_ord bigint, input_ids array<int>"), number)
    got = {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in packer.blocks(spark).collect()}
    assert got == models.pack([lists[k] for k in sorted(lists)], 4, None)
