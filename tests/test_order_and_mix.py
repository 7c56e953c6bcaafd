import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.mix import concat_ordinal, concat_sources, interleave_documents
from corpusloom.operators.order import dense_ordinal, running_total
from corpusloom.operators.rows import cap_total_across_sources
from tests import models


def make_docs(spark, sizes, seed=0, gap=50):
    """Sources of the given sizes with growing, gappy keys, in shuffled row order."""
    rng = random.Random(seed)
    rows = []
    for src, n in enumerate(sizes):
        key = 0
        for i in range(n):
            key += rng.randint(1, gap)
            rows.append((src, key, f"{src}:{i}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "src_ord int, doc_ord bigint, text string").repartition(5)


def sources_of(sizes):
    return [[f"{s}:{i}" for i in range(n)] for s, n in enumerate(sizes)]


@pytest.mark.parametrize("row_bits,key_bits", [(2, 34), (4, 60), (10, 30)])
def test_dense_ordinal_over_levels(spark, row_bits, key_bits):
    df = make_docs(spark, [300])
    got = dense_ordinal(df, "doc_ord", row_bits=row_bits, key_bits=key_bits).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(300))
    assert [r["text"] for r in got] == sources_of([300])[0]


def test_two_levels_of_totals_equal_one(spark):
    df = spark.range(5000).select((F.col("id") * 977).alias("k"), (F.col("id") % 7).alias("v"))
    one = running_total(df, F.col("v"), "k", out="s", row_bits=6, key_bits=20)
    for kw in ({"row_bits": 6, "key_bits": 40}, {"row_bits": 24}, {"row_bits": 3}):
        other = running_total(df, F.col("v"), "k", out="s", **kw)
        assert one.orderBy("k").collect() == other.orderBy("k").collect()
    total = 0
    for r in one.orderBy("k").collect():
        assert r["s"] == total
        total += r["v"]


@pytest.mark.parametrize("sizes", [[5, 3, 9], [1, 40], [7], [0, 4, 4], [30, 1, 1, 17]])
@pytest.mark.parametrize("stop", ["all", "first"])
def test_interleave(spark, sizes, stop):
    got = interleave_documents(make_docs(spark, sizes), stop=stop).orderBy("pos").collect()
    present = [s for s in sources_of(sizes) if s]
    model = models.interleave_all if stop == "all" else models.interleave_first
    assert [r["text"] for r in got] == model(present)
    assert [r["pos"] for r in got] == list(range(len(got)))


def test_many_or_unnumbered_sources_keep_their_sizes_in_a_table(spark, monkeypatch):
    df = make_docs(spark, [5, 3, 9])
    expect = [r["text"] for r in interleave_documents(df).orderBy("pos").collect()]
    shifted = df.withColumn("src_ord", F.col("src_ord") * 3 - 1)
    assert [r["text"] for r in interleave_documents(shifted).orderBy("pos").collect()] == expect
    monkeypatch.setattr("corpusloom.operators.mix.MAX_LISTED_SOURCES", 2)
    assert [r["text"] for r in interleave_documents(df).orderBy("pos").collect()] == expect


@pytest.mark.parametrize("odd", [(None, 1), (3, None), (3, -1)])
def test_null_and_negative_keys_are_an_error_at_every_number_of_sources(spark, odd):
    for n in (5, 1_001):
        rows = [(i, 7) for i in range(n)] + [odd]
        with pytest.raises(ValueError, match="must not be null or negative"):
            interleave_documents(spark.createDataFrame(rows, "src_ord int, doc_ord bigint"))


def test_interleave_by_known_ranks_has_no_shuffle(spark):
    sizes = [5, 0, 9]
    df = dense_ordinal(make_docs(spark, sizes), "doc_ord", by=["src_ord"], out="r")
    frozen = spark.createDataFrame(df.collect(), df.schema)
    mixed = interleave_documents(frozen, rank="r", counts=sizes)
    assert "Exchange" not in mixed._jdf.queryExecution().executedPlan().toString()
    got = [r["text"] for r in mixed.orderBy("pos").collect()]
    assert got == models.interleave_all(sources_of(sizes))


def test_results_do_not_depend_on_partitions(spark):
    df = make_docs(spark, [50, 8, 21])
    results = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(interleave_documents(df).orderBy("pos").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_one_source_with_most_rows_is_split(spark):
    """A third of all rows in one source still falls into bounded window groups."""
    df = spark.range(40_000).select(F.lit(0).alias("src_ord"), F.col("id").alias("doc_ord"))
    groups = df.groupBy("src_ord", F.shiftright("doc_ord", 10)).count().agg(F.max("count")).head()[0]
    assert groups == 1024
    got = interleave_documents(df).agg(F.max("pos"), F.count_distinct("pos")).head()
    assert tuple(got) == (39_999, 40_000)


def test_concat_and_cap_across_sources(spark):
    a = spark.createDataFrame([(3, "a3"), (1, "a1")], "doc_ord bigint, text string")
    b = spark.createDataFrame([(2, "b2"), (9, "b9"), (1, "b1")], "doc_ord bigint, text string")
    both = concat_sources([a, b])
    got = concat_ordinal(both).orderBy("ord").collect()
    assert [r["text"] for r in got] == ["a1", "a3", "b1", "b2", "b9"]
    for n, expect in [(0, []), (1, ["a1"]), (4, ["a1", "a3", "b1", "b2"]), (99, 5)]:
        kept = cap_total_across_sources(both, n).orderBy("src_ord", "doc_ord").collect()
        assert len(kept) == expect if isinstance(expect, int) else [r["text"] for r in kept] == expect


def test_concat_needs_a_source():
    with pytest.raises(ValueError):
        concat_sources([])
