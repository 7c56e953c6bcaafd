"""Listed Parquet files as a data source, filters by functions over batches."""

import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions.batches import filter_batches
from corpusloom.sources.listed import read_listed, stream_listed
from corpusloom.streaming.flows import run_to_files


def parquet(path, start, n, group=10):
    """Rows ``start .. start + n`` in row groups of ten."""
    table = pa.table({"x": pa.array(range(start, start + n), pa.int64()), "t": [None if i % 7 == 0 else f"t{i}" for i in range(n)]})
    pq.write_table(table, path, row_group_size=group)
    return str(path)


def rows(df):
    return sorted((r["file_ord"], r["row_index"], r["x"]) for r in df.collect())


def test_order_is_the_list_and_not_the_name(spark, tmp_path):
    b, a = parquet(tmp_path / "b.parquet", 100, 35), parquet(tmp_path / "a.parquet", 0, 25)
    expected = [(0, i, 100 + i) for i in range(35)] + [(1, i, i) for i in range(25)] + [(2, i, 100 + i) for i in range(35)]
    for splits in (1, 3, 64):
        assert rows(read_listed(spark, [b, a, b], ["x"], splits=splits)) == expected
    assert rows(read_listed(spark, [f"file://{b}", a, b])) == expected


def test_nulls_and_columns_of_another_width(spark, tmp_path):
    path = parquet(tmp_path / "a.parquet", 0, 8)
    schema = StructType([StructField("t", StringType()), StructField("x", LongType())])
    found = read_listed(spark, [path], schema=schema)
    assert found.columns == ["file_ord", "row_index", "t", "x"]
    assert [r["t"] for r in found.orderBy("row_index").collect()] == [None, *(f"t{i}" for i in range(1, 7)), None]


def test_first_rows_of_each_file(spark, tmp_path):
    files = [parquet(tmp_path / "a.parquet", 0, 25), parquet(tmp_path / "b.parquet", 100, 5), parquet(tmp_path / "e.parquet", 0, 0)]
    for n in (0, 1, 10, 12, 99):
        expected = [(0, i, i) for i in range(min(n, 25))] + [(1, i, 100 + i) for i in range(min(n, 5))]
        assert rows(read_listed(spark, files, ["x"], first_n=n)) == expected


def test_later_row_groups_stay_unread(spark, tmp_path):
    path = parquet(tmp_path / "a.parquet", 0, 100)
    group = pq.ParquetFile(path).metadata.row_group(5)
    with open(path, "r+b") as handle:  # destroy the sixth group
        handle.seek(group.column(0).dictionary_page_offset or group.column(0).data_page_offset)
        handle.write(b"\xff" * group.column(0).total_compressed_size)
    assert len(rows(read_listed(spark, [path], ["x"], first_n=45))) == 45
    with pytest.raises(Exception):
        rows(read_listed(spark, [path], ["x"], first_n=55))


def test_what_is_refused(spark, tmp_path):
    path = parquet(tmp_path / "a.parquet", 0, 5)
    with pytest.raises(ValueError, match="clash"):
        read_listed(spark, [path], schema=StructType([StructField("row_index", LongType())]))
    with pytest.raises(Exception, match="no columns"):
        read_listed(spark, [path], schema=StructType([StructField("y", LongType())])).collect()
    with pytest.raises(Exception):
        read_listed(spark, [path, str(tmp_path / "none.parquet")], ["x"]).collect()


def test_a_growing_list_is_a_stream(spark, tmp_path):
    files = [parquet(tmp_path / f"{name}.parquet", i * 100, 25) for i, name in enumerate("dbca")]
    schema = StructType([StructField("x", LongType())])
    names, out, ckpt = (str(tmp_path / n) for n in ("names", "out", "ckpt"))
    for n in (1, 1, 3, 4):  # the second run finds nothing new
        with open(names, "w") as handle:
            handle.write("\n".join(files[:n]) + "\n\n")
        run_to_files(stream_listed(spark, names, schema), out, ckpt)
        assert rows(spark.read.parquet(out)) == [(f, i, f * 100 + i) for f in range(n) for i in range(25)]
    assert len([f for f in os.listdir(f"{ckpt}/commits") if f.isdigit()]) == 3


def test_filter_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "w " * i) for i in range(20)], "id int, text string")
    found = filter_batches(df, lambda pdf: pdf["text"].str.len() > 10, ["text"])
    assert sorted(r["id"] for r in found.collect()) == list(range(6, 20))
    assert found.columns == ["id", "text"]
    assert filter_batches(df, lambda pdf: pd.Series([None] * len(pdf))).count() == 0
    assert filter_batches(df.limit(0), lambda pdf: pdf["id"] > 0).count() == 0


def test_a_folder_is_one_file_of_the_list(spark, tmp_path):
    (tmp_path / "many" / "inner").mkdir(parents=True)
    for name, start, n in (("part-0", 0, 25), ("part-1", 25, 5), ("inner/part-2", 1000, 12)):
        parquet(tmp_path / "many" / f"{name}.parquet", start, n)
    (tmp_path / "many" / "_SUCCESS").write_text("")
    one, many = parquet(tmp_path / "one.parquet", 100, 7), str(tmp_path / "many")
    held = [*range(1000, 1012), *range(30)]  # by name: inner/part-2, part-0, part-1
    lists = [[100 + i for i in range(7)], held, [100 + i for i in range(7)]]
    for n in (None, 0, 3, 14, 40, 99):
        expected = [(f, i, x) for f, xs in enumerate(lists) for i, x in enumerate(xs[:n])]
        assert rows(read_listed(spark, [one, many, one], ["x"], first_n=n)) == expected
    names, out, ckpt = (str(tmp_path / n) for n in ("names", "out", "ckpt"))
    for n in (1, 3):
        (tmp_path / "names").write_text("\n".join([one, many, one][:n]))
        run_to_files(stream_listed(spark, names, StructType([StructField("x", LongType())])), out, ckpt)
    assert rows(spark.read.parquet(out)) == [(f, i, x) for f, xs in enumerate(lists) for i, x in enumerate(xs)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, documents as a folder of three files."""
    from tests.conftest import SF_DIR

    if not os.path.isdir(SF_DIR):
        pytest.skip("no table folder")
    path = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF_DIR):
        if name != "documents.parquet":
            os.symlink(f"{SF_DIR}/{name}", path / name)
    docs = pq.read_table(f"{SF_DIR}/documents.parquet")
    (path / "documents.parquet").mkdir()
    for i, lo in enumerate(range(0, docs.num_rows, 80)):
        pq.write_table(docs.slice(lo, 80), path / "documents.parquet" / f"part-{i}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["listed_files", "listed_first_n", "stream_listed", "stream_take", "stream_tokenize"])
def test_tables_that_are_folders(spark, sf_dir, folders, name):
    from corpusloom.plans.registry import QUERIES

    def found(path):
        return sorted(map(tuple, QUERIES[name](spark, path).collect()))

    assert found(folders) == found(sf_dir)
