"""A Python data source over a list of Parquet files: in list order, as a batch or a stream.

A task reads a run of a file's row groups and takes their place in the file from the footer
it opens anyway, so no row moves to be numbered. A listed folder stands for its data files, by
name; only the footers of these are read ahead, to number the rows over the folder.
Paths must lead to where Arrow's file systems read (local, ``s3://``, ``gs://``, ``hdfs://``);
``files.read_files_in_order`` reads every path that Spark does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusloom.sources.files import real_path

NAME = "listed_parquet"
# Runs of row groups that a file is read in, unless a reader asks for another number.
SPLITS = 8
# Rows of one Arrow batch; a text column of long documents stays small in it.
BATCH_ROWS = 1_024
# Footers of a folder's files that are read at once.
FOOTERS = 16
PLACE = [StructField("file_ord", IntegerType()), StructField("row_index", LongType())]


@dataclass
class Run(InputPartition):
    """The ``part``-th of ``parts`` runs of row groups of a file.

    ``file_ord`` is the place in the list of the file or of its folder, whose earlier files hold ``before`` rows.
    """

    file_ord: int
    path: str
    part: int
    parts: int
    before: int = 0


class _Listed:
    """What the batch and the stream reader share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.splits = int(options.get("splits", SPLITS))
        first_n = options.get("firstn")  # option names arrive in lower case
        self.first_n = None if first_n is None else int(first_n)
        self.files = options.get("files")
        self.list_path = options.get("path")
        if self.splits < 1:
            raise ValueError("splits must be at least 1")
        if (self.files is None) == (self.list_path is None):
            raise ValueError("give either the option files (a JSON list) or the path of a list of files")

    def listed(self) -> list[str]:
        """The files now listed; a list in a file is read anew."""
        if self.files is not None:
            return list(json.loads(self.files))
        with _open(self.list_path) as handle:
            lines = handle.read().decode("utf-8").splitlines()
        return [line.strip() for line in lines if line.strip()]

    def runs(self, start: int, end: int) -> list[Run]:
        files = self.listed()
        return [run for i in range(start, end) for run in self._runs_of(i, files[i])]

    def _runs_of(self, file_ord: int, path: str) -> Iterator[Run]:
        # The first rows of a file lie in its first row groups, which one task reads.
        most = self.splits if self.first_n is None else 1
        inner = _data_files(path)
        if inner is None:
            yield from (Run(file_ord, path, k, most) for k in range(most))
            return
        before = 0
        with ThreadPoolExecutor(FOOTERS) as pool:
            for lo in range(0, len(inner), FOOTERS):
                some = inner[lo : lo + FOOTERS]
                for name, (rows, groups) in zip(some, pool.map(_footer, some)):
                    if self.first_n is not None and before >= self.first_n:
                        return
                    parts = min(most, max(1, groups))
                    yield from (Run(file_ord, name, k, parts, before) for k in range(parts))
                    before += rows

    def read(self, run: Run) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        columns = [f.name for f in self.schema.fields if f not in PLACE]
        with _open(run.path) as handle:
            file = pq.ParquetFile(handle)
            absent = set(columns) - set(file.schema_arrow.names)
            if absent:
                raise ValueError(f"{run.path} has no columns {sorted(absent)}")
            groups, first = file.metadata.num_row_groups, run.before
            for group in range(groups):
                rows = file.metadata.row_group(group).num_rows
                due = group * run.parts // groups == run.part
                if due and (self.first_n is None or first < self.first_n):
                    left = rows if self.first_n is None else min(rows, self.first_n - first)
                    yield from _batches(pa, file, group, columns, wanted, run.file_ord, first, left)
                first += rows


def _batches(pa, file, group: int, columns: list[str], wanted, file_ord: int, first: int, left: int) -> Iterator:
    for batch in file.iter_batches(BATCH_ROWS, row_groups=[group], columns=columns, use_threads=False):
        if left <= 0:
            return
        batch = batch.slice(0, left)
        n = batch.num_rows
        place = {"file_ord": pa.array([file_ord] * n, pa.int32()), "row_index": pa.array(range(first, first + n), pa.int64())}
        arrays = [place[f.name] if f.name in place else batch.column(f.name).cast(f.type) for f in wanted]
        yield pa.RecordBatch.from_arrays(arrays, schema=wanted)
        first, left = first + n, left - n


def _system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _open(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def _data_files(path: str) -> list[str] | None:
    """The data files below a folder, by name; None for anything else."""
    from pyarrow import fs

    system, inner = _system(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return None
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    # As Spark does, leave out names with a mark in front, also of folders.
    files = [(f.path, f.path.removeprefix(inner).strip("/")) for f in found if f.type == fs.FileType.File]
    names = sorted(name for _, name in files if not any(part[0] in "._" for part in name.split("/")))
    if not names:
        raise ValueError(f"no data files in {path}")
    return [f"{path.rstrip('/')}/{name}" for name in names]


def _footer(path: str) -> tuple[int, int]:
    """Rows and row groups of a file."""
    import pyarrow.parquet as pq

    with _open(path) as handle:
        found = pq.ParquetFile(handle).metadata
        return found.num_rows, found.num_row_groups


class ListedReader(_Listed, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.runs(0, len(self.listed()))


class ListedStreamReader(_Listed, DataSourceStreamReader):
    """The offset is the number of files read, so a list that grows is a stream."""

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.listed())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["files"] < start["files"]:
            raise ValueError(f"the list shrank from {start['files']} to {end['files']} files")
        return self.runs(start["files"], end["files"])


class ListedParquet(DataSource):
    """Format ``listed_parquet``. Options: ``files`` or a path to a list, ``firstN``, ``splits``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError(f"{NAME} needs a schema: use read_listed or stream_listed")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ListedStreamReader(schema, self.options)


def with_place(schema: StructType, columns: Sequence[str] | None = None) -> StructType:
    """``schema``, or the named columns of it, behind ``file_ord`` and ``row_index``."""
    taken = {f.name for f in PLACE}
    clash = taken & set(columns if columns is not None else schema.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the place of a row; name other columns")
    kept = schema.fields if columns is None else [schema[c] for c in columns]
    return StructType([*PLACE, *(StructField(f.name, f.dataType) for f in kept)])


def read_listed(
    spark: SparkSession,
    files: Sequence[str],
    columns: Sequence[str] | None = None,
    first_n: int | None = None,
    schema: StructType | None = None,
    splits: int = SPLITS,
) -> DataFrame:
    """``file_ord, row_index`` and the columns of the listed files.

    The two numbers give the order of the concatenation. With ``first_n`` a file's task stops
    in the row group that holds its n-th row and opens no later one. A file listed twice is
    read twice; one that is missing or lacks a column is an error. A folder counts as one file.
    """
    if schema is None:
        schema = spark.read.parquet(files[0]).schema if files else StructType([])
    spark.dataSource.register(ListedParquet)
    reader = spark.read.format(NAME).schema(with_place(schema, columns)).option("files", json.dumps([real_path(spark, p) for p in files]))
    if first_n is not None:
        reader = reader.option("firstN", str(first_n))
    return reader.option("splits", str(splits)).load()


def stream_listed(
    spark: SparkSession,
    list_path: str,
    schema: StructType,
    columns: Sequence[str] | None = None,
    first_n: int | None = None,
    splits: int = SPLITS,
) -> DataFrame:
    """The files named in a text file, one a line, as a stream in the order of the list.

    Lines appended to the list arrive as the next micro-batch, also after a restart from the
    checkpoint. ``file_ord`` counts over the whole list. Lines already read must stay, and so must
    the files of a listed folder. Paths of mounts are written to the list as ``files.real_path`` gives them.
    """
    spark.dataSource.register(ListedParquet)
    reader = spark.readStream.format(NAME).schema(with_place(schema, columns)).option("splits", str(splits))
    if first_n is not None:
        reader = reader.option("firstN", str(first_n))
    return reader.load(real_path(spark, list_path))
