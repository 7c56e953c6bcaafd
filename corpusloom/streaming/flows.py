"""The flow over streams.

Stateless steps are the batch functions on a streaming frame. Packing, taking and shard
writing keep a little state between micro-batches. It is stored under the number of the
micro-batch that leaves it, next to that micro-batch's output, so a replay of a
micro-batch overwrites what it wrote before and reads what its predecessor left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import attention_mask, tokenize
from corpusloom.operators.mix import interleave_documents
from corpusloom.operators.order import LIGHT_BITS, dense_ordinal
from corpusloom.operators.pack import cut_blocks, pack_blocks
from corpusloom.operators.rows import filter_nonempty, filter_valid_text
from corpusloom.session import scratch_path
from corpusloom.sources.files import delete_path, list_names, path_exists
from corpusloom.sources.shards import MAX_SAMPLES_PER_SHARD, commit_once

BLOCK_SCHEMA = "batch_id bigint, block_ord bigint, input_ids array<int>, attention_mask array<int>"
PENDING_SCHEMA = "ord bigint, input_ids array<int>"
STATE_SCHEMA = "batches bigint, blocks bigint, pending bigint"
# Rows of token lists that a scan takes at a time, and bytes that a writer holds of them.
READ_ROWS = 512
GROUP_BYTES = 16 << 20


def tokenize_stream(docs: DataFrame, **settings) -> DataFrame:
    """Valid documents with ids and mask; the same columns on a batch or a stream."""
    ids = filter_valid_text(docs).withColumn("input_ids", tokenize("text", **settings)).drop("text")
    return filter_nonempty(ids.withColumn("attention_mask", attention_mask("input_ids")))


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available now as Parquet, exactly once over restarts."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(
    df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Call ``step(frame, number)`` for each micro-batch that is available now."""
    query = (
        df.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def last_finished(spark: SparkSession, folder: str) -> int:
    """The highest micro-batch whose state in ``folder`` is written whole; -1 without one."""
    numbers = sorted((int(n) for n in list_names(spark, folder) if n.isdigit()), reverse=True)
    return next((n for n in numbers if path_exists(spark, f"{folder}/{n}/_SUCCESS")), -1)


def forget(spark: SparkSession, folder: str, number: int) -> None:
    """Drop what no replay of micro-batch ``number`` reads: the states before its predecessor's."""
    delete_path(spark, f"{folder}/{number - 2}")


@contextmanager
def kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the scratch folder, read some rows at a time, for as long as the block lasts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    path = scratch_path(spark, name)
    try:
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_path(spark, path)


class StreamPacker:
    """Packs a stream of token lists as ``pack_blocks`` packs a table.

    Batches of ``batch_size`` documents run on over micro-batches: the documents of an
    unfinished batch, fewer than ``batch_size``, wait for the next micro-batch. With
    ``batch_size=None`` the whole stream is one batch, and fewer than ``block_size``
    ids wait. Within a micro-batch ``order`` gives the order of the documents.

    What a micro-batch reads more than once is written to the scratch folder while it lasts: kept in
    executors it would fill their memory, and what they put to disk they map into it again.
    """

    def __init__(
        self,
        path: str,
        block_size: int,
        batch_size: int | None = 1000,
        order: str = "doc_ord",
    ):
        self.path, self.block_size, self.order = path, block_size, order
        self.batch_size = batch_size if batch_size and batch_size > 0 else None

    def _left(self, spark: SparkSession, number: int) -> tuple[int, int, int]:
        path = f"{self.path}/_state/{number}"
        if number < 0:
            return 0, 0, 0
        if not path_exists(spark, path):
            raise FileNotFoundError(f"the state of micro-batch {number} is missing: {path}")
        return tuple(spark.read.schema(STATE_SCHEMA).parquet(path).head())

    def _pending(self, spark: SparkSession, number: int) -> DataFrame:
        path = f"{self.path}/_pending/{number}"
        if number < 0 or not path_exists(spark, path):
            return spark.createDataFrame([], PENDING_SCHEMA)
        return spark.read.schema(PENDING_SCHEMA).parquet(path)

    def _save(self, blocks: DataFrame, pending: DataFrame, state: tuple, number: int) -> None:
        spark = blocks.sparkSession
        blocks.write.mode("overwrite").parquet(f"{self.path}/commit={number}")
        pending.select("ord", "input_ids").write.mode("overwrite").parquet(
            f"{self.path}/_pending/{number}"
        )
        spark.createDataFrame([state], STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/_state/{number}"
        )
        for folder in ("_state", "_pending"):
            forget(spark, f"{self.path}/{folder}", number)

    def __call__(self, df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        batches, blocks, pending = self._left(spark, number - 1)
        with kept(df.select(self.order, "input_ids"), "arrived") as fresh:
            if self.batch_size is None:  # the order is enough, and the ids stay; what waits comes first, as 0
                rows = fresh.select((F.col(self.order) + 1).alias("ord"), "input_ids")
                self._step_continuous(self._pending(spark, number - 1).unionByName(rows), blocks, number)
            else:
                self._step_batches(fresh, batches, pending, number)

    def _numbered(self, df: DataFrame, before: int) -> DataFrame:
        numbered = dense_ordinal(df, self.order, out="ord")
        return numbered.select((F.col("ord") + before).alias("ord"), "input_ids")

    def _step_batches(self, fresh: DataFrame, batches: int, pending: int, number: int) -> None:
        spark = fresh.sparkSession
        n = pending + fresh.count()
        full = n // self.batch_size
        cut = full * self.batch_size
        old = self._pending(spark, number - 1)
        if full == 0:
            packed = pack_blocks(self._pending(spark, -1), self.block_size, self.batch_size)
            waiting = old.unionByName(self._numbered(fresh, pending))
        else:
            # The first row that waits is found by its key, so that the lists of those that wait are not numbered with the others.
            keys = dense_ordinal(fresh.select(self.order), self.order, out="ord", row_bits=LIGHT_BITS)
            first = keys.where(F.col("ord") == cut - pending).select(self.order).head()
            ready, late = fresh, fresh.limit(0)
            if first is not None:
                ready, late = fresh.where(F.col(self.order) < first[0]), fresh.where(F.col(self.order) >= first[0])
            packed = pack_blocks(old.unionByName(self._numbered(ready, pending)), self.block_size, self.batch_size)
            waiting = self._numbered(late, 0)
        self._save(
            packed.withColumn("batch_id", F.col("batch_id") + batches),
            waiting,
            (batches + full, 0, n - cut),
            number,
        )

    def _step_continuous(self, rows: DataFrame, blocks: int, number: int) -> None:
        with kept(cut_blocks(rows, self.block_size, None), "pieces") as pieces:
            full = F.size("input_ids") == self.block_size
            packed = (
                pieces.where(full)
                .withColumn("block_ord", F.col("block_ord") + blocks)
                .withColumn("attention_mask", F.array_repeat(F.lit(1), self.block_size))
            )
            tail = pieces.where(~full).select(F.lit(0).cast("bigint").alias("ord"), "input_ids")
            counted = pieces.agg(F.count_if(full), F.count_if(~full)).head()
            self._save(packed, tail, (0, blocks + counted[0], counted[1]), number)

    def finish(self, spark: SparkSession) -> None:
        """Pack the last, unfinished batch; to be called when the stream has ended."""
        last = self.last_number(spark)
        batches, _, pending = self._left(spark, last)
        if self.batch_size is None or pending == 0:
            return
        packed = pack_blocks(self._pending(spark, last), self.block_size, self.batch_size)
        packed = packed.withColumn("batch_id", F.col("batch_id") + batches)
        self._save(packed, self._pending(spark, -1), (batches + 1, 0, 0), last + 1)

    def last_number(self, spark: SparkSession) -> int:
        return last_finished(spark, f"{self.path}/_state")

    def blocks(self, spark: SparkSession) -> DataFrame:
        """The blocks of all finished micro-batches."""
        last = self.last_number(spark)
        if last < 0:
            return spark.createDataFrame([], BLOCK_SCHEMA)
        found = spark.read.schema(f"{BLOCK_SCHEMA}, commit bigint").parquet(self.path)
        return found.where(F.col("commit") <= last).drop("commit")


class StreamTake:
    """The first ``n`` rows of a stream; a micro-batch fills up what is left of ``n``."""

    def __init__(self, path: str, n: int, order: Sequence[str]):
        self.path, self.n, self.order = path, n, list(order)

    def taken(self, spark: SparkSession, number: int) -> int:
        """Rows taken up to the end of micro-batch ``number``."""
        path = f"{self.path}/_taken/{number}"
        if number < 0 or not path_exists(spark, path):
            return 0
        return spark.read.schema("taken bigint").parquet(path).head()[0]

    def __call__(self, df: DataFrame, number: int) -> None:
        spark, before = df.sparkSession, self.taken(df.sparkSession, number - 1)
        rows, path = 0, f"{self.path}/part={number}"
        if before < self.n:
            first = df.orderBy(*self.order).limit(self.n - before)
            first.write.mode("overwrite").parquet(path)
            rows = spark.read.schema(df.schema).parquet(path).count()
        spark.createDataFrame([(before + rows,)], "taken bigint").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/_taken/{number}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/part=*")


def interleave_streams(streams: Sequence[DataFrame]) -> DataFrame:
    """Union of streams tagged with their place in the round-robin."""
    tagged = [s.withColumn("src_ord", F.lit(i)) for i, s in enumerate(streams)]
    return reduce(DataFrame.unionByName, tagged)


class StreamInterleave:
    """The round-robin over streams, going on from micro-batch to micro-batch.

    The state is the number of rows of each source so far, which a source's rows of the next
    micro-batch take their ranks from. Positions follow from ranks and sizes when the rows are
    read, so they equal those of the table for any cut into micro-batches, as long as each
    source arrives in the order of ``order``.
    """

    def __init__(self, path: str, src: str = "src_ord", order: str = "doc_ord"):
        self.path, self.src, self.order = path, src, order

    def _sizes(self, spark: SparkSession, number: int) -> dict[int, int]:
        """Rows of each source up to the end of a micro-batch; there are as many as streams."""
        if number < 0:
            return {}
        found = spark.read.schema("src int, n bigint").parquet(f"{self.path}/_sizes/{number}")
        return {r["src"]: r["n"] for r in found.collect()}

    def __call__(self, df: DataFrame, number: int) -> None:
        spark, path = df.sparkSession, f"{self.path}/part={number}"
        sizes = self._sizes(spark, number - 1)
        before = F.lit(0).cast("bigint")
        for source, n in sizes.items():
            before = F.when(F.col(self.src) == source, F.lit(n)).otherwise(before)
        ranked = dense_ordinal(df, self.order, by=[self.src], out="rank")
        ranked.withColumn("rank", F.col("rank") + before).withColumn(
            "micro_batch", F.lit(number).cast("bigint")
        ).write.mode("overwrite").parquet(path)
        for r in spark.read.schema(df.schema).parquet(path).groupBy(self.src).count().collect():
            sizes[r[self.src]] = sizes.get(r[self.src], 0) + r["count"]
        spark.createDataFrame(list(sizes.items()), "src int, n bigint").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/_sizes/{number}")
        forget(spark, f"{self.path}/_sizes", number)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of finished micro-batches with ``pos``, their place in the round-robin."""
        last = last_finished(spark, f"{self.path}/_sizes")
        if last < 0:
            raise FileNotFoundError(f"no micro-batch is finished in {self.path}")
        sizes = self._sizes(spark, last)
        counts = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
        found = spark.read.parquet(self.path).where(F.col("part") <= last).drop("part")
        return interleave_documents(found, src=self.src, rank="rank", counts=counts).drop("rank")


class StreamShards:
    """Each micro-batch of blocks becomes one commit of a shard directory."""

    def __init__(
        self, path: str, order: str, max_samples: int = MAX_SAMPLES_PER_SHARD, writer: str = "stream"
    ):
        self.path, self.order, self.max_samples, self.writer = path, order, max_samples, writer

    def __call__(self, df: DataFrame, number: int) -> None:
        # The blocks move once, to the ranges in which they are written.
        rows = dense_ordinal(df, self.order, out="ord", ranged=True)
        commit_once(rows, self.path, number, self.max_samples, writer=self.writer, ranged=True)
