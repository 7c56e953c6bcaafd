"""Packing token lists into blocks, chunking, and batch padding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from corpusloom.operators.order import running_total

# Batches up to this many documents are one window group each.
WINDOW_BATCH = 1 << 14
IGNORE_LABEL = -100
# Bytes of an Arrow batch of token lists, or one longer list.
BATCH_BYTES = 6 << 20


def batch_of(ordinal: str, batch_size: int | None) -> Column:
    """Batch number of a dense ordinal; ``None`` or <= 0 puts all rows in one batch."""
    if batch_size is None or batch_size <= 0:
        return F.lit(0).cast("bigint")
    return F.expr(f"`{ordinal}` div {int(batch_size)}")


def pack_blocks(
    rows: DataFrame,
    block_size: int,
    batch_size: int | None = 1000,
    ordinal: str = "ord",
    ids: str = "input_ids",
    by: Sequence[str] = (),
) -> DataFrame:
    """Concatenate the token lists of each batch and cut them into full blocks.

    A batch is ``batch_size`` consecutive rows by the dense ``ordinal``; the tail of a
    batch that does not fill a block is dropped. With ``by`` each group has ordinals and
    batches of its own. Gives ``(*by, batch_id, block_ord, input_ids, attention_mask)``.

    Rows that already carry ``batch_id`` keep it, and with it their partitioning.

    Batches of up to ``WINDOW_BATCH`` rows are cut in one pass over their rows in order, in Arrow tasks. In longer
    ones each row finds the blocks it touches from its token offset in the batch and sends
    one slice to each, so what moves is tokens once, never a row per token.
    """
    blocks = cut_blocks(rows, block_size, batch_size, ordinal, ids, by)
    return blocks.where(F.size("input_ids") == block_size).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), block_size)
    )


def cut_blocks(
    rows: DataFrame,
    block_size: int,
    batch_size: int | None = 1000,
    ordinal: str = "ord",
    ids: str = "input_ids",
    by: Sequence[str] = (),
) -> DataFrame:
    """The blocks of each batch with its tail, and without a mask."""
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    whole = batch_size is None or batch_size <= 0
    batch = [*by, "batch_id"]
    # A filter on the ids here would be pushed down and tokenize a second time.
    lists = rows.select(
        *by,
        "batch_id" if "batch_id" in rows.columns else batch_of(ordinal, batch_size).alias("batch_id"),
        F.col(ordinal).alias("__ord"),
        F.col(ids).alias("__ids"),
        F.coalesce(F.size(ids), F.lit(0)).cast("bigint").alias("__n"),
    )
    if whole or batch_size > WINDOW_BATCH:
        placed = running_total(lists, F.col("__n"), "__ord", by=batch, out="__start")
        return _assemble(placed.where("__n > 0"), block_size, batch)
    earlier = W.partitionBy(*batch).orderBy("__ord").rowsBetween(W.unboundedPreceding, -1)
    placed = lists.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("bigint")))
    return _cut_in_order(placed.where("__n > 0"), block_size, batch)


def _cut_in_order(placed: DataFrame, block_size: int, batch: Sequence[str]) -> DataFrame:
    """Cut rows as the window leaves them: batch after batch, in order inside each.

    A task holds one Arrow batch and less than a block besides. Each row's offset is checked against
    what was read, so rows in another order are an error, never other blocks.
    """
    rows = placed.select(*batch, "__start", "__ids")
    ids = rows.schema["__ids"].dataType
    out = StructType([rows.schema[c] for c in batch]).add("block_ord", LongType()).add("input_ids", ids)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, rest = None, 0, None

        def blocks(keys: list[tuple], parts: list[pa.Array], ends: list[int], numbers: list[int]) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))
            named = zip(batch, zip(*keys))
            columns = [pa.array(values, types[c]) for c, values in named]
            return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), lists], [*batch, "block_ord", "input_ids"])

        for frame in frames:
            types = {c: frame.schema.field(c).type for c in batch}
            lists, starts = frame.column("__ids"), frame.column("__start").to_pylist()
            values, offsets = lists.values, lists.offsets.to_pylist()
            every = list(zip(*(frame.column(c).to_pylist() for c in batch)))
            keys, parts, ends, numbers = [], [], [0], []
            for now, places in groupby(range(len(every)), every.__getitem__):
                places = list(places)
                first, last = places[0], places[-1]
                if now != key:
                    if rest is not None and len(rest):
                        keys, parts, ends, numbers = [*keys, key], [*parts, rest], [*ends, ends[-1] + len(rest)], [*numbers, number]
                    key, number, rest = now, 0, values.slice(0, 0)
                before = number * block_size + len(rest) - offsets[first]
                if any(starts[i] != before + offsets[i] for i in places):
                    raise ValueError("rows of a batch are out of order")
                line = pa.concat_arrays([rest, values.slice(offsets[first], offsets[last + 1] - offsets[first])])
                n = len(line) // block_size
                parts.append(line.slice(0, n * block_size))
                keys += [now] * n
                numbers += range(number, number + n)
                ends += range(ends[-1] + block_size, ends[-1] + n * block_size + 1, block_size)
                number, rest = number + n, pa.concat_arrays([line.slice(n * block_size)])
            if keys:
                yield blocks(keys, parts, ends, numbers)
        if rest is not None and len(rest):
            yield blocks([key], [rest], [0, len(rest)], [number])

    return rows.mapInArrow(work, out)


def _assemble(placed: DataFrame, block_size: int, batch: Sequence[str]) -> DataFrame:
    b = F.lit(block_size).cast("bigint")
    start, n = F.col("__start"), F.col("__n")

    def piece(block: Column) -> Column:
        first = F.greatest(block * b - start, F.lit(0).cast("bigint"))
        stop = F.least((block + 1) * b - start, n)
        return F.struct(
            block.alias("block_ord"),
            F.slice("__ids", (first + 1).cast("int"), (stop - first).cast("int")).alias("part"),
        )

    touched = F.sequence(
        F.expr(f"__start div {block_size}"), F.expr(f"(__start + __n - 1) div {block_size}")
    )
    pieces = placed.select(*batch, "__ord", F.explode(F.transform(touched, piece)).alias("p"))
    return (
        pieces.groupBy(*batch, F.col("p.block_ord").alias("block_ord"))
        .agg(F.sort_array(F.collect_list(F.struct("__ord", F.col("p.part").alias("part")))).alias("ps"))
        .select(*batch, "block_ord", F.flatten(F.col("ps.part")).alias("input_ids"))
    )


def chunk_row(ids: str | Column, n: int) -> Column:
    """Cut one list into full chunks of ``n``; a shorter rest is dropped."""
    col = F.col(ids) if isinstance(ids, str) else ids
    k = F.floor(F.size(col) / n).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(col, i * n + 1, n))
    return F.when(k > 0, chunks).otherwise(F.array().cast("array<array<int>>"))


def collate(
    rows: DataFrame,
    batch_size: int,
    pad_id: int,
    side: str = "left",
    ordinal: str = "ord",
    ids: str = "input_ids",
) -> DataFrame:
    """Pad the rows of each batch of ``batch_size`` to the longest one.

    The mask is 0 on padding. Labels repeat the ids with -100 wherever the id is the pad
    id, so that the loss skips it; this covers an EOS that doubles as pad.
    """
    if side not in ("left", "right"):
        raise ValueError(f"side must be 'left' or 'right', not {side!r}")
    in_batch = W.partitionBy("batch_id")
    gap = F.max(F.size(ids)).over(in_batch) - F.size(ids)
    sized = rows.withColumn("batch_id", batch_of(ordinal, batch_size)).withColumn("__gap", gap)

    def join(fill: Column, body: Column) -> Column:
        return F.concat(fill, body) if side == "left" else F.concat(body, fill)

    padded = sized.withColumn(
        "attention_mask",
        join(F.array_repeat(F.lit(0), F.col("__gap")), F.array_repeat(F.lit(1), F.size(ids))),
    ).withColumn(ids, join(F.array_repeat(F.lit(pad_id), F.col("__gap")), F.col(ids)))
    labels = F.transform(ids, lambda x: F.when(x == pad_id, IGNORE_LABEL).otherwise(x))
    return padded.withColumn("labels", labels).drop("__gap")
