"""Dense ordinals and running totals without a single-task window.

Row order is part of the data model, and a DataFrame has none. Every operator here
takes an explicit BIGINT order key. A running total is found in two steps: rows are
windowed inside buckets of adjacent keys, and the bucket totals, one light row per
bucket, get a running total of their own. A bucket covers a fixed range of keys, so its
size has an upper bound whatever share of the table one source holds. Totals that are too
many for one window are summed the same way again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.session import stage

# Keys per window group where rows carry texts or token lists: 2^10.
ROW_BITS = 10
# Keys per window group where rows are a few numbers: 2^16.
LIGHT_BITS = 16
# Buckets whose first ordinals are sent to all tasks.
BROADCAST_BUCKETS = 1 << 20


def key_bits_for(largest: int | None) -> int:
    """Bits of the largest order key."""
    return max(0, largest or 0).bit_length()


def measure_key_bits(df: DataFrame, order: str) -> int:
    """Read the key column once to see how many levels of buckets it needs."""
    return key_bits_for(df.agg(F.max(order)).head()[0])


def running_total(
    df: DataFrame,
    value: Column,
    order: str,
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
    out: str = "before",
    row_bits: int = ROW_BITS,
    key_bits: int | None = None,
    enrich: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come earlier.

    Rows are ordered by ``(*lead, order)`` and the total restarts for each ``by``. The
    order must be unique inside ``(*by, *lead)``, not negative, and its columns non-null.
    ``key_bits`` bounds the order keys; without it the key column is read once to find the
    bound. It decides the number of levels, so that no window group spans more than
    ``2^row_bits`` keys, or 2^16 buckets, whatever the size of the table.

    ``enrich`` gets the light bucket table and the name of its total column; the columns
    that it adds reach the rows by the same join.
    """
    if key_bits is None:
        key_bits = measure_key_bits(df, order)
    if key_bits <= row_bits and not lead and enrich is None:
        return df.withColumn(out, _sum_before(value, W.partitionBy(*by).orderBy(order)))
    bucket, amount, base = f"__b_{out}", f"__v_{out}", f"__base_{out}"
    group = [*by, *lead, bucket]
    # Never null, so that the joins put no filters below them and plans can be shared.
    place = F.coalesce(F.shiftright(F.col(order), row_bits), F.lit(-1).cast("bigint"))
    keyed = df.withColumn(bucket, place)
    rows = keyed.withColumn(out, _sum_before(value, W.partitionBy(*group).orderBy(order)))
    totals = keyed.groupBy(*group).agg(F.sum(value).alias(amount))
    left_bits = max(0, key_bits - row_bits)
    if left_bits > LIGHT_BITS:
        bases = running_total(
            totals, F.col(amount), bucket, by, lead, base, LIGHT_BITS, left_bits
        )
    else:
        bases = totals.withColumn(
            base, _sum_before(F.col(amount), W.partitionBy(*by).orderBy(*lead, bucket))
        )
    if enrich is not None:
        bases = enrich(bases, amount)
    return (
        rows.join(bases.drop(amount), group)
        .withColumn(out, F.coalesce(F.col(out) + F.col(base), F.lit(0)).cast("bigint"))
        .drop(bucket, base)
    )


def _sum_before(value: Column, order: W) -> Column:
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("bigint")


def dense_ordinal(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
    out: str = "ord",
    ranged: bool = False,
    **kw,
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... in the order of ``(*lead, order)`` inside ``by``.

    With ``ranged``, which takes neither ``by`` nor ``lead``, the rows come in partitions by ranges of ``order`` and sorted by it.
    They move once, and are read twice before that, for the numbers of rows and for the ranges.
    """
    if ranged:
        if by or lead:
            raise ValueError("ranges are those of one order key")
        return _ranged_ordinal(df, order, out, **kw)
    return running_total(df, F.lit(1).cast("bigint"), order, by, lead, out, **kw)


def _ranged_ordinal(df: DataFrame, order: str, out: str, row_bits: int = ROW_BITS) -> DataFrame:
    bucket, amount, base = f"__b_{out}", f"__v_{out}", f"__base_{out}"
    keyed = df.withColumn(bucket, F.coalesce(F.shiftright(F.col(order), row_bits), F.lit(-1).cast("bigint")))
    # Written: the sizes of the buckets are read several times, the rows that they are counted from once.
    totals = stage(keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias(amount)), "totals")
    bases = running_total(totals, F.col(amount), bucket, out=base, row_bits=LIGHT_BITS).select(bucket, base)
    if totals.count() <= BROADCAST_BUCKETS:
        bases = F.broadcast(bases)
    # One range of buckets is one partition, so the window needs no move of its own.
    moved = keyed.repartitionByRange(bucket).sortWithinPartitions(bucket, order)
    rows = moved.withColumn(out, _sum_before(F.lit(1).cast("bigint"), W.partitionBy(bucket).orderBy(order)))
    joined = rows.join(bases, bucket).withColumn(out, F.col(out) + F.col(base)).drop(bucket, base)
    return joined if totals.count() <= BROADCAST_BUCKETS else joined.repartitionByRange(out)
