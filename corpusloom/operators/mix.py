"""Combining sources: concatenation and document-wise interleaving."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.operators.order import ROW_BITS, dense_ordinal, key_bits_for

# Sources whose sizes may come to the driver.
MAX_LISTED_SOURCES = 1_000


def concat_sources(sources: Sequence[DataFrame], src: str = "src_ord") -> DataFrame:
    """Append sources in order; duplicates stay. ``src`` numbers them from 0."""
    if not sources:
        raise ValueError("no source to concatenate")
    tagged = [df.withColumn(src, F.lit(i)) for i, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged)


def concat_ordinal(
    df: DataFrame, src: str = "src_ord", order: str = "doc_ord", out: str = "ord"
) -> DataFrame:
    """Position of each document in the concatenation of its sources."""
    return dense_ordinal(df, order, lead=[src], out=out)


def _position(rank: Column, all_counts: Column, counts_left: Column, stop: str) -> Column:
    """Round-robin position of the document with 0-based ``rank`` in its source.

    ``all_counts`` are the sizes of all sources, ``counts_left`` those of the sources
    that come first in a round.
    """
    if stop == "first":
        return rank * F.size(all_counts) + F.size(counts_left)
    rounds = F.aggregate(
        all_counts, F.lit(0).cast("bigint"), lambda acc, c: acc + F.least(c, rank)
    )
    this_round = F.aggregate(
        counts_left,
        F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.when(c > rank, 1).otherwise(0),
    )
    return rounds + this_round


def interleave_documents(
    df: DataFrame,
    stop: str = "all",
    src: str = "src_ord",
    order: str = "doc_ord",
    out: str = "pos",
    rank: str | None = None,
    counts: Sequence[int] | None = None,
    row_bits: int = ROW_BITS,
    sizes: tuple[Sequence[int] | None, int] | None = None,
) -> DataFrame:
    """Add ``out``, the position in a round-robin over the sources, one document each.

    ``stop="all"``: an exhausted source drops out and the rest go on.
    ``stop="first"``: every source gives as many documents as the shortest one has.

    The position follows from the rank in the source and the sizes of all sources, so
    nothing is sorted globally. Sizes and largest keys come from one scan of the key
    columns, or from ``sizes`` if ``source_sizes`` was asked before. When ``rank`` (0-based, dense) and ``counts`` (size of source 0, 1, ...) are
    known, as with sources made of whole files, there is neither a scan nor a shuffle.
    """
    if stop not in ("all", "first"):
        raise ValueError(f"stop must be 'all' or 'first', not {stop!r}")
    if (rank is None) != (counts is None):
        raise ValueError("rank and counts belong together")
    if counts is None:
        counts, key_bits = sizes or source_sizes(df, src, order)
        enrich = None if counts is not None else lambda b, n: _with_counts(b, n, src)
        ranked = dense_ordinal(
            df, order, by=[src], out="__rank", row_bits=row_bits, key_bits=key_bits, enrich=enrich
        )
    else:
        ranked = df.withColumn("__rank", F.col(rank).cast("bigint"))
    if counts is not None:
        listed = F.array(*[F.lit(int(c)).cast("bigint") for c in counts])
        ranked = ranked.withColumn("__all", listed)
        ranked = ranked.withColumn("__left", F.slice("__all", F.lit(1), F.col(src)))
    if stop == "first":
        ranked = ranked.where(F.col("__rank") < F.array_min("__all"))
    pos = _position(F.col("__rank"), F.col("__all"), F.col("__left"), stop)
    return ranked.withColumn(out, F.coalesce(pos, F.lit(0)).cast("bigint")).drop(
        "__rank", "__all", "__left"
    )


def source_sizes(
    df: DataFrame, src: str = "src_ord", order: str = "doc_ord"
) -> tuple[list[int] | None, int]:
    """``(size of each source, bits of the largest key)``.

    The sizes are None, and stay in a table, when there are more than 1,000 sources or
    they are not numbered 0, 1, 2, ... Null or negative keys are an error: the joins on
    them would lose rows.
    """
    per_source = df.groupBy(src).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(order).alias("last"),
        F.min(order).alias("first"),
        F.count(order).alias("known"),
    )
    listed = per_source.orderBy(src).limit(MAX_LISTED_SOURCES + 1).collect()
    error = f"{src} and {order} must not be null or negative"
    if len(listed) > MAX_LISTED_SOURCES:
        whole = per_source.agg(
            F.count_if(F.col(src).isNull()).alias("no_source"),
            F.count_if(F.col("known") < F.col("n")).alias("no_key"),
            F.count_if(F.col("first") < 0).alias("negative"),
            F.max("last").alias("last"),
        ).first()
        if whole["no_source"] or whole["no_key"] or whole["negative"]:
            raise ValueError(
                f"{error}: {whole['no_source']} without {src}, {whole['no_key']} with null and {whole['negative']} with negative {order}"
            )
        return None, key_bits_for(whole["last"])
    for r in listed:
        if r[src] is None or r["known"] < r["n"] or r["first"] < 0:
            raise ValueError(f"source {r[src]}: {error}")
    bits = key_bits_for(max((r["last"] for r in listed), default=0))
    numbered = [r[src] for r in listed] == list(range(len(listed)))
    return [r["n"] for r in listed] if numbered and listed else None, bits


def _with_counts(buckets: DataFrame, rows: str, src: str) -> DataFrame:
    """Give each light bucket row the sizes of all sources, and of those before its own."""
    counts = buckets.groupBy(src).agg(F.sum(rows).alias("__cnt"))
    in_order = W.orderBy(src)  # one row per source
    counts = counts.select(
        src,
        F.collect_list("__cnt")
        .over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("__all"),
        F.collect_list("__cnt").over(in_order.rowsBetween(W.unboundedPreceding, -1)).alias("__left"),
    )
    return buckets.join(counts, src)
