"""Counts, run sizing and vocabulary bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.session import spread

# Steps per epoch when the number of samples is unknown.
DEFAULT_STEPS_PER_EPOCH = 100_000


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))


def corpus_summary(df: DataFrame, lang: str = "lang", shard: str = "shard") -> DataFrame:
    """Rows and shards per language, and the total under a null language.

    Counted per shard first, so that the distinct count sees one row per shard.
    """
    per_shard = df.groupBy(lang, shard).agg(F.count(F.lit(1)).alias("__n"))
    return per_shard.rollup(lang).agg(
        F.sum("__n").alias("rows"), F.countDistinct(shard).alias("shards")
    )


def rows_per_file(df: DataFrame, file: str) -> DataFrame:
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"))


def sample_count_exact(per_file: DataFrame, rows: str = "rows") -> DataFrame:
    return per_file.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("samples"))


def sample_count_estimate(per_file: DataFrame, order: str, rows: str = "rows") -> DataFrame:
    """Samples estimated from the first and the last file by name."""
    n, first, last = F.col("n"), F.col("first"), F.col("last")
    return per_file.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(rows, order).alias("first"),
        F.max_by(rows, order).alias("last"),
    ).select(
        F.when(n == 1, first)
        .when(last < first, first * (n - 1) + last)
        .otherwise(first * n)
        .alias("samples")
    )


def plan_steps(
    samples: Column | None, batch: int, world: int = 1, accum: int = 1, epochs: int = 1
) -> Column:
    """Optimizer steps of a run; an unknown size takes a default per epoch."""
    unknown = F.lit(DEFAULT_STEPS_PER_EPOCH * epochs).cast("bigint")
    if samples is None:
        return unknown
    per_step = batch * world * accum
    steps = (F.floor(samples / per_step) * epochs).cast("bigint")
    return F.when(samples > 0, steps).otherwise(unknown)


def required_vocab_size(vocab_size: Column, pad_id: Column) -> Column:
    """The embedding must also cover the pad id."""
    return F.greatest(vocab_size, pad_id + 1)


def id_range(blocks: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Smallest and largest id of a table, from the extremes of each row."""
    return blocks.agg(
        F.min(F.array_min(ids)).alias("min_id"), F.max(F.array_max(ids)).alias("max_id")
    )


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(ch, n)``: occurrences of each character."""
    return (
        spread(texts.where(F.length(text) > 0))
        .select(F.explode(F.split(text, "")).alias("ch"))
        .groupBy("ch")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def char_coverage(counts: DataFrame, coverage: float = 0.98) -> DataFrame:
    """Keep the most frequent characters until they cover the wanted share.

    ``counts`` has one row per distinct character: at most 1,114,112 light rows, so one
    window over them is bounded.
    """
    order = W.orderBy(F.desc("n"), "ch")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy())
    return (
        counts.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .withColumn("before", before)
        .withColumn("total", total)
        .where(F.col("before") < F.col("total") * F.lit(coverage))
        .select("rank", "ch", "n")
    )


def byte_fallback_flag(vocab: DataFrame, piece: str = "piece") -> DataFrame:
    """Whether a vocabulary holds byte pieces."""
    return vocab.agg(
        F.coalesce(F.max(F.col(piece).rlike("^<0x.*>$")), F.lit(False)).alias("byte_fallback")
    )


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def pack_stats(blocks: DataFrame, batch: str = "batch_id", ids: str = "input_ids") -> DataFrame:
    """Blocks and tokens that each batch gave."""
    return blocks.groupBy(batch).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.size(ids)).alias("tokens")
    )
