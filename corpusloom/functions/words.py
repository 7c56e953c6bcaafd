"""Words between white space as token ids, looked up in a dictionary of all words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corpusloom.functions.tokens import whitespace_pieces
from corpusloom.functions.vocab import EOS_ID, RESERVED, UNK_ID
from corpusloom.operators.skew import LEAST_HOT, salted_join
from corpusloom.session import spread, stage

FIRST_WORD_ID = len(RESERVED)
# Bytes of words that meet their ids at once, or one longer text.
GROUP_BYTES = 4 << 20


@dataclass(frozen=True)
class WordModel:
    """A dictionary ``(id int, piece string, n bigint)``; other words get ``unk_id``."""

    vocab: DataFrame
    unk_id: int = UNK_ID
    eos_id: int = EOS_ID


def word_model(docs: DataFrame, text: str = "text", least: int = 1) -> WordModel:
    """The dictionary of all words of ``docs`` that occur ``least`` times or more.

    Ids follow the reserved ones, by falling count, ties by the bytes of the word. The words are
    sorted by ranges: each range numbers its own, after the sizes of the ranges before it, so no
    task holds more than a range. Null and blank texts have no words.
    """
    spark = docs.sparkSession
    words = spread(docs).select(F.explode(whitespace_pieces(text)).alias("piece"))
    counted = words.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(ranges, F.desc("n"), F.asc("piece"))
    # Written with its range: a range's number must not change between two readings.
    placed = stage(ranged.withColumn("range", F.spark_partition_id()), "dictionary")
    rank = F.row_number().over(W.partitionBy("range").orderBy(F.desc("n"), F.asc("piece"))) - 1
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    bases = placed.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    bases = bases.select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    vocab = placed.withColumn("rank", rank).join(F.broadcast(bases), "range")
    vocab = vocab.select((F.col("base") + F.col("rank") + FIRST_WORD_ID).cast("int").alias("id"), "piece", "n")
    return WordModel(stage(vocab, "words"))


def _in_groups(split: DataFrame) -> DataFrame:
    """Add ``__group``: rows that follow one another in a task, of some ``GROUP_BYTES`` of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("__words")).to_numpy().astype(np.int64)
            upto = seen + np.cumsum(sizes)
            group = first + (upto - sizes) // GROUP_BYTES
            seen = int(upto[-1]) if len(upto) else seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group)], [*batch.schema.names, "__group"])

    schema = StructType([*split.schema.fields, StructField("__group", LongType())])
    return split.mapInArrow(work, schema)


def encode_words(
    docs: DataFrame, model: WordModel, text: str = "text", out: str = "input_ids", least_hot: int = LEAST_HOT
) -> DataFrame:
    """Replace ``text`` by the ids of its words, in order.

    The other columns are passed on. Rows form groups of some ``GROUP_BYTES``. The distinct words of each group meet the
    dictionary, in a join that deals frequent ones over salts where there are many groups; then a
    group's rows meet the ids of its words in one task. A row without words has an empty list.
    """
    keys = [c for c in docs.columns if c != text]
    if not keys:
        raise ValueError("a key column is needed next to the text")
    joined = F.array_join(whitespace_pieces(text), " ").alias("__words")  # words hold no blank
    # Written with its group: a group must not change between two readings.
    rows = stage(_in_groups(spread(docs).select(*keys, joined)), "split")
    used = rows.select(F.col("__group").alias("__in"), F.explode(F.split("__words", " ")).alias("__piece")).where("__piece <> ''").distinct()
    ids = model.vocab.select(F.col("piece").alias("__piece"), F.col("id").alias("__id"))
    # A word has at most a row for each group.
    if rows.select("__group").distinct().count() > least_hot:
        met = salted_join(stage(used, "used"), ids, ["__piece"], "inner", least_hot)
    else:
        met = used.join(ids, "__piece")
    unknown = model.unk_id

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = left.column("__words").combine_chunks()
        joined = pc.if_else(pc.equal(joined, ""), pa.scalar(None, joined.type), joined)
        lists = pc.split_pattern(joined, " ")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        at = pc.index_in(lists.flatten(), right.column("__piece").combine_chunks())
        found = pc.fill_null(right.column("__id").combine_chunks().take(at), unknown)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return left.select(keys).append_column(out, pa.ListArray.from_arrays(ends, found))

    schema = StructType([*docs.select(*keys).schema.fields, StructField(out, ArrayType(IntegerType()))])
    by_group = met.select("__in", "__piece", "__id").groupBy("__in")
    return rows.groupBy("__group").cogroup(by_group).applyInArrow(look_up, schema)
