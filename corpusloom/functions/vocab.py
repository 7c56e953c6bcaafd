"""Vocabulary tables ``(id, piece, kind)`` and lookups against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

# Ids and pieces of the reserved tokens. There is no BOS.
PAD, UNK, EOS = "<pad>", "<unk>", "<|endoftext|>"
PAD_ID, UNK_ID, EOS_ID = 0, 1, 2
RESERVED = (PAD, UNK, EOS)

# The special tokens a vocabulary asks for by default.
DEFAULT_SPECIAL_TOKENS = (
    "<|endoftext|>",
    "<unk>",
    "<pad>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|reserved_special_token_0|>",
    "<|reserved_special_token_1|>",
    "<|reserved_special_token_2|>",
    "<|reserved_special_token_3|>",
)

# Vocabularies up to this many pieces may be broadcast or brought to the driver.
MAX_VOCAB = 1 << 21

BYTES = 256


def user_symbols(special_tokens: Sequence[str] = DEFAULT_SPECIAL_TOKENS) -> list[str]:
    """The special tokens that need an id of their own, in order, once each."""
    return [t for t in dict.fromkeys(special_tokens) if t not in RESERVED]


def special_rows(spark: SparkSession, special_tokens: Sequence[str] = DEFAULT_SPECIAL_TOKENS) -> DataFrame:
    """Reserved tokens, then user symbols."""
    rows = [(i, p, "control") for i, p in enumerate(RESERVED)]
    rows += [(len(RESERVED) + i, p, "user") for i, p in enumerate(user_symbols(special_tokens))]
    return spark.createDataFrame(rows, "id int, piece string, kind string")


def byte_rows(spark: SparkSession, first_id: int) -> DataFrame:
    """``<0x00>`` to ``<0xFF>``."""
    b = F.col("id")
    return spark.range(BYTES).select(
        (b + first_id).cast("int").alias("id"),
        F.concat(F.lit("<0x"), F.lpad(F.hex(b), 2, "0"), F.lit(">")).alias("piece"),
        F.lit("byte").alias("kind"),
    )


def char_vocab(
    spark: SparkSession, chars: DataFrame, special_tokens: Sequence[str] = DEFAULT_SPECIAL_TOKENS
) -> DataFrame:
    """A vocabulary without merges: special tokens, bytes, covered characters.

    ``chars`` is ``(rank, ch, n)`` with ranks from 1.
    """
    first_byte = len(RESERVED) + len(user_symbols(special_tokens))
    pieces = chars.select(
        (F.col("rank") + (first_byte + BYTES - 1)).cast("int").alias("id"),
        F.col("ch").alias("piece"),
        F.lit("char").alias("kind"),
    )
    return (
        special_rows(spark, special_tokens).unionByName(byte_rows(spark, first_byte)).unionByName(pieces)
    )


def bounded(vocab: DataFrame, limit: int = MAX_VOCAB) -> DataFrame:
    """The vocabulary as a broadcast side if it has at most ``limit`` pieces."""
    return F.broadcast(vocab) if vocab.limit(limit + 1).count() <= limit else vocab


def piece_to_id(
    pieces: DataFrame, vocab: DataFrame, piece: str = "piece", out: str = "id", unk_id: int = UNK_ID
) -> DataFrame:
    """Look up ids; an unknown piece gives the unk id."""
    side = bounded(vocab.select(F.col("piece").alias(piece), F.col("id").alias("__id")))
    return pieces.join(side, piece, "left").withColumn(
        out, F.coalesce(F.col("__id"), F.lit(unk_id))
    ).drop("__id")


def id_to_piece(ids: DataFrame, vocab: DataFrame, id: str = "id", out: str = "piece") -> DataFrame:
    side = bounded(vocab.select(F.col("id").alias(id), F.col("piece").alias(out)))
    return ids.join(side, id, "left")


def special_token_table(requested: DataFrame, vocab: DataFrame) -> DataFrame:
    """Decoder entries ``(id, content, flags)`` of the requested tokens in the vocabulary."""
    known = vocab.where(F.col("id") != UNK_ID).unionByName(vocab.where(F.col("piece") == UNK))
    flag = {f: F.lit(f == "special") for f in ("lstrip", "normalized", "rstrip", "single_word", "special")}
    return (
        requested.select("piece")
        .distinct()
        .join(bounded(known.select("id", "piece")), "piece")
        .select("id", F.col("piece").alias("content"), *[c.alias(f) for f, c in flag.items()])
    )


def vocab_export(vocab: DataFrame, added: DataFrame) -> DataFrame:
    """``(piece, id)`` of a vocabulary with added tokens; the added entry wins."""
    both = vocab.select("piece", "id", F.lit(0).alias("turn")).unionByName(
        added.select("piece", "id", F.lit(1).alias("turn"))
    )
    return both.groupBy("piece").agg(F.max_by("id", F.struct("turn", "id")).alias("id"))


def rank_pieces(counts: DataFrame, piece: str, n: str, size: int, first_id: int) -> DataFrame:
    """The ``size`` most frequent pieces with ids from ``first_id``."""
    top = counts.orderBy(F.desc(n), piece).limit(size)
    order = W.orderBy(F.desc(n), piece)  # at most ``size`` rows
    return top.select(
        (F.row_number().over(order) + (first_id - 1)).alias("id"), F.col(piece).alias("piece")
    )


def special_ids(requested: DataFrame) -> DataFrame:
    """Reserved tokens and, after them, the requested ones that are not reserved.

    ``requested`` is a short table ``(piece)``; its pieces take ids in their own order.
    """
    spark = requested.sparkSession
    reserved = special_rows(spark, ())
    fresh = requested.select("piece").distinct().join(F.broadcast(reserved), "piece", "left_anti")
    order = W.orderBy("piece")  # a vocabulary's worth of rows at most
    return reserved.unionByName(
        fresh.select(
            (F.row_number().over(order) + (len(RESERVED) - 1)).alias("id"),
            "piece",
            F.lit("user").alias("kind"),
        )
    )


def byte_usage(byte_pieces: DataFrame, counts: DataFrame, covered: DataFrame) -> DataFrame:
    """``(id, piece, n)``: bytes needed for the characters that are not covered."""
    outside = counts.join(covered.select("ch"), "ch", "left_anti")
    hexes = F.regexp_extract_all(F.hex(F.encode("ch", "UTF-8")), F.lit("(..)"), F.lit(1))
    used = (
        outside.select(F.explode(hexes).alias("h"), "n")
        .groupBy(F.concat(F.lit("<0x"), "h", F.lit(">")).alias("piece"))
        .agg(F.sum("n").alias("n"))
    )
    return byte_pieces.join(used, "piece", "left").select(
        "id", "piece", F.coalesce("n", F.lit(0)).alias("n")
    )
