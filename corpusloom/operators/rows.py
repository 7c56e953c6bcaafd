"""Projections, row filters, caps and holdouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import dense_ordinal

# Largest row count for which a key list may be broadcast: 100,000 two-column keys.
BROADCAST_ROWS = 100_000

# A character that is not white space. The four separators U+001C to U+001F count as
# white space for text but not for the regular expression class.
NOT_BLANK = r"(?U)[^\s\x1C-\x1F]"


def keep_columns(df: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """Keep the named columns, so that differing sources union cleanly."""
    require_columns(df, columns)
    return df.select(*columns)


def require_columns(df: DataFrame, columns: Sequence[str] = ("input_ids", "attention_mask")) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def has_text(text: str | Column = "text") -> Column:
    """True for a non-null text with at least one non-white-space character."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.rlike(NOT_BLANK), F.lit(False))


def filter_valid_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(has_text(text))


def filter_nonempty(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Drop rows whose token list is null or empty."""
    return df.where(F.coalesce(F.size(ids), F.lit(0)) > 0)


def add_labels(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """``labels`` repeats ``input_ids``; existing labels stay."""
    return df if "labels" in df.columns else df.withColumn("labels", F.col(ids))


def cap_documents(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` documents by a dense position: a filter, no sort."""
    return df.where(F.col(pos) < n)


def cap_total_across_sources(
    df: DataFrame, n: int, src: str = "src_ord", order: str = "doc_ord"
) -> DataFrame:
    """Sources in turn take what is left of the budget of ``n`` documents.

    That is the first ``n`` rows of the concatenation, so its ordinal decides.
    """
    return (
        dense_ordinal(df, order, lead=[src], out="__total")
        .where(F.col("__total") < n)
        .drop("__total")
    )


def first_n_per_file(df: DataFrame, n: int, row_index: str = "row_index") -> DataFrame:
    """Cap each file on its own, by the row number stored with the scan."""
    return df.where(F.col(row_index) < n)


def holdout(
    df: DataFrame, n: int = 1000, order: Sequence[str] = ("ord",), overlap: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(train, eval)``; eval is the first ``n`` rows.

    Train keeps those rows unless ``overlap`` is false. The order columns must identify
    a row.
    """
    keys = list(order)
    held = df.orderBy(*keys).limit(n)
    if overlap:
        return df, held
    taken = held.select(*keys)
    if n <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    return df.join(taken, keys, "left_anti"), held


def holdout_by_ordinal(
    df: DataFrame, n: int = 1000, ord: str = "ord", overlap: bool = True
) -> tuple[DataFrame, DataFrame]:
    """As ``holdout`` for rows that already carry a dense ordinal: two filters."""
    train = df if overlap else df.where(F.col(ord) >= n)
    return train, df.where(F.col(ord) < n)


def preview(df: DataFrame, k: int = 5, order: Sequence[str] = ("ord",), ids: str = "input_ids") -> DataFrame:
    """The first ``k`` rows with the lengths of their token lists."""
    return (
        df.orderBy(*order).limit(k).select(*order, F.size(ids).alias("input_ids_len"))
    )


def exclude_committed(df: DataFrame, committed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not yet in the committed output."""
    return df.join(committed.select(*keys), list(keys), "left_anti")
