"""User functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.pack import batch_of


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | StructType,
    batch_size: int = 1000,
    ordinal: str | None = None,
) -> DataFrame:
    """Call ``fn`` on batches of ``batch_size`` rows; it may give any number of rows.

    With a dense ``ordinal`` a batch is that many consecutive rows. Without it batches
    follow the partitions, which saves the shuffle for functions that work row by row; only
    the last one of a partition may be shorter.
    """
    if ordinal is not None:
        return df.groupBy(batch_of(ordinal, batch_size).alias("batch_id")).applyInPandas(
            lambda pdf: fn(pdf.sort_values(ordinal, ignore_index=True)), schema
        )

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in frames:
            while len(pdf):
                part, pdf = pdf.iloc[: batch_size - rows], pdf.iloc[batch_size - rows :]
                held.append(part)
                rows += len(part)
                if rows == batch_size:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, rows = [], 0
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(chunks, schema)


def filter_batches(
    df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str] | None = None
) -> DataFrame:
    """The rows for which ``keep``, called on Arrow batches, gives true; null counts as false.

    With ``columns`` only these go to Python, for the answer alone, so other columns of any
    type and size stay in the JVM. A predicate of built-in expressions belongs into ``where``.
    """
    sent = list(columns) if columns is not None else df.columns

    @F.pandas_udf("boolean")
    def answer(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(keep(rows), index=rows.index).fillna(False).astype(bool)

    return df.where(answer(F.struct(*[F.col(f"`{c}`") for c in sent])))
