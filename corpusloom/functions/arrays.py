"""Index and label arithmetic on token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shift_inputs(ids: str | Column) -> Column:
    """All ids but the last."""
    c = _col(ids)
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def shift_targets(ids: str | Column) -> Column:
    """All ids but the first."""
    c = _col(ids)
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def position_ids(ids: str | Column, offset: int = 0) -> Column:
    n = F.size(_col(ids))
    run = F.sequence(F.lit(offset), F.lit(offset) + n - 1)
    return F.when(n > 0, run).otherwise(F.array().cast("array<int>"))


def last_non_pad_index(ids: str | Column, pad_id: int | None) -> Column:
    """Index of the right-most id that is not padding, 0 if all are.

    Without a pad id it is the last position.
    """
    c = _col(ids)
    if pad_id is None:
        return F.size(c) - 1
    return F.array_max(F.transform(c, lambda x, i: F.when(x != pad_id, i).otherwise(0)))


def clamp_span(position: str | Column, length: str | Column) -> Column:
    """Clamp a span end to ``[0, length]``; the value ``length`` means 'ignore'."""
    return F.greatest(F.lit(0), F.least(_col(position), _col(length)))


def span_ignored(position: str | Column, length: str | Column) -> Column:
    return clamp_span(position, length) == _col(length)


def infer_problem_type(num_labels: str | Column, integer_labels: str | Column) -> Column:
    """One label is a regression, several integer ones a single choice, else many."""
    return (
        F.when(_col(num_labels) == 1, "regression")
        .when(_col(integer_labels), "single_label_classification")
        .otherwise("multi_label_classification")
    )
