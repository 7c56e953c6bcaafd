"""Keep or drop the documents of a list of ids without moving texts where the list is short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage

BROADCAST_IDS = 1_000_000


def matching(docs: DataFrame, ids: DataFrame, how: str, rows: int | None = None) -> DataFrame:
    """``docs`` joined by ``how`` (left_semi or left_anti) with ``ids(doc_id)``.

    The list is written and counted. Up to ``BROADCAST_IDS`` ids, some 16 MB, it goes to every
    task; beyond that both sides are shuffled. ``rows`` is a bound on their number, if one is known.
    """
    ids = stage(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "ids", rows)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how).select(*docs.columns)
