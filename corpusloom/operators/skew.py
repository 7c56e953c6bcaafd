"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key of more rows than this, and than a ``SHARE``-th of the table, is dealt over salts.
LEAST_HOT = 100_000
SHARE = 1_000


def salted_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", least_hot: int = LEAST_HOT
) -> DataFrame:
    """``rows`` joined by ``how`` (left or inner) with ``table``; hot keys of ``rows`` are split.

    ``table`` should hold few rows for each key. One aggregation counts the rows of each key. Those
    of a hot key are dealt by a hash of all their columns over as many salts as the key holds
    measures, and its rows of ``table`` are repeated for each salt; all other keys meet once. At
    most ``SHARE`` keys can be hot, so their list is broadcast. ``rows`` is read twice: pass a
    written table or a cheap plan. Null keys match nothing and are dealt over all tasks.
    """
    on = list(on)
    spark = rows.sparkSession
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    measure = max(least_hot, total // SHARE)
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    hot = counts.where(known).where(F.col("__n") > measure)
    hot = hot.select(*on, F.ceil(F.col("__n") / measure).cast("int").alias("__of"))
    found = hot.limit(SHARE + 1).collect()  # a key above the measure holds a SHARE-th of all rows
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__of", F.when(F.expr(known), 1).otherwise(wide))).cast("int")
    if found:
        listed = spark.createDataFrame(found, hot.schema)
        salted = rows.join(F.broadcast(listed), on, "left").withColumn("__salt", dealt).drop("__of")
        copies = table.join(F.broadcast(listed), on, "left")
        copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__of", F.lit(1)) - 1))).drop("__of")
    else:
        salted = rows.withColumn("__of", F.lit(None).cast("int")).withColumn("__salt", dealt).drop("__of")
        copies = table.withColumn("__salt", F.lit(0))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
