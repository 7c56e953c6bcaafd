"""Proportional stratified interleaving into shards, from built-in expressions only.

Rows are shuffled within their source by a seeded hash of the id and ranked. Row ``r`` of ``n``
of a source stands at ``(r - 1/2) / n`` of the whole; sorting all rows by that place and cutting
into equal counts gives every shard the mixture of the table, to within one row or two a source.

No window group grows with a source: ranks come from row numbers inside 4,096 hash buckets a
source plus running totals over bucket counts, the global place from row numbers inside 4,096
buckets of the place plus running totals. Texts are read once, for size and checksum, and never
shuffled.

Defined cases: null text has no bytes and checksum 0; a null source is a source of its own; a
null id hashes as the empty string. Equal ids are ordered by size and checksum, rows equal in
these too take their slots in any order. Sources of one row, empty tables and shards that get
no row are fine; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BUCKETS = 4096
OVERHEAD_BYTES = 16


def _bucket_of_hash(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def running_number(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Row number over ``group`` by bucket, then ``order``: bucket row numbers plus running totals."""
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_rn", F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)))
    return inside.join(offsets, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_rn")).drop("_before", "_rn")


def assign_shards(
    docs: DataFrame,
    shards: int,
    seed: str = "1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot``; counts of any two shards differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("_source"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_key"),
    ).withColumn("_bucket", _bucket_of_hash(F.col("_key")))
    ties = [F.col(c) for c in ("_key", "doc_id", "size", "text_crc32")]
    ranked = running_number(light, ["_source"], "_bucket", ties, "_rank")
    totals = light.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked.join(totals, "_source").withColumn("_place", (F.col("_rank") - 0.5) / F.col("_n"))
    placed = placed.withColumn("_all", F.lit(0)).withColumn("_slice", F.floor(F.col("_place") * BUCKETS))
    numbered = running_number(placed, ["_all"], "_slice", [F.col("_place"), F.col("_source"), *ties], "_at")
    total = light.agg(F.count(F.lit(1)).alias("_total"))
    shard = F.floor((F.col("_at") - 1) * shards / F.col("_total"))
    first = F.ceil(F.col("shard") * F.col("_total") / shards)
    return (
        numbered.crossJoin(F.broadcast(total))  # one row
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_at") - 1 - first).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )


def op7_stratified_interleave(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = assign_shards(docs, 40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


# The same rows in plain SQL. The checksum is worked out byte by byte from its polynomial.
SQL = """
WITH steps AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5('1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), h AS (
  SELECT *, hex(encode(text)) AS hx FROM d
), l AS (
  SELECT doc_id, source, key, octet_length(encode(text)) + 16 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(hx) // 2),
      lambda i: ('0x' || substr(hx, (2 * i + 1)::INT, 2))::BIGINT),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM h, steps
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, text_crc32) AS rank,
    count(*) OVER (PARTITION BY source) AS n FROM l
), p AS (
  SELECT *, row_number() OVER (ORDER BY (rank - 0.5::DOUBLE) / n, 's' || source NULLS FIRST, key, doc_id, size, text_crc32) AS pos,
    count(*) OVER () AS total FROM r
), c AS (SELECT *, CAST(floor((pos - 1) * 40 / total) AS INT) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard,
  CAST(pos - 1 - ceil(shard * total / 40) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source
FROM c
"""
