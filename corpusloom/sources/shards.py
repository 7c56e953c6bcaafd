"""Capped, resumable Parquet shards.

A run is a series of commits. Commit ``c`` writes ``commit=c/shard=i/`` and then one row
of the progress table. Readers take the commits of the progress table, so files of a
commit that never finished are not seen, and the next attempt overwrites them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.order import LIGHT_BITS, measure_key_bits, running_total
from corpusloom.operators.rows import require_columns
from corpusloom.session import stage
from corpusloom.sources.files import path_exists

MAX_SAMPLES_PER_SHARD = 200_000
SAVE_BATCH_SIZE = 100_000
# Rows that a task of a commit should write at least, and bytes of stored blocks at most.
PART_ROWS = 1 << 10
PART_BYTES = 4 << 20
# Bits of the largest batch number up to which each task gets the numbers of all batches.
BROADCAST_BITS = 20
PROGRESS_SCHEMA = (
    "commit bigint, lang string, rows bigint, rows_done bigint, shard int, "
    "rows_in_shard bigint, done boolean"
)
# The log keeps, besides, which stream wrote a commit and from which of its micro-batches.
LOG_SCHEMA = f"{PROGRESS_SCHEMA}, writer string, micro_batch bigint"


def block_ordinal(
    blocks: DataFrame,
    batch: str = "batch_id",
    block: str = "block_ord",
    out: str = "ord",
    counts: DataFrame | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Dense ordinal over blocks: blocks of the earlier batches plus the own number.

    Only one light row per batch is summed up. The blocks are read several times, so they
    should be staged. Numbers of up to ``2^BROADCAST_BITS`` batches are sent to the blocks, which then
    stay where they are; Spark itself would take the numbers to be as large as the blocks.
    Where ``counts``, the blocks ``__n`` of each batch, and the ``bits`` of its numbers are known, the blocks are read once.
    """
    if counts is None:
        counts = blocks.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"))
    bits = measure_key_bits(blocks, batch) if bits is None else bits
    bases = running_total(counts, F.col("__n"), batch, out="__base", row_bits=LIGHT_BITS, key_bits=bits)
    bases = bases.select(batch, "__base")
    bases = F.broadcast(bases) if bits <= BROADCAST_BITS else bases
    return blocks.join(bases, batch).withColumn(out, F.col("__base") + F.col(block)).drop("__base")


def assign_shard(df: DataFrame, max_samples: int, ord: str = "ord", start: int = 0) -> DataFrame:
    """Shard ``i`` holds the ordinals from ``i * max_samples`` up to the next shard's."""
    return df.withColumn(
        "shard", F.expr(f"cast((`{ord}` + {int(start)}) div {int(max_samples)} as int)")
    )


def _stored(df: DataFrame) -> DataFrame:
    """Shards hold the ids and the mask as 64-bit integers."""
    return require_columns(df).withColumns(
        {c: F.col(c).cast("array<bigint>") for c in ("input_ids", "attention_mask")}
    )


def _write(df: DataFrame, path: str, max_samples: int, ord: str, start: int, ranged: bool = False, span: tuple[int, int, int] | None = None) -> None:
    # By ranges of the ordinal: a shard may take several tasks, whose files follow one another.
    rows = assign_shard(require_columns(df), max_samples, ord, start).select("shard", ord, "input_ids", "attention_mask")
    if span is not None:  # ordinals from the first to before the second, in so many parts of one size
        low, high, parts = map(int, span)
        rows = rows.repartitionById(parts, F.expr(f"cast((`{ord}` - {low}) * {parts} div {high - low} as int)"))
    elif not ranged:
        rows = rows.repartitionByRange(ord)
    moved = rows.sortWithinPartitions("shard", ord).drop(ord)
    (
        _stored(moved)  # widened after the shuffle
        .write.mode("overwrite")
        .partitionBy("shard")
        .option("compression", "snappy")
        .parquet(path)
    )


def write_shards(
    blocks: DataFrame,
    path: str,
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    ord: str = "ord",
    lang: str = "all",
    resume: bool = False,
    done: bool = True,
    ranged: bool = False,
) -> DataFrame:
    """Write blocks with a dense ordinal as one commit; gives the progress table.

    A fresh run needs a path without progress. With ``resume`` the rows below the
    committed count are skipped, so an interrupted run ends up as an undisturbed one.
    ``ranged`` blocks already lie in partitions by ranges of the ordinal and are written where they are.
    """
    spark = blocks.sparkSession
    if not resume and has_progress(spark, path):
        raise FileExistsError(f"{path} holds shards already; pass resume=True to go on")
    if resume and lang in finished_languages(spark, path):
        return progress(spark, path)
    in_lang, total = _rows_done(spark, path, lang)
    rest = blocks.where(F.col(ord) >= in_lang)
    return _commit(rest, path, max_samples, ord, lang, total - in_lang, total, done, ranged=ranged)


def append_shards(
    blocks: DataFrame,
    path: str,
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    ord: str = "ord",
    lang: str = "all",
    done: bool = True,
) -> DataFrame:
    """Add rows after the committed ones: the partial shard is filled up by new files."""
    spark = blocks.sparkSession
    _, total = _rows_done(spark, path, lang)
    return _commit(blocks, path, max_samples, ord, lang, total, total, done)


def commit_once(
    blocks: DataFrame,
    path: str,
    micro_batch: int,
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    ord: str = "ord",
    writer: str = "stream",
    done: bool = False,
    ranged: bool = False,
) -> DataFrame:
    """Append the blocks of a stream's micro-batch once; a repeated call does nothing.

    The log tells the micro-batches of each ``writer`` apart, so other commits in the same
    directory, of batch runs or other streams, do not matter. ``ranged`` blocks already lie in partitions by
    ranges of the ordinal and are written where they are.
    """
    spark = blocks.sparkSession
    mine = (F.col("writer") == writer) & (F.col("micro_batch") == micro_batch)
    if _log_rows(spark, path).where(mine).limit(1).count():
        return progress(spark, path)
    _, total = _rows_done(spark, path, "all")
    return _commit(blocks, path, max_samples, ord, "all", total, total, done, (writer, micro_batch), ranged)


def _commit(df, path, max_samples, ord, lang, start, total, done, origin=(None, None), ranged=False, span=None) -> DataFrame:
    spark = df.sparkSession
    number = _next_commit(spark, path)
    target = f"{path}/commit={number}"
    _write(df, target, max_samples, ord, start, ranged, span)
    rows = _count_rows(spark, target)
    now = total + rows
    entry = (number, lang, rows, now, int(now // max_samples), now % max_samples, done, *origin)
    _log(spark, path, entry)
    return progress(spark, path)


def write_incremental(
    blocks: DataFrame,
    path: str,
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    save_every: int = SAVE_BATCH_SIZE,
    ord: str = "ord",
    lang: str = "all",
    resume: bool = False,
    max_commits: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Commit every ``save_every`` rows, which bounds the work a failure loses.

    The blocks are staged once, sorted by ordinal, so that each commit reads its own
    key range. ``stored`` blocks are a table in that order already, with ordinals from 0 without a gap; they are read as they are,
    and a commit moves its rows to parts of one size. ``max_commits`` stops a run early.
    """
    spark = blocks.sparkSession
    if not resume and has_progress(spark, path):
        raise FileExistsError(f"{path} holds shards already; pass resume=True to go on")
    if lang in finished_languages(spark, path):
        return progress(spark, path)
    staged = blocks.select(ord, "input_ids", "attention_mask")
    if not stored:
        staged = stage(staged.repartitionByRange(ord).sortWithinPartitions(ord), "blocks")
    n = staged.count()
    size = int(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    in_lang, total = _rows_done(spark, path, lang)
    offset, commits = total - in_lang, 0
    while in_lang < n or commits == 0:
        if max_commits is not None and commits >= max_commits:
            break
        upto = min(n, in_lang + save_every)
        part = staged.where((F.col(ord) >= in_lang) & (F.col(ord) < upto))
        rows, span = upto - in_lang, None
        if stored and rows:
            span = in_lang, upto, max(min(cores, -(-rows // PART_ROWS)), -(-size * rows // (n * PART_BYTES)))
        _commit(part, path, max_samples, ord, lang, offset, offset + in_lang, upto == n, span=span)
        in_lang, commits = upto, commits + 1
    return progress(spark, path)


def write_unordered(blocks: DataFrame, path: str, max_samples: int = MAX_SAMPLES_PER_SHARD) -> None:
    """The fast form without a defined shard order: no shuffle, files capped in rows."""
    _stored(blocks).select("input_ids", "attention_mask").write.mode("errorifexists").option(
        "maxRecordsPerFile", max_samples
    ).option("compression", "snappy").parquet(path)


def write_languages(
    sources: Iterable[tuple[str, DataFrame]],
    path: str,
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    ord: str = "ord",
    resume: bool = False,
) -> DataFrame | None:
    """One commit per language, in turn; with ``resume`` finished languages are skipped.

    Ordinals run on over the languages, so no shard goes over its cap.
    """
    table = None
    for i, (lang, blocks) in enumerate(sources):
        table = write_shards(blocks, path, max_samples, ord, lang, resume=resume or i > 0)
    return table


# Progress table


def _log_path(path: str) -> str:
    return f"{path}/_progress"


def has_progress(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, _log_path(path))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit."""
    return _log_rows(spark, path).drop("writer", "micro_batch")


def _log_rows(spark: SparkSession, path: str) -> DataFrame:
    if not has_progress(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(_log_path(path))


def _log(spark: SparkSession, path: str, entry: tuple) -> None:
    spark.createDataFrame([entry], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
        _log_path(path)
    )


def _next_commit(spark: SparkSession, path: str) -> int:
    last = progress(spark, path).agg(F.max("commit")).head()[0]
    return 0 if last is None else last + 1


def _rows_done(spark: SparkSession, path: str, lang: str) -> tuple[int, int]:
    """Committed rows of the language, and of all."""
    row = progress(spark, path).agg(
        F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("rows"))), F.lit(0)),
        F.coalesce(F.sum("rows"), F.lit(0)),
    ).head()
    return int(row[0]), int(row[1])


def finished_languages(spark: SparkSession, path: str) -> list[str]:
    rows = progress(spark, path).where("done").select("lang").distinct().collect()
    return sorted(r[0] for r in rows)


def commits_by_writer(spark: SparkSession, path: str) -> dict[str, int]:
    """How many numbered commits each writer has made; one entry per writer."""
    rows = _log_rows(spark, path).where("writer IS NOT NULL").groupBy("writer").agg(F.countDistinct("micro_batch"))
    return {r[0]: r[1] for r in rows.collect()}


def _count_rows(spark: SparkSession, path: str) -> int:
    """Row count from the file footers."""
    return spark.read.schema("input_ids array<bigint>").parquet(path).count()


def progress_by_language(entries: DataFrame) -> DataFrame:
    """Where each language stands: the latest commit of each, and its rows."""
    return entries.groupBy("lang").agg(
        F.sum("rows").alias("rows_done"),
        F.max_by("shard", "commit").alias("shard"),
        F.max_by("rows_in_shard", "commit").alias("rows_in_shard"),
        F.max_by("done", "commit").alias("done"),
    )


def progress_rows(
    counts: DataFrame, max_samples: int, lang: str = "lang", order: str = "src_ord", rows: str = "rows"
) -> DataFrame:
    """The progress table a finished run over ``counts`` (one row per language) leaves."""
    upto = running_total(counts, F.col(rows), order, out="__before")
    total = F.col("__before") + F.col(rows)
    return upto.select(
        F.col(order),
        F.col(lang),
        F.col(rows).alias("rows_done"),
        total.alias("rows_total"),
        F.floor(total / max_samples).cast("int").alias("shard"),
        (total % max_samples).alias("rows_in_shard"),
    )


# Reading back


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of finished commits, with their ``commit`` and ``shard``."""
    last = progress(spark, path).agg(F.max("commit")).head()[0]
    if last is None:
        raise FileNotFoundError(f"no committed shards in {path}")
    # Commits are numbered without a gap; partition pruning leaves a later one out.
    schema = "input_ids array<bigint>, attention_mask array<bigint>, commit bigint, shard int"
    return spark.read.schema(schema).parquet(path).where(F.col("commit") <= last)


# Sidecar


def dataset_info(blocks: DataFrame, ids: Sequence[str] = ("input_ids", "attention_mask")) -> DataFrame:
    """One row: format, number of examples, and the row shape of each column."""
    stats = [F.count(F.lit(1)).alias("num_examples")]
    for c in ids:
        stats += [F.min(F.size(c)).alias(f"{c}_min"), F.max(F.size(c)).alias(f"{c}_max")]
    return blocks.agg(*stats).select(F.lit("parquet").alias("format"), F.lit("train").alias("split"), "*")


def write_dataset_info(blocks: DataFrame, path: str) -> None:
    dataset_info(blocks).coalesce(1).write.mode("overwrite").json(f"{path}/_dataset_info")
