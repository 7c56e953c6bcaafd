"""Loading prepared data for training: ``(train, eval)`` from one of three origins."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.rows import add_labels, holdout, require_columns
from corpusloom.plans.pretokenize import PretokenizeOptions, pretokenize
from corpusloom.sources.files import read_files_in_order, read_manifest, read_shards
from corpusloom.sources.materialize import DatasetCache
from corpusloom.sources.shards import has_progress, read_committed


def load_manifest(
    spark: SparkSession, path: str, cache: DatasetCache | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and eval rows of a manifest, with labels; kept in ``cache`` if there is one."""
    manifest = read_manifest(spark, path)
    name = md5(path.rstrip("/").encode()).hexdigest()  # manifests of one base name stay apart

    def build(files, first_n):
        rows = require_columns(read_files_in_order(spark, files, first_n=first_n))
        return add_labels(rows).drop("row_index")

    out = []
    for split, files, first_n in (
        ("train", manifest.train, None),
        ("eval", manifest.eval, manifest.eval_size),
    ):
        if cache is None:
            out.append(build(files, first_n))
        else:
            config = {"eval_size": first_n, "add_labels": True}
            key = f"{split}_{name}"
            out.append(cache.materialize(key, files, config, lambda: build(files, first_n)))
    return out[0], out[1]


def load_shards(
    spark: SparkSession, path: str, eval_rows: int = 1000, overlap: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A shard directory; eval is its first rows by file and row number."""
    # Where a progress table tells finished commits, files of others are not rows.
    rows = read_committed(spark, path) if has_progress(spark, path) else read_shards(spark, path)
    keys = [c for c in ("shard", "commit") if c in rows.columns]
    placed = require_columns(rows).select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    return holdout(placed, eval_rows, [*keys, "file", "row_index"], overlap)


def load_corpus(
    docs: DataFrame, block_size: int = 1024, eval_rows: int = 1000, overlap: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Documents tokenized on the fly: whole texts, no EOS, first-exhausted interleaving."""
    opts = PretokenizeOptions(
        block_size=block_size, interleave="first", truncate=None, eos_id=None
    )
    return holdout(add_labels(pretokenize(docs, opts)), eval_rows, ["batch_id", "block_ord"], overlap)
