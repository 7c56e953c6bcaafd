"""Language codes to corpora."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.mix import concat_sources
from corpusloom.sources.files import path_exists, read_files_in_order

# Deprecated language codes and what they stand for.
LANGUAGE_ALIASES = {"zh": "cn"}


@dataclass(frozen=True)
class Source:
    """Where the corpus of one language lies, and a filter if others share it.

    ``key`` names a numeric order key. With ``key=None`` documents keep the order of their
    files, by name, and rows, which Parquet alone can tell.
    """

    path: str
    where: str | None = None
    text: str = "text"
    key: str | None = "doc_id"
    format: str = "parquet"
    schema: StructType | str | None = None


def resolve_language(catalog: Mapping[str, Source], lang: str) -> str:
    if lang in LANGUAGE_ALIASES:
        target = LANGUAGE_ALIASES[lang]
        warnings.warn(f"language code {lang!r} is deprecated, using {target!r}", stacklevel=2)
        lang = target
    if lang not in catalog:
        raise ValueError(f"unsupported language: {lang}")
    return lang


def read_corpus(
    spark: SparkSession,
    catalog: Mapping[str, Source],
    lang: str,
    streaming: bool = False,
    schema: StructType | str | None = None,
) -> DataFrame:
    """``(doc_ord, lang, text)`` of one language, as a batch or a stream.

    The language filter and the two columns reach the scan. ``schema`` goes before that of
    the source; a stream without either takes the schema of the files that are there.
    """
    lang = resolve_language(catalog, lang)
    source = catalog[lang]
    schema = schema or source.schema
    if source.key is None:
        df = _by_file_and_row(spark, source, streaming, schema)
    elif streaming:
        if schema is None:
            schema = spark.read.format(source.format).load(source.path).schema
        reader = spark.readStream.format(source.format).schema(schema)
        if source.format == "parquet":
            reader = reader.option("pathGlobFilter", "*.parquet")
        df = reader.load(source.path)
    else:
        reader = spark.read.format(source.format)
        df = (reader.schema(schema) if schema is not None else reader).load(source.path)
    if source.where:
        df = df.where(source.where)
    return df.select(
        F.col(source.key or "ord").cast("bigint").alias("doc_ord"),
        F.lit(lang).alias("lang"),
        F.col(source.text).alias("text"),
    )


def _by_file_and_row(spark: SparkSession, source: Source, streaming: bool, schema) -> DataFrame:
    """The rows with ``ord``, their number over all files of the source."""
    if streaming or source.format != "parquet":
        raise ValueError("a source without a key must be a batch of Parquet files")
    reader = spark.read if schema is None else spark.read.schema(schema)
    found = sorted(reader.parquet(source.path).inputFiles())
    taken = {"ord", "row_index", "file_ord"}
    columns = [c for c in reader.parquet(source.path).columns if c == source.text or c not in taken]
    return read_files_in_order(spark, found, columns, schema=schema)


def read_corpora(
    spark: SparkSession,
    catalog: Mapping[str, Source],
    langs: Sequence[str],
    on_missing: str = "skip",
    streaming: bool = False,
) -> DataFrame:
    """``(src_ord, doc_ord, lang, text)`` of several languages, numbered in list order.

    An unknown code is an error. A known language without data is skipped with a warning
    (or an error with ``on_missing="error"``); no language left is an error. With
    ``streaming`` the result is one stream over all of them.
    """
    frames = []
    for lang in langs:
        code = resolve_language(catalog, lang)
        if not path_exists(spark, catalog[code].path):
            if on_missing == "error":
                raise FileNotFoundError(catalog[code].path)
            warnings.warn(f"no data for language {code!r}, skipped", stacklevel=2)
            continue
        frames.append(read_corpus(spark, catalog, code, streaming))
    if not frames:
        raise ValueError("no corpus could be read")
    return concat_sources(frames).select("src_ord", "doc_ord", "lang", "text")
