"""Every operator as a query over the given tables, with the same result in plain SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from corpusloom.functions import arrays, bpe, tokens, vocab, words as word_ids
from corpusloom.functions.batches import filter_batches, map_batches
from corpusloom.operators import mix, pack, rows, sizing
from corpusloom.operators.order import dense_ordinal
from corpusloom.plans.loading import load_shards
from corpusloom.plans.pretokenize import (
    PretokenizeOptions,
    order_documents,
    pretokenize,
    pretokenize_by_language,
    pretokenize_numbered,
    pretokenize_to_shards,
    tokenize_documents,
)
from corpusloom.session import scratch_path, spread, stage
from corpusloom.sources import catalog, files, listed, materialize, shards
from corpusloom.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


# Shared inputs

LANGS = ("en", "fr", "de", "es")
BLOCK, BATCH = 128, 100
SHARD = 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def src_ord() -> Column:
    """Place of the language in the list; -1 for one that is not in it."""
    place = F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang"))
    return F.coalesce(place - 1, F.lit(-1)).cast("int")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(src_ord, doc_ord, lang, text)`` in one scan."""
    return table(spark, sf, "documents").select(
        src_ord().alias("src_ord"), F.col("doc_id").alias("doc_ord"), "lang", "text"
    )


def language_catalog(sf: str) -> dict[str, catalog.Source]:
    path = f"{sf}/documents.parquet"
    known = {lang: catalog.Source(path, f"lang = '{lang}'") for lang in LANGS}
    return known | {"ja": catalog.Source(f"{sf}/documents_ja.parquet")}


def ids_md5(ids: str | Column) -> Column:
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.array_join(col.cast("array<string>"), " "))


def text_md5(text: str | Column = "text") -> Column:
    return F.md5(F.col(text) if isinstance(text, str) else text)


def big(c: Column) -> Column:
    return c.cast("bigint")


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as code points, closed with EOS."""
    return spread(documents(spark, sf)).select(
        "src_ord", "doc_ord", "lang", tokens.tokenize("text", eos_id=tokens.EOS_ID).alias("input_ids")
    )


WHOLE = PretokenizeOptions(block_size=BLOCK, batch_size=BATCH, truncate=None)


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return pretokenize(documents(spark, sf), WHOLE)


def numbered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return shards.block_ordinal(stage(blocks_of(spark, sf), "blocks"))


def stored_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered blocks as a table in the order of their ordinal, written once; their masks are made when they are read."""
    numbered = pretokenize_numbered(documents(spark, sf), WHOLE)
    stored = stage(numbered.drop("attention_mask"), "numbered")
    return stored.withColumn("attention_mask", tokens.attention_mask("input_ids"))


def block_out(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, big(F.size("input_ids")).alias("n_tokens"), ids_md5("input_ids").alias("ids_md5"))


# Shared SQL

_PLACE = "list_position(['en','fr','de','es'], lang) - 1"
_D = f"d AS (SELECT CAST({_PLACE} AS INT) AS src_ord, doc_id AS doc_ord, lang, text FROM documents)"
_CP = "list_transform(string_split({0}, ''), lambda c: unicode(c))"
_IDS = f"list_append({_CP.format('text')}, {tokens.EOS_ID})"
_MIX = (
    "r AS (SELECT *, row_number() OVER (PARTITION BY src_ord ORDER BY doc_ord) AS rn FROM d), "
    "m AS (SELECT *, row_number() OVER (ORDER BY rn, src_ord) - 1 AS pos FROM r)"
)


def _pack_sql(ids: str, batch: str, block: int = BLOCK, source: str = "m", by: str = "") -> str:
    """CTEs ``t``, ``p``, ``b``: tokens, their place in the batch, full blocks."""
    return (
        f"t AS (SELECT {by} ord, {batch} AS batch_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i "
        f"FROM (SELECT {by} pos AS ord, {ids} AS ids FROM {source})), "
        f"p AS (SELECT {by} batch_id, id, row_number() OVER (PARTITION BY {by} batch_id ORDER BY ord, i) - 1 AS place FROM t), "
        f"b AS (SELECT {by} batch_id, place // {block} AS block_ord, count(*) AS n_tokens, "
        "md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY place)) AS ids_md5 "
        f"FROM p GROUP BY {by} batch_id, place // {block} HAVING count(*) = {block})"
    )


_BLOCKS = f"WITH {_D}, {_MIX}, {_pack_sql(_IDS, f'ord // {BATCH}')}"
_NUMBERED = (
    f"{_BLOCKS}, o AS (SELECT *, row_number() OVER (ORDER BY batch_id, block_ord) - 1 AS ord FROM b)"
)


# Flow


@query(
    "pretokenize",
    f"""WITH {_D}, {_MIX}, {_pack_sql(_IDS, "ord // 1000", 1024)}
    SELECT batch_id, block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    return block_out(pretokenize(documents(spark, sf)), "batch_id", "block_ord")


@query(
    "pretokenize_by_language",
    f"""WITH {_D}, m AS (SELECT src_ord, text,
        row_number() OVER (PARTITION BY src_ord ORDER BY doc_ord) - 1 AS pos FROM d),
    {_pack_sql(_IDS, f"ord // {BATCH}", by="src_ord,")}
    SELECT src_ord, batch_id, block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    blocks = pretokenize_by_language(documents(spark, sf), WHOLE)
    return block_out(blocks, "src_ord", "batch_id", "block_ord")


# Sources


@query("read_corpus", "SELECT doc_id AS doc_ord, lang, md5(text) AS text_md5 FROM documents WHERE lang = 'en'")
def _(spark, sf):
    df = catalog.read_corpus(spark, language_catalog(sf), "en")
    return df.select("doc_ord", "lang", text_md5().alias("text_md5"))


def _web_catalog(sf: str) -> dict[str, catalog.Source]:
    """English documents, and pages, which are read without a key."""
    return {
        "en": catalog.Source(f"{sf}/documents.parquet", "lang = 'en'"),
        "web": catalog.Source(f"{sf}/pages.parquet", text="html", key=None),
    }


@query("read_corpus_by_row", "SELECT row_number() OVER (ORDER BY page_id) - 1 AS doc_ord, md5(html) AS text_md5 FROM pages")
def _(spark, sf):
    df = catalog.read_corpus(spark, _web_catalog(sf), "web")
    return df.select("doc_ord", text_md5().alias("text_md5"))


@query(
    "pretokenize_files",
    f"""WITH d AS (SELECT 0 AS src_ord, doc_id AS doc_ord, text FROM documents WHERE lang = 'en'
    UNION ALL SELECT 1, page_id, html FROM pages), {_MIX}, {_pack_sql(_IDS, f"ord // {BATCH}")}
    SELECT batch_id, block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    docs = catalog.read_corpora(spark, _web_catalog(sf), ["en", "web"])
    return block_out(pretokenize(docs, WHOLE), "batch_id", "block_ord")


@query(
    "read_corpora_skip",
    """SELECT CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS src_ord, doc_id AS doc_ord, lang,
    md5(text) AS text_md5 FROM documents WHERE lang IN ('fr', 'en')""",
)
def _(spark, sf):
    df = catalog.read_corpora(spark, language_catalog(sf), ["fr", "ja", "en"])
    return df.select("src_ord", "doc_ord", "lang", text_md5().alias("text_md5"))


@query("read_shards", f"{_BLOCKS} SELECT n_tokens, ids_md5 FROM b")
def _(spark, sf):
    path = scratch_path(spark, "shards")
    shards.write_unordered(blocks_of(spark, sf), path, SHARD)
    return block_out(files.read_shards(spark, path))


def _manifest(spark: SparkSession, sf: str) -> files.Manifest:
    """Write a manifest over two tables and read it back."""
    docs, bench = f"{sf}/documents.parquet", f"{sf}/benchmark.parquet"
    body = json.dumps({"train": [docs, bench], "eval": [bench, docs], "eval_size": 25})
    path = scratch_path(spark, "manifest")
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)
    return files.read_manifest(spark, path)


def _split_rows(spark: SparkSession, sf: str) -> DataFrame:
    train, held = files.read_manifest_splits(spark, _manifest(spark, sf), ["text"])
    return train.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("eval")))


_SPLITS = """WITH f AS (
    SELECT 'train' AS split, 0 AS file_ord, doc_id AS row_index, text FROM documents
    UNION ALL SELECT 'train', 1, item_id, text FROM benchmark
    UNION ALL SELECT 'eval', 0, item_id, text FROM benchmark WHERE item_id < 25
    UNION ALL SELECT 'eval', 1, doc_id, text FROM documents WHERE doc_id < 25)"""


@query(
    "manifest_split",
    f"""{_SPLITS} SELECT split, file_ord, row_index,
    row_number() OVER (PARTITION BY split ORDER BY file_ord, row_index) - 1 AS ord,
    md5(text) AS text_md5 FROM f""",
)
def _(spark, sf):
    return _split_rows(spark, sf).select(
        "split", "file_ord", "row_index", "ord", text_md5().alias("text_md5")
    )


@query("split_counts", f"{_SPLITS} SELECT split, count(*) AS rows FROM f GROUP BY split")
def _(spark, sf):
    return sizing.split_counts(_split_rows(spark, sf))


@query(
    "ordered_concat",
    """WITH f AS (SELECT 0 AS file_ord, item_id AS row_index, text FROM benchmark
    UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark)
    SELECT file_ord, row_number() OVER (ORDER BY file_ord, row_index) - 1 AS ord, md5(text) AS text_md5 FROM f""",
)
def _(spark, sf):
    bench, docs = f"{sf}/benchmark.parquet", f"{sf}/documents.parquet"
    df = files.read_files_in_order(spark, [bench, docs, bench], ["text"])
    return df.select("file_ord", "ord", text_md5().alias("text_md5"))


_LISTED = """SELECT 0 AS file_ord, item_id AS row_index, md5(text) AS text_md5 FROM benchmark
    UNION ALL SELECT 1, doc_id, md5(text) FROM documents UNION ALL SELECT 2, item_id, md5(text) FROM benchmark"""


def _listed_paths(sf: str) -> list[str]:
    return [f"{sf}/{name}.parquet" for name in ("benchmark", "documents", "benchmark")]


def _listed_out(df: DataFrame) -> DataFrame:
    return df.select("file_ord", "row_index", text_md5().alias("text_md5"))


@query("listed_files", _LISTED)
def _(spark, sf):
    return _listed_out(listed.read_listed(spark, _listed_paths(sf), ["text"]))


@query(
    "listed_first_n",
    f"SELECT * FROM ({_LISTED}) WHERE row_index < 30",
)
def _(spark, sf):
    return _listed_out(listed.read_listed(spark, _listed_paths(sf), ["text"], first_n=30))


@query("stream_listed", _LISTED)
def _(spark, sf):
    """The list grows by a file before each of three runs from one checkpoint."""
    path, ckpt, names = scratch_path(spark, "listed"), scratch_path(spark, "ckpt"), scratch_path(spark, "names")
    paths, schema = [files.real_path(spark, p) for p in _listed_paths(sf)], table(spark, sf, "documents").schema
    for n in range(1, len(paths) + 1):
        files.write_text(spark, names, "\n".join(paths[:n]))
        flows.run_to_files(listed.stream_listed(spark, names, schema, ["text"]), path, ckpt)
    return _listed_out(spark.read.parquet(path))


# Sinks and resumable state


@query(
    "shard_assign",
    f"""{_NUMBERED} SELECT CAST(ord // {SHARD} AS INT) AS shard, count(*) AS rows, min(ord) AS first_ord,
    max(ord) AS last_ord FROM o GROUP BY 1""",
)
def _(spark, sf):
    df = shards.assign_shard(numbered_blocks(spark, sf), SHARD)
    return df.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


_IN_SHARDS = f"{_NUMBERED} SELECT CAST(ord // {SHARD} AS INT) AS shard, n_tokens, ids_md5 FROM o"


@query("shard_write", _IN_SHARDS)
def _(spark, sf):
    path = scratch_path(spark, "shards")
    shards.write_shards(pretokenize_numbered(documents(spark, sf), WHOLE), path, SHARD, ranged=True)
    return block_out(shards.read_committed(spark, path), "shard")


@query("shard_incremental", _IN_SHARDS)
def _(spark, sf):
    """Stops after one commit, then resumes to the end."""
    path, blocks = scratch_path(spark, "shards"), stored_blocks(spark, sf)
    every = max(1, blocks.count() // 3)
    shards.write_incremental(blocks, path, SHARD, every, max_commits=1, stored=True)
    shards.write_incremental(blocks, path, SHARD, every, resume=True, stored=True)
    return block_out(shards.read_committed(spark, path), "shard")


@query("pretokenize_resume", _IN_SHARDS)
def _(spark, sf):
    """The run that saves as it goes: stopped after one commit, then resumed to the end."""
    path, docs = scratch_path(spark, "shards"), documents(spark, sf)
    every = max(1, docs.count() // BATCH // 3)
    pretokenize_to_shards(docs, path, WHOLE, SHARD, batches_per_commit=every, max_commits=1)
    pretokenize_to_shards(docs, path, WHOLE, SHARD, resume=True, batches_per_commit=every)
    return block_out(shards.read_committed(spark, path), "shard")


@query(
    "shard_append",
    f"""WITH {_D}, m AS (SELECT src_ord, text,
        row_number() OVER (PARTITION BY src_ord ORDER BY doc_ord) - 1 AS pos FROM d),
    {_pack_sql(_IDS, f"ord // {BATCH}", by="src_ord,")}
    SELECT CAST((row_number() OVER (ORDER BY src_ord, batch_id, block_ord) - 1) // {SHARD} AS INT) AS shard,
    n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    path = scratch_path(spark, "shards")
    blocks = stage(pretokenize_by_language(documents(spark, sf), WHOLE), "blocks")
    for i, lang in enumerate(LANGS):
        one = shards.block_ordinal(blocks.where(F.col("src_ord") == i))
        shards.append_shards(one, path, SHARD, lang=lang)
    return block_out(shards.read_committed(spark, path), "shard")


def _stream_into_shards(spark: SparkSession, blocks: DataFrame, path: str) -> None:
    """Blocks arrive in two steps; a stream that is started anew for each appends them."""
    source, ckpt = scratch_path(spark, "blocks"), scratch_path(spark, "ckpt")
    blocks = blocks.withColumnRenamed("ord", "at")
    bounds = blocks.agg(F.min("at"), F.max("at")).head()
    middle = sum(b or 0 for b in bounds) // 2
    for step in (F.col("at") <= middle, F.col("at") > middle):
        blocks.where(step).drop("attention_mask").write.mode("append").parquet(source)
        stream = files.read_stream(spark, source, blocks.drop("attention_mask").schema)
        stream = stream.withColumn("attention_mask", tokens.attention_mask("input_ids"))
        flows.run_batches(stream, flows.StreamShards(path, "at", SHARD), ckpt)


@query("stream_shards", _IN_SHARDS)
def _(spark, sf):
    path = scratch_path(spark, "shards")
    _stream_into_shards(spark, stored_blocks(spark, sf), path)
    return block_out(shards.read_committed(spark, path), "shard")


@query("stream_append_shards", _IN_SHARDS)
def _(spark, sf):
    """A stream into a directory that holds a batch run's commit already."""
    path = scratch_path(spark, "shards")
    blocks = stored_blocks(spark, sf)
    shards.write_shards(blocks.where(F.col("ord") < SHARD + 500), path, SHARD)
    _stream_into_shards(spark, blocks.where(F.col("ord") >= SHARD + 500), path)
    return block_out(shards.read_committed(spark, path), "shard")


@query("load_shards", _IN_SHARDS)
def _(spark, sf):
    """Loading leaves out the files of a commit that never finished."""
    path = scratch_path(spark, "shards")
    blocks = numbered_blocks(spark, sf)
    shards.write_shards(blocks, path, SHARD)
    blocks.where(F.col("ord") < 10).select("input_ids", "attention_mask").write.parquet(f"{path}/commit=1/shard=0")
    train, _ = load_shards(spark, path)
    return block_out(train, "shard")


@query(
    "progress_table",
    f"""WITH {_D}, c AS (SELECT src_ord, lang, count(*) AS rows FROM d GROUP BY 1, 2),
    t AS (SELECT *, CAST(sum(rows) OVER (ORDER BY src_ord) AS BIGINT) AS rows_total FROM c)
    SELECT src_ord, lang, rows AS rows_done, rows_total, CAST(rows_total // {SHARD} AS INT) AS shard,
    rows_total % {SHARD} AS rows_in_shard FROM t""",
)
def _(spark, sf):
    counts = documents(spark, sf).groupBy("src_ord", "lang").agg(F.count(F.lit(1)).alias("rows"))
    return shards.progress_rows(counts, SHARD)


@query(
    "resume_anti",
    f"""WITH {_D} SELECT src_ord, doc_ord, len({_IDS}) AS n_tokens FROM d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_ord)""",
)
def _(spark, sf):
    committed = table(spark, sf, "labels").select(F.col("doc_id").alias("doc_ord"))
    rest = rows.exclude_committed(documents(spark, sf), committed, ["doc_ord"])
    ids = tokens.tokenize("text", eos_id=tokens.EOS_ID)
    return rest.select("src_ord", "doc_ord", big(F.size(ids)).alias("n_tokens"))


@query(
    "dataset_info",
    f"""{_BLOCKS} SELECT 'parquet' AS format, 'train' AS split, count(*) AS num_examples,
    CAST(min(n_tokens) AS INT) AS input_ids_min, CAST(max(n_tokens) AS INT) AS input_ids_max,
    CAST(min(n_tokens) AS INT) AS attention_mask_min, CAST(max(n_tokens) AS INT) AS attention_mask_max FROM b""",
)
def _(spark, sf):
    return shards.dataset_info(blocks_of(spark, sf))


def _prepared(spark: SparkSession, sf: str) -> tuple[materialize.DatasetCache, DataFrame]:
    """Two prepared datasets, the first asked for twice; gives its second answer."""
    cache = materialize.DatasetCache(spark, scratch_path(spark, "cache"))
    answer = None
    for name, columns in (("documents", ["text"]), ("benchmark", ["text"]), ("documents", ["text"])):
        listed = [f"{sf}/{name}.parquet"]
        build = lambda: files.read_files_in_order(spark, listed, columns)
        answer = cache.materialize(name, listed, {"columns": columns}, build)
    return cache, answer


@query("materialize", "SELECT doc_id AS ord, md5(text) AS text_md5 FROM documents")
def _(spark, sf):
    return _prepared(spark, sf)[1].select("ord", text_md5().alias("text_md5"))


@query(
    "cache_info",
    """SELECT CAST(2 AS BIGINT) AS entries, CAST(2 AS BIGINT) AS files,
    (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS total_samples""",
)
def _(spark, sf):
    return _prepared(spark, sf)[0].info()


@query(
    "fingerprint",
    f"""WITH e AS (SELECT page_id AS place, concat_ws(':', url, strlen(html)) AS part FROM pages),
    a AS (SELECT CAST(floor(place / {materialize.CHUNK}) AS BIGINT) AS chunk, count(*) AS n,
      sha256(string_agg(part, chr(10) ORDER BY place, part)) AS part FROM e GROUP BY 1),
    b AS (SELECT CAST(floor(a.chunk / {materialize.CHUNK}) AS BIGINT) AS upper, sum(n) AS n,
      sha256(string_agg(part, chr(10) ORDER BY a.chunk)) AS part FROM a GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS entries,
      sha256(string_agg(part, chr(10) ORDER BY upper) || chr(10) || '{materialize.config_text({"block_size": BLOCK})}')
      AS fingerprint FROM b""",
)
def _(spark, sf):
    """Pages as the list of files: address and size, in the order of their ids."""
    entry = F.concat_ws(":", "url", F.octet_length("html").cast("string"))
    listed = table(spark, sf, "pages").select(F.col("page_id").alias("file_ord"), entry.alias("entry"))
    return materialize.fingerprint_of(listed, {"block_size": BLOCK})


# Projections and filters


@query("keep_text", "SELECT md5(html) AS text_md5 FROM pages")
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumnRenamed("html", "text")
    return rows.keep_columns(pages, ["text"]).select(text_md5().alias("text_md5"))


@query(
    "add_labels",
    f"WITH {_D} SELECT doc_ord, len({_IDS}) AS n_labels, md5(array_to_string({_IDS}, ' ')) AS labels_md5 FROM d",
)
def _(spark, sf):
    return rows.add_labels(token_rows(spark, sf)).select(
        "doc_ord", big(F.size("labels")).alias("n_labels"), ids_md5("labels").alias("labels_md5")
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every text, blank ones too, and five blank texts."""
    parts = documents(spark, sf).select("doc_ord", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    blanks = [(-1, i, t) for i, t in enumerate([None, "", "  ", "\n\t", "\r\n"])]
    return parts.unionByName(spark.createDataFrame(blanks, "doc_ord bigint, line int, text string"))


_LINES = """l AS (SELECT doc_id AS doc_ord, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"""


@query(
    "valid_text",
    rf"""WITH {_LINES} SELECT doc_ord, CAST(line AS INT) AS line, md5(text) AS text_md5 FROM l
    WHERE regexp_matches(text, '\S')""",
)
def _(spark, sf):
    return rows.filter_valid_text(_lines(spark, sf)).select("doc_ord", "line", text_md5().alias("text_md5"))


@query(
    "nonempty",
    f"""WITH {_LINES} SELECT doc_ord, CAST(line AS INT) AS line, len({_CP.format('text')}) AS n_tokens FROM l
    WHERE text <> '' UNION ALL SELECT -1, 2, 2 UNION ALL SELECT -1, 3, 2 UNION ALL SELECT -1, 4, 2""",
)
def _(spark, sf):
    ids = _lines(spark, sf).withColumn("input_ids", tokens.codepoint_ids())
    return rows.filter_nonempty(ids).select("doc_ord", "line", big(F.size("input_ids")).alias("n_tokens"))


# Limits and holdout

CAP = 700


@query("cap_documents", f"WITH {_D}, {_MIX} SELECT pos, src_ord, doc_ord FROM m WHERE pos < {CAP}")
def _(spark, sf):
    mixed = mix.interleave_documents(documents(spark, sf).select("src_ord", "doc_ord"))
    return rows.cap_documents(mixed, CAP).select("pos", "src_ord", "doc_ord")


@query(
    "cap_across_sources",
    f"""WITH {_D}, o AS (SELECT *, row_number() OVER (ORDER BY src_ord, doc_ord) AS k FROM d)
    SELECT src_ord, doc_ord FROM o WHERE k <= {CAP}""",
)
def _(spark, sf):
    docs = documents(spark, sf).select("src_ord", "doc_ord")
    return rows.cap_total_across_sources(docs, CAP)


@query(
    "first_n_per_file",
    """SELECT 0 AS file_ord, doc_id AS row_index, md5(text) AS text_md5 FROM documents WHERE doc_id < 30
    UNION ALL SELECT 1, item_id, md5(text) FROM benchmark WHERE item_id < 30""",
)
def _(spark, sf):
    listed = [f"{sf}/documents.parquet", f"{sf}/benchmark.parquet"]
    df = files.read_files_in_order(spark, listed, ["text"], first_n=30)
    return df.select("file_ord", "row_index", text_md5().alias("text_md5"))


@query("holdout_eval", f"{_NUMBERED} SELECT ord, ids_md5 FROM o WHERE ord < 100")
def _(spark, sf):
    _, held = rows.holdout(numbered_blocks(spark, sf), 100)
    return held.select("ord", ids_md5("input_ids").alias("ids_md5"))


@query("holdout_train", f"{_NUMBERED} SELECT ord, ids_md5 FROM o WHERE ord >= 100")
def _(spark, sf):
    train, _ = rows.holdout(numbered_blocks(spark, sf), 100, overlap=False)
    return train.select("ord", ids_md5("input_ids").alias("ids_md5"))


@query("preview", f"{_NUMBERED} SELECT ord, CAST(n_tokens AS INT) AS input_ids_len FROM o WHERE ord < 5")
def _(spark, sf):
    return rows.preview(numbered_blocks(spark, sf))


# Mixing


@query("interleave_all", f"WITH {_D}, {_MIX} SELECT pos, src_ord, doc_ord, md5(text) AS text_md5 FROM m")
def _(spark, sf):
    mixed = mix.interleave_documents(documents(spark, sf))
    return mixed.select("pos", "src_ord", "doc_ord", text_md5().alias("text_md5"))


@query(
    "interleave_first",
    f"""WITH {_D}, {_MIX}, n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM d GROUP BY src_ord))
    SELECT pos, src_ord, doc_ord, md5(text) AS text_md5 FROM m, n WHERE rn <= least""",
)
def _(spark, sf):
    mixed = mix.interleave_documents(documents(spark, sf), stop="first")
    return mixed.select("pos", "src_ord", "doc_ord", text_md5().alias("text_md5"))


# Tokens


@query(
    "tokenize_codepoint",
    f"""WITH {_D}, i AS (SELECT doc_ord, {_CP.format('text')} AS ids FROM d)
    SELECT doc_ord, len(ids) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    ids = spread(documents(spark, sf)).select("doc_ord", tokens.tokenize().alias("input_ids"))
    return block_out(ids, "doc_ord")


@query(
    "tokenize_byte",
    """WITH i AS (SELECT doc_id AS doc_ord, list_transform(regexp_extract_all(hex(encode(text)), '..'),
    lambda h: CAST(CAST('0x' || h AS INT) AS VARCHAR)) AS ids FROM documents)
    SELECT doc_ord, len(ids) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    ids = spread(documents(spark, sf)).select("doc_ord", tokens.tokenize(tokenizer="byte").alias("input_ids"))
    return block_out(ids, "doc_ord")


@query(
    "tokenize_whitespace",
    r"""WITH i AS (SELECT doc_id AS doc_ord, regexp_extract_all(text, '\S+') AS words FROM documents)
    SELECT doc_ord, len(words) AS n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM i""",
)
def _(spark, sf):
    words = spread(documents(spark, sf)).select("doc_ord", tokens.whitespace_pieces().alias("w"))
    return words.select(
        "doc_ord", big(F.size("w")).alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5")
    )


_DICTIONARY = r"""x AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS piece,
        generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS place FROM documents),
    y AS (SELECT piece, count(*) AS n FROM x GROUP BY piece),
    z AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, piece) + 2 AS INT) AS id, piece, n FROM y),
    wd AS (SELECT doc_id, list(id ORDER BY place) AS ids FROM x JOIN z USING (piece) GROUP BY doc_id)"""


@query("word_dictionary", f"WITH {_DICTIONARY} SELECT id, piece, n FROM z")
def _(spark, sf):
    return word_ids.word_model(documents(spark, sf)).vocab


@query(
    "tokenize_words",
    f"""WITH {_DICTIONARY} SELECT doc_id AS doc_ord, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_tokens,
    md5(array_to_string(coalesce(ids, []), ' ')) AS ids_md5 FROM documents LEFT JOIN wd USING (doc_id)""",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_ord", "text")
    return block_out(word_ids.encode_words(docs, word_ids.word_model(docs)), "doc_ord")


@query(
    "truncate",
    f"""WITH {_D}, i AS (SELECT doc_ord, ({_CP.format('text')})[1:{BLOCK}] AS ids FROM d)
    SELECT doc_ord, len(ids) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    ids = spread(documents(spark, sf)).select("doc_ord", tokens.tokenize(max_length=BLOCK).alias("input_ids"))
    return block_out(ids, "doc_ord")


@query(
    "append_eos",
    f"""WITH {_D}, i AS (SELECT doc_ord, {_CP.format('text')} AS ids FROM d)
    SELECT doc_ord, len(ids) + CASE WHEN ids[-1] = 46 THEN 0 ELSE 1 END AS n_tokens,
    md5(array_to_string(CASE WHEN ids[-1] = 46 THEN ids ELSE list_append(ids, 46) END, ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    """The full stop ends most texts, so it shows both cases as the EOS."""
    ids = documents(spark, sf).select(
        "doc_ord", tokens.append_eos(tokens.codepoint_ids(), ord(".")).alias("input_ids")
    )
    return block_out(ids, "doc_ord")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant turn that follows it."""
    after = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.lead("role").over(after).alias("next_role"), F.lead("text").over(after).alias("reply"),
    )
    pairs = turns.where("role = 'user' and next_role = 'assistant'")
    return pairs.select(
        "conv_id", "turn", tokens.codepoint_ids("text").alias("a"), tokens.codepoint_ids("reply").alias("b")
    )


_TURNS = f"""WITH w AS (SELECT conv_id, turn, role, text,
    lead(role) OVER v AS next_role, lead(text) OVER v AS reply FROM conversations
    WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
    ab AS (SELECT conv_id, turn, {_CP.format('text')} AS a, {_CP.format('reply')} AS b FROM w
    WHERE role = 'user' AND next_role = 'assistant')"""


@query(
    "special_single",
    f"""WITH i AS (SELECT conv_id, turn, list_concat([{tokens.BOS_ID}], {_CP.format('text')}, [{tokens.EOS_ID}]) AS ids
    FROM conversations) SELECT conv_id, turn, len(ids) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    ids = tokens.add_special("a", eos_id=tokens.EOS_ID)
    every = table(spark, sf, "conversations").select("conv_id", "turn", tokens.codepoint_ids("text").alias("a"))
    return block_out(every.withColumn("input_ids", ids), "conv_id", "turn")


@query(
    "special_pair",
    f"""{_TURNS}, i AS (SELECT conv_id, turn, list_concat(list_concat([{tokens.BOS_ID}], a),
    list_concat([{tokens.BOS_ID}], b)) AS ids FROM ab)
    SELECT conv_id, turn, len(ids) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    ids = tokens.add_special("a", "b")
    return block_out(_turns(spark, sf).withColumn("input_ids", ids), "conv_id", "turn")


@query(
    "special_mask",
    f"""{_TURNS} SELECT conv_id, turn, len(a) + len(b) + 4 AS n, CAST(4 AS BIGINT) AS ones,
    '1' || repeat('0', CAST(len(a) AS BIGINT)) || '11' || repeat('0', CAST(len(b) AS BIGINT)) || '1' AS built,
    '1' || repeat('0', CAST(len(a) AS BIGINT)) || '11' || repeat('0', CAST(len(b) AS BIGINT)) || '1' AS found FROM ab""",
)
def _(spark, sf):
    whole = tokens.add_special("a", "b", tokens.BOS_ID, tokens.EOS_ID)
    built = tokens.special_tokens_mask("a", "b", bos=True, eos=True)
    found = tokens.existing_special_mask(whole, [tokens.BOS_ID, tokens.EOS_ID])
    ones = F.aggregate(built, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _turns(spark, sf).select(
        "conv_id", "turn", big(F.size(built)).alias("n"), ones.alias("ones"),
        F.array_join(built.cast("array<string>"), "").alias("built"),
        F.array_join(found.cast("array<string>"), "").alias("found"),
    )


@query(
    "token_type_ids",
    f"""{_TURNS} SELECT conv_id, turn,
    repeat('0', CAST(len(a) + 1 AS BIGINT)) || repeat('1', CAST(len(b) + 1 AS BIGINT)) AS types FROM ab""",
)
def _(spark, sf):
    types = tokens.token_type_ids("a", "b")
    return _turns(spark, sf).select(
        "conv_id", "turn", F.array_join(types.cast("array<string>"), "").alias("types")
    )


@query(
    "decode_codepoint",
    f"""WITH {_D} SELECT doc_ord, md5(text) AS plain, md5('<bos>' || text || '<eos>') AS verbatim,
    md5('<bos> ' || text || ' <eos>') AS spaced FROM d""",
)
def _(spark, sf):
    names = {tokens.BOS_ID: "<bos>", tokens.EOS_ID: "<eos>"}
    ids = tokens.add_special(tokens.codepoint_ids(), eos_id=tokens.EOS_ID)
    return spread(documents(spark, sf)).select("doc_ord", ids.alias("ids")).select(
        "doc_ord",
        text_md5(tokens.decode_codepoint("ids", names, skip_special=True)).alias("plain"),
        text_md5(tokens.decode_codepoint("ids", names)).alias("verbatim"),
        text_md5(tokens.decode_codepoint("ids", names, spaces_between=True)).alias("spaced"),
    )


_CHARS = """c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch),
    s AS (SELECT ch, n, row_number() OVER (ORDER BY n DESC, ch) AS rank,
    CAST(sum(n) OVER (ORDER BY n DESC, ch) AS BIGINT) - n AS before, CAST(sum(n) OVER () AS BIGINT) AS total FROM c),
    k AS (SELECT rank, ch, n FROM s WHERE before < total * 0.98)"""


def _chars(spark: SparkSession, sf: str) -> DataFrame:
    return sizing.char_counts(documents(spark, sf).select("text"))


@query("char_coverage", f"WITH {_CHARS} SELECT rank, ch, n FROM k")
def _(spark, sf):
    return sizing.char_coverage(_chars(spark, sf))


@query(
    "pad_fallback",
    f"""WITH {_D}, u AS (SELECT lang, unnest({_CP.format('text')}) AS id FROM d),
    v AS (SELECT lang, min(id) FILTER (id = 241) AS pad_id, max(id) AS eos_id FROM u GROUP BY lang)
    SELECT lang, pad_id IS NULL AS falls_back, coalesce(pad_id, eos_id) AS pad_id FROM v""",
)
def _(spark, sf):
    """Per language: the character n with tilde pads where it is used, the largest id elsewhere."""
    ids = documents(spark, sf).select("lang", tokens.codepoint_ids().alias("ids"))
    found = F.when(F.array_contains("ids", 241), 241)
    ends = ids.groupBy("lang").agg(
        F.min(found).alias("pad"), F.max(F.array_max("ids")).alias("eos")
    )
    return ends.select(
        "lang", F.col("pad").isNull().alias("falls_back"), tokens.pad_or_eos("pad", "eos").alias("pad_id")
    )


# Vocabulary

_SPECIAL_VALUES = ", ".join(
    f"({i}, '{p}', '{k}')"
    for i, (p, k) in enumerate(
        [(p, "control") for p in vocab.RESERVED] + [(p, "user") for p in vocab.user_symbols()]
    )
)
_FIRST_BYTE = len(vocab.RESERVED) + len(vocab.user_symbols())
_FIRST_CHAR = _FIRST_BYTE + vocab.BYTES
_VOCAB = f"""{_CHARS}, x AS (SELECT * FROM (VALUES {_SPECIAL_VALUES}) q(id, piece, kind)),
    y AS (SELECT CAST({_FIRST_BYTE} + i AS INT) AS id, printf('<0x%02X>', i) AS piece, 'byte' AS kind FROM range(256) g(i)),
    v AS (SELECT * FROM x UNION ALL SELECT * FROM y
    UNION ALL SELECT CAST({_FIRST_CHAR} - 1 + rank AS INT), ch, 'char' FROM k)"""


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.char_vocab(spark, sizing.char_coverage(_chars(spark, sf)))


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    """The role names of the conversations as special tokens."""
    name = F.concat(F.lit("<|"), "role", F.lit("|>"))
    return table(spark, sf, "conversations").select(name.alias("piece")).distinct()


@query("vocab_table", f"WITH {_VOCAB} SELECT id, piece, kind FROM v")
def _(spark, sf):
    """Saved as an artefact and read back."""
    path, table_ = scratch_path(spark, "vocab"), _vocab(spark, sf)
    none = spark.createDataFrame([], "rank int, left string, right string, id int")
    requested = table_.where("kind = 'user'").select("piece")
    bpe.save_vocabulary(spark, table_, none, vocab.special_token_table(requested, table_), path)
    return bpe.load_vocabulary(spark, path)[0]


@query("vocab_size", f"WITH {_VOCAB} SELECT count(*) AS vocab_size FROM v")
def _(spark, sf):
    return sizing.vocab_size(_vocab(spark, sf))


@query(
    "byte_fallback_flag",
    f"""WITH {_VOCAB} SELECT kind, bool_or(regexp_matches(piece, '^<0x.*>$')) AS byte_fallback FROM v GROUP BY kind""",
)
def _(spark, sf):
    """For the whole vocabulary, and for each kind of piece on its own."""
    pieces = _vocab(spark, sf)
    flags = [
        sizing.byte_fallback_flag(pieces.where(F.col("kind") == k)).select(F.lit(k).alias("kind"), "byte_fallback")
        for k in ("control", "user", "byte", "char")
    ]
    return flags[0].union(flags[1]).union(flags[2]).union(flags[3])


@query(
    "vocab_bound",
    f"""WITH {_D}, u AS (SELECT max(list_max({_IDS})) AS max_id, min(list_min({_IDS})) AS min_id FROM d)
    SELECT min_id, max_id, greatest(max_id + 1, {tokens.PAD_ID} + 1) AS required FROM u""",
)
def _(spark, sf):
    span = sizing.id_range(token_rows(spark, sf))
    required = sizing.required_vocab_size(F.col("max_id") + 1, F.lit(tokens.PAD_ID))
    return span.select("min_id", "max_id", required.alias("required"))


@query(
    "piece_to_id",
    f"""WITH {_VOCAB} SELECT c.ch AS piece, c.n, coalesce(v.id, 1) AS id FROM c
    LEFT JOIN v ON v.piece = c.ch""",
)
def _(spark, sf):
    pieces = _chars(spark, sf).withColumnRenamed("ch", "piece")
    return vocab.piece_to_id(pieces, _vocab(spark, sf)).select("piece", "n", "id")


@query(
    "id_to_piece",
    f"""WITH {_VOCAB}, e AS (SELECT coalesce(v.id, 1) AS id, CAST(sum(c.n) AS BIGINT) AS n FROM c
    LEFT JOIN v ON v.piece = c.ch GROUP BY 1)
    SELECT e.id, e.n, v.piece FROM e JOIN v ON v.id = e.id""",
)
def _(spark, sf):
    pieces, table_ = _chars(spark, sf).withColumnRenamed("ch", "piece"), _vocab(spark, sf)
    ids = vocab.piece_to_id(pieces, table_).groupBy("id").agg(F.sum("n").alias("n"))
    return vocab.id_to_piece(ids, table_)


@query(
    "special_ids",
    """WITH r AS (SELECT DISTINCT '<|' || role || '|>' AS piece FROM conversations
    UNION SELECT '<unk>' UNION SELECT '<pad>'),
    u AS (SELECT piece FROM r WHERE piece NOT IN ('<pad>', '<unk>', '<|endoftext|>'))
    SELECT * FROM (VALUES (0, '<pad>', 'control'), (1, '<unk>', 'control'), (2, '<|endoftext|>', 'control')) q(id, piece, kind)
    UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY piece) AS INT), piece, 'user' FROM u""",
)
def _(spark, sf):
    asked = _roles(spark, sf).union(spark.createDataFrame([("<unk>",), ("<pad>",)], "piece string"))
    return vocab.special_ids(asked)


@query(
    "byte_pieces",
    f"""WITH {_VOCAB}, o AS (SELECT ch, n, hex(encode(ch)) AS h FROM c WHERE ch NOT IN (SELECT ch FROM k)),
    z AS (SELECT n, unnest(list_transform(range(0, CAST(length(h) // 2 AS BIGINT)), lambda j: h[2 * j + 1 : 2 * j + 2])) AS hh FROM o)
    SELECT v.id, v.piece, CAST(coalesce(sum(z.n), 0) AS BIGINT) AS n FROM v LEFT JOIN z ON v.piece = '<0x' || z.hh || '>'
    WHERE v.kind = 'byte' GROUP BY 1, 2""",
)
def _(spark, sf):
    """How often each byte piece stands in for a character outside the coverage."""
    counts = _chars(spark, sf)
    return vocab.byte_usage(vocab.byte_rows(spark, _FIRST_BYTE), counts, sizing.char_coverage(counts))


@query(
    "special_token_table",
    f"""WITH {_VOCAB}, r AS (SELECT DISTINCT '<|' || role || '|>' AS piece FROM conversations)
    SELECT v.id, v.piece AS content, false AS lstrip, false AS normalized, false AS rstrip,
    false AS single_word, true AS special FROM v JOIN r ON r.piece = v.piece""",
)
def _(spark, sf):
    return vocab.special_token_table(_roles(spark, sf), _vocab(spark, sf))


@query(
    "vocab_export",
    f"""WITH {_VOCAB}, r AS (SELECT DISTINCT '<|' || role || '|>' AS piece FROM conversations),
    a AS (SELECT piece, CAST(9999 + row_number() OVER (ORDER BY piece) AS INT) AS id FROM r)
    SELECT piece, id FROM a UNION ALL SELECT piece, id FROM v WHERE piece NOT IN (SELECT piece FROM a)""",
)
def _(spark, sf):
    """Added tokens take new ids from 10,000 on."""
    added = vocab.rank_pieces(_roles(spark, sf).withColumn("n", F.lit(1)), "piece", "n", 1000, 10_000)
    return vocab.vocab_export(_vocab(spark, sf), added)


# Byte-pair vocabulary

_WORDS = f"""w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
    replace(line, ' ', '{tokens.WORD_MARK}'), '{bpe.WORD_PATTERN}')) AS word
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY word)"""


@query(
    "max_sentence_len",
    "SELECT doc_id AS doc_ord, strlen(text) AS bytes FROM documents WHERE strlen(text) <= 16384",
)
def _(spark, sf):
    kept = bpe.max_sentence_length(documents(spark, sf))
    return kept.select("doc_ord", big(F.octet_length("text")).alias("bytes"))


@query(
    "bpe_pair_counts",
    f"""WITH {_WORDS}, h AS (SELECT n, string_split(word, '') AS cs FROM w),
    g AS (SELECT n, cs, unnest(range(1, CAST(len(cs) AS BIGINT))) AS i FROM h)
    SELECT cs[i] AS "left", cs[i + 1] AS "right", CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2""",
)
def _(spark, sf):
    words = bpe.word_counts(bpe.text_lines(documents(spark, sf)))
    return bpe.pair_counts(words.select(F.split("word", "").alias("symbols"), "n"))


# The size that SQL can follow merge by merge; the README has the figure of a whole vocabulary.
BPE_SIZE = 480
_trained: dict[tuple[str, str], tuple[DataFrame, DataFrame, bpe.BpeModel]] = {}
_FIRST_BYTE = len(vocab.RESERVED) + len(vocab.user_symbols())
_FIRST_CHAR = _FIRST_BYTE + vocab.BYTES

# Training by recursion: a word is its pieces between the marks 1 and 2, a character outside the coverage
# has the mark 3. The row without a word lists the pieces made so far and the last merge.
_BPE_SQL = f"""{_WORDS}, ch AS (SELECT c, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(string_split(word, '')) AS c, n FROM w) GROUP BY c),
rk AS (SELECT c, row_number() OVER o AS rank, coalesce(sum(n) OVER (ORDER BY n DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
    sum(n) OVER () AS total FROM ch WINDOW o AS (ORDER BY n DESC, c)),
cv AS (SELECT c, rank FROM rk WHERE seen < CAST(total AS DOUBLE) * CAST(0.98 AS DOUBLE)),
cl AS (SELECT list(c ORDER BY rank) AS cs FROM cv),
tr AS (
  SELECT 0 AS step, word, n, array_to_string(list_transform(string_split(word, ''), lambda x:
      chr(1) || CASE WHEN list_contains(cs, x) THEN x ELSE chr(3) || x END || chr(2)), '') AS s,
    CAST([] AS VARCHAR[]) AS known, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS r FROM w, cl
  UNION ALL SELECT 0, NULL, 0, '', CAST([] AS VARCHAR[]), NULL, NULL
  UNION ALL
  SELECT step + 1, word, n, replace(s, chr(1) || top.l || chr(2) || chr(1) || top.r || chr(2), chr(1) || top.l || top.r || chr(2)),
    CASE WHEN word IS NULL AND NOT list_contains(known, top.l || top.r) THEN list_append(known, top.l || top.r) ELSE known END, top.l, top.r
  FROM tr, (
    SELECT l, r FROM (
      SELECT ps[i] AS l, ps[i + 1] AS r, n FROM (
        SELECT ps, n, unnest(range(1, len(ps))) AS i FROM (SELECT string_split(s[2 : length(s) - 1], chr(2) || chr(1)) AS ps, n FROM tr WHERE word IS NOT NULL)))
    WHERE l[1] <> chr(3) AND r[1] <> chr(3) GROUP BY l, r
    ORDER BY sum(n) DESC,
      greatest(CASE WHEN length(l) = 1 THEN unicode(l) ELSE 2000000 + list_position((SELECT known FROM tr WHERE word IS NULL), l) END,
        CASE WHEN length(r) = 1 THEN unicode(r) ELSE 2000000 + list_position((SELECT known FROM tr WHERE word IS NULL), r) END),
      CASE WHEN length(l) = 1 THEN unicode(l) ELSE 2000000 + list_position((SELECT known FROM tr WHERE word IS NULL), l) END,
      CASE WHEN length(r) = 1 THEN unicode(r) ELSE 2000000 + list_position((SELECT known FROM tr WHERE word IS NULL), r) END LIMIT 1) AS top
  WHERE (SELECT len(known) FROM tr WHERE word IS NULL) + {_FIRST_CHAR} + (SELECT len(cs) FROM cl) < {BPE_SIZE}
), pc AS (
  SELECT cs[i] AS piece, {_FIRST_CHAR - 1} + i AS id FROM (SELECT cs, unnest(range(1, len(cs) + 1)) AS i FROM cl)
  UNION ALL SELECT known[i], {_FIRST_CHAR - 1} + (SELECT len(cs) FROM cl) + i
  FROM (SELECT known, unnest(range(1, len(known) + 1)) AS i FROM tr WHERE word IS NULL AND step = (SELECT max(step) FROM tr))
)"""

# Ids of each document: lines of words of pieces, with the byte of a line feed between lines.
_BPE_IDS = f"""pm AS (SELECT map(list(piece), list(id)) AS m FROM pc),
sg AS (SELECT word, flatten(list_transform(string_split(s[2 : length(s) - 1], chr(2) || chr(1)), lambda p: CASE WHEN p[1] = chr(3)
    THEN list_transform(range(octet_length(encode(p[2:]))), lambda k: {_FIRST_BYTE} + CAST('0x' || substr(hex(encode(p[2:])), 2 * k + 1, 2) AS INT))
    ELSE [m[p]] END)) AS ids FROM tr, pm WHERE word IS NOT NULL AND step = (SELECT max(step) FROM tr)),
ln AS (SELECT doc_id, i, regexp_extract_all(replace(string_split(text, chr(10))[i], ' ', '{tokens.WORD_MARK}'), '{bpe.WORD_PATTERN}') AS ws
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
ow AS (SELECT doc_id, i, k, ids FROM (SELECT doc_id, i, ws[k] AS word, k FROM (SELECT doc_id, i, ws, unnest(range(1, len(ws) + 1)) AS k FROM ln)) JOIN sg USING (word)
    UNION ALL SELECT doc_id, i, 0, [{_FIRST_BYTE + 10}] FROM ln WHERE i > 1),
bd AS (SELECT doc_id, flatten(list(ids ORDER BY i, k)) AS ids FROM ow GROUP BY doc_id)"""


def _bpe(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, bpe.BpeModel]:
    """Train once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        pieces, merges = bpe.train_bpe(bpe.text_lines(documents(spark, sf)), BPE_SIZE)
        _trained[key] = pieces, merges, bpe.BpeModel.from_tables(pieces, merges)
    return _trained[key]


@query(
    "train_bpe",
    f"""WITH RECURSIVE {_BPE_SQL}
    SELECT CAST(step - 1 AS INT) AS rank, l AS "left", r AS "right", CAST(pc.id AS INT) AS id
    FROM tr JOIN pc ON pc.piece = l || r WHERE word IS NULL AND step > 0""",
)
def _(spark, sf):
    return _bpe(spark, sf)[1]


def _encoded(spark: SparkSession, sf: str) -> tuple[DataFrame, bpe.BpeModel]:
    model = _bpe(spark, sf)[2]
    return bpe.encode_bpe(documents(spark, sf), model), model


@query(
    "encode_bpe",
    f"""WITH RECURSIVE {_BPE_SQL}, {_BPE_IDS}
    SELECT doc_id AS doc_ord, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_tokens, md5(array_to_string(coalesce(ids, []), ' ')) AS ids_md5
    FROM documents LEFT JOIN bd USING (doc_id)""",
)
def _(spark, sf):
    return block_out(_encoded(spark, sf)[0], "doc_ord")


@query(
    "pretokenize_bpe",
    f"""WITH RECURSIVE {_BPE_SQL}, {_BPE_IDS}, {_D}, {_MIX}, mb AS (SELECT m.*, bd.ids AS own FROM m JOIN bd ON bd.doc_id = m.doc_ord),
    {_pack_sql(f"list_append(own, {vocab.EOS_ID})", f"ord // {BATCH}", source="mb")}
    SELECT batch_id, block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    """The flow with the trained vocabulary."""
    model = _bpe(spark, sf)[2]
    opts = PretokenizeOptions(BLOCK, BATCH, truncate=None, eos_id=vocab.EOS_ID, tokenizer=model)
    return block_out(pretokenize(documents(spark, sf), opts), "batch_id", "block_ord")


@query(
    "pretokenize_words",
    f"""WITH {_DICTIONARY}, {_D}, {_MIX}, mw AS (SELECT m.*, wd.ids AS own FROM m JOIN wd ON wd.doc_id = m.doc_ord),
    {_pack_sql(f"list_append(own, {vocab.EOS_ID})", f"ord // {BATCH}", source="mw")}
    SELECT batch_id, block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    opts = PretokenizeOptions(BLOCK, BATCH, truncate=None, tokenizer="whitespace")
    return block_out(pretokenize(documents(spark, sf), opts), "batch_id", "block_ord")


@query("decode_bpe", "SELECT doc_id AS doc_ord, md5(text) AS text_md5 FROM documents")
def _(spark, sf):
    df, model = _encoded(spark, sf)
    return bpe.decode_bpe(df, model, out="back").select("doc_ord", text_md5("back").alias("text_md5"))


@query(
    "tokenizer_parity",
    r"""SELECT count(*) AS texts, count(*) FILTER (strlen(text) = length(text)) AS equal,
    count(*) FILTER (strlen(text) <> length(text)) AS different FROM documents""",
)
def _(spark, sf):
    """Bytes and code points agree on pure ASCII only."""
    docs = documents(spark, sf)
    a = docs.select("doc_ord", tokens.codepoint_ids().alias("input_ids"))
    b = docs.select("doc_ord", tokens.byte_ids().alias("input_ids"))
    return bpe.compare_tokenizations(a, b, ["doc_ord"])


# Packing and arrays


@query("pack_batch", f"{_BLOCKS} SELECT batch_id, block_ord, n_tokens, ids_md5 FROM b")
def _(spark, sf):
    return block_out(blocks_of(spark, sf), "batch_id", "block_ord")


@query(
    "pack_global",
    f"""WITH {_D}, {_MIX}, {_pack_sql(_IDS, '0')} SELECT block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    """One batch for the whole corpus."""
    opts = PretokenizeOptions(block_size=BLOCK, batch_size=None, truncate=None)
    ids = tokenize_documents(order_documents(documents(spark, sf), opts), opts)
    staged = stage(ids.select("ord", "input_ids"), "tokens")
    return block_out(pack.pack_blocks(staged, BLOCK, None), "block_ord")


@query("pack_stats", f"{_BLOCKS} SELECT batch_id, count(*) AS blocks, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM b GROUP BY 1")
def _(spark, sf):
    return sizing.pack_stats(blocks_of(spark, sf))


@query(
    "chunk_row",
    f"""WITH {_D}, i AS (SELECT doc_ord, {_IDS} AS ids FROM d)
    SELECT doc_ord, len(ids) // {BLOCK} AS chunks,
    md5(array_to_string(ids[1 : (len(ids) // {BLOCK}) * {BLOCK}], ' ')) AS ids_md5 FROM i""",
)
def _(spark, sf):
    chunks = token_rows(spark, sf).select("doc_ord", pack.chunk_row("input_ids", BLOCK).alias("c"))
    return chunks.select(
        "doc_ord", big(F.size("c")).alias("chunks"), ids_md5(F.flatten("c")).alias("ids_md5")
    )


@query(
    "attention_mask",
    f"WITH {_D} SELECT doc_ord, repeat('1', CAST(len({_IDS}) AS BIGINT)) AS mask FROM d",
)
def _(spark, sf):
    mask = tokens.attention_mask("input_ids").cast("array<string>")
    return token_rows(spark, sf).select("doc_ord", F.array_join(mask, "").alias("mask"))


def _part_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each order as an id list, at most seven lines long."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    in_order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return lines.groupBy("l_orderkey").agg(in_order.alias("x")).select(
        "l_orderkey", F.col("x.l_partkey").alias("input_ids")
    )


_PARTS = """q AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1)"""
# Below every part number.
PAD = -1


def _collated(spark: SparkSession, sf: str, side: str) -> DataFrame:
    ranked = dense_ordinal(_part_lists(spark, sf), "l_orderkey")
    return pack.collate(ranked, 32, PAD, side)


_COLLATED = f"""{_PARTS}, n AS (SELECT *, (row_number() OVER (ORDER BY l_orderkey) - 1) // 32 AS batch_id FROM q),
    g AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS gap FROM n),
    f AS (SELECT *, list_transform(range(0, CAST(gap AS BIGINT)), lambda i: CAST({PAD} AS BIGINT)) AS fill FROM g)"""


@query(
    "collate_pad",
    f"""WITH {_COLLATED} SELECT l_orderkey, batch_id, array_to_string(list_concat(fill, ids), ' ') AS ids,
    repeat('0', CAST(gap AS BIGINT)) || repeat('1', CAST(len(ids) AS BIGINT)) AS mask,
    array_to_string(list_concat(list_transform(fill, lambda i: CAST(-100 AS BIGINT)), ids), ' ') AS labels FROM f""",
)
def _(spark, sf):
    def text(c, sep):
        return F.array_join(F.col(c).cast("array<string>"), sep)

    return _collated(spark, sf, "left").select(
        "l_orderkey", "batch_id", text("input_ids", " ").alias("ids"),
        text("attention_mask", "").alias("mask"), text("labels", " ").alias("labels"),
    )


@query(
    "last_non_pad",
    f"""WITH {_COLLATED} SELECT l_orderkey, CAST(len(ids) - 1 AS INT) AS right_padded,
    CAST(gap + len(ids) - 1 AS INT) AS no_pad_id FROM f""",
)
def _(spark, sf):
    return _collated(spark, sf, "right").select(
        "l_orderkey",
        arrays.last_non_pad_index("input_ids", PAD).alias("right_padded"),
        arrays.last_non_pad_index("input_ids", None).alias("no_pad_id"),
    )


@query(
    "shift_labels",
    f"""WITH {_PARTS} SELECT l_orderkey, array_to_string(ids[1 : len(ids) - 1], ' ') AS inputs,
    array_to_string(ids[2 : len(ids)], ' ') AS targets FROM q""",
)
def _(spark, sf):
    return _part_lists(spark, sf).select(
        "l_orderkey",
        F.array_join(arrays.shift_inputs("input_ids").cast("array<string>"), " ").alias("inputs"),
        F.array_join(arrays.shift_targets("input_ids").cast("array<string>"), " ").alias("targets"),
    )


@query(
    "position_ids",
    f"""WITH {_PARTS} SELECT l_orderkey, array_to_string(range(0, CAST(len(ids) AS BIGINT)), ' ') AS positions,
    array_to_string(range(3, CAST(len(ids) + 3 AS BIGINT)), ' ') AS shifted FROM q""",
)
def _(spark, sf):
    def text(offset):
        return F.array_join(arrays.position_ids("input_ids", offset).cast("array<string>"), " ")

    return _part_lists(spark, sf).select(
        "l_orderkey", text(0).alias("positions"), text(3).alias("shifted")
    )


@query(
    "clamp_span",
    """WITH z AS (SELECT doc_id AS doc_ord, strpos(text, '.') - 2 AS s, length(text) AS e, 512 AS l FROM documents)
    SELECT doc_ord, CAST(greatest(0, least(s, l)) AS INT) AS span_start, CAST(greatest(0, least(e, l)) AS INT) AS span_end,
    greatest(0, least(e, l)) = l AS ignored FROM z""",
)
def _(spark, sf):
    """The first sentence's end and the text's end, in a window of 512 positions."""
    start, end = F.instr("text", ".") - 2, F.length("text")
    return documents(spark, sf).select(
        "doc_ord",
        arrays.clamp_span(start, F.lit(512)).alias("span_start"),
        arrays.clamp_span(end, F.lit(512)).alias("span_end"),
        arrays.span_ignored(end, F.lit(512)).alias("ignored"),
    )


@query(
    "problem_type",
    """WITH z AS (SELECT 'quality' AS label, count(DISTINCT quality) AS num_labels, true AS whole FROM labels
    UNION ALL SELECT 'toxic', count(DISTINCT toxic), true FROM labels
    UNION ALL SELECT 'value', count(DISTINCT value), false FROM events
    UNION ALL SELECT 'regions', count(DISTINCT r_regionkey) // count(*), true FROM region)
    SELECT label, num_labels, CASE WHEN num_labels = 1 THEN 'regression'
    WHEN whole THEN 'single_label_classification' ELSE 'multi_label_classification' END AS problem_type FROM z""",
)
def _(spark, sf):
    marks, events, region = (table(spark, sf, t) for t in ("labels", "events", "region"))
    per_region = F.floor(F.countDistinct("r_regionkey") / F.count(F.lit(1)))
    found = [
        marks.agg(F.countDistinct("quality").alias("n")).select(F.lit("quality").alias("label"), "n", F.lit(True).alias("whole")),
        marks.agg(F.countDistinct("toxic").alias("n")).select(F.lit("toxic").alias("label"), "n", F.lit(True).alias("whole")),
        events.agg(F.countDistinct("value").alias("n")).select(F.lit("value").alias("label"), "n", F.lit(False).alias("whole")),
        region.agg(per_region.alias("n")).select(F.lit("regions").alias("label"), "n", F.lit(True).alias("whole")),
    ]
    both = found[0].union(found[1]).union(found[2]).union(found[3])
    return both.select("label", F.col("n").alias("num_labels"), arrays.infer_problem_type("n", "whole").alias("problem_type"))


# Sizing


@query(
    "corpus_summary",
    f"""WITH {_D}, o AS (SELECT lang, (row_number() OVER (ORDER BY src_ord, doc_ord) - 1) // {SHARD} AS shard FROM d)
    SELECT lang, count(*) AS rows, count(DISTINCT shard) AS shards FROM o GROUP BY ROLLUP (lang)""",
)
def _(spark, sf):
    placed = mix.concat_ordinal(documents(spark, sf).select("src_ord", "doc_ord", "lang"))
    return sizing.corpus_summary(shards.assign_shard(placed, SHARD))


def _shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    shards.write_shards(numbered_blocks(spark, sf), path, SHARD)
    return sizing.rows_per_file(shards.read_committed(spark, path), "shard")


@query("sample_count_exact", f"{_BLOCKS} SELECT count(*) AS samples FROM b")
def _(spark, sf):
    return sizing.sample_count_exact(_shard_rows(spark, sf))


@query("sample_count_estimate", f"{_BLOCKS} SELECT count(*) AS samples FROM b")
def _(spark, sf):
    """All shards but the last are full, so the estimate from the ends is exact."""
    return sizing.sample_count_estimate(_shard_rows(spark, sf), "shard")


@query("plan_steps", f"{_BLOCKS} SELECT count(*) AS samples, count(*) // (4 * 2 * 2) * 3 AS steps FROM b")
def _(spark, sf):
    n = blocks_of(spark, sf).agg(F.count(F.lit(1)).alias("samples"))
    return n.select("samples", sizing.plan_steps(F.col("samples"), 4, 2, 2, 3).alias("steps"))


# Batches and streams


@query(
    "map_batches",
    f"""WITH {_D} SELECT doc_ord // {BATCH} AS batch, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM d GROUP BY 1""",
)
def _(spark, sf):
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["ord"].iloc[0] // BATCH
        return pd.DataFrame({"batch": [at], "rows": [len(pdf)], "chars": [int(pdf["text"].str.len().sum())]})

    df = files.read_files_in_order(spark, [f"{sf}/documents.parquet"], ["text"])
    return map_batches(df.select("ord", "text"), summarise, "batch bigint, rows bigint, chars bigint", BATCH, "ord")


@query(
    "filter_batches",
    """SELECT doc_id AS ord, md5(text) AS text_md5 FROM documents
    WHERE length(text) - length(replace(text, ' ', '')) >= 50""",
)
def _(spark, sf):
    df = files.read_files_in_order(spark, [f"{sf}/documents.parquet"], ["text"])
    kept = filter_batches(df, lambda pdf: pdf["text"].str.count(" ") >= 50, ["text"])
    return kept.select("ord", text_md5().alias("text_md5"))


@query(
    "text_lines",
    """SELECT md5(line) AS line_md5, count(*) AS lines FROM
    (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "lines")
    flat = F.regexp_replace("text", "\\r", "")
    table(spark, sf, "documents").where(F.col("text").isNotNull()).select(flat.alias("text")).write.text(path)
    lines = files.read_text_lines(spark, path)
    return lines.groupBy(F.md5("text").alias("line_md5")).agg(F.count(F.lit(1)).alias("lines"))


def _document_files(spark: SparkSession, sf: str) -> str:
    """The documents as many files, to be streamed over some four micro-batches."""
    path = scratch_path(spark, "documents")
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    documents(spark, sf).repartitionByRange(parts, "doc_ord").sortWithinPartitions("doc_ord").write.parquet(path)
    return path


def _document_stream(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    schema = documents(spark, sf).schema
    if path is not None:
        n = sum(name.endswith(".parquet") for name in files.list_names(spark, path))
        return files.read_stream(spark, path, schema, max_files=max(1, -(-n // 4)))
    # A pattern, as a plain path may not be one file; what it finds may be a file or a folder.
    raw = files.read_stream(spark, f"{sf}/documents.parque[t]", table(spark, sf, "documents").schema)
    return raw.select(src_ord().alias("src_ord"), F.col("doc_id").alias("doc_ord"), "lang", "text")


@query("stream_scan", "SELECT lang, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(spark, sf):
    path = scratch_path(spark, "scan")
    flows.run_to_files(_document_stream(spark, sf, _document_files(spark, sf)), path, scratch_path(spark, "ckpt"))
    return spark.read.parquet(path).groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")
    )


_TOKENIZED = f"""WITH {_D}, i AS (SELECT doc_ord, {_IDS} AS ids FROM d)
    SELECT doc_ord, len(ids) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i"""


@query("stream_tokenize", _TOKENIZED)
def _(spark, sf):
    path = scratch_path(spark, "tokens")
    stream = flows.tokenize_stream(_document_stream(spark, sf), eos_id=tokens.EOS_ID)
    flows.run_to_files(stream, path, scratch_path(spark, "ckpt"))
    return block_out(spark.read.parquet(path), "doc_ord")


def _arriving(spark: SparkSession, sf: str, run: Callable[[DataFrame], None]) -> None:
    """The documents arrive in four steps; ``run`` is called with a new stream after each.

    A step is one micro-batch of all its files, so streams that keep their checkpoint go
    through four micro-batches and three restarts.
    """
    docs, path = documents(spark, sf), scratch_path(spark, "arriving")
    step = (docs.agg(F.max("doc_ord")).head()[0] or 0) // 4 + 1
    for i in range(4):
        part = docs.where((F.col("doc_ord") >= i * step) & (F.col("doc_ord") < (i + 1) * step))
        spread(part).write.mode("append").parquet(path)
        run(files.read_stream(spark, path, docs.schema))


@query("stream_resume", _TOKENIZED)
def _(spark, sf):
    """Ended after each step and run again from the same checkpoint."""
    path, ckpt = scratch_path(spark, "tokens"), scratch_path(spark, "ckpt")
    _arriving(spark, sf, lambda docs: flows.run_to_files(flows.tokenize_stream(docs, eos_id=tokens.EOS_ID), path, ckpt))
    return block_out(spark.read.parquet(path), "doc_ord")


def _packed_stream(spark: SparkSession, sf: str, batch_size: int | None) -> DataFrame:
    path, ckpt = scratch_path(spark, "packed"), scratch_path(spark, "ckpt")

    def run(docs):
        ids = flows.tokenize_stream(docs, eos_id=tokens.EOS_ID)
        flows.run_batches(ids, flows.StreamPacker(path, BLOCK, batch_size), ckpt)

    _arriving(spark, sf, run)
    packer = flows.StreamPacker(path, BLOCK, batch_size)
    packer.finish(spark)
    return packer.blocks(spark)


@query(
    "stream_pack_batch",
    f"""WITH {_D}, m AS (SELECT text, row_number() OVER (ORDER BY doc_ord) - 1 AS pos FROM d),
    {_pack_sql(_IDS, f"ord // {BATCH}")} SELECT batch_id, block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    return block_out(_packed_stream(spark, sf, BATCH), "batch_id", "block_ord")


@query(
    "stream_pack_carry",
    f"""WITH {_D}, m AS (SELECT text, row_number() OVER (ORDER BY doc_ord) - 1 AS pos FROM d),
    {_pack_sql(_IDS, "0")} SELECT block_ord, n_tokens, ids_md5 FROM b""",
)
def _(spark, sf):
    return block_out(_packed_stream(spark, sf, None), "block_ord")


@query("stream_take", "SELECT doc_id AS doc_ord, md5(text) AS text_md5 FROM documents WHERE doc_id < 150")
def _(spark, sf):
    take = flows.StreamTake(scratch_path(spark, "take"), 150, ["doc_ord"])
    flows.run_batches(_document_stream(spark, sf), take, scratch_path(spark, "ckpt"))
    return take.rows(spark).select("doc_ord", text_md5().alias("text_md5"))


@query(
    "stream_interleave",
    f"""WITH {_D}, {_MIX} SELECT pos, src_ord, doc_ord, md5(text) AS text_md5 FROM m WHERE src_ord >= 0""",
)
def _(spark, sf):
    """One stream per language, over four micro-batches; the round goes on from one to the next."""
    path, ckpt = scratch_path(spark, "mixed"), scratch_path(spark, "ckpt")

    def run(docs):
        docs = docs.drop("src_ord")
        streams = [docs.where(F.col("lang") == lang) for lang in LANGS]
        flows.run_batches(flows.interleave_streams(streams), flows.StreamInterleave(path), ckpt)

    _arriving(spark, sf, run)
    mixed = flows.StreamInterleave(path).rows(spark)
    return mixed.select("pos", "src_ord", "doc_ord", text_md5().alias("text_md5"))
