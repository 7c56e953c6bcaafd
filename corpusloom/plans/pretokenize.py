"""The flow from documents to blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.bpe import BpeModel, bpe_ids
from corpusloom.functions.tokens import EOS_ID, append_eos, token_count, tokenize, truncate
from corpusloom.functions.words import WordModel, encode_words, word_model
from corpusloom.operators.mix import concat_ordinal, interleave_documents, source_sizes
from corpusloom.operators.order import LIGHT_BITS, dense_ordinal, key_bits_for
from corpusloom.operators.pack import WINDOW_BATCH, batch_of, pack_blocks
from corpusloom.operators.rows import cap_documents, filter_nonempty, filter_valid_text, has_text
from corpusloom.session import fine_parts, scratch_path, spread, stage
from corpusloom.sources.shards import (
    MAX_SAMPLES_PER_SHARD,
    block_ordinal,
    commit_once,
    commits_by_writer,
    finished_languages,
    has_progress,
    progress,
    read_committed,
    write_dataset_info,
    write_languages,
    write_shards,
)

# Bytes of stored texts whose blocks one task makes and writes.
TEXT_BYTES = 8 << 20


@dataclass(frozen=True)
class PretokenizeOptions:
    """Settings of a run.

    ``truncate=None`` keeps whole texts, a number cuts them before EOS. The
    tokenizer is the name of an expression tokenizer, ``whitespace``, a byte-pair vocabulary or a
    dictionary of words; ``whitespace`` makes a dictionary of the documents of the run. The last
    three close texts with an ``eos_id`` of their own, 2.
    """

    block_size: int = 1024
    batch_size: int | None = 1000
    interleave: str = "all"
    max_documents: int | None = None
    truncate: int | None = None
    eos_id: int | None = EOS_ID
    tokenizer: str | BpeModel | WordModel = "codepoint"


def with_dictionary(docs: DataFrame, opts: PretokenizeOptions) -> PretokenizeOptions:
    """Options whose ``whitespace`` tokenizer has become the dictionary of ``docs``.

    It closes texts with the dictionary's EOS where the options ask for the default one.
    """
    if opts.tokenizer != "whitespace":
        return opts
    model = word_model(docs)
    return replace(opts, tokenizer=model, eos_id=model.eos_id if opts.eos_id == EOS_ID else opts.eos_id)


def order_documents(docs: DataFrame, opts: PretokenizeOptions) -> DataFrame:
    """Valid documents with a dense ordinal ``ord`` over the interleaved corpus.

    Blank documents take part in the interleaving and count towards the cap; they are
    dropped after that. The order is worked out on keys and a flag alone; the texts move
    once, to meet their ordinal.
    """
    keys = ["src_ord", "doc_ord"]
    flagged = docs.select(*keys, has_text().alias("valid"))
    sizes = source_sizes(docs)
    mixed = interleave_documents(flagged, stop=opts.interleave, row_bits=LIGHT_BITS, sizes=sizes)
    if opts.max_documents is not None:
        mixed = cap_documents(mixed, opts.max_documents)
    ordinals = dense_ordinal(
        mixed.where("valid").select(*keys, "pos"),
        "pos",
        out="ord",
        row_bits=LIGHT_BITS,
        key_bits=key_bits_for(docs.count() if sizes[0] is None else sum(sizes[0])),
    )
    return spread(docs).join(ordinals.drop("pos"), keys)


def tokenize_documents(docs: DataFrame, opts: PretokenizeOptions) -> DataFrame:
    """Replace ``text`` by ``input_ids``: truncated first, closed with EOS second."""
    opts = with_dictionary(docs, opts)
    if isinstance(opts.tokenizer, str):
        ids = tokenize("text", opts.tokenizer, opts.truncate, opts.eos_id)
        return docs.withColumn("input_ids", ids).drop("text")
    if isinstance(opts.tokenizer, WordModel):
        whole = encode_words(docs, opts.tokenizer)
    else:
        whole = docs.withColumn("input_ids", bpe_ids(docs.sparkSession, opts.tokenizer)).drop("text")
    ids = F.col("input_ids") if opts.truncate is None else truncate("input_ids", opts.truncate)
    return whole.withColumn("input_ids", append_eos(ids, opts.eos_id))


def pretokenize(docs: DataFrame, opts: PretokenizeOptions = PretokenizeOptions()) -> DataFrame:
    """Documents ``(src_ord, doc_ord, text)`` to ``(batch_id, block_ord, ids, mask)``."""
    opts = with_dictionary(docs, opts)
    return _pack(order_documents(docs, opts).select("ord", "text"), opts)


def _pack(placed: DataFrame, opts: PretokenizeOptions, by: Sequence[str] = ()) -> DataFrame:
    """The texts move to their batch before they are tokenized: the token lists, several
    times larger, are then packed where they are made.
    """
    if opts.batch_size and 0 < opts.batch_size <= WINDOW_BATCH:
        batch = batch_of("ord", opts.batch_size)
        placed = placed.withColumn("batch_id", batch).repartition(*by, "batch_id")
    tokens = tokenize_documents(placed, opts)
    return filter_nonempty(pack_blocks(tokens, opts.block_size, opts.batch_size, by=by))


def pretokenize_to_shards(
    docs: DataFrame,
    path: str,
    opts: PretokenizeOptions = PretokenizeOptions(),
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    resume: bool = False,
    batches_per_commit: int | None = None,
    max_commits: int | None = None,
) -> DataFrame:
    """The whole run, from documents to shards with their sidecar; gives the progress table.

    With ``batches_per_commit`` the run saves as it goes, one commit for so many batches, and
    ``resume`` tokenizes only the batches that no commit holds yet; ``max_commits`` stops it
    early. A commit is a job over all cores, so it should hold many batches. Without it the
    whole corpus is one commit. A finished run is not done again.
    """
    spark = docs.sparkSession
    if not resume and has_progress(spark, path):
        raise FileExistsError(f"{path} holds shards already; pass resume=True to go on")
    if "all" in finished_languages(spark, path):
        return progress(spark, path)
    if batches_per_commit is None:
        opts = with_dictionary(docs, opts)
        write_shards(pretokenize_numbered(docs, opts), path, max_samples, resume=resume, ranged=_in_place(opts))
    else:
        _commit_batches(docs, path, opts, max_samples, batches_per_commit, max_commits)
    write_dataset_info(read_committed(spark, path), path)
    return progress(spark, path)


def _commit_batches(docs, path, opts, max_samples, batches_per_commit, max_commits) -> None:
    """Commit after commit, each from its own folder of documents in order."""
    if not opts.batch_size or opts.batch_size <= 0:
        raise ValueError("a run that commits batches needs a batch_size")
    spark = docs.sparkSession
    opts = with_dictionary(docs, opts)  # one for all commits
    span = batches_per_commit * opts.batch_size
    writer = f"batches-{span}"
    made = commits_by_writer(spark, path)
    if made.keys() - {writer}:
        raise ValueError(f"{path} was begun with other batches: {sorted(made)}")
    number = made.get(writer, 0)
    placed = order_documents(docs, opts).select("ord", "text").withColumn("part", F.expr(f"ord div {int(span)}"))
    folder = scratch_path(spark, "ordered")
    wanted = F.col("part") >= number
    if max_commits is not None:  # a run that stops early writes no texts for later ones
        wanted = wanted & (F.col("part") < number + max_commits)
    placed.where(wanted).repartitionByRange("ord").write.partitionBy("part").parquet(folder)
    ordered = spark.read.schema("ord bigint, text string, part bigint").parquet(folder)
    last = (ordered if max_commits is None else placed).agg(F.max("part")).head()[0]
    last = number if last is None else last
    stop = last + 1 if max_commits is None else min(last + 1, number + max_commits)
    for part in range(number, stop):
        docs = ordered.where(F.col("part") == part).drop("part")
        in_place = _in_place(opts)
        blocks = _in_order(docs, opts, (part + 1) * batches_per_commit) if in_place else block_ordinal(stage(_pack(docs, opts), "blocks"))
        commit_once(blocks, path, part, max_samples, writer=writer, done=part == last, ranged=in_place)


def pretokenize_numbered(docs: DataFrame, opts: PretokenizeOptions = PretokenizeOptions()) -> DataFrame:
    """The blocks of ``pretokenize`` with their dense ordinal ``ord``.

    With an expression tokenizer and batches of up to ``WINDOW_BATCH`` documents they lie in partitions by ranges of the
    ordinal: the texts in order are staged, not the blocks, which are several times larger. Other blocks are staged and numbered.
    """
    opts = with_dictionary(docs, opts)
    if not _in_place(opts):
        # The blocks are staged: numbering and writing them reads them twice.
        return block_ordinal(stage(pretokenize(docs, opts), "blocks"))
    ordered = stage(order_documents(docs, opts).select("ord", "text"), "ordered")
    batches = ordered.count() // opts.batch_size + 1
    return _in_order(ordered, opts, batches, min(batches, fine_parts(ordered, TEXT_BYTES)))


def _in_place(opts: PretokenizeOptions) -> bool:
    """Whether blocks can be numbered from the sizes of texts, and each batch is cut in one task."""
    return isinstance(opts.tokenizer, str) and opts.tokenizer != "whitespace" and 0 < (opts.batch_size or 0) <= WINDOW_BATCH


def _in_order(docs: DataFrame, opts: PretokenizeOptions, batches: int, parts: int | None = None) -> DataFrame:
    """The blocks of ``docs`` with their ordinal, in partitions by ranges of it.

    The texts move by ranges of their batch, and the numbers of blocks follow from the numbers of tokens. Counting tokens
    takes less than writing the blocks and moving them, which are several times the texts.
    """
    docs = docs.withColumn("batch_id", batch_of("ord", opts.batch_size))
    n = token_count("text", opts.tokenizer, opts.truncate, opts.eos_id)
    counts = docs.groupBy("batch_id").agg(F.sum(n).alias("n"))
    counts = counts.select("batch_id", F.expr(f"n div {int(opts.block_size)}").alias("__n"))
    # Sorted as texts, so that the token lists need no sort.
    moved = docs.repartitionByRange(*([] if parts is None else [parts]), "batch_id")
    placed = moved.sortWithinPartitions("batch_id", "ord")
    tokens = tokenize_documents(placed, opts)
    blocks = filter_nonempty(pack_blocks(tokens, opts.block_size, opts.batch_size))
    return block_ordinal(blocks, counts=counts, bits=key_bits_for(batches))


def pretokenize_languages_to_shards(
    docs: DataFrame,
    path: str,
    langs: Sequence[str],
    opts: PretokenizeOptions = PretokenizeOptions(),
    max_samples: int = MAX_SAMPLES_PER_SHARD,
    resume: bool = False,
) -> DataFrame | None:
    """One commit per language in list order; ``langs[i]`` names ``src_ord`` ``i``.

    With ``resume`` the languages that are done are neither read nor tokenized again.
    """
    spark = docs.sparkSession
    skip = set(finished_languages(spark, path)) if resume else set()
    todo = [(i, lang) for i, lang in enumerate(langs) if lang not in skip]
    if todo:
        opts = with_dictionary(docs, opts)  # of all languages, also when some are done
        if opts.max_documents is not None:
            docs = cap_documents(concat_ordinal(docs, out="__at"), opts.max_documents, "__at").drop("__at")
            opts = replace(opts, max_documents=None)
        wanted = docs.where(F.col("src_ord").isin([i for i, _ in todo]))
        blocks = stage(pretokenize_by_language(wanted, opts), "blocks")
        parts = ((lang, block_ordinal(blocks.where(F.col("src_ord") == i))) for i, lang in todo)
        write_languages(parts, path, max_samples, resume=resume)
        write_dataset_info(read_committed(spark, path), path)
    return progress(spark, path)


def pretokenize_by_language(
    docs: DataFrame, opts: PretokenizeOptions = PretokenizeOptions()
) -> DataFrame:
    """One language after the other: batches never mix languages.

    ``max_documents`` is a budget over all languages in turn. Gives the block columns
    with ``src_ord`` in front; each language numbers its batches from 0.
    """
    opts = with_dictionary(docs, opts)
    if opts.max_documents is not None:
        docs = cap_documents(concat_ordinal(docs, out="__at"), opts.max_documents, "__at").drop("__at")
    valid = dense_ordinal(filter_valid_text(docs), "doc_ord", by=["src_ord"], out="ord")
    return _pack(valid.select("src_ord", "ord", "text"), opts, by=["src_ord"])
