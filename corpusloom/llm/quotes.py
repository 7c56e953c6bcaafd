"""Quotation linking in conversations, from built-in expressions only.

A line's quote level is the number of ``>`` before its text. Runs of lines of one level are
passages; level 0 is the message's own text, without attribution lines ("... wrote:") right before a
quote. Quoted passages, their paragraphs and each of their lines are normalised (lower case, single spaces)
and hashed; the same units of every message's own text are hashed too. A quote links to the
first message of its own conversation that says it earlier, else to the earliest message
of any other (lowest conversation, then turn). The two lowest conversations of each hash are looked up in
one row, so a passage that everybody quotes joins one original only. A message answers the message its lowest quote
level links to, whole passages before paragraphs and lines, and longer units before shorter ones.

Threads follow these links inside a conversation. Messages are ordered by their thread's
first turn, then by turn: reply order. Messages without quotes keep their turn's place.

Defined cases: null text is empty; a message of quotes only has empty own text; a null
conversation is one of its own, a null turn comes before turn 0. Repeated rows keep one row each
and are ordered by role and text hash. Units without a letter or digit link to nothing. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.interleave import running_number
from corpusloom.session import stage

TURNS = 256

# A quote mark at the start of a line, and lines that introduce a quote.
MARK = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?i)^.{0,200}(?:wrote|writes|said|schrieb|écrit|escribió)[^\n]{0,80}:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(text: Column) -> Column:
    """Lines as structs ``level, line``."""
    lines = F.split(text, "\n", -1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARK, "").alias("line"),
        ),
    )


def own_text(lines: Column) -> Column:
    """Level-0 lines without attributions, trimmed."""
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    return F.trim(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level above 0, as structs ``level, lines``; every line is copied once."""
    level = lambda i: F.get(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    bounds = F.arrays_zip(
        starts.alias("start"), F.concat(F.slice(starts, 2, F.size(lines)), F.array(F.size(lines))).alias("end")
    )
    quoted = F.filter(bounds, lambda r: level(r["start"]) > 0)
    return F.transform(
        quoted,
        lambda r: F.struct(
            level(r["start"]).alias("level"),
            F.transform(F.slice(lines, r["start"] + 1, r["end"] - r["start"]), lambda x: x["line"]).alias("lines"),
        ),
    )


def _unit(text: Column, whole: Column) -> Column:
    normal = _normal(text)
    return F.struct(whole.alias("whole"), F.length(normal).alias("size"), F.md5(normal).alias("hash"), normal.rlike("[\\p{L}\\p{N}]").alias("says"))


def link(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` give own text, what each message answers, and its place.

    Columns: ``conv_id, turn, role, own, n_quotes, n_linked, reply_conv, reply_turn, thread, place``.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns(
        {
            "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
            "_turn": F.coalesce("turn", F.lit(-1)),
            "_tie": F.xxhash64(F.coalesce("role", F.lit("")), "text"),
        }
    )
    quoting = F.col("text").rlike("(?m)" + MARK)
    parsed = rows.withColumn("_lines", F.when(quoting, parse(F.col("text"))))
    parsed = parsed.withColumn(
        "own", F.when(quoting, own_text(F.col("_lines"))).otherwise(F.trim(F.col("text"), F.lit(" \t\r\n")))
    )
    key = ["_conv", "_turn", "_tie"]
    passages = (
        parsed.where(quoting)
        .dropDuplicates(key)
        .select(*key, F.posexplode(_passages(F.col("_lines"))).alias("passage", "run"))
        .select(*key, "passage", "run.level", "run.lines")
    )
    paragraphs = F.split(F.array_join("lines", "\n"), r"\n\s*\n")
    units = F.concat(
        F.array(_unit(F.array_join("lines", " "), F.lit(True))),
        F.transform(F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.array().cast("array<string>")), lambda x: _unit(x, F.lit(False))),
        F.transform("lines", lambda x: _unit(x, F.lit(False))),
    )
    asked = passages.select(*key, "passage", "level", F.explode(units).alias("u")).where("u.says")
    asked = stage(asked.select(*key, "passage", "level", "u.whole", "u.size", "u.hash"), "quotes")

    own_units = F.concat(
        F.array(F.col("own")), F.split("own", r"\n\s*\n"), F.split("own", r"\n")
    )
    hashes = F.array_distinct(F.transform(own_units, lambda x: F.md5(_normal(x))))
    # Only hashes that some quote asks for go on.
    said = (
        parsed.select("_conv", "_turn", "conv_id", F.explode(hashes).alias("hash"))
        .join(asked.select("hash").distinct(), "hash", "left_semi")
    )
    first = said.groupBy("_conv", "hash").agg(F.min("_turn").alias("near"), F.first("conv_id").alias("conv_id"))
    # Each task passes on two rows of a hash at most.
    lowest = first.withColumn("at", F.row_number().over(W.partitionBy("hash").orderBy("conv_id", "_conv"))).where("at <= 2")
    message = F.struct("conv_id", "_conv", "near")
    anywhere = lowest.groupBy("hash").agg(F.min(message).alias("far"), F.max(message).alias("farther"))
    found = asked.join(first.select("_conv", "hash", "near"), ["_conv", "hash"], "left").join(anywhere, "hash", "left")
    in_conv = F.col("near") < F.col("_turn")
    other = F.when(F.col("far._conv") != F.col("_conv"), F.col("far")).when(F.col("farther._conv") != F.col("_conv"), F.col("farther"))
    found = found.withColumn("other", other)
    elsewhere = F.col("other").isNotNull()
    found = found.select(
        *key, "passage", "level", "whole", "size",
        F.when(in_conv, F.col("_conv")).when(elsewhere, F.col("other._conv")).alias("to_conv"),
        F.when(in_conv, F.col("near")).when(elsewhere, F.col("other.near")).alias("to_turn"),
    )
    linked = F.col("to_conv").isNotNull()
    # The best unit decides: lowest level, whole passages first, then the longest, then the first.
    best = F.min(
        F.when(linked, F.struct("level", (~F.col("whole")).alias("part"), (-F.col("size")).alias("less"), "passage", "to_turn", "to_conv"))
    )
    answers = found.groupBy(*key).agg(
        F.countDistinct("passage").alias("n_quotes"),
        F.countDistinct(F.when(linked, F.col("passage"))).alias("n_linked"),
        best.alias("best"),
    )
    placed = parsed.drop("_lines", "text").join(
        answers.select(*key, "n_quotes", "n_linked", F.col("best.to_conv").alias("_to_conv"), F.col("best.to_turn").alias("_to_turn")),
        key,
        "left",
    )
    roots = _threads(placed.where(F.col("_to_conv") == F.col("_conv")).groupBy("_conv", "_turn").agg(F.min("_to_turn").alias("up")))
    threaded = placed.join(roots, ["_conv", "_turn"], "left").withColumn("_root", F.coalesce("_root", "_turn"))
    numbered = running_number(
        threaded.withColumn("_bucket", F.floor(F.col("_root") / TURNS)),
        ["_conv"], "_bucket", [F.col("_root"), F.col("_turn"), F.col("_tie")], "_place",
    )
    return numbered.select(
        "conv_id", "turn", "role", "own",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.expr("nullif(_to_conv, '')").cast("long").alias("reply_conv"),
        F.expr("nullif(_to_turn, -1)").cast("long").alias("reply_turn"),
        F.col("_root").alias("thread"),
        (F.col("_place") - 1).cast("long").alias("place"),
    )


def _threads(ups: DataFrame) -> DataFrame:
    """``_conv, _turn, _root``: the first turn each chain of answers leads to, by jumping twice as far each round."""
    labels = stage(ups.select("_conv", "_turn", F.col("up").alias("_root")), "threads")
    while True:
        via = labels.select("_conv", F.col("_turn").alias("_root"), F.col("_root").alias("further"))
        jumped = stage(labels.join(via, ["_conv", "_root"], "left").select("_conv", "_turn", F.coalesce("further", "_root").alias("_root"), F.col("further").isNotNull().alias("moved")), "threads")
        labels = jumped.drop("moved")
        if jumped.where("moved").limit(1).count() == 0:
            return labels


def op5_quotation_links(spark, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = link(messages)
    return found.select(
        "conv_id", "turn", "role", F.length("own").cast("long").alias("n_chars"), F.md5("own").alias("own_md5"),
        "n_quotes", "n_linked", "reply_conv", "reply_turn", "thread", "place",
    )
