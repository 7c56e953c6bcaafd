"""Benchmark decontamination by template windows.

Words lose their case and punctuation; numbers, names (words with a capital first letter) and
units (a unit word right after a number) become typed placeholders. Windows of ``WINDOW``
template words, at least five eighths of them literal, are hash-joined between benchmark and
documents. A joined window counts if its literals are equal and its slots have equal types.
In the windows of a document and an item on one alignment, four fifths of the names and units
must follow the benchmark's: equal ones stand for equal ones. Numbers are free, since equal
numbers may merely coincide, and so are names that open a sentence; two benchmark values may become one. An
alignment with ``VERBATIM_WINDOWS`` windows equal word for word counts as it is. So a question
asked again with other numbers or names is found, a chance likeness with mixed-up slots is not.

Document windows are checked against a bitmap of the benchmark's window hashes before they
are emitted; the bitmap has a fixed size, so it can be sent to every task however large the
benchmark is. Benchmark items shorter than the window are matched by windows of their length.
Windows that are not literal enough, in the item or in the document (all capitals, say), are
joined on their words in lower case, so exact copies of them are found.

An item is found by two windows, or by one if it has no more. ``drop_contaminated`` asks for more:
a third of the item's words or ``DROP_WORDS`` words, and of an item shorter than the window at least
``SHORT_LITERALS`` literal words.

Defined cases: null text is empty and matches nothing. Null ids of documents or items are kept apart from all others by null-safe
grouping and reported as null. Repeated rows and ids are merged into one result row. Empty
tables give empty results. Other columns are not read; ``drop_contaminated`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import vector
from corpusloom.llm.membership import matching
from corpusloom.session import stage

WINDOW = 8
LITERAL_SHARE = (5, 8)
LEAST_WINDOWS = 2
SLOT_SHARE = (4, 5)
VERBATIM_WINDOWS = 12
DROP_SHARE = (1, 3)
DROP_WORDS = 50
SHORT_LITERALS = 5
BITS = 1 << 24
PAGE = 32768
GROUP_BYTES = 1 << 20

# Unit words that count as units after a number.
UNITS = (
    "mm cm dm m km in inch inches ft feet foot yard yards mile miles mg g kg t ton tons oz ounce ounces lb lbs pound pounds "
    "ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week "
    "weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp degrees degree watt watts volt "
    "volts kb mb gb tb mph kmh hz khz mhz ghz people persons times"
).split()

_DIGIT = vector.byte_class(b"0123456789")
_LETTER = vector.byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_JOINT = vector.byte_class(b".,")
_STOP = vector.byte_class(b".!?:\n")
_CAPITAL = vector.byte_class(bytes(range(65, 91)))
_SLOTS = vector.mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_STEP = np.uint64(0xE7037ED1A0B428DB)
TYPES = "wnNuO"  # literal word, number, name, unit, name that opens a sentence


def template(data: np.ndarray, bounds: np.ndarray):
    """Start, end, type, template hash and own hash of each word, and the first word of each row."""
    lower = vector.ascii_lower(data)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    upper_latin = second & (data >= 0x80) & (data <= 0x9E)
    lower[upper_latin] += 0x20
    digit = _DIGIT[data]
    joint = _JOINT[data]
    joint[:-1] &= digit[1:]
    joint[1:] &= digit[:-1]
    if len(joint):
        joint[0] = joint[-1] = False
    word = _LETTER[data] | digit | joint
    starts, ends, hashes = vector.words(lower, bounds, word)
    other = np.concatenate([[0], np.cumsum(~(digit | joint))])
    number = other[ends] == other[starts]
    name = _CAPITAL[data[starts]] | np.append(upper_latin, False)[np.minimum(starts + 1, len(data))]
    kind = np.where(number, 1, np.where(name, 2, 0))
    row = np.searchsorted(bounds, starts, "right")
    unit = np.zeros(len(starts), bool)
    if len(starts) > 1:
        unit[1:] = number[:-1] & (row[1:] == row[:-1]) & np.isin(hashes[1:], _unit_hashes())
    kind[unit] = 3
    shape = np.where(kind > 0, _SLOTS[np.maximum(kind, 1) - 1], hashes)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(starts), bool)
    opens[1:] = (stops[starts[1:]] > stops[ends[:-1]]) | (row[1:] != row[:-1])
    kind[opens & (kind == 2)] = 4
    return starts, ends, kind, shape, hashes, np.searchsorted(starts, bounds)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(vector.hash_words(UNITS))
    return _units[0]


def _windows(kind, shape, plain, first, width):
    """Places where a window of ``width`` words lies in one row, whether it is literal enough, its template and its words hashed."""
    n = len(shape) - width + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, bool), none, none
    row = np.searchsorted(first, np.arange(len(shape)), "right")
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    rich = (literal[width:] - literal[:-width]) * LITERAL_SHARE[1] >= LITERAL_SHARE[0] * width

    def rolled(words):
        hashes = words[:n].copy()
        for k in range(1, width):
            hashes = hashes * _STEP + words[k : n + k]
        return hashes[at] + np.uint64(width)

    return at, rich[at], vector.mix(rolled(shape)), rolled(plain)


def _texts_of(lower_text: bytes, starts, ends, kind) -> list[str]:
    return [
        TYPES[k] + lower_text[a:b].decode("utf-8", "replace").lower()
        for a, b, k in zip(starts.tolist(), ends.tolist(), kind.tolist(), strict=True)
    ]


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds each hash."""
    place = hashes % np.uint64(BITS)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _keys(rich, template_hash, plain, asked: bool):
    """Index and key of each window to join on.

    Literal windows meet on the template. Where either side is not literal enough, the words
    themselves decide: an item's window is asked for by documents' poor windows, and if it is
    poor by their literal ones too.
    """
    for_poor, for_rich = vector.mix(plain + np.uint64(1 << 32)), vector.mix(plain + np.uint64(2 << 32))
    every = np.arange(len(rich))
    if not asked:
        return np.concatenate([every, every[rich]]), np.concatenate([np.where(rich, template_hash, for_poor), for_rich[rich]])
    return (
        np.concatenate([every[rich], every, every[~rich]]),
        np.concatenate([template_hash[rich], for_poor, for_rich[~rich]]),
    )


OUT = "id long, width int, place int, hash long, words array<string>, total int, rich int"


def windows(rows: DataFrame, widths: list[int] | None, bitmap=None) -> DataFrame:
    """Windows of ``rows(id, text)``; without ``widths`` each row's ``min(WINDOW, its words)``.

    With ``bitmap`` only those whose hash it holds. ``total`` words and ``rich`` windows belong to the row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        for batch in batches:
            ids = batch.column("id").to_pylist()
            data, bounds = vector.texts(batch.column("text"))
            for lo, hi in vector.groups(bounds, GROUP_BYTES):
                part = data[bounds[lo] : bounds[hi]]
                starts, ends, kind, shape, plain, first = template(part, bounds[lo : hi + 1] - bounds[lo])
                own = np.diff(first)
                raw = part.tobytes()
                out = []
                for width in widths or sorted({min(WINDOW, int(n)) for n in own} - {0}):
                    at, rich, *hashed = _windows(kind, shape, plain, first, width)
                    of_row = np.bincount(np.searchsorted(first, at[rich], "right") - 1, minlength=len(own))
                    which, hashes = _keys(rich, *hashed, widths is None)
                    keep = np.ones(len(which), bool) if bits is None else _held(bits, hashes)
                    which, hashes = which[keep], hashes[keep]
                    row = np.searchsorted(first, at[which], "right") - 1
                    if widths is None:
                        fits = np.minimum(WINDOW, own[row]) == width
                        which, hashes, row = which[fits], hashes[fits], row[fits]
                    for i, h, r in zip(at[which].tolist(), hashes.view(np.int64).tolist(), row.tolist(), strict=True):
                        span = slice(i, i + width)
                        words = _texts_of(raw, starts[span], ends[span], kind[span])
                        out.append((ids[lo + r], width, i - int(first[r]), h, words, int(own[r]), int(of_row[r])))
                if out:
                    a, b, c, d, e, f, g = zip(*out, strict=True)
                    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32())]
                    columns += [pa.array(d, pa.int64()), pa.array(e, pa.list_(pa.string()))]
                    columns += [pa.array(f, pa.int32()), pa.array(g, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "width", "place", "hash", "words", "total", "rich"])
        vector.give_back()

    vector.bound_batches(rows.sparkSession)
    return rows.mapInArrow(work, OUT)


def _bitmap(windows_of_items: DataFrame):
    """Which hashes modulo ``BITS`` occur, as 2 MB whatever the number of windows."""
    place = F.pmod(F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)"), F.lit(BITS)).cast("long")
    pages = (
        windows_of_items.select(place.alias("h"))
        .groupBy(F.floor(F.col("h") / PAGE).cast("int").alias("page"))
        .agg(F.bitmap_construct_agg(F.col("h") % PAGE).alias("bits"))
        .collect()
    )
    out = bytearray(BITS // 8)
    for r in pages:
        out[r["page"] * (PAGE // 8) : (r["page"] + 1) * (PAGE // 8)] = r["bits"]
    return windows_of_items.sparkSession.sparkContext.broadcast(bytes(out))


def _type(word):
    return F.translate(F.substring(word, 1, 1), "O", "N")


def _value(word):
    return F.substring(word, 2, 1 << 30)


def _following(slots: str):
    """How many slots have the document value that their benchmark value has most often."""
    state = "struct<words:string,said:string,run:int,best:int,sum:int>"

    def step(s, x):
        known = s["words"].eqNullSafe(x["words"])
        run = F.when(known & s["said"].eqNullSafe(x["said"]), s["run"] + 1).otherwise(1)
        best = F.when(known, F.greatest(s["best"], run)).otherwise(1)
        total = F.when(known, s["sum"]).otherwise(s["sum"] + s["best"])
        return F.struct(
            x["words"].alias("words"), x["said"].alias("said"), run.alias("run"), best.alias("best"), total.alias("sum")
        ).cast(state)

    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("words", "said")], *[F.lit(0).alias(c) for c in ("run", "best", "sum")])
    return F.aggregate(F.array_sort(slots), none.cast(state), step, lambda s: s["sum"] + s["best"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """``doc_id, item_id, windows, exact``: matched windows, and whether all slots have the benchmark's values."""
    return measured_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select("doc_id", "item_id", "windows", "exact")


def measured_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """``find_leaks`` with ``covered`` of the item's ``total`` words, and the ``literals`` of its windows at most."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    asked = stage(windows(items, None), "items")
    widths = sorted(r["width"] for r in asked.select("width").distinct().collect())  # at most WINDOW
    held = windows(rows, widths or [WINDOW], _bitmap(asked)).select(
        F.col("id").alias("doc_id"), F.col("place").alias("at"), "width", "hash", F.col("words").alias("said")
    )
    wanted = asked.select(F.col("id").alias("item_id"), "place", "width", "hash", "words", "total", "rich")
    pairs = F.arrays_zip("words", "said")
    equal = F.forall(pairs, lambda x: _value(x["words"]) == _value(x["said"]))
    alike = F.forall(
        pairs,
        lambda x: (_type(x["words"]) == _type(x["said"])) & (~x["words"].startswith("w") | (x["words"] == x["said"])),
    )
    joined = held.join(wanted, ["hash", "width"]).where(alike | equal)
    bound = F.filter(
        F.transform(pairs, lambda x, i: F.struct(x["words"].alias("words"), x["said"].alias("said"), (F.col("place") + i).alias("at"))),
        lambda x: x["words"].rlike("^[Nu]") & x["said"].rlike("^[Nu]"),
    )
    literals = F.size(F.filter("words", lambda w: w.startswith("w")))
    full = literals * LITERAL_SHARE[1] >= F.col("width") * LITERAL_SHARE[0]
    aligned = (
        joined.select(
            "doc_id", "item_id", "place", "width", "total", "rich", (F.col("at") - F.col("place")).alias("shift"),
            bound.alias("slots"), equal.alias("equal"), literals.alias("literals"), full.alias("full"),
        )
        .groupBy("doc_id", "item_id", "shift")
        .agg(
            F.collect_set("place").alias("places"),
            F.size(F.collect_set(F.when(F.col("equal"), F.col("place")))).alias("verbatim"),
            F.size(F.collect_set(F.when(F.col("full"), F.col("place")))).alias("literal"),
            F.bool_and("equal").alias("exact"),
            F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
            *[F.min(c).alias(c) for c in ("width", "total", "rich")],
            F.max("literals").alias("literals"),
        )
        .withColumn("windows", F.size("places"))
    )
    follow = _following("slots") * SLOT_SHARE[1] >= F.size("slots") * SLOT_SHARE[0]
    consistent = aligned.where(follow | (F.col("verbatim") >= VERBATIM_WINDOWS)).where(
        (F.col("windows") >= F.least(F.lit(LEAST_WINDOWS), F.col("total") - F.col("width") + 1))
        | (F.col("rich") > 0) & (F.col("literal") >= F.least(F.lit(LEAST_WINDOWS), F.col("rich")))
    )
    gaps = F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.col("width")), F.col("width")))
    return (
        consistent.groupBy("doc_id", "item_id")
        .agg(
            F.sum("windows").cast("long").alias("windows"),
            F.bool_or("exact").alias("exact"),
            F.collect_set("places").alias("places"),
            *[F.min(c).alias(c) for c in ("width", "total")],
            F.max("literals").alias("literals"),
        )
        .withColumn("places", F.array_sort(F.array_distinct(F.flatten("places"))))
        .withColumn("covered", F.aggregate(gaps, F.lit(0), lambda a, x: a + x))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, or enough of its words."""
    enough = (F.col("covered") * DROP_SHARE[1] >= F.col("total") * DROP_SHARE[0]) | (F.col("covered") >= DROP_WORDS)
    long_or_literal = (F.col("total") >= WINDOW) | (F.col("literals") >= SHORT_LITERALS)
    return matching(docs, measured_leaks(docs, benchmark).where(enough & long_or_literal), "left_anti")


def op2_template_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
