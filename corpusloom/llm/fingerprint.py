"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two primes near 2**31, the prefix sums of ``c[i] * base**i``. Any
span's hash is one subtraction and one multiplication, so span equality is O(1) and the
longest common extension of two positions is a binary search.

A fingerprint is ``length.hash.sketch``: code points, the whole-text hash, and the smallest
``SKETCH`` hashes of all spans of ``SPAN`` code points (the whole text where it is shorter).
``likeness`` estimates the share of common spans (twice the Jaccard estimate over one plus
it), so a text whose second half was replaced scores about one half.

Defined cases: null text is empty; the empty text has an empty sketch, is wholly like another
empty text and unlike any other. Rows with equal ids follow each other by text. A null id comes
before all others. A single row is its own successor. An empty table gives an empty result.
Columns of ``docs`` other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 16
SKETCH = 64
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CUTS_PER_PARTITION = 4
MAX_CUTS = 8192

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo prime ``k`` for ``i < n``, grown by doubling."""
    p = np.uint64(PRIMES[k])
    if k not in _tables:
        _tables[k] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    while len(_tables[k][0]) < n:
        size = len(_tables[k][0])
        factors = (pow(BASES[k], size, PRIMES[k]), pow(BASES[k], -size, PRIMES[k]))
        _tables[k] = tuple(
            np.concatenate([t, t * np.uint64(f) % p]) for t, f in zip(_tables[k], factors, strict=True)
        )
    return _tables[k][0][:n], _tables[k][1][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Modular prefix arrays of one text."""

    def __init__(self, text: str):
        points = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix, self.down = [], []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            up, down = _powers(k, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * up[:-1] % p, out=sums[1:])
            self.prefix.append(sums % p)
            self.down.append(down)

    def spans(self, starts, ends) -> np.ndarray:
        """62-bit hashes of ``[start, end)``; equal spans have equal hashes wherever they lie."""
        out = []
        for prime, sums, down in zip(PRIMES, self.prefix, self.down, strict=True):
            p = np.uint64(prime)
            out.append((sums[ends] + p - sums[starts]) % p * down[starts] % p)
        return out[0] << np.uint64(31) | out[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def whole(self) -> int:
        return self.span(0, self.n)


def span_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension of ``a[i:]`` and ``b[j:]``."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if span_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(h: PrefixHash) -> np.ndarray:
    """The smallest mixed span hashes, ascending, as 32-bit values."""
    if h.n == 0:
        return np.zeros(0, np.uint32)
    width = min(SPAN, h.n)
    starts = np.arange(h.n - width + 1)
    mixed = h.spans(starts, starts + width) * np.uint64(0x9E3779B97F4A7C15)
    short = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    values = short.astype(np.uint32)
    keep = SKETCH * 4
    if len(values) > keep:
        # spans repeat: take more than needed, and all of them if too few are distinct
        part = np.unique(np.partition(values, keep)[:keep])
        if len(part) < SKETCH:
            part = np.unique(values)
        values = part
    else:
        values = np.unique(values)
    return values[:SKETCH]


def render(h: PrefixHash, values: np.ndarray) -> str:
    return f"{h.n:x}.{h.whole():016x}." + values.astype(">u4").tobytes().hex()


def parse(fingerprint: str) -> tuple[int, int, np.ndarray]:
    n, whole, values = fingerprint.split(".")
    return int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(values), ">u4").astype(np.uint32)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Share of spans in common, 0 to 1, from two parsed fingerprints."""
    if a[:2] == b[:2]:
        return 1.0
    if not len(a[2]) or not len(b[2]):
        return 0.0
    union = np.union1d(a[2], b[2])[:SKETCH]
    both = np.intersect1d(np.intersect1d(a[2], b[2], assume_unique=True), union, assume_unique=True)
    jaccard = len(both) / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(doc_id, text: str, own, following) -> dict:
    """``own`` and ``following``: (text, hash, sketch) of the row and its successor."""
    _, h, values = own
    changed = edited(text, following[0])
    other = PrefixHash(changed)
    other_values = sketch(other)
    me = (h.n, h.whole(), values)
    return {
        "doc_id": doc_id,
        "n_chars": h.n,
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": render(h, values),
        "edited_fingerprint": render(other, other_values),
        "near_edited": likeness(me, (other.n, other.whole(), other_values)),
        "near_next": likeness(me, (following[1].n, following[1].whole(), following[2])),
        "common_edited": common_extension(h, 0, other, 0),
        "common_next": common_extension(h, 0, following[1], 0),
    }


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)
_OUT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("common_edited", pa.int64()), ("common_next", pa.int64())]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place; the last row of a range is only a successor."""
    held = None
    rows: list[dict] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            columns = (part.column(c).to_pylist() for c in ("part", "lent", "doc_id", "text"))
            for part_no, lent, doc_id, text in zip(*columns, strict=True):
                h = PrefixHash(text)
                now = (text, h, sketch(h))
                if held is not None and held[0] == part_no:
                    rows.append(_compare(held[1], held[2][0], held[2], now))
                held = None if lent else (part_no, doc_id, now)
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema=_OUT_ARROW)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_OUT_ARROW)


def _cut_points(docs: DataFrame) -> list[int]:
    """Ids that cut the table into ranges of about equal row counts; null where there is none."""
    spark = docs.sparkSession
    wanted = min(MAX_CUTS, CUTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / wanted for i in range(1, wanted)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * wanted).alias("q")).first()["q"]
    return sorted(set(found or []))


def _range_of(cuts: list[int]) -> Column:
    """Number of cuts at or below ``doc_id``, found by halving; a null id lies below all."""

    def below(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        middle = (lo + hi) // 2
        return f"IF(doc_id >= {cuts[middle]}, {below(middle + 1, hi)}, {below(lo, middle)})"

    return F.expr(f"IF(doc_id IS NULL, 0, {below(0, len(cuts))})")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare it with both and with its successor.

    Texts move once: to a range of adjacent ids. The first row of each range also goes, as
    a successor only, to the range before it (the very first row to the last range), so no
    task needs another's rows. The ranges' first rows are found on ids alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = _cut_points(rows)
    placed = rows.withColumn("part", _range_of(cuts))
    # One light row per range, at most MAX_CUTS of them: its smallest id.
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    found = placed.groupBy("part").agg(F.min(order).alias("head")).collect()
    heads = sorted((r["part"], r["head"]["doc_id"]) for r in found)
    table = spark.createDataFrame(
        [(part, head, heads[i - 1][0]) for i, (part, head) in enumerate(heads)],
        "part int, head long, to_part int",
    )
    mark = F.xxhash64("text")
    firsts = (
        placed.join(F.broadcast(table), "part")
        .where(F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("part")
        .agg(F.min_by(F.struct("doc_id", "text", "to_part"), mark).alias("f"))
        .select(F.col("f.to_part").alias("part"), F.lit(True).alias("lent"), "f.doc_id", "f.text")
    )
    moved = placed.select("part", F.lit(False).alias("lent"), "doc_id", "text").unionByName(firsts)
    ordered = moved.repartition("part").sortWithinPartitions(
        "part", "lent", F.col("doc_id").asc_nulls_first(), F.when(~F.col("lent"), F.xxhash64("text"))
    )
    return ordered.mapInArrow(_walk, OUT)


def op1_prefix_hash(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
