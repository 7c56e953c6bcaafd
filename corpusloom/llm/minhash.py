"""Near-duplicate groups by HyperMinHash registers, banding and exact confirmation.

Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A
document's set holds its distinct shingles of ``width`` words; with fewer words the whole
sequence is the one shingle; without words the set is empty and linked with nothing.

1. Each of 128 buckets keeps the smallest hash of the set under a hash function of its own,
   compressed to a count of leading zeros and ten mantissa bits (16 bits instead of 64).
   Sharing one hash function among the buckets would leave most buckets of short documents
   empty and lose their links.
2. Equal sets form a class with one representative; copies are never paired.
3. Four registers make a band. Two sets at similarity 0.8 share one of 32 bands but for about
   5 in 10**8 cases. Every representative is paired with the smallest id of each of its bands and,
   in a hashed order of its own for each band, with its predecessor.
4. Registers give a Jaccard estimate, corrected for chance collisions. Pairs estimated
   below ``threshold - 0.15`` (more than four standard deviations) are dropped; all others are
   confirmed on full sets. Links form components.
5. Where a band still holds several components, all pairs of different components in it are
   estimated, in blocks of bounded size inside tasks and each pair in its first shared band
   only. Documents of plausible pairs, not the pairs, are emitted; their full sets meet in
   a second task of bounded bytes, which confirms the pairs and emits links between
   components not yet joined. So no link between different components is lost
   because both its ends failed against their partners of step 3.

Defined cases: null text is empty; a document with an empty set is alone and kept. A row with
a null id is kept, has its set size and no component. Rows with equal ids count as copies of one
document: links of any of them hold for all. Ties go to the smallest id. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm import vector
from corpusloom.llm.components import components
from corpusloom.llm.membership import matching
from corpusloom.session import stage

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
SLACK = 0.15
BLOCK = 1024
SET_BYTES = 16 << 20
PART = 2048

_GAPS = vector.byte_class(b" \t\n\x0b\x0c\r")
_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, ascending."""
    lower = vector.ascii_lower(data)
    starts, _, hashes = vector.words(lower, bounds, ~_GAPS[lower])
    first = np.searchsorted(starts, bounds)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h = hashes[lo:hi]
        n = len(h)
        if n == 0:
            yield h
            continue
        take = min(n, width)
        joined = h[: n - take + 1].copy()
        for k in range(1, take):
            joined = joined * _STEP + h[k : n - take + 1 + k]
        yield np.unique(vector.mix(joined + np.uint64(take)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of each bucket's smallest hash, as 16 bits."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), PART):
        part = hashes[lo : lo + PART]
        scores = part[None, :] * _FACTORS[:, None]
        scores += _SHIFTS[:, None]
        np.minimum(low, scores.min(axis=1), out=low)
    bits = np.maximum(low, np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    return np.minimum(bits - np.uint64(1023 << MANTISSA), np.uint64(0xFFFF)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from register rows, less the collisions expected of unequal minima.

    Two minima of n and m values fall into one register of relative width 2**-10 with
    probability of about 0.72 * 2**-10 * n m / (n + m)**2.
    """
    equal = (a == b).mean(axis=-1)
    n, m = size_a.astype(float), size_b.astype(float)
    chance = 0.72 / (1 << MANTISSA) * n * m / (n + m) ** 2
    return (equal - chance) / (1 - chance)


_SIGNED = "doc_id long, n long, set_a long, set_b long, regs binary"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, set_a, set_b, regs``; equal sets have equal ``(n, set_a, set_b)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            data, bounds = vector.texts(batch.column("text"))
            for lo, hi in vector.groups(bounds):
                sizes, a, b, regs = [], [], [], []
                part = data[bounds[lo] : bounds[hi]]
                for s in shingle_sets(part, bounds[lo : hi + 1] - bounds[lo], width):
                    sizes.append(len(s))
                    a.append(vector.mix(s).sum(dtype=np.uint64))
                    b.append(vector.mix(s * _STEP + np.uint64(1)).sum(dtype=np.uint64))
                    regs.append(registers(s).tobytes() if len(s) else None)
                columns = [
                    ids.slice(lo, hi - lo),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.array(regs, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_a", "set_b", "regs"])
        vector.give_back()

    return docs.mapInArrow(work, _SIGNED)


def band_keys(representatives: DataFrame) -> DataFrame:
    """``id, band, key``: one row for each band."""
    hexed = F.hex("regs")
    step = ROWS * 4
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring(hexed, 1 + i * step, step)) for i in range(BANDS)))
    return representatives.select("id", F.posexplode(keys).alias("band", "key"))


def full_sets(ids: DataFrame, docs: DataFrame, width: int, rows: int) -> DataFrame:
    """``id, items``: the packed full set of each document in ``ids(doc_id)``, a table of ``rows`` rows at most."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = vector.texts(batch.column("text"))
            for lo, hi in vector.groups(bounds):
                part = data[bounds[lo] : bounds[hi]]
                found = shingle_sets(part, bounds[lo : hi + 1] - bounds[lo], width)
                packed = pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), packed], ["id", "items"])
        vector.give_back()

    return matching(docs, ids, "left_semi", rows).mapInArrow(sets, "id long, items binary")


def linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """``100 * both >= percent * either`` of two ascending arrays of distinct hashes."""
    if len(u) > len(v):
        u, v = v, u
    if 100 * len(u) < percent * len(v) or not len(u):
        return False
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    both = int((v[at] == u).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones among pairs ``a, b``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        vector.give_back()

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    full = stage(full_sets(wanted, docs, width, 2 * pairs.count()), "sets")
    left = full.select(F.col("id").alias("a"), F.col("items").alias("sa"))
    right = full.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(compare, "a long, b long")


def _plausible(frame: pd.DataFrame, key: tuple, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers ``i`` and ``js`` of pairs of different components that this unit has to look at."""
    _, band, u, v = key[:4]
    regs = np.frombuffer(b"".join(frame["regs"]), np.uint16).reshape(-1, REGISTERS)
    bands = regs.view(np.uint64)
    n, ids, label, of = (frame[c].to_numpy() for c in ("n", "id", "label", "block"))
    others = np.flatnonzero(of == v)
    for i in np.flatnonzero(of == u):
        js = others[label[others] != label[i]]
        if u == v:
            js = js[ids[js] > ids[i]]
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        if len(js):
            js = js[estimate(regs[js], regs[i], n[js], n[i : i + 1]) >= percent / 100 - SLACK]
            js = js[(bands[js] == bands[i]).argmax(axis=1) == band]
        if len(js):
            yield i, js


def cross_links(open_bands: DataFrame, light: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between different components of bands ``key, band, id, label, blocks``."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    partners = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("block", k).alias("u"), F.greatest("block", k).alias("v")),
    )
    units = open_bands.withColumn("block", block).withColumn("unit", F.explode(partners))
    units = units.select("key", "band", F.col("unit.u").alias("u"), F.col("unit.v").alias("v"), "id", "label", "block")

    def find(key, frame: pd.DataFrame) -> pd.DataFrame:
        pairs = [np.stack([np.full(len(js), i), js]) for i, js in _plausible(frame, key, percent)]
        if not pairs:
            return pd.DataFrame(columns=["key", "band", "u", "v", "sub", "id", "label", "block"])
        at = np.concatenate(pairs, axis=1)
        who = np.unique(at)
        chunk = np.zeros(len(frame), np.int64)
        chunk[who] = np.cumsum(frame["n"].to_numpy()[who] * 8) // SET_BYTES
        many = int(chunk.max()) + 1
        sub = chunk[at].min(axis=0) * many + chunk[at].max(axis=0)
        rows = np.unique(np.stack([np.tile(sub, 2), at.reshape(-1)]), axis=1)
        out = frame.iloc[rows[1]][["key", "band", "u", "v", "id", "label", "block"]].assign(sub=rows[0])
        return out[["key", "band", "u", "v", "sub", "id", "label", "block"]]

    kinds = "key long, band int, u int, v int, sub long, id long, label long, block int"
    found = units.join(light, "id").groupBy("key", "band", "u", "v").applyInPandas(find, kinds)
    found = stage(found, "open")

    def decide(key, frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in frame["items"]]
        ids, label = (frame[c].to_numpy() for c in ("id", "label"))
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        links = []
        for i, js in _plausible(frame, key, percent):
            for j in js:
                a, b = root(label[i]), root(label[j])
                if a != b and linked(sets[i], sets[j], percent):
                    joined[a] = b
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    sets = full_sets(found.select(F.col("id").alias("doc_id")), docs, width, found.count())
    return (
        found.join(light, "id").join(sets, "id")
        .groupBy("key", "band", "u", "v", "sub")
        .applyInPandas(decide, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``."""
    vector.bound_batches(docs.sparkSession)
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(signatures(rows, width), "signatures")
    size = signed.count()  # from the footers, as the counts below
    whole = ["n", "set_a", "set_b"]
    classes = signed.where("n > 0 AND doc_id IS NOT NULL")
    # min over (id, registers): equal sets have equal registers
    found = classes.groupBy(*whole).agg(F.min("doc_id").alias("id"), F.any_value("regs").alias("regs"))
    representatives = stage(found, "classes", size)

    keys = band_keys(representatives)
    shared = keys.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("center"), F.max("id").alias("most")
    )
    shared = shared.where("center < most").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = stage(keys.join(shared.select("key", "band", "center", "blocks"), ["key", "band"]), "bands", BANDS * size)
    star = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b"))
    order = W.partitionBy("key", "band", "part").orderBy(F.xxhash64("id", "key"), "id")
    chain = (
        members.withColumn("part", F.pmod(F.xxhash64("key", "id"), F.col("blocks")))
        .withColumn("last", F.lag("id").over(order))
        .where("last IS NOT NULL")
        .select(F.least("id", "last").alias("a"), F.greatest("id", "last").alias("b"))
    )
    first_pairs = star.union(chain).distinct()

    light = representatives.select("id", "n", "regs")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for c in ("ra", "rb")
                )
                n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
                good = (estimate(x, y, n, m) >= threshold - SLACK) & (
                    100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                )
                yield batch.select(["a", "b"]).filter(pa.array(good))

    def side(name: str, to: str) -> DataFrame:
        return light.select(F.col("id").alias(name), F.col("n").alias(f"n{to}"), F.col("regs").alias(f"r{to}"))

    estimated = (
        first_pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").select("a", "b", "na", "nb", "ra", "rb")
        .mapInArrow(plausible, "a long, b long")
    )
    pairs = stage(estimated, "pairs", 2 * members.count())
    links = stage(confirm(pairs, rows, width, percent), "links")
    labels = components(links, rows=links.count())

    # Bands that still hold several components
    placed = members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
    mixed = placed.groupBy("key", "band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    open_bands = placed.join(mixed.select("key", "band"), ["key", "band"]).select("key", "band", "id", "label", "blocks")
    more = stage(cross_links(open_bands, light, rows, width, percent), "links")
    if more.limit(1).count():
        # Joins of whole components: contract to their labels, then follow both steps.
        to = labels.select("id", "component")
        ends = more.join(to.toDF("a", "ca"), "a", "left").join(to.toDF("b", "cb"), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        above = components(ends, rows=more.count())
        lone = above.join(to.select("id"), "id", "left_anti")
        labels = (
            labels.join(above.toDF("component", "up"), "component", "left")
            .select("id", F.coalesce("up", "component").alias("component"))
            .unionByName(lone)
        )
        labels = stage(labels, "labels", size)

    # Copies, then rows with equal ids, follow their class.
    joined = classes.select("doc_id", *whole).join(representatives.select("id", *whole), whole).select("doc_id", "id")
    member = joined.join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    repeated = signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 AND doc_id IS NOT NULL").limit(1).count()
    if repeated:
        member = components(
            member.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
            .union(member.select(F.col("component").alias("a"), F.col("component").alias("b")))
        ).select(F.col("id").alias("doc_id"), "component")
    member = member.dropDuplicates(["doc_id"])
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"),
    ).withColumn("kept", F.coalesce("kept", F.lit(True)))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group; rows whose id is null stay."""
    found = stage(near_duplicates(docs, width, percent).select("doc_id", "kept"), "kept")
    left = matching(docs, found.where("NOT kept"), "left_anti", found.count())
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    if ids.where("c > 1").limit(1).count() == 0:
        return left
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(left.where("doc_id IS NULL"))


def op10_hyperminhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4, percent=80)


# Every pair of sets that share a shingle, counted in full; components by recursion.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * common >= 80 * (na.n + nb.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
