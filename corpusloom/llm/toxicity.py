"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon, closeness of its hits to second-person words, shares of
capitals and punctuation, and rates of obfuscated spelling. The lexicon is a short fixed list
plus words and word beginnings that stand out in toxic training documents (signed
log-likelihood ratio at least ``LEAST_RATIO``); entries are hashes with log-odds weights, at most
``LEXICON``. Trees and calibration are fitted on at most ``SAMPLE`` labelled documents, those
with the smallest hashed ids; one of ``PARTS`` parts of them, chosen by another hash, is for calibration only.
For fitting, the features of each part come from a lexicon learned on the others; scores use the one of all.
Labels of held-out rows (crc32 of the id as text modulo 3 is 1) are never read.

Defined cases: null text is empty and scored like any other; labels that are null or neither 0
nor 1 are left out, of several labels of one id the largest counts. Without labels of
both classes every score is 0. A null id is scored and not held out. Other columns, whatever their
names, are passed on by ``score``; one named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import vector
from corpusloom.session import stage

SAMPLE = 12_000
LEXICON = 20_000
PARTS = 3
LEAST_RATIO = 25.0
LEAST_ODDS = 1.5
GROUP_BYTES = 1 << 20
BEGINNING = 5
NEAR = 5
CUT = 0.7

# Common insults, second-person words, and look-alike characters.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool dumb ugly hate jerk".split()
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti".split()
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

FEATURES = [
    "f_words", "f_hits", "f_hit_rate", "f_weight_rate", "f_weight_most", "f_strong_rate", "f_begin_rate", "f_begin_weight",
    "f_second_rate", "f_second_near", "f_capitals", "f_shouted", "f_punctuation", "f_exclaims", "f_digits",
    "f_mixed", "f_disguised", "f_spaced", "f_word_length",
]

_LETTER = vector.byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = vector.byte_class(b"0123456789")
_WORD = _LETTER | _DIGIT
_LOOK = vector.byte_class("".join(LOOK_ALIKES).encode())
_PLAIN = np.arange(256, dtype=np.uint8)
for _from, _to in LOOK_ALIKES.items():
    _PLAIN[ord(_from)] = ord(_to)
_CAPITAL = vector.byte_class(bytes(range(65, 91)))
_GAP = vector.byte_class(b" \t\n\x0b\x0c\r")
_PUNCTUATION = ~(_WORD | _GAP)
_EXCLAIM = vector.byte_class(b"!?")


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE in lower case."""
    out = vector.ascii_lower(data)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    out[second & (data >= 0x80) & (data <= 0x9E)] += 0x20
    return out


def _beginnings(lower, bounds, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the first bytes of longer words."""
    begin = starts[ends - starts > BEGINNING]
    mask = np.zeros(len(lower), bool)
    for k in range(BEGINNING):
        mask[begin + k] = True
    at, _, hashes = vector.words(lower, bounds, mask)
    return at, hashes ^ np.uint64(1)


def _held(lexicon, hashes: np.ndarray) -> np.ndarray:
    """Weight of each hash, 0 where the lexicon does not hold it."""
    keys, weights = lexicon
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, weights[at], 0.0)


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _features(data: np.ndarray, bounds: np.ndarray, lexicon) -> np.ndarray:
    rows = len(bounds) - 1
    lower = _lower(data)
    starts, ends, hashes = vector.words(lower, bounds, _WORD[lower])
    doc = np.searchsorted(bounds, starts, "right") - 1
    per = lambda d, w=None: np.bincount(d, w, rows)
    byte_doc = np.repeat(np.arange(rows, dtype=np.int32), np.diff(bounds))
    share = lambda table, of=data: per(byte_doc[table[of]])
    words = np.maximum(per(doc), 1.0)
    size = np.maximum(np.diff(bounds), 1.0)
    weight = _held(lexicon, hashes)
    hit = weight > 0
    begin_at, begin_hash = _beginnings(lower, bounds, starts, ends)
    begin_doc = np.searchsorted(bounds, begin_at, "right") - 1
    begin_weight = _held(lexicon, begin_hash)
    second = np.isin(hashes, _second_person())
    # Words from each hit to the nearest second-person word of the same text
    place, at = np.flatnonzero(hit), np.flatnonzero(second)
    near = np.zeros(len(place), bool)
    if len(at):
        for side in (np.searchsorted(at, place) - 1, np.searchsorted(at, place)):
            ok = (side >= 0) & (side < len(at))
            other = at[np.clip(side, 0, len(at) - 1)]
            near |= ok & (np.abs(other - place) <= NEAR) & (doc[other] == doc[place])
    letters = _sums(_LETTER[data])
    capitals = _sums(_CAPITAL[data])
    digits = _sums(_DIGIT[data])
    length = ends - starts
    in_word = lambda sums: sums[ends] - sums[starts]
    shouted = (length >= 3) & (in_word(capitals) == length)
    mixed = (in_word(letters) > 0) & (in_word(digits) > 0)
    plain = _PLAIN[lower]
    d_start, d_end, d_hash = vector.words(plain, bounds, _LETTER[plain] | _WORD[lower])
    looks = _sums(_LOOK[data])
    disguised = (looks[d_end] > looks[d_start]) & (letters[d_end] > letters[d_start]) & (_held(lexicon, d_hash) > 0)
    lone = (length == 1) & (in_word(letters) == 1)
    spaced = np.zeros(len(lone), bool)
    if len(lone) > 2:
        spaced[2:] = lone[2:] & lone[1:-1] & lone[:-2] & (doc[2:] == doc[:-2])
    most = np.zeros(rows)
    np.maximum.at(most, doc[hit], weight[hit])
    columns = [
        np.log1p(per(doc)), per(doc[hit]), per(doc[hit]) / words, per(doc, weight) / words, most,
        per(doc[weight > 3]) / words, per(begin_doc[begin_weight > 0]) / words, per(begin_doc, begin_weight) / words,
        per(doc[second]) / words, per(doc[place[near]]) / words, share(_CAPITAL) / size, per(doc[shouted]) / words,
        share(_PUNCTUATION) / size, share(_EXCLAIM) / size, share(_DIGIT) / size, per(doc[mixed]) / words,
        per((np.searchsorted(bounds, d_start, "right") - 1)[disguised]) / words, per(doc[spaced]) / words,
        per(doc, length.astype(float)) / words,
    ]
    return np.stack(columns)


_second: list[np.ndarray] = []


def _second_person() -> np.ndarray:
    if not _second:
        _second.append(vector.hash_words(SECOND_PERSON))
    return _second[0]


def features(spark, lexicon, text: Column) -> Column:
    """The features of a text as an array; ``lexicon`` holds sorted hashes and weights.

    Only texts go to Python, and only numbers come back.
    """
    vector.bound_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # at most LEXICON entries

    @F.arrow_udf("array<double>")
    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, bounds = vector.texts(column)
            found = [np.zeros((len(FEATURES), 0))]
            for lo, hi in vector.groups(bounds, GROUP_BYTES):
                found.append(_features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], shared.value))
            values = np.concatenate(found, axis=1).T.astype(float)
            at = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(values).ravel()))
        vector.give_back()

    return work(text)


def held_out(id_col: str = "doc_id") -> Column:
    crc = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, label, part`` of at most ``SAMPLE`` training rows; part 0 is for calibration."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int"))
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings that mark toxic training documents, and their log-odds."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = vector.texts(batch.column("text"))
            labels = batch.column("label").to_numpy()
            for lo, hi in vector.groups(bounds, GROUP_BYTES):
                inner = bounds[lo : hi + 1] - bounds[lo]
                lower = _lower(data[bounds[lo] : bounds[hi]])
                starts, ends, hashes = vector.words(lower, inner, _WORD[lower])
                at, begin = _beginnings(lower, inner, starts, ends)
                doc = np.searchsorted(inner, np.concatenate([starts, at]), "right") - 1
                both = np.concatenate([hashes, begin])
                order = np.lexsort((both, doc))
                doc, both = doc[order], both[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (both[1:] != both[:-1])
                toxic = labels[lo:hi][doc[new]]
                yield pa.RecordBatch.from_arrays([pa.array(both[new].view(np.int64)), pa.array(toxic)], ["term", "toxic"])
        vector.give_back()

    totals = sample.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, n = totals["pos"] or 0.0, totals["n"]
    if not 0 < pos < n:
        return np.zeros(0, np.uint64), np.zeros(0)
    counted = sample.mapInArrow(terms, "term long, toxic double").groupBy("term").agg(
        F.sum("toxic").alias("p"), (F.count(F.lit(1)) - F.sum("toxic")).alias("q")
    )
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (n - pos + 1))
    both = F.col("p") + F.col("q")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (both * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("p"), pos / n) + part(F.col("q"), 1 - pos / n))
    found = counted.where((odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)).select("term", odds.alias("w"), ratio.alias("r"))
    rows = found.orderBy(F.desc("r"), "term").limit(LEXICON).collect()
    keys = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    weights = np.array([r["w"] for r in rows], float)
    seeds = vector.hash_words(INSULTS)
    seeds = seeds[~np.isin(seeds, keys)]
    keys, weights = np.concatenate([keys, seeds]), np.concatenate([weights, np.full(len(seeds), 3.0)])
    order = np.argsort(keys)
    return keys[order], weights[order]


class Model:
    """A fitted lexicon, trees and calibration; without trees every score is 0."""

    def __init__(self, lexicon, trees=None, calibration=None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    vector.bound_batches(docs.sparkSession)
    sample = stage(labelled_sample(docs, labels), "labelled")
    lexicon = learn_lexicon(sample)
    if not len(lexicon[0]):
        return Model(lexicon)
    # No row's features come from a lexicon that has seen its label.
    parts = []
    for k in range(PARTS):
        other = learn_lexicon(sample.where(F.col("part") != k))
        vectors = array_to_vector(features(docs.sparkSession, other, F.col("text"))).alias("features")
        parts.append(sample.where(F.col("part") == k).select("label", "part", vectors))
    rows = stage(reduce(DataFrame.unionByName, parts), "training")
    counts = {r["part"]: (r["n"], r["p"]) for r in rows.groupBy((F.col("part") == 0).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    if any(not 0 < counts.get(side, (0, 0))[1] < counts[side][0] for side in (True, False)):
        return Model(lexicon)
    trees = GBTClassifier(
        labelCol="label", maxIter=20, maxDepth=4, stepSize=0.3, minInstancesPerNode=5, subsamplingRate=0.8, seed=11
    ).fit(rows.where("part <> 0").repartition(4))
    held = _margin(trees, rows.where("part = 0")).select("label", "margin")
    calibration = IsotonicRegression(labelCol="label", featuresCol="margin").fit(held)
    return Model(lexicon, trees, calibration)


def _margin(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("margin", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all but ``name``) of ``docs`` and the score as ``name``.

    Calibration is a step function; a hundredth of the trees' own probability keeps the order
    within a step.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    if model.trees is None:
        return docs.select(*kept, F.lit(0.0).alias(name))
    # Spark ML adds columns of its own; those of the input wait in one.
    found = features(docs.sparkSession, model.lexicon, F.col(text_col))
    rows = docs.select(F.struct(*kept).alias("row"), found.alias("found"))
    rows = _margin(model.trees, rows.select("row", array_to_vector("found").alias("features")))
    rows = model.calibration.transform(rows.drop("prediction"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("prediction") + 0.01 * F.col("margin")))
    return rows.select(*(F.col("row")[c].alias(c) for c in kept), value.alias(name))


def op6_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
