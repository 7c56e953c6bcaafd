"""Phrase collocations counted in HAT-tries that spill sorted runs.

Every task counts the phrases of its texts in one trie for each language: hash containers under word ids,
one shared by the rarer first words, one for each first word of many phrases, then for its second words
(see ``Trie``). A task holds at most ``ENTRIES`` phrases: beyond that its largest
subtrees leave as sorted runs until half are left, and the rest follow at the end. Runs are dealt by prefix
partitions, all words but the last and a slice of the last, so that the subtree below a frequent prefix is spread
over ``SLICES`` of them, and merged there by adding up.

Phrases come in two steps: single words and pairs first, then longer ones behind a bitmap of
the phrases one word shorter that are frequent enough, as a phrase is never more frequent than its parts. The
bitmap only saves work (its size is bounded, a full one lets everything through); counts are exact and
cover all texts. A text is read in pieces of ``CHUNK`` bytes.

Scoring joins each candidate with the counts of its parts, hot parts dealt over salts; arithmetic is
in decimals. The leading phrases of a language are found in hash buckets first.

Defined cases: null text is empty, null language is ``und``; ids are not read, repeated rows count each time; a
text without words adds nothing; an empty table gives no rows. Ties in score go to the more frequent phrase,
then to byte order. Columns other than text and language are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, count as counter, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm import vector
from corpusloom.operators.skew import salted_join
from corpusloom.session import stage

LEAST = 10
LONGEST = 3
TOP = 2_000
NO_LANG = "und"
KEEP_SHARE = 50

BURST = 4_096
DEEPER = 1 << 16
ENTRIES = 1 << 20
WORDS = 1 << 20
WORD_BYTES = 32 << 20
TOKENS = 1 << 20
CHUNK = 1 << 20
OUT_ROWS = 1 << 16
ID_BITS = 21
_TAIL_BITS = ID_BITS * (LONGEST - 1)

GATE_BITS = 1 << 27
GATE_PAGE = 1 << 15
BITS_PER_PHRASE = 16
BUCKET_ROWS = 1 << 14
# Prefix partitions of the phrases that share all words but the last.
SLICES = 64

# What ends a piece; blanks and tabs part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_MARK = bytes.maketrans(ENDS, b"." * len(ENDS))
_GAP = re.compile(rb"[ \t.]")
RUN = "part long, lang string, phrase string, n long"


class Trie:
    """Counts of phrases of numbered words, packed into one integer each.

    Single words are an array. Phrases of rarer first words share one hash container; a first word with
    more than ``BURST`` phrases bursts out of it into a container of its own, and that one, beyond ``DEEPER``
    phrases, into one for each second word.
    """

    def __init__(self):
        self.ones = np.zeros(1 << 10, np.int64)
        self.shared: dict[int, int] = {}
        self.checked = 0
        self.own: dict[int, dict] = {}
        self.split: set[int] = set()
        self.held: dict[int, int] = {}

    def count_words(self, ids: np.ndarray) -> None:
        found = np.bincount(ids)
        if len(found) > len(self.ones):
            self.ones = np.concatenate([self.ones, np.zeros(max(len(found), len(self.ones)), np.int64)])
        self.ones[: len(found)] += found

    def add(self, packed: np.ndarray, counts: np.ndarray) -> int:
        """Count sorted, distinct phrases; gives how many are new."""
        firsts = packed >> _TAIL_BITS
        out = np.isin(firsts, np.fromiter(self.own, np.int64, len(self.own)))
        before, get, shared = len(self.shared), self.shared.get, self.shared
        for phrase, n in zip(packed[~out].tolist(), counts[~out].tolist()):
            shared[phrase] = get(phrase, 0) + n
        new = len(shared) - before
        firsts, packed, counts = firsts[out], packed[out], counts[out]
        cuts = [0, *(np.flatnonzero(np.diff(firsts)) + 1).tolist(), len(firsts)]
        packed, counts = packed.tolist(), counts.tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                new += self._add_below(int(firsts[lo]), packed[lo:hi], counts[lo:hi])
        if len(shared) > max(BURST, 1.5 * self.checked):
            self._burst()
        return new

    def _add_below(self, first: int, packed: list[int], counts: list[int]) -> int:
        node, new = self.own[first], 0
        if first in self.split:
            for phrase, n in zip(packed, counts):
                second = node.setdefault(phrase >> ID_BITS, {})
                seen = second.get(phrase)
                new += seen is None
                second[phrase] = (seen or 0) + n
        else:
            before, get = len(node), node.get
            for phrase, n in zip(packed, counts):
                node[phrase] = get(phrase, 0) + n
            new = len(node) - before
            if len(node) > DEEPER:
                below: dict[int, dict[int, int]] = {}
                for phrase, n in node.items():
                    below.setdefault(phrase >> ID_BITS, {})[phrase] = n
                self.own[first] = below
                self.split.add(first)
        self.held[first] += new
        return new

    def _burst(self) -> None:
        held = np.fromiter(self.shared, np.int64, len(self.shared))
        firsts, sizes = np.unique(held >> _TAIL_BITS, return_counts=True)
        many = firsts[sizes > BURST]
        for phrase in held[np.isin(held >> _TAIL_BITS, many)].tolist():
            self.own.setdefault(phrase >> _TAIL_BITS, {})[phrase] = self.shared.pop(phrase)
        for first in many.tolist():
            self.held[first] = len(self.own[first])
        self.checked = len(self.shared)

    def sizes(self) -> list[tuple[int, int]]:
        """Phrases held and first word of each subtree; 0 is the shared container."""
        return [(len(self.shared), 0), *((n, first) for first, n in self.held.items())]

    def take(self, first: int) -> list[dict[int, int]]:
        """The containers of a subtree, which leave the trie."""
        if not first:
            found, self.shared, self.checked = self.shared, {}, 0
            return [found]
        found = self.own.pop(first)
        del self.held[first]
        if first not in self.split:
            return [found]
        self.split.discard(first)
        return list(found.values())

    def take_words(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.flatnonzero(self.ones)
        counts, self.ones = self.ones[ids], np.zeros(1 << 10, np.int64)
        return ids, counts


_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def chain_hash(lang: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase from those of its language and its words."""
    out = lang
    for h in hashes:
        out = vector.mix(out * _ODD + h)
    return out


class Counter:
    """The tries of one task and the words they number."""

    def __init__(self, lengths: tuple[int, ...], gate: np.ndarray | None):
        self.lengths, self.gate = lengths, gate
        self.tries: dict[str, Trie] = {}
        self.buffers: dict[str, array] = {}
        self.carried: dict[str, int] = {}
        self.entries = 0
        self._new_words()

    def _new_words(self) -> None:
        numbers = counter()
        self.ids: dict[bytes, int] = _Numbered(numbers)
        self.ids[b"."]  # the mark between pieces is number 0
        self.word_bytes = 0
        self.hashes = np.zeros(0, np.uint64)

    def read(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        for lo, hi in _chunks(text):
            buffer = self.buffers.setdefault(lang, array("i", [0]))
            part = text[lo:hi].lower().translate(_TO_MARK).replace(b".", b" . ")
            ids = self.ids
            known = len(ids)
            buffer.extend([ids[w] for w in part.split()])
            if len(ids) > known:
                self.word_bytes += hi - lo
            if sum(map(len, self.buffers.values())) >= TOKENS:
                yield from self.flush()
            if len(ids) >= WORDS or self.word_bytes >= WORD_BYTES:
                yield from self.restart()
        if lang in self.buffers:
            self.buffers[lang].append(0)

    def restart(self) -> Iterator[pa.RecordBatch]:
        """Spill everything and number words anew; the words that go on keep their place."""
        yield from self.flush()
        names = list(self.ids)
        ends = {lang: [names[i] for i in buffer] for lang, buffer in self.buffers.items()}
        yield from self.spill(0)
        self._new_words()
        self.buffers = {lang: array("i", [self.ids[w] for w in end]) for lang, end in ends.items()}

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, buffer in self.buffers.items():
            arr = np.array(buffer, np.int64)
            self._count(lang, arr, self.carried.get(lang, 0))
            rest = arr[max(0, len(arr) - LONGEST + 1) :]
            self.carried[lang] = len(rest)
            self.buffers[lang] = array("i", rest.tolist())
            if self.entries > ENTRIES:
                yield from self.spill(ENTRIES // 2)

    def _count(self, lang: str, arr: np.ndarray, carried: int) -> None:
        """Count the phrases that end after the first ``carried`` words."""
        trie = self.tries.setdefault(lang, Trie())
        words = [arr > 0]
        for k in range(1, max(self.lengths)):
            words.append(words[-1][: len(arr) - k] & (arr[k:] > 0) if len(arr) > k else np.zeros(0, bool))
        for length in self.lengths:
            ok = words[length - 1].copy()
            ok[: max(0, carried - length + 1)] = False
            at = np.flatnonzero(ok)
            if length == 1:
                trie.count_words(arr[at])
                continue
            if length > 2 and self.gate is not None and len(at):
                at = at[self._passes(lang, arr, at, length)]
            packed = np.zeros(len(at), np.int64)
            for k in range(LONGEST):
                packed = (packed << ID_BITS) | (arr[at + k] if k < length else 0)
            self.entries += trie.add(*np.unique(packed, return_counts=True))

    def _passes(self, lang: str, arr: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        self._hash_words()
        seed = word_hashes([lang.encode()], 1)
        good = np.ones(len(at), bool)
        for shift in (0, 1):
            h = chain_hash(seed, [self.hashes[arr[at + shift + k]] for k in range(length - 1)])
            place = h % np.uint64(len(self.gate) * 8)
            good &= (self.gate[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return good

    def _hash_words(self) -> None:
        new = len(self.ids) - len(self.hashes)
        if new:
            self.hashes = np.concatenate([self.hashes, word_hashes(islice(self.ids, len(self.hashes), None), new)])

    def spill(self, until: int) -> Iterator[pa.RecordBatch]:
        """The largest subtrees as sorted runs, until at most ``until`` phrases are held; words too if that is 0."""
        sizes = sorted(((n, lang, first) for lang, t in self.tries.items() for n, first in t.sizes()), reverse=True)
        chosen: dict[str, list[int]] = {lang: [] for lang in self.tries} if not until else {}
        for n, lang, first in sizes:
            if self.entries <= until:
                break
            chosen.setdefault(lang, []).append(first)
            self.entries -= n
        if not chosen:
            return
        names = pa.array([b"", *islice(self.ids, 1, None)], pa.binary()).cast(pa.string())
        rank = np.empty(len(names), np.int64)
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        rank[0] = -1  # no word
        self._hash_words()
        for lang in sorted(chosen):
            trie = self.tries[lang]
            if not until:
                ids, counts = trie.take_words()
                # the empty phrase stands for all words
                ids, counts = np.concatenate([[0], ids]), np.concatenate([[counts.sum()], counts])
                yield from _sorted_run(lang, ids << _TAIL_BITS, counts, names, rank, self.hashes)
            taken = [t for first in chosen[lang] for t in trie.take(first)]
            held = sum(map(len, taken))
            packed = np.fromiter(chain.from_iterable(taken), np.int64, held)
            counts = np.fromiter(chain.from_iterable(t.values() for t in taken), np.int64, held)
            yield from _sorted_run(lang, packed, counts, names, rank, self.hashes)


def _prefix_partition(lang: str, ids: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """A number for all words but the last and the slice of the last; a single word has its own."""
    out = np.broadcast_to(word_hashes([lang.encode()], 1), len(ids[0]))
    for k, i in enumerate(ids):
        last = (ids[k + 1] == 0) if k + 1 < len(ids) else np.ones(len(i), bool)
        h = hashes[i]
        if k:
            h = np.where(last, h % np.uint64(SLICES), h)
        out = np.where(i > 0, chain_hash(out, [h]), out)
    return out.view(np.int64)


def _sorted_run(
    lang: str, packed: np.ndarray, counts: np.ndarray, names: pa.Array, rank: np.ndarray, hashes: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Phrases and counts in the byte order of their words."""
    mask = (1 << ID_BITS) - 1
    order = np.lexsort([rank[i] for i in (packed & mask, (packed >> ID_BITS) & mask, packed >> _TAIL_BITS)])
    for lo in range(0, len(order), OUT_ROWS):
        at = order[lo : lo + OUT_ROWS]
        some = packed[at]
        ids = [some >> _TAIL_BITS, (some >> ID_BITS) & mask, some & mask]
        words = [names.take(pa.array(i, mask=(i == 0) & (k > 0))) for k, i in enumerate(ids)]
        phrase = pc.binary_join_element_wise(*words, " ", null_handling="skip")
        langs = pa.array([lang]).take(pa.array(np.zeros(len(at), np.int32)))
        columns = [pa.array(_prefix_partition(lang, ids, hashes)), langs, phrase, pa.array(counts[at])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "lang", "phrase", "n"])


class _Numbered(dict):
    def __init__(self, numbers):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word):
        found = self[word] = next(self.numbers)
        return found


def _chunks(text: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK`` bytes that end before a separator or at the end."""
    lo = 0
    while lo < len(text):
        gap = _GAP.search(text, lo + CHUNK) if lo + CHUNK < len(text) else None
        hi = gap.start() if gap else len(text)
        yield lo, hi
        lo = hi


def runs(docs: DataFrame, lengths: tuple[int, ...], gate=None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``part, lang, phrase, n``: sorted runs of counts, several rows for a phrase; the empty phrase counts all words."""
    vector.bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(lengths, None if gate is None else np.frombuffer(gate.value, np.uint8))
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                if text.is_valid:
                    yield from own.read(lang.as_py(), text.as_buffer().to_pybytes())
        yield from own.flush()
        yield from own.spill(0)

    return rows.mapInArrow(work, RUN)


def merged(found: DataFrame) -> DataFrame:
    """``lang, phrase, n``: runs added up, one prefix partition in one task."""
    return found.repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("n").alias("n")).drop("part")


def gate_of(frequent: DataFrame):
    """A broadcast bitmap over the hashes of frequent phrases of one length, at most ``GATE_BITS`` wide."""
    spark = frequent.sparkSession
    size = GATE_PAGE
    wanted = frequent.count() * BITS_PER_PHRASE
    while size < min(wanted, GATE_BITS):
        size *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [x.encode() for x in batch.column("lang").to_pylist()]
            parts = zip(*(x.encode().split(b" ") for x in batch.column("phrase").to_pylist()))
            hashes = [word_hashes(words, len(langs)) for words in parts]
            places = chain_hash(word_hashes(langs, len(langs)), hashes) % np.uint64(size)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], ["place"])

    pages = (
        frequent.select("lang", "phrase").mapInArrow(work, "place long")
        .groupBy(F.expr(f"CAST(place DIV {GATE_PAGE} AS INT)").alias("page"))
        .agg(F.bitmap_construct_agg(F.col("place") % GATE_PAGE).alias("bits"))
    )
    bits = bytearray(size // 8)
    for r in pages.collect():  # at most GATE_BITS
        bits[r["page"] * (GATE_PAGE // 8) : (r["page"] + 1) * (GATE_PAGE // 8)] = r["bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases with ``n >= least``, and ``lang, n`` over all words, where they are as many."""
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)

    def often(lengths: tuple[int, ...], gate) -> DataFrame:
        found = merged(runs(docs, lengths, gate, text_col, lang_col)).where(F.col("n") >= least)
        return stage(found.select("lang", "phrase", words.alias("words"), "n"), "counts")

    short = often((1, 2), None)
    gate = gate_of(short.where("words = 2"))
    longer = often((LONGEST,), gate).where("words > 0")
    gate.destroy()
    return short.where("words > 0").unionByName(longer), short.where("words = 0").select("lang", "n")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every phrase of two words or more, by its lowest cut."""
    phrases = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    ws = _words(F.col("phrase"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice(ws, F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice(ws, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("part")),
    )
    asked = cuts.withColumn("_p", F.explode(parts)).select("lang", "phrase", "a", "k", "_p.side", "_p.part")
    counts = frequent.select("lang", F.col("phrase").alias("part"), "n")
    met = salted_join(asked, counts, ["lang", "part"], "inner")
    n = lambda side: F.max(F.when(F.col("side") == side, F.col("n"))).alias(side)
    both = met.groupBy("lang", "phrase", "a", "k").agg(n("l"), n("r"))
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    exact = both.withColumns({f"_{c}": v for c, v in wide.items()}).withColumn("score", F.expr("(_a * _a * 1000000BD) DIV (_l * _r)"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("_m")
    return exact.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "_m.l", "_m.r", "_m.score")


def without_covered(candidates: DataFrame, share: int = KEEP_SHARE) -> DataFrame:
    """Candidates without those of which a longer one holds ``share`` per cent of the occurrences."""
    ws = _words(F.col("phrase"))
    longer = candidates.where(F.size(ws) > 2)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size(ws) - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " ")),
        )
    )
    held = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_b"))
    most = held.groupBy("lang", "phrase").agg(F.max("_b").alias("_b"))
    return candidates.join(most, ["lang", "phrase"], "left").where(
        F.col("_b").isNull() | (100 * F.col("_b") < share * F.col("a"))
    ).drop("_b")


def leading(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with ``rank``; buckets are cut to ``top`` until one window is small."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = candidates.count()
    while left > BUCKET_ROWS + top:
        buckets = -(-left // BUCKET_ROWS)
        inside = W.partitionBy("lang", "_bucket").orderBy(*order)
        bucket = F.pmod(F.xxhash64("phrase", F.lit(left)), F.lit(buckets))
        candidates = candidates.withColumn("_bucket", bucket).withColumn("_at", F.row_number().over(inside))
        candidates = candidates.where(F.col("_at") <= top).drop("_bucket", "_at")
        smaller = buckets * top
        if smaller >= left:
            break
        left = smaller
    ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``."""
    frequent, sizes = phrase_counts(docs, least, text_col, lang_col)
    kept = stage(without_covered(scored(frequent)), "candidates")
    found = leading(kept, top).join(sizes, "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_hat_trie(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, k, w[i : i + k - 1] AS ws FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k))
), f AS (
  SELECT lang, k, array_to_string(ws, ' ') AS phrase, count(*) AS n, any_value(ws) AS ws FROM g GROUP BY lang, k, array_to_string(ws, ' ')
), t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, ws, k, n AS a FROM f WHERE k > 1 AND n >= 10),
s AS (
  SELECT m.lang, m.phrase, m.len, a, cut, x.n AS l, y.n AS r, 1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n) AS score
  FROM (SELECT lang, phrase, ws, a, k AS len, unnest(range(1, k)) AS cut FROM c) AS m
  JOIN f AS x ON x.lang = m.lang AND x.phrase = array_to_string(m.ws[1 : cut], ' ')
  JOIN f AS y ON y.lang = m.lang AND y.phrase = array_to_string(m.ws[cut + 1 : m.len], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c AS h WHERE h.lang = b.lang AND h.k > b.len AND 100 * h.a >= 50 * b.a
      AND (array_to_string(h.ws[1 : 2], ' ') = b.phrase OR array_to_string(h.ws[2 : 3], ' ') = b.phrase))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, t.n AS n, CAST(score AS BIGINT) AS score
FROM o JOIN t USING (lang)
QUALIFY rank <= 2000
"""
