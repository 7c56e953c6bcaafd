"""Byte-pair vocabulary: training as Spark rounds, encoding and decoding as Arrow jobs."""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import CODEPOINTS, WORD_MARK
from corpusloom.functions.vocab import (
    BYTES,
    DEFAULT_SPECIAL_TOKENS,
    MAX_VOCAB,
    RESERVED,
    UNK_ID,
    char_vocab,
    user_symbols,
)
from corpusloom.operators.sizing import char_coverage
from corpusloom.session import spread, stage

# A run of word marks stays with the word that follows it.
WORD_PATTERN = f"{WORD_MARK}*[^{WORD_MARK}]+|{WORD_MARK}+"
# The same for lines that are joined by line feeds, which belong to no word.
LINE_WORDS = re.compile(f"{WORD_MARK}*[^{WORD_MARK}\n]+|{WORD_MARK}+")

# Pairs looked at, and merges taken, in one training round.
ROUND_PAIRS = 512
ROUND_MERGES = 256
# Pairs that the driver ranks, and distinct words of one partition.
MAX_PAIRS = 200_000
PART_WORDS = 500_000
# Symbols of distinct words that a training task works on at once, or one longer word.
STATE_PLACES = 1 << 18
# Rounds between two written copies of the words.
STAGE_EVERY = 20
# Distinct words a worker remembers before it starts over, and the pieces in them.
WORD_CACHE = 200_000
PIECE_CACHE = 4_000_000
# Characters whose words a task counts before it hands the counts on.
COUNTED_CHARS = 1 << 24
# Symbols of a word up to which it is merged together with others, and the place of a pair without a merge.
SHORT_WORD = 64
UNMERGED = 1 << 30
# Bytes of text whose words are looked up together.
WORDS_BYTES = 1 << 18
# Bytes of text that become ids at once, or one longer text.
GROUP_BYTES = 1 << 21
# Bytes of an Arrow batch that is sent to a worker, or one longer text.
BATCH_BYTES = 6 << 20


# Corpus side


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents as the lines of a text file."""
    return docs.select(F.explode(F.split(text, "\n")).alias("text")).where(F.length("text") > 0)


def max_sentence_length(lines: DataFrame, n: int = 16_384, text: str = "text") -> DataFrame:
    """Drop lines longer than ``n`` bytes."""
    return lines.where(F.octet_length(text) <= n)


def word_counts(
    lines: DataFrame, special_tokens: Sequence[str] = DEFAULT_SPECIAL_TOKENS, text: str = "text"
) -> DataFrame:
    """``(word, n)``: distinct words with their counts; symbols of the user end a word.

    Arrow tasks count the words of their lines, so what moves is distinct words of a task, not occurrences.
    """
    symbols = user_symbols(special_tokens)
    cut = re.compile("|".join(map(re.escape, symbols))).sub if symbols else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for group in text_groups(batch.column("text")):
                texts = [cut("\n", t) if cut else t for t in group if t]
                run = "\n".join(texts).replace(" ", WORD_MARK)
                counts.update(found_words(run, LINE_WORDS))
                held += len(run)
                if len(counts) >= WORD_CACHE or held >= COUNTED_CHARS:
                    yield rows()
                    counts.clear()
                    held = 0
        if counts:
            yield rows()

    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sent = spread(lines).select(F.make_valid_utf8(F.col(text)).alias("text"))
    return sent.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def found_words(text: str, pattern: re.Pattern) -> Iterable[str]:
    """The words of a text; those of a very long one are not listed at once."""
    if len(text) <= GROUP_BYTES:
        return pattern.findall(text)
    return (m[0] for m in pattern.finditer(text))


def word_char_counts(words: DataFrame) -> DataFrame:
    """``(ch, n)`` over all occurrences, from the distinct words."""
    return (
        words.select(F.explode(F.split("word", "")).alias("ch"), "n")
        .groupBy("ch")
        .agg(F.sum("n").alias("n"))
    )


def pair_counts(words: DataFrame, symbols: str = "symbols") -> DataFrame:
    """``(left, right, n)``: how often two symbols are neighbours, over all occurrences.

    ``symbols`` is an array of strings; an empty symbol belongs to no pair.
    """
    n = F.size(symbols)
    pairs = F.arrays_zip(
        F.slice(symbols, F.lit(1), n - 1).alias("left"), F.slice(symbols, F.lit(2), n - 1).alias("right")
    )
    return (
        words.where(n >= 2)
        .select(F.explode(pairs).alias("p"), "n")
        .groupBy("p.left", "p.right")
        .agg(F.sum("n").alias("n"))
        .where("left <> '' and right <> ''")
    )


# Training

# While training, some ``STATE_PLACES`` places of the distinct words are one row: an array of symbols, words parted by
# ``GAP``, and the count of the word at each place. A worker holds one such row and arrays of its size at a time. A character is its code point, a merged symbol a number
# above all code points. ``GAP`` also stands for a character outside the coverage; nothing merges with it.
GAP = -1
STATE = "left int, right int, n long, symbols binary, weights binary"


def _state_row(symbols: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, pa.array([symbols.tobytes()]), pa.array([weights.tobytes()])], STATE_NAMES)


STATE_NAMES = ["left", "right", "n", "symbols", "weights"]


def _pair_rows(keys: np.ndarray, amounts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Amounts added up for each packed pair, without those that come to nothing."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, amounts)
    keys, total = keys[total != 0], total[total != 0]
    if len(keys):
        none = pa.nulls(len(keys), pa.binary())
        left, right = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(total), none, none], STATE_NAMES)


class _PairSums:
    """Amounts of pairs over the rows of a task, handed on when there are many."""

    def __init__(self):
        self.keys, self.amounts, self.held = [], [], 0

    def add(self, keys: np.ndarray, amounts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.amounts.append(amounts)
        self.held += len(keys)
        if self.held >= STATE_PLACES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from _pair_rows(np.concatenate(self.keys), np.concatenate(self.amounts))
        self.__init__()


def _packed(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair that begins at each place, and whether there is one."""
    wide = symbols.astype(np.int64)
    return wide[:-1] << 32 | wide[1:] & 0xFFFFFFFF, (wide[:-1] >= 0) & (wide[1:] >= 0)


def _initial_state(words: DataFrame, covered: Sequence[str]) -> DataFrame:
    """Rows of some ``STATE_PLACES``; the words are spread so that a partition has at most some ``PART_WORDS``."""
    points = np.array(sorted(map(ord, covered)), np.int32)
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // PART_WORDS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, weights, held = [np.array([GAP], np.int32)], [np.zeros(1, np.int64)], 0
        for batch in batches:
            for texts, counts in word_groups(batch, STATE_PLACES):
                sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
                if held and held + sizes.sum() > STATE_PLACES:
                    yield _state_row(np.concatenate(symbols), np.concatenate(weights))
                    symbols, weights, held = [np.array([GAP], np.int32)], [np.zeros(1, np.int64)], 0
                flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.int32).copy()
                ends = np.cumsum(sizes) - 1
                flat[~np.isin(flat, points)] = GAP
                flat[ends] = GAP
                symbols.append(flat)
                weights.append(np.repeat(counts, sizes))
                held += len(flat)
        yield _state_row(np.concatenate(symbols), np.concatenate(weights))

    # A batch of rows is sent to Python whole, and rows of the state take far more room there than in files.
    words.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return words.select("word", "n").repartition(parts, "word").mapInArrow(work, STATE)


def word_groups(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words in groups of at most ``limit`` places, or of one longer word, with their counts."""
    words, counts = batch.column("word"), batch.column("n").to_numpy()
    start, size = 0, 0
    for i, n in enumerate(pc.utf8_length(words).to_pylist()):
        if i > start and size + n + 1 > limit:
            yield words[start:i].to_pylist(), counts[start:i]
            start, size = i, 0
        size += n + 1
    if start < len(words):
        yield words[start:].to_pylist(), counts[start:]


def _read_state(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for symbols, weights in zip(batch.column("symbols"), batch.column("weights")):
        if symbols.is_valid:
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(weights.as_buffer(), np.int64)


def _all_pairs(state: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _PairSums()
        for batch in batches:
            for symbols, weights in _read_state(batch):
                keys, real = _packed(symbols)
                yield from sums.add(keys[real], weights[:-1][real])
        yield from sums.rest()

    return state.mapInArrow(work, STATE).groupBy("left", "right").agg(F.sum("n").alias("n"))


def _packed_at(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_packed`` for the places ``at`` alone; none of them is the last."""
    left, right = symbols[at].astype(np.int64), symbols[at + 1].astype(np.int64)
    return left << 32 | right & 0xFFFFFFFF, (left >= 0) & (right >= 0)


def merge_places(symbols: np.ndarray, taken: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where one of the pairs ``taken`` is merged, left to right, and into what."""
    wanted = np.array(sorted(taken), np.int64)
    made = np.array([taken[int(k)] for k in wanted], np.int32)
    # Most places are left out by their symbol; the last entry stands for ``GAP``.
    begins = np.zeros(max(int(symbols.max(initial=0)), int(wanted[-1] >> 32)) + 2, bool)
    begins[wanted >> 32] = True
    at = np.flatnonzero(begins[symbols[:-1]])
    keys, real = _packed_at(symbols, at)
    near = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    hit = real & (wanted[near] == keys)
    at, near = at[hit], near[hit]
    # A run of one symbol merges in twos from its first.
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.diff(at) > 1
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    first = (np.arange(len(at)) - start) % 2 == 0
    return at[first], made[near[first]]


def merged_state(symbols: np.ndarray, weights: np.ndarray, taken: dict[int, int]):
    """The state after a round's merges, and what they take from and add to the pairs around them."""
    at, into = merge_places(symbols, taken)
    old = np.unique(np.concatenate([at - 1, at, at + 1]))
    old = old[(old >= 0) & (old < len(symbols) - 1)]
    keys, real = _packed_at(symbols, old)
    lost_keys, lost = keys[real], -weights[old[real]]
    after = symbols.copy()
    after[at] = into
    keep = np.ones(len(after), bool)
    keep[at + 1] = False
    new_at = at - np.arange(len(at))
    after, weights = after[keep], weights[keep]
    new = np.unique(np.concatenate([new_at - 1, new_at]))
    new = new[(new >= 0) & (new < len(after) - 1)]
    keys, real = _packed_at(after, new)
    return after, weights, np.concatenate([lost_keys, keys[real]]), np.concatenate([lost, weights[new[real]]])


def _without_finished(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one symbol take part in nothing more."""
    lone = np.zeros(len(symbols), bool)
    lone[1:-1] = (symbols[:-2] == GAP) & (symbols[2:] == GAP)
    return symbols[~lone], weights[~lone]


def _round(state: DataFrame, taken: dict[int, int]) -> DataFrame:
    """The merged words, and a row for each pair whose count changes in a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _PairSums()
        for batch in batches:
            for symbols, weights in _read_state(batch):
                symbols, weights, keys, amounts = merged_state(symbols, weights, taken)
                yield _state_row(*_without_finished(symbols, weights))
                yield from sums.add(keys, amounts)
        yield from sums.rest()

    return state.where("symbols IS NOT NULL").mapInArrow(work, STATE)


class Ranking:
    """The pairs that count at least ``floor``, on the driver, in the order of merging.

    At most ``MAX_PAIRS`` are held. Changes reported by a round keep them exact; pairs below the floor
    are left to the next reading of all pairs.
    """

    def __init__(self):
        self.counts: dict[tuple[int, int], int] = {}
        self.heap: list[tuple[int, int, int, int]] = []
        self.floor = 1
        self.spent = False  # holds a list that is good for one round only

    def read(self, pairs: DataFrame) -> None:
        rows = pairs.orderBy(F.desc("n"), F.greatest("left", "right"), "left", "right").limit(MAX_PAIRS).collect()
        self.floor = rows[-1]["n"] + 1 if len(rows) == MAX_PAIRS else 1
        self.spent = bool(rows) and rows[0]["n"] < self.floor
        self.counts = {(r["left"], r["right"]): r["n"] for r in rows if self.spent or r["n"] >= self.floor}
        self.heap = [(-n, max(pair), *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.heap)

    def leading(self, most: int) -> list[tuple[int, int]]:
        out, seen, put_back = [], set(), []
        while self.heap and len(out) < most:
            entry = heapq.heappop(self.heap)
            pair = entry[2:]
            if self.counts.get(pair) == -entry[0] and pair not in seen:
                out.append(pair)
                seen.add(pair)
                put_back.append(entry)
        for entry in put_back:
            heapq.heappush(self.heap, entry)
        return out

    def change(self, lefts: list[int], rights: list[int], amounts: list[int], first_new: int) -> None:
        """Add what a round reports; ``first_new`` is the lowest symbol that it made."""
        for left, right, amount in zip(lefts, rights, amounts):
            pair = (left, right)
            known = self.counts.get(pair)
            if known is None and max(pair) < first_new:
                continue
            n = (known or 0) + amount
            if n >= self.floor:
                self.counts[pair] = n
                heapq.heappush(self.heap, (-n, max(pair), left, right))
            elif known is not None:
                del self.counts[pair]


def accept_prefix(
    ranked: Sequence[tuple[int, int]], piece: dict[int, str], known: dict[str, int], room: int
) -> list[tuple[int, int]]:
    """The leading pairs that one round may merge at once.

    Merging ``(a, b)`` changes the count only of pairs that end in ``a`` or begin with
    ``b``, and a new symbol's pairs never count more than those. So the ranking holds up
    to the first such pair, and merging the pairs before it together equals merging them
    one by one. A merge that makes a known piece again changes that piece's counts and is
    the last of its round.
    """
    taken: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    made: set[str] = set()
    for left, right in ranked:
        if len(taken) >= min(room, ROUND_MERGES) or right in lefts or left in rights:
            break
        text = piece[left] + piece[right]
        again = text in known or text in made
        taken.append((left, right))
        if again:
            break
        lefts.add(left)
        rights.add(right)
        made.add(text)
    return taken


def train_bpe(
    lines: DataFrame,
    vocab_size: int = 32_000,
    special_tokens: Sequence[str] = DEFAULT_SPECIAL_TOKENS,
    coverage: float = 0.98,
    max_length: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Learn merges; gives ``vocab (id, piece, kind)`` and ``merges (rank, left, right, id)``.

    A round merges all leading pairs that cannot influence each other. Each partition of the distinct words
    applies them where they occur and reports by how much the pairs around those places change; the changes,
    added up, bring the ranking on the driver up to date. Its size is bounded, and so are the changes: a
    merge touches pairs with its two parts and its result only. All pairs are counted at the start, when the ranking
    is used up, and after a merge that makes a known piece again. Ties go to older
    symbols. Training stops at ``vocab_size`` pieces or when no pair is left. With ``max_length`` lines of more
    bytes are left out.
    """
    spark = lines.sparkSession
    kept = lines if max_length is None else max_sentence_length(lines, max_length)
    words = stage(word_counts(kept, special_tokens), "words")
    chars = char_coverage(word_char_counts(words), coverage)
    covered = [r["ch"] for r in chars.orderBy("rank").limit(vocab_size + 1).collect()]
    base = len(RESERVED) + len(user_symbols(special_tokens)) + BYTES
    room = vocab_size - base - len(covered)
    if room < 0:
        raise ValueError(f"vocab_size {vocab_size} is below the {base + len(covered)} basic pieces")

    piece = {ord(c): c for c in covered}
    vocab_id = {ord(c): base + i for i, c in enumerate(covered)}
    known: dict[str, int] = {}
    learned: list[tuple[int, str, str, int]] = []
    state = stage(_initial_state(words, covered), "symbols")
    ranking = Ranking()
    recount, rounds, held = True, 0, []
    while room > 0:
        if recount:
            ranking.read(_all_pairs(state))
        ranked = ranking.leading(ROUND_PAIRS)
        if not ranked:
            if recount:
                break
            recount = True
            continue
        first_new = CODEPOINTS + len(known)
        taken: dict[int, int] = {}
        recount = ranking.spent
        for left, right in accept_prefix(ranked, piece, known, room):
            text = piece[left] + piece[right]
            recount = recount or text in known
            if text not in known:
                known[text] = CODEPOINTS + len(known)
                piece[known[text]] = text
                vocab_id[known[text]] = base + len(covered) + len(known) - 1
                room -= 1
            taken[left << 32 | right] = known[text]
            learned.append((len(learned), piece[left], piece[right], vocab_id[known[text]]))
        rounds += 1
        state = _round(state, taken)
        if rounds % STAGE_EVERY == 0:
            state = stage(state, "symbols")
        else:
            state = state.persist()
            held.append(state)
        # By the pair: rows of symbols have none, and looking at the symbols would read them all.
        changed = state.where("left IS NOT NULL").groupBy("left", "right").agg(F.sum("n").alias("n")).toArrow()
        ranking.change(*(changed.column(c).to_pylist() for c in ("left", "right", "n")), first_new)
        # The round before is only needed until this one is written or held.
        while held and held[0] is not state:
            held.pop(0).unpersist()
    for df in held:
        df.unpersist()

    merges = spark.createDataFrame(learned, "rank int, left string, right string, id int")
    ranks = spark.createDataFrame(
        [(i + 1, c, 0) for i, c in enumerate(covered)], "rank int, ch string, n int"
    )
    new = merges.groupBy("id").agg(F.min(F.concat("left", "right")).alias("piece"))
    vocab = char_vocab(spark, ranks, special_tokens).unionByName(
        new.select("id", "piece", F.lit("merge").alias("kind"))
    )
    return vocab, merges


# Encoding and decoding


@dataclass
class BpeModel:
    """A vocabulary as plain values, small enough to send to every worker."""

    pieces: list[str]
    kinds: list[str]
    merges: dict[tuple[int, int], tuple[int, int]] = field(repr=False)

    @classmethod
    def from_tables(cls, vocab: DataFrame, merges: DataFrame) -> BpeModel:
        """Read the tables; they are bounded by the vocabulary size."""
        rows = vocab.orderBy("id").limit(MAX_VOCAB + 1).collect()
        if len(rows) > MAX_VOCAB:
            raise ValueError(f"a vocabulary may have at most {MAX_VOCAB} pieces")
        ids = {r["piece"]: r["id"] for r in rows if r["kind"] in ("char", "merge")}
        pairs = {
            (ids[r["left"]], ids[r["right"]]): (r["rank"], r["id"])
            for r in merges.orderBy(F.desc("rank")).collect()
        }
        return cls([r["piece"] for r in rows], [r["kind"] for r in rows], pairs)

    def with_kind(self, *kinds: str) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in kinds}


def merge_word(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the lowest-ranked merge, left-most first, until none is left."""
    n = len(ids)
    if n < 2:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := merges.get((ids[i], ids[j]))):
            heapq.heappush(queue, (hit[0], i, ids[i], ids[j]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = merges[left, right][1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


class WordMerger:
    """``merge_word`` for many words at once: each step makes the next merge of every word that has one."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        listed = sorted((left << 32 | right, rank, made) for (left, right), (rank, made) in merges.items())
        self.keys, self.ranks, self.made = (np.array([m[i] for m in listed], np.int64) for i in range(3))

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of the merge in the list by rank, or ``UNMERGED``."""
        if not len(self.keys):
            return np.full(len(left), UNMERGED, np.int64)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[near] == keys, self.by_rank[near], UNMERGED)

    @cached_property
    def by_rank(self) -> np.ndarray:
        """The places of the merges in the order of their ranks."""
        places = np.empty(len(self.ranks), np.int64)
        places[np.argsort(self.ranks, kind="stable")] = np.arange(len(places))
        return places

    def __call__(self, symbols: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of each word as bytes; ``symbols`` has ``GAP`` after each word, and a word is not empty."""
        made = np.empty(len(self.made), np.int32)
        made[self.by_rank] = self.made
        out: list[bytes] = [b""] * len(sizes)
        words, starts = np.arange(len(sizes)), np.cumsum(sizes + 1) - sizes - 1
        merge = np.append(self._find(symbols[:-1], symbols[1:]), UNMERGED)
        while len(words):
            first = np.minimum.reduceat(merge << 32 | np.arange(len(merge)), starts)
            going = first < UNMERGED << 32
            for word, start, size in zip(words[~going].tolist(), starts[~going].tolist(), sizes[~going].tolist()):
                out[word] = symbols[start : start + size].tobytes()
            if not going.all():
                first = first - starts
                kept = np.repeat(going, sizes + 1)
                symbols, merge = symbols[kept], merge[kept]
                words, sizes, first = words[going], sizes[going], first[going]
                starts = np.cumsum(sizes + 1) - sizes - 1
                first = first + starts
            at = first & 0xFFFFFFFF
            symbols[at] = made[first >> 32]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, merge = symbols[kept], merge[kept]
            # Each word before has lost a place.
            at, starts, sizes = at - np.arange(len(at)), starts - np.arange(len(at)), sizes - 1
            merge[at] = self._find(symbols[at], symbols[at + 1])
            after = at[at > starts]
            merge[after - 1] = self._find(symbols[after - 1], symbols[after])
        return out


def text_encoder(model: BpeModel):
    """A function from text to a list of ids."""
    encode = array_encoder(model)
    return lambda text: encode(text).tolist()


class _WordIds(dict):
    """The ids of words as bytes, found when words are first asked for; what is full starts over."""

    def __init__(self, model: BpeModel):
        self.chars = model.with_kind("char")
        self.first_byte = model.kinds.index("byte") if "byte" in model.kinds else None
        self.merges, self.merger, self.held = model.merges, WordMerger(model.merges), 0
        single = sorted((ord(c), i) for c, i in self.chars.items() if len(c) == 1)
        self.points, self.ids = np.array([p for p, _ in single], np.int64), np.array([i for _, i in single], np.int32)

    def __missing__(self, word: str) -> bytes:
        self.make_room()
        return self.keep(word, array("i", merge_word(self.basic_ids(word), self.merges)).tobytes())

    def keep(self, word: str, ids: bytes) -> bytes:
        self[word] = ids
        self.held += len(ids) // 4
        return ids

    def make_room(self) -> None:
        if len(self) >= WORD_CACHE or self.held >= PIECE_CACHE:
            self.clear()
            self.held = 0

    def basic_ids(self, word: str) -> list[int]:
        ids: list[int] = []
        for c in word:
            if c in self.chars:
                ids.append(self.chars[c])
            elif self.first_byte is None:
                ids.append(UNK_ID)
            else:
                # A mark that no vocabulary character stands for was a blank.
                raw = " " if c == WORD_MARK else c
                ids.extend(self.first_byte + b for b in raw.encode("utf-8"))
        return ids

    def learn(self, found: Iterable[list[str]]) -> None:
        """Find the ids of all new words together but for long ones and those with a character of no piece."""
        self.make_room()
        new = [w for w in set().union(*found).difference(self) if len(w) <= SHORT_WORD]
        if not new or not len(self.points):
            return
        flat = np.frombuffer("\0".join([*new, ""]).encode("utf-32-le"), np.int32)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        near = np.minimum(np.searchsorted(self.points, flat), len(self.points) - 1)
        symbols = np.where(self.points[near] == flat, self.ids[near], GAP).astype(np.int32)
        symbols[np.cumsum(sizes + 1) - 1] = GAP
        starts = np.cumsum(sizes + 1) - sizes - 1
        known = np.add.reduceat(symbols == GAP, starts, dtype=np.int64) == 1
        lists = self.merger(symbols[np.repeat(known, sizes + 1)], sizes[known])
        for i, ids in zip(np.flatnonzero(known).tolist(), lists):
            self.keep(new[i], ids)


def texts_encoder(model: BpeModel):
    """A function from texts to an array of ids for each that remembers the words it has seen."""
    words, finder = _WordIds(model), re.compile(WORD_PATTERN)
    symbols = model.with_kind("user")
    split_symbols = re.compile("(" + "|".join(map(re.escape, symbols)) + ")").split if symbols else None

    def encode(texts: Sequence[str | None]) -> list[array]:
        parted = [split_symbols(text or "") if split_symbols else [text or ""] for text in texts]
        found = [[p if p in symbols else found_words(p.replace(" ", WORD_MARK), finder) for p in parts] for parts in parted]
        words.learn(f for parts in found for f in parts if isinstance(f, list))
        out = []
        for parts in found:
            ids = array("i")
            for f in parts:
                # Without a step of Python for a word that is remembered.
                ids.frombytes(array("i", [symbols[f]]).tobytes() if isinstance(f, str) else b"".join(map(words.__getitem__, f)))
            out.append(ids)
        return out

    return encode


def array_encoder(model: BpeModel):
    """A function from one text to an array of ids."""
    encode = texts_encoder(model)
    return lambda text: encode([text])[0]


def text_groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[list[str | None]]:
    """The texts in groups of at most ``limit`` characters, or of one longer text."""
    group, size = [], 0
    for text in texts:
        text = text.as_py()
        if group and size + len(text or "") > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def id_lists(rows: Sequence[array]) -> pa.Array:
    """An array of lists from one array of 32-bit ids a row."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r, np.int32) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def bpe_ids(spark: SparkSession, model: BpeModel, text: str = "text") -> Column:
    """Token ids of a text; each worker remembers the words it has seen.

    Texts come in small batches and ids go back in smaller ones, as arrays of 32-bit numbers:
    ids as Python objects would take many times the room of the text.
    """
    shared = spark.sparkContext.broadcast(model)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        many = texts_encoder(shared.value)
        for texts in batches:
            for group in text_groups(texts):
                yield id_lists([ids for some in text_groups(pa.array(group, pa.string()), WORDS_BYTES) for ids in many(some)])

    return encode(text)


def encode_bpe(df: DataFrame, model: BpeModel, text: str = "text", out: str = "input_ids") -> DataFrame:
    """Add token ids; a map over Arrow batches without a shuffle."""
    return spread(df).withColumn(out, bpe_ids(df.sparkSession, model, text))


def decode_bpe(
    df: DataFrame,
    model: BpeModel,
    ids: str = "input_ids",
    out: str = "text",
    skip_special: bool = False,
    spaces_between: bool = False,
) -> DataFrame:
    """Add the text of token ids, from built-in expressions alone.

    Pieces are looked up as hexadecimal bytes in one constant array. Bytes that are not UTF-8
    become the replacement character, runs of them as Python's ``errors="replace"`` has it.
    ``spaces_between`` parts special tokens from their neighbours by a blank.
    """
    byte_of = {i: p[3:5] for p, i in model.with_kind("byte").items()}
    special = sorted(model.with_kind("control", "user").values())
    hexed = [byte_of.get(i, p.encode("utf-8").hex()) for i, p in enumerate(model.pieces)]
    if skip_special:
        for i in special:
            hexed[i] = ""
    pieces = F.split(F.lit(",".join(hexed)), ",")
    listed = F.coalesce(F.col(ids), F.array().cast("array<int>"))

    def piece(x, i):
        found = F.element_at(pieces, (x + 1).cast("int"))
        if skip_special or not spaces_between:
            return found
        edge = (i > 0) & (x.isin(special) | F.get(listed, i - 1).isin(special))
        return F.concat(F.when(edge, "20").otherwise(""), found)

    raw = F.unhex(F.array_join(F.transform(listed, piece), ""))
    valid = F.make_valid_utf8(raw.cast("string"))
    return df.withColumn(out, F.replace(valid, F.lit(WORD_MARK), F.lit(" ")))


def compare_tokenizations(
    a: DataFrame, b: DataFrame, key: Sequence[str], ids: str = "input_ids"
) -> DataFrame:
    """``(texts, equal, different)`` for two tokenizations of the same texts."""
    keys = list(key)
    both = a.select(*keys, F.col(ids).alias("__a")).join(
        b.select(*keys, F.col(ids).alias("__b")), keys, "full_outer"
    )
    same = F.col("__a").eqNullSafe(F.col("__b"))
    return both.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(same).alias("equal"),
        F.count_if(~same).alias("different"),
    )


# Artefacts


def save_vocabulary(spark: SparkSession, vocab: DataFrame, merges: DataFrame, specials: DataFrame, path: str):
    """The tables ``vocab``, ``merges`` and ``special_tokens`` below ``path``."""
    for name, table in (("vocab", vocab), ("merges", merges), ("special_tokens", specials)):
        table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("vocab", "merges", "special_tokens"))
