"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

``RankQueue`` has a bucket of linked-list positions for each merge rank and three levels of
64-bit words above them; two find-first-set steps down the levels give the lowest rank in use.
Merging a pair unlinks one position and puts the new neighbouring pairs in; entries that no
longer describe a live pair are skipped when they come up. A pre-token of ``n`` bytes takes
``n`` pushes and at most ``2 n`` more, whatever its length, so very long pre-tokens are fine.

Defined cases: null text is empty and gives no ids; ids decode to the very bytes of the text.
Every row keeps its place, repeated rows give repeated results, other columns are passed on.
The input must not hold the columns ``ids`` or ``decoded``: they are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from corpusloom.llm import vector

MAX_RANK_FILE_BYTES = 64 << 20
WORD_MEMORY = 300_000
RUNS_AT_ONCE = 1 << 16
LONG_TEXT = 1 << 18

_WORD = 63


class RankQueue:
    """Arrays of positions by rank; ``pop`` takes the whole bucket of the lowest rank."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = []
        size = ranks
        while True:
            size = (size + _WORD) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for level in self.levels:
            bit, at = 1 << (at & _WORD), at >> 6
            seen = level[at]
            level[at] = seen | bit
            if seen:
                break

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        bounds = [*starts.tolist(), len(ranks)]
        for k, rank in enumerate(ranks[starts].tolist()):
            self.push(rank, positions[bounds[k] : bounds[k + 1]])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        rest = at
        for level in self.levels:
            bit, rest = 1 << (rest & _WORD), rest >> 6
            level[rest] &= ~bit
            if level[rest]:
                break
        bucket = self.buckets.pop(at)
        return at, np.unique(np.concatenate(bucket)) if len(bucket) > 1 else bucket[0]


class Runs:
    """Arrays of different lengths, kept end to end."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.offsets = np.cumsum(lengths) - lengths

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs numbered ``at``, joined, and where each ends."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if len(ends) else 0, self.flat.dtype)
        for lo in range(0, len(at), RUNS_AT_ONCE):
            part = slice(lo, lo + RUNS_AT_ONCE)
            n, start = lengths[part], int(ends[lo] - lengths[lo])
            stop = int(ends[part][-1])
            shift = self.offsets[at[part]] - (ends[part] - n - start)
            out[start:stop] = self.flat[np.arange(stop - start) + np.repeat(shift, n)]
        return out, ends


class Coder:
    """Ranks, the pre-token pattern and a bounded memory of words already encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(_spelled(pattern, {r"\s": WHITE}))
        self.find_latin = _latin_pattern(pattern)
        self.size = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(max(1, self.size))  # empty between uses
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        lengths = np.zeros(self.size, np.int64)
        for piece, i in ranks.items():
            lengths[i] = len(piece)
        by_id = sorted((i, piece) for piece, i in ranks.items())
        self.vocabulary = Runs(np.frombuffer(b"".join(piece for _, piece in by_id), np.uint8), lengths)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.words = Runs(np.zeros(0, np.int32), np.zeros(0, np.int64))

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours would form, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, words: list[bytes]) -> Runs:
        """Ids of pre-tokens: in each, the lowest-ranked pair first, the leftmost among equals.

        All words share one linked list and one queue, and no pair crosses the end of a word. A
        bucket is merged at once where this equals one merge after another: pairs that overlap
        take turns from the left, and if a merge would make a pair of the same or a lower rank,
        each word takes only its leftmost merge and the others go back into the bucket.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        ends = np.cumsum(lengths)
        token = self.byte_ids[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        whole = [self.ranks.get(w) for w in words]
        done = np.array([w is not None for w in whole], bool)
        # A word that is a token as it stands: its first position takes the id, the others go.
        first = (ends - lengths)[done]
        token[np.repeat(done, lengths)] = -1
        token[first] = [w for w in whole if w is not None]
        after[first] = -1
        rank_at = np.full(n, -1, np.int32)  # rank of the live pair that starts at a position
        queue = self.queue
        for lo in range(0, n, RUNS_AT_ONCE):
            part = slice(lo, lo + RUNS_AT_ONCE)
            live = (np.flatnonzero((token[part] >= 0) & (after[part] >= 0)) + lo).astype(np.int32)
            rank_at[live] = self.pair_rank(token[live], token[after[live]])
            live = live[rank_at[live] >= 0]
            queue.push_all(rank_at[live], live)
        while (entry := queue.pop()) is not None:
            rank, at = entry
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                touching = after[at[:-1]] == at[1:]
                if touching.any():  # in a run of overlapping pairs, every second one waits and goes stale
                    run = np.concatenate([[0], np.flatnonzero(~touching) + 1])
                    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                    queue.push(rank, at[place % 2 == 1])
                    at = at[place % 2 == 0]
            if len(at) > 1 and not self._safe(rank, at, token, after, before):
                single = np.diff(word[at], prepend=-1) != 0
                if not single.all():
                    queue.push(rank, at[~single])
                    at = at[single]
            self._apply(rank, at, token, after, before, rank_at)
        kept = token >= 0
        counts = np.bincount(word[kept], minlength=len(words)).astype(np.int64)
        return Runs(token[kept].astype(np.int32), counts)

    def _safe(self, rank, at, token, after, before) -> bool:
        """Whether the merges at ``at``, all done, make only pairs of higher ranks."""
        ids = token.copy() if len(at) * 8 > len(token) else None
        right, left = after[after[at]], before[at]
        right, left = right[right >= 0], left[left >= 0]
        if ids is not None:
            ids[at] = rank
            right_ids, left_ids = ids[right], ids[left]
        else:
            right_ids = np.where(np.isin(right, at, assume_unique=True), rank, token[right])
            left_ids = token[left]
        merged = np.full(max(len(right), len(left)), rank)
        sides = (self.pair_rank(merged[: len(right)], right_ids), self.pair_rank(left_ids, merged[: len(left)]))
        return all(not ((x >= 0) & (x <= rank)).any() for x in sides)

    def _apply(self, rank, at, token, after, before, rank_at) -> None:
        """Merge the pairs at ``at``, which do not overlap, and queue the pairs this makes."""
        gone = after[at]
        right = after[gone]
        token[at], token[gone] = rank, -1
        rank_at[gone] = -1
        after[at] = right
        has = right >= 0
        before[right[has]] = at[has]
        rank_at[at] = -1
        rank_at[at[has]] = self.pair_rank(token[at[has]], token[right[has]])
        left = before[at]
        left = left[left >= 0]
        rank_at[left] = self.pair_rank(token[left], token[after[left]])
        changed = np.concatenate([at, left])
        changed = changed[rank_at[changed] >= 0]
        if len(changed):
            self.queue.push_all(rank_at[changed], changed)

    def pieces(self, text: str) -> Iterable[str]:
        """Matches of the pattern; Latin text takes an equal pattern with its classes spelled out.

        Those of a long text come one by one, as all of them take many times its size.
        """
        find = self.find
        if self.find_latin is not None:
            try:
                text.encode("latin-1")
                find = self.find_latin
            except UnicodeEncodeError:
                pass
        return find.findall(text) if len(text) < LONG_TEXT else (m[0] for m in find.finditer(text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and where each text ends; what no match covers is left out."""
        if len(self.known) > WORD_MEMORY:
            self.forget()
        number = self.known.__getitem__
        numbers = [np.fromiter(map(number, self.pieces(text)), np.int32) for text in texts]
        fresh = self.known.fresh
        if fresh:
            found = self.merge([w.encode() for w in fresh])
            self.words = Runs(
                np.concatenate([self.words.flat, found.flat]), np.concatenate([self.words.lengths, found.lengths])
            )
            self.known.fresh = []
        flat, ends = self.words.take(np.concatenate([np.zeros(0, np.int32), *numbers]))
        counts = np.cumsum([len(x) for x in numbers])
        return flat, np.concatenate([[0], ends])[counts]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, joined, and where each id's bytes end."""
        return self.vocabulary.take(ids)


class _Numbers(dict):
    """Words to running numbers."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


# White space as the Unicode property has it; \\s of Python's modules holds four control characters more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def _spelled(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with ``\\s``, ``\\S`` and properties replaced by plain classes, inside and outside brackets."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((c for c in classes if pattern.startswith(c, i)), None)
        if name is None and pattern[i] == "\\":
            name, text = pattern[i : i + 2], pattern[i : i + 2]
        elif name is not None:
            text = classes[name] if inside else f"[{classes[name]}]"
        else:
            name = text = pattern[i]
            inside = text == "[" or inside and text != "]"
        out.append(text)
        i += len(name)
    return "".join(out).replace(r"\S", f"[^{WHITE}]")


def _latin_pattern(pattern: str):
    """For text up to U+00FF; None where the pattern uses anything else than these classes."""
    spelled = _spelled(pattern, {r"\s": WHITE, r"\p{L}": LATIN_LETTERS, r"\p{N}": LATIN_NUMBERS})
    return None if re.search(r"\\[pPwWdDbB]|\(\?[^!=:]", spelled) else re.compile(spelled)


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    """Lines of base64 piece and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}


_coders: dict[tuple, Coder] = {}


def _coder(shared, pattern: str) -> Coder:
    """One coder for each worker process; workers live on between tasks."""
    key = (hash(shared.value), len(shared.value), pattern)
    if key not in _coders:
        _coders[key] = Coder(read_ranks(shared.value), pattern)
    return _coders[key]


def load_ranks(spark, path: str):
    """The rank file as a broadcast variable; its size is checked."""
    with open(path, "rb") as f:
        content = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(content) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array, kept: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, name])


def encode(
    docs: DataFrame, ranks, pattern: str, text_col: str = "text", keep_text: bool = True, decoded: bool = False
) -> DataFrame:
    """``docs`` with ``ids array<int>``; ``ranks`` comes from ``load_ranks``.

    With ``decoded`` the ids are decoded again in the same task, to ``decoded binary``.
    """
    vector.bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("ids", "decoded") and (keep_text or c != text_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for whole in batches:
            for lo, hi in vector.groups(vector.texts(whole.column(text_col))[1], vector.BATCH_BYTES):
                batch = whole.slice(lo, hi - lo)
                flat, ends = coder.encode([t or "" for t in batch.column(text_col).to_pylist()])
                ids = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat))
                out = _with(batch, "ids", ids, kept)
                if decoded:
                    out = _with(out, "decoded", _bytes(coder, flat, ends), [*kept, "ids"])
                yield out
        vector.give_back()

    fields = [docs.schema[c] for c in kept] + [StructField("ids", ArrayType(IntegerType()))]
    fields += [StructField("decoded", BinaryType())] * decoded
    return docs.mapInArrow(work, StructType(fields))


def _bytes(coder: Coder, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each run of ids; ``ends`` tells where the runs end."""
    data, at = coder.decode(ids)
    bounds = np.concatenate([[0], at])[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]
    )


def decode(tokens: DataFrame, ranks, pattern: str) -> DataFrame:
    """``tokens`` with ``decoded binary``, the bytes of ``ids``; null ids give no bytes."""
    vector.bound_batches(tokens.sparkSession)
    kept = [c for c in tokens.columns if c != "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids = batch.column("ids").fill_null([])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
                column = _bytes(coder, ids.flatten().to_numpy(zero_copy_only=False), ends[1:])
                yield _with(batch, "decoded", column, kept)
        vector.give_back()

    fields = [tokens.schema[c] for c in kept] + [StructField("decoded", BinaryType())]
    return tokens.mapInArrow(work, StructType(fields))


def digests(docs: DataFrame, rank_path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """Encode, decode the ids again, and reduce both to digests; ``carry`` names columns to keep, ``ids`` among them."""
    ranks = load_ranks(docs.sparkSession, rank_path)
    carry = carry or []
    given = [c for c in carry if c != "ids"]
    both = encode(docs.select("doc_id", *given, "text"), ranks, pattern, keep_text=False, decoded=True)
    return both.select(
        "doc_id",
        *carry,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_rank_queue_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
