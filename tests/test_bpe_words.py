"""Words are counted and encoded without a step for each occurrence."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.functions import bpe

TEXTS = ["a  b", " ", "", None, "x<|user|>y z", "a\n b\n\n  c ", "▁▁\n▁q  ", "é𝄞 é𝄞", "<|user|>", "word " * 50, "a" * 300]


def model_counts(texts, special=("<|user|>",)):
    counts = {}
    for text in texts:
        for run in re.sub("|".join(map(re.escape, special)), "\n", text or "").replace(" ", "▁").split("\n"):
            for word in re.findall(bpe.WORD_PATTERN, run):
                counts[word] = counts.get(word, 0) + 1
    return counts


@pytest.mark.parametrize("cache,group", [(200_000, 1 << 21), (2, 3)])
def test_counts_of_words(spark, monkeypatch, cache, group):
    monkeypatch.setattr(bpe, "WORD_CACHE", cache)
    monkeypatch.setattr(bpe, "GROUP_BYTES", group)
    lines = spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1)
    got = bpe.word_counts(lines)
    assert {r["word"]: r["n"] for r in got.collect()} == model_counts(TEXTS)
    assert got.dtypes == [("word", "string"), ("n", "bigint")]
    # A row for each distinct word leaves a task, not one for each occurrence.
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_text_that_is_not_utf8_is_counted(spark):
    lines = spark.sql("SELECT cast(unhex('61FF2062') AS string) AS text")
    assert {r["word"]: r["n"] for r in bpe.word_counts(lines).collect()} == {"a�": 1, "▁b": 1}


def test_words_are_merged_together_and_once(monkeypatch):
    model = bpe.BpeModel([*"012", "a", "b", "▁", "ab"], ["control"] * 3 + ["char"] * 3 + ["merge"], {(3, 4): (0, 6)})
    asked = []
    merge = bpe.merge_word
    monkeypatch.setattr(bpe, "merge_word", lambda *a: asked.append(1) or merge(*a))
    text = "ab ba  ab" * 20
    many = bpe.texts_encoder(model)
    whole = [ids.tolist() for ids in many([text, None, "b", text])]
    assert not asked  # no word on its own
    monkeypatch.setattr(bpe, "GROUP_BYTES", 4)  # longer ones are not listed at once
    assert [ids.tolist() for ids in bpe.texts_encoder(model)([text, None, "b", text])] == whole
    assert len(asked) == len(set(re.findall(bpe.WORD_PATTERN, text.replace(" ", "▁"))))


def test_merger_equals_the_queue_of_each_word():
    rng = random.Random(7)
    for _ in range(300):
        pairs = {(rng.randint(3, 8), rng.randint(3, 8)) for _ in range(rng.randint(0, 12))}
        # Some merges make a piece again that an earlier one has made.
        merges = {pair: (10 * rank, rng.randint(5, 10)) for rank, pair in enumerate(pairs)}
        words = [[rng.randint(3, 8) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 20))]
        flat = np.array([x for w in words for x in [*w, bpe.GAP]], np.int32)
        got = bpe.WordMerger(merges)(flat, np.array(list(map(len, words))))
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [bpe.merge_word(list(w), merges) for w in words]


def test_long_words_and_characters_of_no_piece(monkeypatch):
    kinds = ["control"] * 3 + ["byte"] * 256 + ["char"] * 2 + ["merge"]
    model = bpe.BpeModel([*"012", *(f"<0x{i:02X}>" for i in range(256)), "a", "b", "ab"], kinds, {(259, 260): (0, 261)})
    text = "abéab ab" + "ab" * 40 + " " + "abé" * 30 + "\0ab"
    whole = bpe.text_encoder(model)(text)
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    assert bpe.text_encoder(model)(text) == whole


def test_merged_places_are_those_of_a_search_over_all_pairs():
    rng = random.Random(5)
    for _ in range(200):
        symbols = np.array([-1, *(rng.choice([-1, 0, 1, 2, 3, 9]) for _ in range(40)), -1], np.int32)
        weights = np.arange(len(symbols), dtype=np.int64)
        pairs = {(rng.choice([0, 1, 2]), rng.choice([3, 9])) for _ in range(3)} | ({(4, 4)} if rng.random() < 0.5 else set())
        taken = {a << 32 | b: 100 + i for i, (a, b) in enumerate(sorted(pairs))}
        want, i, out = [], 0, []
        while i < len(symbols):
            key = (int(symbols[i]) << 32 | int(symbols[i + 1])) if i + 1 < len(symbols) and min(symbols[i : i + 2]) >= 0 else None
            if key in taken:
                want.append((i, taken[key]))
            out.append(taken.get(key, int(symbols[i])))
            i += 1 + (key in taken)
        at, into = bpe.merge_places(symbols, taken)
        assert list(zip(at.tolist(), into.tolist())) == want
        after, heavy, keys, amounts = bpe.merged_state(symbols, weights, taken)
        assert after.tolist() == out and len(heavy) == len(out)
        change = {}
        for part, weight, sign in ((symbols, weights, -1), (after, heavy, 1)):
            key, real = bpe._packed(part)
            for k, w in zip(key[real].tolist(), weight[:-1][real].tolist()):
                change[k] = change.get(k, 0) + sign * w
        got = {}
        for k, w in zip(keys.tolist(), amounts.tolist()):
            got[k] = got.get(k, 0) + w
        assert {k: w for k, w in got.items() if w} == {k: w for k, w in change.items() if w}


def test_changes_are_read_without_the_symbols(spark, monkeypatch):
    seen = []
    change = bpe.Ranking.change
    monkeypatch.setattr(bpe.Ranking, "change", lambda self, *a: seen.append(a) or change(self, *a))
    lines = spark.createDataFrame([("aa ab abc " * 3,)], "text string")
    bpe.train_bpe(lines, 300, coverage=1.0)
    assert seen and all(None not in a[0] for a in seen)
    state = bpe._state_row(np.array([-1, 1], np.int32), np.zeros(2, np.int64))
    assert state.column("left").null_count == 1 and isinstance(state, pa.RecordBatch)
