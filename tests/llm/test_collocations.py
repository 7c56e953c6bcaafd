"""Phrase mining against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations as co

DOCS = "doc_id long, text string, lang string"


def model(rows, least, top):
    """The contract in plain Python."""
    f = {}
    for _, text, lang in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    own[tuple(words[i : i + k])] += 1
    out = set()
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cands.items():
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            covered = any(len(q) > len(p) and (q[:2] == p or q[1:] == p) and 100 * b >= 50 * a for q, b in cands.items())
            if not covered:
                rows_.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out |= {(lang, i, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)}
    return out


def texts(n=120):
    words = ["New", "york", "city", "the", "of", "a", "ünder", "日本", "x1"]
    state, rows = 7, []
    for i in range(n):
        out = []
        for _ in range(40):
            state = (state * 1103515245 + 12345) % 2**31
            out.append(words[state >> 16 & 7] + ("" if state >> 20 & 7 else [".", ",", "\n", "\x0b", "\t"][(state >> 24) % 5]))
        rows.append((i, " ".join(out), ["en", "de", None][i % 3]))
    return [*rows, (900, None, "en"), (901, "", "xx"), (None, "New York city New York", "en"), (902, " \t. ", None), (902, " \t. ", None)]


@pytest.mark.parametrize("least,top", [(10, 2000), (3, 5)])
def test_equals_plain_counting(spark, least, top):
    rows = texts()
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("mine")).withColumn("phrase", F.lit(1)).repartition(5)
    got = {tuple(r) for r in co.collocations(docs, least, top).collect()}
    assert got == model(rows, least, top)


def test_spills_restarts_and_small_chunks_change_nothing(spark, monkeypatch):
    rows = texts()
    rows = [*rows, (1000, " ".join(t or "" for _, t, _ in rows), "en")]
    for name, value in [("BURST", 4), ("DEEPER", 12), ("ENTRIES", 50), ("WORDS", 6), ("TOKENS", 64), ("CHUNK", 16), ("GATE_BITS", 1 << 15)]:
        monkeypatch.setattr(co, name, value)

    def counted(lengths):
        own, total, parts = co.Counter(lengths, None), Counter(), {}
        batches = []
        for _, text, lang in rows:
            batches += own.read(lang or "und", (text or "").encode())
        batches += own.flush()
        batches += own.spill(0)
        for b in batches:
            run = list(zip(*(b.column(c).to_pylist() for c in ("lang", "phrase"))))
            assert run == sorted(run, key=lambda r: (r[0].encode(), [w.encode() for w in r[1].split(" ") if w]))
            for part, lang, phrase, n in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "phrase", "n"))):
                assert parts.setdefault((lang, phrase), part) == part
                total[lang, phrase] += n
        return total, len(batches)

    small, spills = counted((1, 2, 3))
    monkeypatch.undo()
    large, _ = counted((1, 2, 3))
    assert small == large and spills > 50


def test_burst_containers_count_on(monkeypatch):
    monkeypatch.setattr(co, "BURST", 8)
    monkeypatch.setattr(co, "DEEPER", 30)
    trie, want = co.Trie(), Counter()
    for k in range(1, 8):
        phrases = np.unique([(1 + i % 3 % 2 << 2 * co.ID_BITS) | (1 + i % 9 << co.ID_BITS) | i % (20 * k) for i in range(40 * k)])
        new = len(set(phrases.tolist()) - set(want))
        want.update({p: k for p in phrases.tolist()})
        assert trie.add(phrases, np.full(len(phrases), k)) == new
    assert trie.split and set(trie.own) == {1, 2} and sum(n for n, _ in trie.sizes()) == len(want)
    got = Counter()
    for _, first in trie.sizes():
        for container in trie.take(first):
            got.update(container)
    assert got == want and trie.sizes() == [(0, 0)]


def test_a_frequent_prefix_is_spread(spark):
    ids = [np.full(500, 1), np.full(500, 2), np.arange(3, 503)]
    hashes = co.word_hashes([str(i).encode() for i in range(503)], 503)
    assert len(set(co._prefix_partition("en", ids, hashes).tolist())) == co.SLICES


def test_a_full_gate_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), DOCS)
    want = sorted(map(repr, co.collocations(docs, 3).collect()))
    monkeypatch.setattr(co, "gate_of", lambda frequent: spark.sparkContext.broadcast(b"\xff" * 4096))
    assert sorted(map(repr, co.collocations(docs, 3).collect())) == want


def test_leading_in_buckets(spark, monkeypatch):
    rows = [("en" if i % 5 else "fr", f"p{i:04d}", i % 17, 1, 1, i * 37 % 101) for i in range(900)]
    table = spark.createDataFrame(rows, "lang string, phrase string, a int, l int, r int, score int")
    want = sorted(map(repr, co.leading(table, 20).collect()))
    monkeypatch.setattr(co, "BUCKET_ROWS", 64)
    assert sorted(map(repr, co.leading(table, 20).collect())) == want and len(want) == 40


def test_large_counts_are_exact(spark):
    big = 3_000_000_000
    rows = [("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big)]
    got = co.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).head()
    assert got["score"] == 10**6 * big * big // ((big + 7) * (big + 1))


def test_empty_table_and_no_words(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert co.collocations(spark.createDataFrame([(1, None, None), (2, "...", "en")], DOCS)).collect() == []


def test_very_long_words_and_texts(spark):
    long = "w" * (3 << 20)
    rows = [(1, f"{long} b " * 2, "en"), (2, "a b c " * 400_000, "en")]
    got = {r["phrase"]: r["a"] for r in co.collocations(spark.createDataFrame(rows, DOCS), least=2).collect()}
    assert got == {"a b c": 400_000, "b c a": 399_999, "c a b": 399_999, f"{long} b": 2}


def test_chunks_cut_at_separators():
    text = b"ab cd " * 10
    cuts = list(co._chunks(text))
    assert cuts == [(0, len(text))]
    long = b"x" * (co.CHUNK + 5) + b" y" * co.CHUNK
    cuts = list(co._chunks(long))
    assert cuts[0] == (0, co.CHUNK + 5) and all(long[lo : lo + 1] == b" " for lo, _ in cuts[1:]) and cuts[-1][1] == len(long)
