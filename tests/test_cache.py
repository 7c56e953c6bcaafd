"""Prepared datasets under several sessions, readers and failures."""

import os
import threading
import time

import pytest
from pyspark.errors import AnalysisException

from corpusloom.sources.files import create_new, path_exists
from corpusloom.sources.materialize import DatasetCache


def build(spark, n, calls=None, wait=0.0):
    def run():
        if calls is not None:
            calls.append(n)
        time.sleep(wait)
        return spark.range(n).repartition(2)

    return run


def test_sessions_on_one_key_build_once(spark, tmp_path):
    calls, found = [], []

    def ask():
        cache = DatasetCache(spark.newSession(), str(tmp_path), poll_seconds=0.2)
        found.append(cache.materialize("k", [], {"a": 1}, build(spark, 9, calls, wait=2)).count())

    asking = [threading.Thread(target=ask) for _ in range(3)]
    for t in asking:
        t.start()
    for t in asking:
        t.join()
    assert calls == [9] and found == [9, 9, 9]
    assert os.listdir(tmp_path / "_claims") == []


def test_sessions_on_different_keys_all_reach_the_index(spark, tmp_path):
    caches = [DatasetCache(spark.newSession(), str(tmp_path)) for _ in range(4)]
    asking = [
        threading.Thread(target=cache.materialize, args=(f"k{i}", [], {}, build(spark, i + 1)))
        for i, cache in enumerate(caches)
    ]
    for t in asking:
        t.start()
    for t in asking:
        t.join()
    assert sorted((r["key"], r["num_samples"]) for r in caches[0].index().collect()) == [(f"k{i}", i + 1) for i in range(4)]


def test_a_reader_survives_replacements(spark, tmp_path):
    cache = DatasetCache(spark, str(tmp_path))
    first = cache.materialize("k", [], {"v": 0}, build(spark, 5))
    cache.materialize("k", [], {"v": 1}, build(spark, 6))
    assert len(first.collect()) == 5  # one replacement: kept
    with cache.reading("k") as held:
        for v in (2, 3, 4):
            cache.materialize("k", [], {"v": v}, build(spark, 5 + v))
        assert len(held.collect()) == 6  # leased
        assert cache.remove("k")
        assert len(held.collect()) == 6
        path = held.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, path)
    assert cache.prune("k") == 1 and not path_exists(spark, path)
    with pytest.raises(KeyError), cache.reading("k"):
        pass


def test_a_lease_of_a_lost_session_runs_out(spark, tmp_path):
    cache = DatasetCache(spark, str(tmp_path), keep=1, lease_seconds=0)
    cache.materialize("k", [], {"v": 0}, build(spark, 5))
    with cache.reading("k") as held:
        time.sleep(0.1)
        cache.materialize("k", [], {"v": 1}, build(spark, 6))
        assert not path_exists(spark, held.inputFiles()[0])


def test_a_claim_of_a_lost_session_is_taken_over(spark, tmp_path):
    cache = DatasetCache(spark, str(tmp_path), claim_seconds=0.5, poll_seconds=0.2)
    claim = cache._claim("k")
    assert claim is not None and cache._claim("k") is None
    assert not create_new(spark, claim, "other")
    assert cache.materialize("k", [], {}, build(spark, 4)).count() == 4


def test_a_failing_build_leaves_nothing_and_says_why(spark, tmp_path):
    cache = DatasetCache(spark, str(tmp_path))

    def fail():
        raise ZeroDivisionError("no")

    with pytest.raises(ZeroDivisionError):
        cache.materialize("k", [], {}, fail)
    with pytest.raises(AnalysisException):
        cache.materialize("k", [], {}, lambda: spark.range(3).select("absent"))
    assert cache.info().head()["entries"] == 0
    assert cache.materialize("k", [], {}, build(spark, 3)).count() == 3


@pytest.mark.parametrize("damage", ["gone", "empty", "garbage"])
def test_damaged_datasets_are_built_anew(spark, tmp_path, damage):
    cache, calls = DatasetCache(spark, str(tmp_path)), []
    cache.materialize("k", [], {}, build(spark, 50, calls))
    stored = cache.index().head()["path"]
    for name in os.listdir(stored):
        path = os.path.join(stored, name)
        if damage == "gone":
            os.remove(path)
        elif not name.startswith((".", "_")):
            with open(path, "wb") as handle:
                handle.write(b"" if damage == "empty" else b"x" * 500)
    assert cache.materialize("k", [], {}, build(spark, 50, calls)).count() == 50
    assert calls == [50, 50]


def test_other_errors_of_the_store_surface(spark, tmp_path, monkeypatch):
    cache = DatasetCache(spark, str(tmp_path))
    cache.materialize("k", [], {}, build(spark, 5))

    class Broken:
        def parquet(self, path):
            raise PermissionError(path)

    entry = cache._entry("k")
    monkeypatch.setattr(cache, "_entry", lambda key: entry)
    monkeypatch.setattr(type(spark), "read", property(lambda self: Broken()))
    with pytest.raises(PermissionError):
        cache._stored("k", entry["fingerprint"])
