import json
import os
import warnings

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.batches import map_batches
from corpusloom.plans.loading import load_manifest, load_shards
from corpusloom.plans.pretokenize import (
    PretokenizeOptions,
    pretokenize,
    pretokenize_languages_to_shards,
    pretokenize_to_shards,
)
from corpusloom.sources import catalog, files, shards
from corpusloom.sources.materialize import DatasetCache, fingerprint
from corpusloom.session import scratch_root


def write(spark, path, rows, schema="input_ids array<bigint>, attention_mask array<bigint>"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def blocks(spark, n, start=0, size=4):
    rows = [(i, list(range(start + i, start + i + size)), [1] * size) for i in range(n)]
    schema = "ord bigint, input_ids array<int>, attention_mask array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


def first_ids(df, *cols):
    return sorted((*[r[c] for c in cols], r["input_ids"][0]) for r in df.collect())


# Catalog


def test_language_codes(spark, tmp_path):
    path = write(spark, tmp_path / "cn", [(1, "一", "x")], "doc_id bigint, text string, url string")
    known = {"cn": catalog.Source(path), "ko": catalog.Source(str(tmp_path / "none"))}
    with pytest.warns(UserWarning, match="deprecated"):
        assert catalog.read_corpus(spark, known, "zh").columns == ["doc_ord", "lang", "text"]
    with pytest.raises(ValueError, match="unsupported"):
        catalog.read_corpora(spark, known, ["cn", "xx"])
    with pytest.warns(UserWarning, match="skipped"):
        assert catalog.read_corpora(spark, known, ["ko", "cn"]).count() == 1
    with pytest.raises(ValueError, match="no corpus"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        catalog.read_corpora(spark, known, ["ko"])
    with pytest.raises(FileNotFoundError):
        catalog.read_corpora(spark, known, ["ko"], on_missing="error")


def test_language_filter_and_columns_reach_the_scan(spark, sf_dir):
    known = {"en": catalog.Source(f"{sf_dir}/documents.parquet", "lang = 'en'")}
    plan = catalog.read_corpus(spark, known, "en")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan


# Files


def test_files_in_order(spark, tmp_path):
    a = write(spark, tmp_path / "a b", [("a0",), ("a1",), ("a2",)], "text string")
    b = write(spark, tmp_path / "b", [("b0",)], "text string")
    a, b = (next(os.path.join(p, f) for f in os.listdir(p) if f.endswith(".parquet")) for p in (a, b))
    with pytest.warns(UserWarning, match="not found"):
        df = files.read_files_in_order(spark, [b, str(tmp_path / "no"), a, b])
    got = df.orderBy("ord").collect()
    assert [(r["text"], r["file_ord"]) for r in got] == [("b0", 0), ("a0", 1), ("a1", 1), ("a2", 1), ("b0", 2)]
    assert [r["ord"] for r in got] == list(range(5))
    capped = files.read_files_in_order(spark, [a, b], first_n=2).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in capped] == [(0, "a0"), (1, "a1"), (2, "b0")]
    with pytest.raises(FileNotFoundError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        files.read_files_in_order(spark, ["/none"])


def test_ordering_files_does_not_shuffle_their_rows(spark, sf_dir):
    df = files.read_files_in_order(spark, [f"{sf_dir}/documents.parquet"], ["text"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(text" not in plan and "BroadcastHashJoin" in plan


def test_shard_directory_and_text_lines(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, str(tmp_path / "empty"))
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert [r[0] for r in files.read_text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    with pytest.raises(FileNotFoundError):
        files.read_text_lines(spark, str(tmp_path / "no.txt"))


def test_manifest(spark, tmp_path):
    def manifest(body):
        path = tmp_path / f"m{len(os.listdir(tmp_path))}.yaml"
        path.write_text(json.dumps(body))
        return files.read_manifest(spark, str(path))

    got = manifest({"train": ["x", "y"], "eval": ["z"]})
    assert got.eval_size == 10_000
    assert got.table(spark).count() == 3
    for body in ({"eval": ["z"]}, {"train": ["x"], "eval": []}, {}):
        with pytest.raises(ValueError):
            manifest(body)


def test_load_from_manifest_and_shards(spark, tmp_path):
    rows = [([i, i + 1], [1, 1]) for i in range(5)]
    one, two = write(spark, tmp_path / "one", rows), write(spark, tmp_path / "two", rows)
    one, two = (next(os.path.join(p, f) for f in os.listdir(p) if f.endswith(".parquet")) for p in (one, two))
    path = tmp_path / "m.yaml"
    path.write_text(json.dumps({"train": [one, two], "eval": [two, one], "eval_size": 2}))
    cache = DatasetCache(spark, str(tmp_path / "cache"))
    for c in (None, cache, cache):
        train, held = load_manifest(spark, str(path), c)
        assert train.count() == 10 and held.count() == 4
        assert all(r["labels"] == r["input_ids"] for r in held.collect())
    assert cache.info().head()["entries"] == 2
    train, held = load_shards(spark, str(tmp_path / "one"), 2)
    assert (train.count(), first_ids(held)) == (5, [(0,), (1,)])


# Shards


def test_fresh_run_append_and_cap(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_shards(blocks(spark, 10), path, 4)
    with pytest.raises(FileExistsError):
        shards.write_shards(blocks(spark, 1), path, 4)
    shards.append_shards(blocks(spark, 5, start=10), path, 4)
    got = shards.read_committed(spark, path)
    assert first_ids(got, "shard") == [(i // 4, i) for i in range(15)]
    stored = spark.read.parquet(f"{path}/commit=0")
    assert stored.drop("shard").dtypes == [("input_ids", "array<bigint>"), ("attention_mask", "array<bigint>")]
    last = shards.progress(spark, path).orderBy("commit").collect()[-1]
    assert (last["rows_done"], last["shard"], last["rows_in_shard"]) == (15, 3, 3)


def test_resume_after_a_stop_equals_an_undisturbed_run(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_incremental(blocks(spark, 23), path, 5, save_every=4, max_commits=2)
    # Files of a commit that died before its progress row was written.
    blocks(spark, 3).select("input_ids", "attention_mask", F.lit(1).alias("shard")).write.partitionBy(
        "shard"
    ).parquet(f"{path}/commit=2")
    assert shards.read_committed(spark, path).count() == 8
    for _ in range(2):  # the second resume finds nothing left to do
        shards.write_incremental(blocks(spark, 23), path, 5, save_every=4, resume=True)
        assert first_ids(shards.read_committed(spark, path), "shard") == [(i // 5, i) for i in range(23)]
    by_lang = shards.progress_by_language(shards.progress(spark, path)).head()
    assert (by_lang["rows_done"], by_lang["shard"], by_lang["rows_in_shard"], by_lang["done"]) == (23, 4, 3, True)


def test_languages_in_turn_and_resume(spark, tmp_path):
    path = str(tmp_path / "s")
    parts = [("en", blocks(spark, 7)), ("ja", blocks(spark, 3, start=7)), ("ko", blocks(spark, 2, start=10))]
    shards.write_languages(parts[:2], path, 4)
    assert shards.finished_languages(spark, path) == ["en", "ja"]
    shards.write_languages(parts, path, 4, resume=True)
    assert first_ids(shards.read_committed(spark, path), "shard") == [(i // 4, i) for i in range(12)]
    assert shards.progress(spark, path).count() == 3


def test_order_inside_a_shard_and_sidecar(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_shards(blocks(spark, 9), path, 9)
    files_ = [f for f in os.listdir(f"{path}/commit=0/shard=0") if f.endswith(".parquet")]
    assert len(files_) == 1
    rows = spark.read.parquet(f"{path}/commit=0/shard=0").select("input_ids", "_metadata.row_index").collect()
    assert all(r["input_ids"][0] == r["row_index"] for r in rows)
    shards.write_dataset_info(shards.read_committed(spark, path), path)
    info = spark.read.json(f"{path}/_dataset_info").head()
    assert (info["num_examples"], info["input_ids_min"], info["input_ids_max"]) == (9, 4, 4)


def test_block_ordinal(spark):
    rows = [(b, k) for b in range(6) for k in range(b % 3)]
    df = spark.createDataFrame(rows, "batch_id bigint, block_ord bigint")
    got = shards.block_ordinal(df).orderBy("batch_id", "block_ord").collect()
    assert [r["ord"] for r in got] == list(range(len(rows)))


def test_write_failure_aborts(spark, tmp_path):
    bad = blocks(spark, 3).withColumn("input_ids", F.when(F.col("ord") == 1, F.raise_error(F.lit("boom"))).otherwise(F.col("input_ids")))
    with pytest.raises(Exception, match="boom"):
        shards.write_shards(bad, str(tmp_path / "s"), 2)
    assert not shards.has_progress(spark, str(tmp_path / "s"))


# Cache


def test_cache_reuse_rebuild_and_removal(spark, tmp_path):
    source = write(spark, tmp_path / "src", [([1], [1])])
    listed = [next(os.path.join(source, f) for f in os.listdir(source) if f.endswith(".parquet"))]
    cache, built = DatasetCache(spark, str(tmp_path / "cache")), []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    for config, times in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        assert cache.materialize("k", listed, config, build).count() == 1
        assert len(built) == times
    os.utime(listed[0], (1, 1))
    cache.materialize("k", listed, {"a": 2}, build)
    assert len(built) == 3 and cache.info().head()["total_samples"] == 1
    stored = cache.index().head()["path"]
    for f in os.listdir(stored):
        open(os.path.join(stored, f), "wb").close()
    cache.materialize("k", listed, {"a": 2}, build)
    assert len(built) == 4
    assert cache.remove("k") and not cache.remove("k")
    cache.materialize("k", listed, {}, build)
    cache.clear()
    assert cache.info().head()["entries"] == 0


def test_fingerprint_depends_on_order_config_and_presence(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("x"), b.write_text("yy")
    of = lambda fs, c: fingerprint(spark, [str(f) for f in fs], c)
    base = of([a, b], {"p": 1, "q": 2})
    assert len(base) == 64 and base == of([a, b], {"q": 2, "p": 1})
    others = [of([b, a], {"p": 1, "q": 2}), of([a, b], {"p": 2}), of([a, tmp_path / "c"], {"p": 1, "q": 2})]
    assert len({base, *others}) == 4


# Batches and scratch


def test_map_batches(spark):
    df = spark.range(10).select(F.col("id").alias("ord"), (F.col("id") * 2).alias("v")).repartition(3)
    got = map_batches(df, lambda p: p.head(1)[["ord"]], "ord bigint", 4, "ord").orderBy("ord").collect()
    assert [r[0] for r in got] == [0, 4, 8]
    rows = map_batches(df, lambda p: p.assign(v=p.v + 1)[["ord", "v"]], "ord bigint, v bigint", 4)
    assert sorted(tuple(r) for r in rows.collect()) == [(i, 2 * i + 1) for i in range(10)]


def test_scratch_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert root == configured.rstrip("/") if configured else os.path.isdir(root)
    assert spark.sparkContext.getCheckpointDir() is not None


# Whole runs


def run_docs(spark, keep=None):
    rows = [(s, i, f"text {s} {i} " * 3) for s in range(3) for i in range(6 + s)]
    return spark.createDataFrame([r for r in rows if keep is None or r[0] in keep], "src_ord int, doc_ord bigint, text string")


def test_run_to_shards(spark, tmp_path):
    opts = PretokenizeOptions(block_size=8, batch_size=5, truncate=None)
    table = pretokenize_to_shards(run_docs(spark), str(tmp_path / "s"), opts, 10)
    stored = shards.read_committed(spark, str(tmp_path / "s"))
    assert stored.count() == table.head()["rows_done"] == pretokenize(run_docs(spark), opts).count()
    assert spark.read.json(str(tmp_path / "s/_dataset_info")).head()["num_examples"] == stored.count()


def test_sources_without_a_key_in_other_formats_and_as_streams(spark, tmp_path):
    rows, lines, odd = (str(tmp_path / n) for n in ("rows", "lines", "odd"))
    for i in range(3):
        part = spark.createDataFrame([(f"u{i}", f"{i}-{k}") for k in range(4)], "url string, text string")
        part.coalesce(1).write.mode("append").parquet(rows)
    spark.createDataFrame([(7, "x"), (8, "y")], "id int, body string").write.json(lines)
    spark.createDataFrame([("a", 5)], "text string, ord int").write.parquet(odd)
    known = {
        "rows": catalog.Source(rows, key=None),
        "some": catalog.Source(rows, "url <> 'u1'", key=None),
        "lines": catalog.Source(lines, text="body", key="id", format="json", schema="id int, body string"),
        "odd": catalog.Source(odd, key=None),
        "bad": catalog.Source(lines, text="body", key=None, format="json"),
    }
    got = catalog.read_corpus(spark, known, "rows").orderBy("doc_ord").collect()
    assert [r["doc_ord"] for r in got] == list(range(12))
    assert [r["text"][1:] for r in got] == ["-0", "-1", "-2", "-3"] * 3
    kept = {(r["doc_ord"], r["text"]) for r in got if not r["text"].startswith("1")}
    assert {(r["doc_ord"], r["text"]) for r in catalog.read_corpus(spark, known, "some").collect()} == kept
    assert catalog.read_corpus(spark, known, "odd").head()["doc_ord"] == 0
    assert {tuple(r) for r in catalog.read_corpus(spark, known, "lines").collect()} == {(7, "lines", "x"), (8, "lines", "y")}
    with pytest.raises(ValueError, match="without a key"):
        catalog.read_corpus(spark, known, "bad")
    stream = catalog.read_corpora(spark, known, ["lines"], streaming=True)
    assert stream.isStreaming and stream.columns == ["src_ord", "doc_ord", "lang", "text"]


def test_run_saves_as_it_goes_and_resumes(spark, tmp_path):
    opts = PretokenizeOptions(block_size=8, batch_size=5)
    whole, parts = str(tmp_path / "w"), str(tmp_path / "p")
    view = lambda p: sorted((r["shard"], r["input_ids"]) for r in shards.read_committed(spark, p).collect())
    pretokenize_to_shards(run_docs(spark), whole, opts, 10)
    pretokenize_to_shards(run_docs(spark), parts, opts, 10, batches_per_commit=1, max_commits=2)
    assert shards.finished_languages(spark, parts) == []
    with pytest.raises(FileExistsError):
        pretokenize_to_shards(run_docs(spark), parts, opts, 10, batches_per_commit=1)
    with pytest.raises(ValueError, match="other batches"):
        pretokenize_to_shards(run_docs(spark), parts, opts, 10, resume=True, batches_per_commit=2)
    # What is committed is not tokenized again: another text there changes nothing.
    changed = run_docs(spark).withColumn("text", F.when(F.col("doc_ord") < 3, "?").otherwise(F.col("text")))
    for _ in range(2):
        table = pretokenize_to_shards(changed, parts, opts, 10, resume=True, batches_per_commit=1)
    assert view(whole) == view(parts)
    assert shards.finished_languages(spark, parts) == ["all"]
    assert table.count() == 5
    none = run_docs(spark).limit(0)
    empty = pretokenize_to_shards(none, str(tmp_path / "e"), opts, 10, batches_per_commit=1)
    assert [r["rows"] for r in empty.collect()] == [0]


def test_language_run_resumes_with_the_missing_language(spark, tmp_path):
    opts = PretokenizeOptions(block_size=8, batch_size=5, truncate=None, max_documents=17)
    whole, parts = str(tmp_path / "w"), str(tmp_path / "p")
    pretokenize_languages_to_shards(run_docs(spark), whole, ["a", "b", "c"], opts, 10)
    pretokenize_languages_to_shards(run_docs(spark, {0, 1}), parts, ["a", "b"], opts, 10)
    pretokenize_languages_to_shards(run_docs(spark), parts, ["a", "b", "c"], opts, 10, resume=True)
    view = lambda p: sorted((r["shard"], r["input_ids"]) for r in shards.read_committed(spark, p).collect())
    assert view(whole) == view(parts)
    assert shards.finished_languages(spark, parts) == ["a", "b", "c"]


def numbered(spark, n, start=0):
    rows = [(i, [i] * 4, [1] * 4) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "ord bigint, input_ids array<int>, attention_mask array<int>")


def test_stream_into_a_directory_with_a_batch_commit(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_shards(numbered(spark, 8), path, 5)
    for _ in range(2):  # the second call of a micro-batch does nothing
        shards.commit_once(numbered(spark, 6), path, 0, 5)
    shards.commit_once(numbered(spark, 2), path, 0, 5, writer="other")
    assert shards.read_committed(spark, path).count() == 16
    assert [r["commit"] for r in shards.progress(spark, path).orderBy("commit").collect()] == [0, 1, 2]


def test_load_shards_leaves_out_an_unfinished_commit(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_shards(numbered(spark, 8), path, 5)
    numbered(spark, 3).drop("ord").write.parquet(f"{path}/commit=1/shard=1")
    train, _ = load_shards(spark, path, 2)
    assert train.count() == 8


def test_map_batches_have_their_size_without_an_ordinal(spark):
    df = spark.range(60000).coalesce(1)
    sizes = map_batches(df, lambda p: p.head(1).assign(n=len(p))[["n"]], "n bigint", 25000).collect()
    assert sorted(r["n"] for r in sizes) == [10000, 25000, 25000]


def test_null_and_negative_keys_are_an_error(spark):
    for bad in (None, -1):
        docs = spark.createDataFrame([(0, 0, "a"), (0, bad, "b")], "src_ord int, doc_ord bigint, text string")
        with pytest.raises(ValueError):
            pretokenize(docs, PretokenizeOptions(block_size=1, batch_size=1))


def test_numbers_of_batches_are_sent_to_the_blocks(spark, monkeypatch):
    blocks = spark.createDataFrame([(b, k, [b]) for b in (0, 2, 3) for k in range(b + 1)], "batch_id bigint, block_ord bigint, input_ids array<int>")
    sent = shards.block_ordinal(blocks)
    assert "strategy=broadcast" in sent._jdf.queryExecution().analyzed().toString()
    assert sorted((r["batch_id"], r["block_ord"], r["ord"]) for r in sent.collect()) == [
        (0, 0, 0), (2, 0, 1), (2, 1, 2), (2, 2, 3), (3, 0, 4), (3, 1, 5), (3, 2, 6), (3, 3, 7)
    ]
    monkeypatch.setattr(shards, "BROADCAST_BITS", 1)
    moved = shards.block_ordinal(blocks)
    assert "strategy=broadcast" not in moved._jdf.queryExecution().analyzed().toString()
    assert sorted(moved.collect()) == sorted(sent.collect())
