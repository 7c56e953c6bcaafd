"""Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [None if v is None else str(v) for v in (*row[:4], text)]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and the siblings of each node level by level as (left, right)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = at // 3 * 3
            paths[k].append((nodes[run:at], nodes[at + 1 : run + 3]))
            place[k] = at // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return (nodes[0] if nodes else None), paths


def model(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    kept, subroots = {}, []
    for s in order:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in groups[s])
        sub, paths = tree([k[2] for k, _ in own])
        kept[s] = [(r, k[2], p) for (k, r), p in zip(own, paths)]
        subroots.append(sub)
    root, tops = tree(subroots)
    out = []
    for s, sub, top in zip(order, subroots, tops):
        for r, own, path in kept[s]:
            path = path + top
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf(r, None if r[4] is None else r[4].replace("\n", ""))
            for left, right in path:
                node = H(*left, node, *right)
            proof = H(*(x for left, right in path for x in (*left, *right)))
            out.append((r[0], own, sub, root, proof, node, node == root))
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def rows(counts):
    out = []
    for s, n in counts.items():
        for i in range(n):
            text = [f"line {i}\nnext ü\r\n", "no feed", "", None, "x" * 5000][i % 5]
            out.append((len(out) * 7 - 20, s, "en" if i % 3 else None, i if i % 4 else None, text))
    return out


@pytest.mark.parametrize(
    "counts", [{"a": 1}, {"a": 4}, {"a": 9, "b": 10, None: 3}, {None: 1, "": 2, "ä": 28, "b": 81, "c": 82, **{f"s{i}": 1 for i in range(9)}}]
)
def test_equals_a_plain_tree(spark, counts):
    table = rows(counts)
    docs = spark.createDataFrame(table, DOCS).withColumn("leaf", F.lit("mine")).withColumn("i", F.lit(1)).repartition(5)
    assert got(merkle.manifest(docs, tamper=merkle.without_line_feeds())) == model(table)


def test_one_source_holds_nearly_all_rows(spark):
    table = rows({"hot": 700, "b": 2, "c": 1})
    assert got(merkle.manifest(spark.createDataFrame(table, DOCS).repartition(7), tamper=merkle.without_line_feeds())) == model(table)


def test_null_and_equal_ids_and_repeated_rows(spark):
    table = [(None, "a", "en", 1, "x"), (None, "a", "en", 1, "x"), (5, "a", "en", 1, "y\n"), (5, "a", "en", 1, "z"), (5, "a", "en", 1, "z"), (None, None, None, None, None)]
    assert got(merkle.manifest(spark.createDataFrame(table, DOCS), tamper=merkle.without_line_feeds())) == model(table)


def test_untampered_rows_verify_and_tampered_do_not(spark):
    docs = spark.createDataFrame(rows({"a": 50, "b": 7}), DOCS)
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
    changed = merkle.manifest(docs, tamper=(F.col("doc_id") == -20, F.concat("text", F.lit("!")))).where("NOT verified")
    assert [r["doc_id"] for r in changed.collect()] == [-20]


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), tamper=merkle.without_line_feeds()).collect() == []


def test_no_plan_holds_the_paths_of_all_levels(spark):
    """The last plan joins the lowest level with written paths, whatever the number of levels."""

    def joins(n):
        rows = [(i, "a" if i % 2 else "b", "en", 1, f"t{i}") for i in range(n)]
        plan = merkle.manifest(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join")

    assert joins(9) == joins(40)
