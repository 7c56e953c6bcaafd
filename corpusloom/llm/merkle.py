"""Merkle manifest of a dataset: a tree for each source, one over the sources, and proofs.

A leaf hashes a row's fields. Leaves of a source stand in the order of their ids; a row's place comes
from its position in a range-sorted, written table plus totals over (source, range), of which there
are as many as ranges and sources together, so no window group grows with a source. Every level
joins the nodes with themselves twice, on the index shifted to the next two slots of their run of
three; the rows in slot zero emit the parents. Each level is a written table a third the size of the one
below. Proofs then come down the same tables: a node's path is its own siblings before its
parent's path, one join a level, half as many rows in all as there are leaves besides these themselves. Texts
are read once and never shuffled. Digests travel as 32 bytes and become text where they are hashed.

Defined cases: a null field hashes as ``-``, a null source is a source of its own and comes first; null ids
come first inside a source, equal ids by their leaf. Rows equal in all fields take neighbouring places.
A source of one row has its leaf as subroot; an empty table has no rows and no root. Columns other than the
fields are not read. What a tampered copy holds is a parameter; ids that are null are never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.session import stage

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:int,sibs:binary>>"
_POSITION_BITS = 33


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(values: list[Column]) -> Column:
    """32 bytes over the encoded fields."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def without_line_feeds(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Which rows are tampered with, and their text then."""
    crc = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    return F.coalesce(crc % 2 == 0, F.lit(False)), F.replace(F.col(text_col), F.lit("\n"), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``g``, the number of the group in byte order (null first), ``i`` inside it, ``n`` its size.

    Rows are dealt by ranges and written with their position; a (group, range) pair is one light row.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", _POSITION_BITS).alias("__part")
    # never null, for the joins
    name = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("__group")
    placed = placed.withColumn("__part", part).withColumn("__group", name)
    runs = stage(placed.groupBy("__group", "__part").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n")), "runs")
    inside = W.partitionBy("__group").orderBy("__part")
    earlier = F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumns(
        {
            "__before": F.coalesce(earlier, F.lit(0)),
            "n": F.sum("__n").over(W.partitionBy("__group")),
            "__first": F.min("__part").over(W.partitionBy("__group")),
        }
    )
    starts = runs.where("__part = __first")
    per_range = starts.groupBy("__part").agg(F.count(F.lit(1)).alias("__new"))
    # one row for each range of the deal
    offset = F.coalesce(F.sum("__new").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_range = per_range.select("__part", offset.alias("__offset"))
    within = F.row_number().over(W.partitionBy("__part").orderBy("__from")) - 1
    groups = starts.withColumn("__rank", within).join(per_range, "__part").select(
        "__group", (F.col("__offset") + F.col("__rank")).cast("long").alias("g")
    )
    light = runs.join(groups, "__group").select("__group", "__part", "__from", "__before", "g", "n")
    place = (F.col("__at") - F.col("__from") + F.col("__before")).cast("long")
    return placed.join(light, ["__group", "__part"]).withColumn("i", place).drop("__at", "__from", "__before", "__group", "__part")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Every level of all trees from ``nodes(g, i, n, h)``, from the leaves up: ``g, i, n, h, sibs``.

    ``n`` counts the nodes of the tree on that level; where it is 1, ``h`` is the tree's root.
    Other columns stay on the lowest level.
    """
    out = []
    while True:
        slot = F.col("i") % ARITY
        asked = nodes.withColumns(
            {f"__i{d}": F.when(F.col("n") > 1, F.col("i") - slot + (slot + d) % ARITY) for d in range(1, ARITY)}
        )
        for d in range(1, ARITY):
            shifted = nodes.select("g", F.col("i").alias(f"__i{d}"), F.col("h").alias(f"__h{d}"))
            asked = asked.join(shifted, ["g", f"__i{d}"], "left")
        # siblings by slot: those that wrap around stand before the node
        wraps = [slot + d >= ARITY for d in range(1, ARITY)]
        none = F.lit(b"")
        left = [F.when(w, F.col(f"__h{d}")) for d, w in enumerate(wraps, 1)]
        right = [F.when(~w, F.col(f"__h{d}")) for d, w in enumerate(wraps, 1)]
        sibs = F.concat(*(F.coalesce(c, none) for c in [*left, *right]))
        level = stage(asked.withColumn("sibs", sibs).drop(*(f"__{k}{d}" for k in "ih" for d in range(1, ARITY))), "level")
        out.append(level)
        if level.where("n > 1").limit(1).count() == 0:
            return out
        parents = level.where((F.col("n") > 1) & (F.col("i") % ARITY == 0))
        nodes = parents.select(
            "g",
            F.expr(f"i div {ARITY}").alias("i"),
            F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
            F.unhex(F.sha2(_text(F.concat("h", "sibs")), 256)).alias("h"),
        )


def roots(tree: list[DataFrame]) -> DataFrame:
    """``g, h``: the root of each tree."""
    found = [level.where("n = 1").select("g", "h") for level in tree]
    for other in found[1:]:
        found[0] = found[0].unionByName(other)
    return found[0]


def paths(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with the ``path`` to the root and the columns of ``above(g, path, ...)``."""
    more = [c for c in above.columns if c not in ("g", "path")]
    down = None
    for level in reversed(tree):
        keep = level.columns if level is tree[0] else ["g", "i"]
        tops = level.where("n = 1").join(above, "g").select(*keep, "path", *more)
        if down is not None:
            parent = down.withColumnRenamed("i", "__p")
            own = F.array(F.struct((F.col("i") % ARITY).cast("int").alias("before"), "sibs")).cast(PATH)
            inner = level.where("n > 1").withColumn("__p", F.expr(f"i div {ARITY}")).join(parent, ["g", "__p"])
            tops = tops.unionByName(inner.withColumn("path", F.concat(own, "path")).select(*keep, "path", *more))
        # Written but for the lowest: one plan over all levels would be drawn up anew after each of its stages.
        down = tops if level is tree[0] else stage(tops, "paths")
    return down


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give, as text."""

    def step(node: Column, level: Column) -> Column:
        cut = level["before"] * 64
        sibs = _text(level["sibs"])
        return F.sha2(F.concat(F.substring(sibs, F.lit(1), cut), node, F.substring(sibs, cut + 1, F.length(sibs))), 256)

    return F.aggregate(path, _text(start), step)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "source", tamper=None) -> DataFrame:
    """``id_col, leaf, subroot, root, path, proof_sha256, folded_root, verified``.

    ``tamper`` gives the condition and the text of a changed copy (``without_line_feeds``); without it every
    row is checked as it is.
    """
    own = leaf([F.col(c) for c in fields])
    changed = F.lit(None).cast("binary")
    if tamper is not None:
        hit, text = tamper
        changed = F.when(hit, leaf([text if c == "text" else F.col(c) for c in fields]))
    light = stage(docs.select(F.col(id_col), F.col(group).alias("__source"), own.alias("h"), changed.alias("__changed")), "leaves")
    placed = numbered(light, "__source", [id_col, "h"]).drop("__source")
    tree = levels(placed)
    subroots = roots(tree)
    count = subroots.count()
    top = levels(subroots.select(F.lit(0).cast("long").alias("__all"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), "h")
                 .withColumnRenamed("__all", "g"))
    first = roots(top).head()
    root = _text(F.lit(bytes(first["h"]))) if first else F.lit(None).cast("string")
    start = subroots.sparkSession.createDataFrame([(0,)], "g long").withColumn("path", F.array().cast(PATH))
    above = paths(top, start).select(F.col("i").alias("g"), "path", F.col("h").alias("subroot"))
    proved = paths(tree, above)
    folded = fold(F.coalesce("__changed", "h"), F.col("path"))
    return proved.select(
        id_col,
        _text(F.col("h")).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        "path",
        F.sha2(F.array_join(F.transform("path", lambda p: _text(p["sibs"])), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )


def op12_sibling_shift(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return manifest(docs, tamper=without_line_feeds()).drop("path")


def _sql() -> str:
    def leaf_sql(text: str) -> str:
        part = "coalesce(strlen({0}) || ':' || {0}, '-')"
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return f"sha256({' || '.join(part.format(v) for v in values)})"

    up = "sha256(string_agg(h, '' ORDER BY i))"
    return f"""
WITH RECURSIVE crc AS (
  -- the 256 entries of the checksum table by their rule
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_concat([CAST(k AS UBIGINT)], [CAST(j AS UBIGINT) FOR j IN range(8)]),
      lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS k))
), d AS (
  SELECT doc_id, source, {leaf_sql("text")} AS leaf,
    CASE WHEN (SELECT list_reduce(list_concat([CAST(4294967295 AS UBIGINT)],
        [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda r, b: xor(r >> 8, t[CAST(xor(r, b) & 255 AS BIGINT) + 1])) FROM crc) % 2 = 1
      THEN {leaf_sql("replace(text, chr(10), '')")} END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i
  FROM documents
), t AS (
  SELECT source, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM d
  UNION ALL
  SELECT source, any_value(lvl) + 1, i // 3, {up}, (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, i // 3
), s AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, i, h, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT any_value(lvl) + 1, i // 3, {up}, (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY i // 3
), q AS (
  SELECT d.doc_id, d.leaf, coalesce(d.changed, d.leaf) AS start, d.source, s.h AS subroot, d.i, s.i AS si
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), x AS (
  SELECT q.doc_id, t.lvl, t.i, (SELECT coalesce(string_agg(h, '' ORDER BY i), '') FROM t AS o WHERE o.source IS NOT DISTINCT FROM q.source
      AND o.lvl = t.lvl AND o.i // 3 = t.i // 3 AND o.i < t.i) AS l,
    (SELECT coalesce(string_agg(h, '' ORDER BY i), '') FROM t AS o WHERE o.source IS NOT DISTINCT FROM q.source
      AND o.lvl = t.lvl AND o.i // 3 = t.i // 3 AND o.i > t.i) AS r
  FROM q JOIN t ON t.source IS NOT DISTINCT FROM q.source AND t.n > 1 AND t.i = q.i // CAST(pow(3, t.lvl) AS BIGINT)
  UNION ALL
  SELECT q.doc_id, 1000 + u.lvl, u.i, (SELECT coalesce(string_agg(h, '' ORDER BY i), '') FROM u AS o WHERE
      o.lvl = u.lvl AND o.i // 3 = u.i // 3 AND o.i < u.i),
    (SELECT coalesce(string_agg(h, '' ORDER BY i), '') FROM u AS o WHERE o.lvl = u.lvl AND o.i // 3 = u.i // 3 AND o.i > u.i)
  FROM q JOIN u ON u.n > 1 AND u.i = q.si // CAST(pow(3, u.lvl) AS BIGINT)
), p AS (
  SELECT doc_id, list(struct_pack(l := l, r := r) ORDER BY lvl) AS steps, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof
  FROM x GROUP BY doc_id
), f AS (
  SELECT doc_id, 0 AS k, start AS h FROM q
  UNION ALL
  SELECT f.doc_id, k + 1, sha256(steps[k + 1].l || h || steps[k + 1].r) FROM f JOIN p USING (doc_id) WHERE k < len(steps)
)
SELECT q.doc_id, q.leaf, q.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM q LEFT JOIN p USING (doc_id) JOIN f ON f.doc_id = q.doc_id AND f.k = coalesce(len(p.steps), 0)
"""


SQL = _sql()
