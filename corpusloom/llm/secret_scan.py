"""Secret scans over an inverted index of trigrams, from built-in expressions only.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold.
The index has a posting ``(trigram, doc_id)`` for every trigram that some rule asks for, on
text in lower case. Postings are intersected by counting, for each document and each
conjunction, the trigrams present; documents that satisfy a rule's query are its candidates,
and only they are verified against the expression itself. Rules without a mandatory trigram
are verified on every document, as are rows whose id is null.

Defined cases: null text is empty; an empty text has no spans. Rows with equal ids share
candidates, which the verification sorts out. Spans of different kinds may overlap. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import spans
from corpusloom.operators.skew import salted_join
from corpusloom.session import stage

CLASS_LIMIT = 8
CONJUNCTION_LIMIT = 64


@dataclass(frozen=True)
class Rule:
    """``least``: smallest length of group ``group``; ``any_case`` holds for the keyword group (?i:...) as well."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules, then public token formats.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
)
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("package", r"npm_[A-Za-z0-9]{36}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams, one of which every match holds in full; None: no demand.

    Literals and classes of at most ``CLASS_LIMIT`` characters in a row make runs of sets; a
    run's trigrams are all mandatory, one of each choice. Alternatives are expanded; optional
    and repeated parts end a run.
    """
    return _simplify(_branches(_parser.parse(pattern)))


def _expand(tree) -> list[list[set[str] | None]]:
    """The ways through a tree, each a run of character sets; None stands for anything."""
    ways: list[list[set[str] | None]] = [[]]
    for op, value in tree:
        if op is C.LITERAL:
            more = [[{chr(value).lower()}]]
        elif op is C.IN and (chars := _members(value)) is not None:
            more = [[chars]]
        elif op is C.SUBPATTERN:
            more = _expand(value[3])
        elif op is C.BRANCH:
            more = [way for branch in value[1] for way in _expand(branch)]
        elif op is C.MAX_REPEAT and value[:2] == (0, 1):
            more = [[], *_expand(value[2])]
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            more = [[]]
        else:
            more = [[None]]
        ways = [a + b for a in ways for b in more]
        if len(ways) > CONJUNCTION_LIMIT:
            return [[None]]
    return ways


def _members(items) -> set[str] | None:
    chars: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < CLASS_LIMIT:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= CLASS_LIMIT else None


def _branches(tree) -> list[frozenset[str]] | None:
    found: list[frozenset[str]] = []
    for way in _expand(tree):
        choices = [frozenset()]
        for run in _runs(way):
            single = ["".join(x) for x in itertools.islice(itertools.product(*run), CONJUNCTION_LIMIT + 1)]
            if len(single) > CONJUNCTION_LIMIT:
                continue
            parts = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in single]
            choices = [a | b for a in choices for b in parts]
            if len(choices) > CONJUNCTION_LIMIT:
                return None
        if frozenset() in choices:
            return None
        found += choices
    return found


def _runs(way) -> list[list[set[str]]]:
    runs: list[list[set[str]]] = [[]]
    for chars in way:
        if chars is None:
            runs.append([])
        else:
            runs[-1].append(chars)
    return [run for run in runs if len(run) >= 3]


def _simplify(found: list[frozenset[str]] | None) -> list[frozenset[str]] | None:
    if not found:
        return None
    return sorted((c for c in set(found) if not any(d < c for d in found)), key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram, doc_id`` of the given trigrams, written to the shared folder."""
    wanted = F.array(*map(F.lit, trigrams))
    held = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower("text").alias("text"))
    postings = held.select("doc_id", F.explode(F.filter(wanted, lambda t: F.contains(F.col("text"), t))).alias("trigram"))
    return stage(postings, "postings")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``doc_id, rules``: the rules whose Boolean query a document satisfies."""
    terms = [
        (rule, k, trigram, len(conjunction))
        for rule, conjunctions in queries.items()
        for k, conjunction in enumerate(conjunctions)
        for trigram in sorted(conjunction)
    ]
    table = postings.sparkSession.createDataFrame(terms, "rule string, part int, trigram string, need int")
    hits = postings.distinct().join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
    full = hits.groupBy("doc_id", "rule", "part", "need").agg(F.count(F.lit(1)).alias("have")).where("have = need")
    return full.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def verify(rule: Rule, number: int, only_if: Column | None) -> Column:
    found = spans.find(F.col("text"), rule.pattern, only_if)
    if rule.least:
        value = lambda s: F.regexp_extract(s["text"], rule.pattern, rule.group) if rule.group else s["text"]
        found = F.filter(found, lambda s: F.length(value(s)) >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, for each rule, an array ``start, kind, end`` named after it."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    queries = {r.name: q for r in rules if (q := trigram_query(_plain(r.pattern))) is not None}
    postings = build_index(rows, sorted({t for q in queries.values() for c in q for t in c}))
    held = salted_join(rows, candidates(postings, queries), ["doc_id"])  # null and repeated ids are dealt out
    columns = []
    for k, rule in enumerate(rules):
        may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", rule.name), F.lit(False))
        columns.append(verify(rule, k, may if rule.name in queries else None).alias(rule.name))
    return held.select("doc_id", *columns)


def _plain(pattern: str) -> str:
    """Possessive marks mean nothing to a query; both engines read the rest alike."""
    return re.sub(r"\}\+", "}", pattern)


def op9_trigram_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = BASE + ADDED
    found = scan(docs, rules)
    names = [r.name for r in rules]
    base = F.concat(*(F.col(r.name) for r in BASE))
    return found.select(
        "doc_id",
        *(F.size(r.name).cast("long").alias(f"n_{r.name}") for r in BASE),
        F.sha2(spans.render(base, names), 256).alias("base_sha256"),
        spans.render(F.concat(*map(F.col, names)), names).alias("spans"),
    )
