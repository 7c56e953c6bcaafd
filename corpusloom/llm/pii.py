"""Personal data by weak supervision, from built-in expressions only.

Candidate spans come from wide expressions. Four labelers vote on each (1 yes, 0 no, 2 no
opinion): the format rule, a gazetteer (domains, issuers, calling codes, address blocks), the
words just before it, and its borders. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is for each kind; the posteriors then train a
logistic classifier on the votes, which decides on the spans that the format rule leaves out.
Spans that pass the format rule are always kept. There are at most ``4 * 81`` vote patterns, so
what reaches the driver is bounded; counts cover all documents.

Defined cases: null text is empty, an empty text has no spans. Rows with equal ids are treated
each by itself, as is a null id. A span found only by the classifier is dropped where it
overlaps one of the format rule. Other columns, whatever their names, are passed on by ``redact`` and not read by
``find``. A table without candidates trains nothing and gives no spans.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import spans
from corpusloom.session import stage

KINDS = ["email", "ip", "card", "phone"]
LABELERS = 4
ABSTAIN = 2
ROUNDS = 50
THRESHOLD = 0.5

# The formats, and the words and ranges of the gazetteers.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
EMAIL_WORDED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PHONE_LOCAL = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"
TOP_DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ca au jp cn in br ru ch se no"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
BEFORE = {
    "email": r"(?i)(?:mail|contact|write|reach|from|to|at)\W{0,4}$",
    "ip": r"(?i)(?:\bip|server|host|address|login|from|addr)\W{0,4}$",
    "card": r"(?i)(?:card|visa|credit|debit|payment|account|master)\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|number|cell|ring)\W{0,4}$",
}
AGAINST = r"(?i)(?:version|v|order|isbn|sku|serial|no|id|release)\W{0,3}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _parts_ok(text: Column) -> Column:
    parts = F.split(text, "\\.")
    return F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _rule(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    return {
        "email": F.lit(True),
        "ip": _parts_ok(text),
        "card": F.when(n.between(14, 19), F.coalesce(F.call_function("luhn_check", _digits(text)), F.lit(False))).otherwise(F.lit(False)),
        "phone": n.between(10, 15),
    }[kind]


def _gazetteer(kind: str, text: Column) -> Column:
    known = {
        "email": F.lower(F.regexp_extract(text, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS.split()),
        "ip": ~text.rlike(r"^(?:0|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
        "card": _digits(text).rlike(ISSUERS),
        "phone": text.rlike(CALLING),
    }[kind]
    return F.when(known, 1).otherwise(F.when(text.startswith("(") | text.rlike("^[0-9]{3}[-.]"), ABSTAIN).otherwise(0) if kind == "phone" else F.lit(0))


def _candidates(kind: str, pattern: str, only_if: Column, wide: bool) -> Column:
    """Structs ``start, kind, end, base, code``; ``code`` numbers the vote pattern."""

    def vote(s: Column) -> Column:
        before = F.substring(s["before"], -24, 24)
        rule = F.lit(False) if wide else _rule(kind, s["text"])
        votes = [
            F.when(rule, 1).otherwise(0),
            _gazetteer(kind, s["text"]),
            F.when(before.rlike(BEFORE[kind]), 1).when(before.rlike(AGAINST), 0).otherwise(ABSTAIN),
            F.when(before.rlike(r"[\w]$") | s["after"].rlike(r"^\w"), 0).otherwise(1),
        ]
        code = reduce(lambda a, b: a * 3 + b, votes, F.lit(KINDS.index(kind)))
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            s["end"].alias("end"),
            rule.alias("base"),
            code.cast("int").alias("code"),
        )

    return F.transform(spans.find(F.col("_text"), pattern, only_if), vote)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_text`` and the array ``_found`` of voted candidates."""
    text = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    digits = F.col("_text").rlike
    wide_card = F.filter(
        _candidates("card", CARD, digits(r"[0-9](?:[\x20-]?[0-9]){12}"), False), lambda s: s["end"] - s["start"] >= 13
    )
    base = F.concat(
        _candidates("email", EMAIL, F.contains("_text", F.lit("@")), False),
        _candidates("ip", IP, digits(r"[0-9]\.[0-9]"), False),
        wide_card,
        _candidates("phone", PHONE, F.contains("_text", F.lit("+")), False),
    )
    wide = F.concat(
        _candidates("email", EMAIL_WORDED, digits(r"(?i)[(\[]at[)\]]"), True),
        _candidates("phone", PHONE_LOCAL, digits(r"[0-9]{3}[-.][0-9]{4}"), True),
    )
    return text.withColumn("_found", F.concat(base, wide))


def estimate(counts: dict[int, int]) -> dict[int, float]:
    """Posterior of each vote pattern by expectation-maximisation, kind by kind.

    Starts from reliability 0.8 for every labeler; a labeler's abstentions carry no weight.
    """
    posterior: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = {c: n for c, n in counts.items() if c // 3**LABELERS == kind}
        if not own:
            continue
        hit, false, prior = [0.8] * LABELERS, [0.2] * LABELERS, 0.5
        for _ in range(ROUNDS):
            for code in own:
                odds = math.log(prior / (1 - prior))
                for k, v in enumerate(_votes(code)):
                    if v == 1:
                        odds += math.log(hit[k] / false[k])
                    elif v == 0:
                        odds += math.log((1 - hit[k]) / (1 - false[k]))
                posterior[code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            total = sum(own.values())
            prior = (sum(n * posterior[c] for c, n in own.items()) + 1) / (total + 2)
            for k in range(LABELERS):
                said = [(c, n) for c, n in own.items() if _votes(c)[k] != ABSTAIN]
                yes = sum(n * posterior[c] for c, n in said)
                no = sum(n * (1 - posterior[c]) for c, n in said)
                hit[k] = (sum(n * posterior[c] for c, n in said if _votes(c)[k] == 1) + 8) / (yes + 10)
                false[k] = (sum(n * (1 - posterior[c]) for c, n in said if _votes(c)[k] == 1) + 2) / (no + 10)
    return posterior


def _votes(code: int) -> list[int]:
    return [code // 3**k % 3 for k in reversed(range(LABELERS))]


def _features(code: int) -> list[float]:
    kind = code // 3**LABELERS
    ones = [1.0 if kind == k else 0.0 for k in range(len(KINDS))]
    return ones + [{1: 1.0, 0: -1.0}.get(v, 0.0) for v in _votes(code)]


def train(counts: dict[int, int], posterior: dict[int, float]) -> dict[int, float]:
    """Score of each vote pattern by a logistic classifier fitted to the posteriors."""
    total = sum(counts.values())
    weights = [0.0] * (len(KINDS) + LABELERS)
    for _ in range(400):
        slope = [0.002 * w for w in weights]
        for code, n in counts.items():
            x = _features(code)
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True))))
            for k, value in enumerate(x):
                slope[k] += n / total * (p - posterior[code]) * value
        weights = [w - 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return {c: 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, _features(c), strict=True)))) for c in counts}


def accepted_codes(found: DataFrame) -> list[int]:
    """Vote patterns that the classifier accepts, learned from all candidates."""
    seen = found.select(F.explode("_found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["code"]: r["n"] for r in seen.collect()}
    scores = train(counts, estimate(counts)) if counts else {}
    return sorted(c for c, s in scores.items() if s >= THRESHOLD)


def decided(codes: list[int]) -> tuple[Column, Column]:
    """Base spans and added spans of ``_found``."""
    base = F.filter("_found", lambda s: s["base"])
    more = F.filter(
        "_found",
        lambda s: ~s["base"]
        & s["code"].isin(*codes or [-1])
        & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    keep = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return F.transform(base, keep), F.transform(more, keep)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, added``: arrays ``start, kind, end``. The texts are read once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = stage(candidates(rows).select("doc_id", "_found"), "candidates")
    base, more = decided(accepted_codes(found))
    return found.select("doc_id", base.alias("base"), more.alias("added"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets.

    Rows and their candidates are written once; the votes are counted from the narrow column and the texts
    rewritten from the same table.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    found = candidates(rows.withColumn("text", F.col(f"row.{text_col}"))).select("row", "_found")
    found = stage(found, "candidates")
    base, more = decided(accepted_codes(found))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    own = F.col(f"row.{text_col}")
    text = F.when(F.size("_spans") > 0, spans.replace(own, F.col("_spans"), marks)).otherwise(own)
    done = found.withColumn("_spans", F.array_sort(F.concat(base, more))).withColumn("_new", text)
    return done.select(*(F.col("_new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op3_weak_supervision(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(n(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(spans.render(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans.render(F.concat("base", "added"), KINDS).alias("spans"),
    )
