"""Quotation linking against a plain model that compares every quote with every message."""

import random
import re
import time

import pytest

from corpusloom.llm import quotes

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"^.{0,200}(?:wrote|writes|said)[^\n]{0,80}:\s*$", re.I)
SCHEMA = "conv_id long, turn long, role string, text string"


def normal(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def parse(text):
    marks = [(MARK.match(x), x) for x in text.split("\n")]
    return [(m.group(1).count(">"), MARK.sub("", x)) if m else (0, x) for m, x in marks]


def own_of(lines):
    kept = []
    for i, (level, line) in enumerate(lines):
        introduces = WROTE.match(line) and i + 1 < len(lines) and lines[i + 1][0] > 0
        if level == 0 and not introduces:
            kept.append(line)
    return "\n".join(kept).strip(" \t\r\n")


def runs_of(lines):
    runs = []
    for level, line in lines:
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(line)
    return [r for r in runs if r[0] > 0]


def model(messages):
    """``(conv, turn): own, n_quotes, n_linked, reply_conv, reply_turn, thread, place`` of distinct keys."""
    parsed = {(c, t): parse(text or "") for c, t, _, text in messages}
    own = {k: own_of(lines) for k, lines in parsed.items()}
    says = {k: {normal(u) for u in [o, *re.split(r"\n\s*\n", o), *o.split("\n")]} for k, o in own.items()}
    first_null = lambda c: (c is not None, c or 0)
    turn_of = lambda t: -1 if t is None else t
    ordered = sorted(own, key=lambda k: (first_null(k[0]), turn_of(k[1])))
    out, up = {}, {}
    for conv, turn in own:
        n_quotes, linked, best = 0, 0, None
        for p, (level, lines) in enumerate(runs_of(parsed[conv, turn])):
            paragraphs = re.split(r"\n\s*\n", "\n".join(lines))
            units = [(" ".join(lines), True)]
            units += [(u, False) for u in (paragraphs if len(paragraphs) > 1 else [])] + [(u, False) for u in lines]
            units = [(normal(u), whole) for u, whole in units if re.search(r"\w", normal(u).replace("_", " "))]
            n_quotes += bool(units)
            hit = False
            for unit, whole in units:
                inside = [k for k in ordered if k[0] == conv and unit in says[k]]
                outside = [k for k in ordered if k[0] != conv and unit in says[k]]
                if inside and turn_of(inside[0][1]) < turn_of(turn):
                    to = inside[0]
                elif outside:
                    to = outside[0]
                else:
                    continue
                hit = True
                name = "" if to[0] is None else str(to[0])
                rank = (level, not whole, -len(unit), p, turn_of(to[1]), name)
                if best is None or rank < best[0]:
                    best = (rank, to)
            linked += hit
        to = best[1] if best else (None, None)
        if best and to[0] == conv:
            up[conv, turn] = to
        out[conv, turn] = [own[conv, turn], n_quotes, linked, *to]
    for key in out:
        root = key
        while root in up:
            root = up[root]
        out[key].append(turn_of(root[1]))
    for conv in {c for c, _ in out}:
        inside = sorted((k for k in out if k[0] == conv), key=lambda k: (out[k][5], turn_of(k[1])))
        for place, key in enumerate(inside):
            out[key].append(place)
    return {k: tuple(v) for k, v in out.items()}


def conversations(seed):
    """Messages that quote earlier, later, foreign and unknown passages, nested, in part and wrapped anew."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta gamma delta Epsilon zeta".split()) for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5, 6)]
    rows, texts = [], []
    for conv in (None, 1, 2, 3, 10, 11, 12, 13):
        for turn in [None, *range(7)]:
            parts = []
            for _ in range(rng.randint(0, 3)):
                kind = rng.random()
                if kind < 0.45:
                    parts.append(rng.choice(["", "\n"]).join([rng.choice(pool), "\n" + rng.choice(pool)]))
                elif kind < 0.9:
                    if rng.random() < 0.5:
                        parts.append("On Monday they wrote:")
                    source = rng.choice(texts) if texts and rng.random() < 0.7 else rng.choice([*pool, "!!", "never said"])
                    if rng.random() < 0.3:
                        source = source.replace(" ", "\n", 1)
                    mark = rng.choice(["> ", ">", ">> ", " > > "])
                    parts.append("\n".join(mark + line for line in source.split("\n")))
                else:
                    parts.append(rng.choice(["", "   ", "They said:"]))
            text = None if rng.random() < 0.05 else "\n".join(parts)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), text))
            texts.append(text or "nothing")
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_equal_the_model(spark, seed):
    rows = conversations(seed)
    expected = model(rows)
    assert sum(v[2] for v in expected.values()) >= 10  # the fixture links
    names = ["own", "n_quotes", "n_linked", "reply_conv", "reply_turn", "thread", "place"]
    got = quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {(r["conv_id"], r["turn"]): tuple(r[n] for n in names) for r in got} == expected


def test_no_messages(spark):
    assert quotes.link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_very_long_message(spark):
    """A hundred thousand quoted lines in runs of two levels, and one run of as many lines."""
    n = 100_000
    said = "\n".join(f"line {i}" for i in range(n))
    mixed = "\n".join(("> " if i % 2 else ">> ") + f"line {i}" for i in range(n))
    flat = "\n".join(f"> line {i}" for i in range(n))
    rows = [(1, 0, "user", said), (1, 1, "user", mixed), (1, 2, "user", flat)]
    start = time.time()
    got = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["n_quotes"], got[1]["n_linked"]) == (n, n)
    assert (got[2]["n_quotes"], got[2]["n_linked"], got[2]["reply_turn"]) == (1, 1, 0)
    assert time.time() - start < 90
