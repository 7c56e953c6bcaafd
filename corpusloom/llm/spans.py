"""Places of regular-expression matches, from built-in expressions.

``split`` gives what lies between the leftmost non-overlapping matches and
``regexp_extract_all`` the matches, so running lengths are the code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Items between two fresh arrays; a copy of half of it is made for each item.
BLOCK = 256
SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(items: Column, kind: str, step) -> Column:
    """Walk over an array from the left; gives all that ``step`` put out, in time linear in the array.

    ``step`` takes the state ``at, out`` and an item and gives the next state; ``out`` is an array of ``kind``.
    Appending to an array copies it, so ``out`` starts anew every ``BLOCK`` items and the parts are joined at the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def blocks(all_items: Column) -> Column:
        count = F.ceil(F.size(all_items) / BLOCK).cast("int")
        each = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))

        def walk(state: Column, k: Column) -> Column:
            inner = F.aggregate(
                F.slice(all_items, k * BLOCK + 1, BLOCK), F.struct(state["at"].alias("at"), none.alias("out")), step
            )
            return bind(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(each, start, walk, lambda s: F.flatten(s["out"]))

    return bind(items, blocks)


def find(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """``start, end`` (exclusive), the match and the gaps on both sides, for every match in order."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = bind(
        F.struct(gaps.alias("gaps"), found.alias("found")),
        lambda x: F.arrays_zip(
            F.slice(x["gaps"], 1, F.size(x["found"])).alias("gap"), x["found"].alias("hit"), F.slice(x["gaps"], 2, F.size(x["found"])).alias("next")
        ),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            start.alias("start"), end.alias("end"), x["hit"].alias("text"), x["gap"].alias("before"), x["next"].alias("after")
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    has = text.rlike(pattern)
    return F.when(has if only_if is None else only_if & has, scan(paired, SPAN[6:-1], step)).otherwise(F.array().cast(SPAN))


def replace(text: Column, found: Column, marks: Column) -> Column:
    """``text`` with each span ``start, kind, end`` of a sorted array replaced by its entry of ``marks``.

    A span that begins before the end of the one before it is swallowed by that. The text is cut into a part for
    each ``BLOCK`` spans first, since reaching a place in a string takes time in proportion to it.
    """

    def parts(all_spans: Column) -> Column:
        count = F.ceil(F.size(all_spans) / BLOCK).cast("int")
        each = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def walk(state: Column, k: Column) -> Column:
            block = F.slice(all_spans, k * BLOCK + 1, BLOCK)
            reach = F.array_max(F.transform(block, lambda s: s["end"])) - state["at"]

            def rewrite(piece: Column) -> Column:
                def step(inner: Column, s: Column) -> Column:
                    begins = s["start"] - state["at"]
                    pieces = F.array(F.substring(piece, inner["at"] + 1, begins - inner["at"]), F.element_at(marks, s["kind"] + 1))
                    return F.struct(
                        F.greatest(inner["at"], s["end"] - state["at"]).alias("at"),
                        F.when(begins >= inner["at"], F.concat(inner["out"], pieces)).otherwise(inner["out"]).alias("out"),
                    )

                return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)

            done = bind(F.substring(text, state["at"] + 1, F.greatest(reach, F.lit(0))), rewrite)
            return bind(
                done,
                lambda r: F.struct(
                    (state["at"] + r["at"]).alias("at"), F.concat(state["out"], F.array(F.array_join(r["out"], ""))).alias("out")
                ),
            )

        def close(state: Column) -> Column:
            return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

        return F.aggregate(each, start, walk, close)

    return bind(found, parts)


def render(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of structs ``start, kind, end``, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(
            F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )
