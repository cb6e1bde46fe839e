"""Matches of a pattern in a text with their places, from built-in functions only.

split() gives what lies between the matches and regexp_extract_all() the matches, both leftmost and non-overlapping,
so the text is gap 0, match 0, gap 1, match 1, ... and places are running sums of code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def gaps(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def placed(text: Column, pattern: str, group: int, least: int, order: int, kind: str) -> Column:
    """array<struct<start, order, kind, end>> of the matches whose group has at least `least` code points.

    Places are running sums, taken over runs of about sqrt(n) of n matches and inside each run."""
    whole = found(text, pattern)
    pairs = F.arrays_zip(F.slice(gaps(text, pattern), F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), found(text, pattern, group).alias("val"))
    steps = F.transform(pairs, lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("g"), F.char_length(x["hit"]).cast("long").alias("h"), F.char_length(x["val"]).alias("v")))
    total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda acc, y: acc + y["g"] + y["h"])

    def of(said: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(said))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(said) / run).cast("int") - 1), lambda r: total(F.slice(said, r * run + 1, run)))

        def by_runs(sums_: Column) -> Column:
            before = F.transform(sums_, lambda _, r: F.aggregate(F.slice(sums_, F.lit(1), r), F.lit(0).cast("long"), lambda acc, y: acc + y))
            return let(before, lambda fronts: places(fronts))

        def places(fronts: Column) -> Column:
            def place(x: Column, i: Column) -> Column:
                r = F.floor(i / run).cast("int")
                start = F.element_at(fronts, r + 1) + total(F.slice(said, r * run + 1, i - r * run)) + x["g"]
                return F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (start + x["h"]).alias("end"), x["v"].alias("v"))

            kept = F.filter(F.transform(said, place), lambda x: x["v"] >= least)
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["kind"].alias("kind"), x["end"].alias("end")))

        none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
        return F.when(F.size(said) > 0, let(sums, by_runs)).otherwise(none)

    return let(steps, of)
