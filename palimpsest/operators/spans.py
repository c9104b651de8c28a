"""Arrays of spans within a row: ordering, overlap, greedy resolution, reconciliation, merging, substitution.

Spans stay in their row as arrays, so none of this shuffles. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.types import ENTITIES


def empty(kind: str = ENTITIES) -> Column:
    return F.expr(f"cast(array() as {kind})")


def or_empty(spans: Column, kind: str = ENTITIES) -> Column:
    return F.coalesce(spans, empty(kind))


def sort_by(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    """Spans ordered by keys, the first deciding; equal ones stay in their order."""
    keyed = F.transform(spans, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def by_start(spans: Column) -> Column:
    return sort_by(spans, lambda x: x["start"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy(base: Column, candidates: Column) -> Column:
    """`base` with every candidate, in order, that overlaps nothing taken before it."""
    return F.aggregate(candidates, base, lambda acc, x: F.when(F.exists(acc, lambda a: overlaps(a, x)), acc).otherwise(F.concat(acc, F.array(x))))


def reconcile(base: Column, extra: Column) -> Column:
    """Union of two detections: widest first, the base before the extra on ties, then by order; the kept ones are disjoint."""
    tagged = F.concat(
        F.transform(or_empty(base), lambda x, i: F.struct((x["start"] - x["end"]).alias("w"), F.lit(0).alias("s"), i.alias("i"), x.alias("x"))),
        F.transform(or_empty(extra), lambda x, i: F.struct((x["start"] - x["end"]).alias("w"), F.lit(1).alias("s"), i.alias("i"), x.alias("x"))),
    )
    ordered = F.transform(F.filter(F.array_sort(tagged), lambda y: y["x"]["start"] < y["x"]["end"]), lambda y: y["x"])
    return by_start(greedy(empty(), ordered))


def merge(entities: Column) -> Column:
    """Strictly contiguous spans taken together: same types, or any type followed by LOC; the first's type and confidence stay."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(F.concat(last["text"], x["text"]).alias("text"), last["type"].alias("type"), last["start"].alias("start"), x["end"].alias("end"), last["confidence"].alias("confidence"))
        fits = (F.size(acc) > 0) & (last["end"] == x["start"]) & ((last["type"] == x["type"]) | (x["type"] == "LOC"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(by_start(or_empty(entities)), empty(), step)


def substitute(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with disjoint spans, ordered by start, replaced. A null text stays null."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), replacement(x)).alias("out"), x["end"].alias("at"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def placed(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def clip(spans: Column, start: Column, end: Column) -> Column:
    """Spans of a joined view as seen from one of its segments: clipped at its borders, shifted to its start, empty ones gone."""
    moved = F.transform(spans, lambda x: F.struct(x["type"].alias("type"), (F.greatest(x["start"], start) - start).alias("start"), (F.least(x["end"], end) - start).alias("end"), x["confidence"].alias("confidence")))
    return F.filter(moved, lambda x: x["start"] < x["end"])
