"""Positions of regular-expression matches with SQL functions alone.

``split`` and ``regexp_extract_all`` find the same matches, so the parts between them and the matches themselves, in turn, add up to
positions in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,order:int,stop:int,kind:string,value:string>>"
#: Matches of a text that are added up at once: an array that grows is copied at each step, so it stays short.
CHUNK = 256
#: Between a value and what follows it; a private-use letter that no pattern here takes.
THEN = "\ue000"


def _once(value: Column, use) -> Column:
    """``use`` of a column that is computed once, though named several times."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, kind: str, order: int, keep=None, only_if: Column | None = None, after: str = "") -> Column:
    """Array of (start, order, stop, kind, value) of the leftmost non-overlapping matches of a Java pattern; stop is exclusive.

    ``keep`` takes the value and says which matches stay. ``only_if`` is a cheap test that holds wherever there is a match. With ``after``
    a value is followed by THEN and group 1 of this pattern in what follows it, as far as the end of the next match.
    The pattern must not match the empty string.
    """
    none = F.lit([]).cast(SPAN)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = hits if only_if is None else F.when(only_if, hits).otherwise(F.lit([]).cast("array<string>"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + F.length(x["hit"])
        value = F.concat(x["hit"], F.lit(THEN), x["then"]) if after else x["hit"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(kind).alias("kind"), value.alias("value"))
        one = F.array(span).cast(SPAN)
        return F.struct(stop.alias("at"), F.concat(acc["found"], one if keep is None else F.when(keep(x["hit"]), one).otherwise(none)).alias("found"))

    def chunk(c, at):
        return F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    def chunks(pairs):
        many = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
        return _once(F.transform(many, lambda k: F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK))), lambda parts: F.flatten(F.zip_with(parts, begins(parts), chunk)))

    def begins(parts):
        size = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["hit"]))
        zero = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<int>").alias("all"))
        return F.aggregate(parts, zero, lambda acc, c: F.struct((acc["at"] + size(c)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def zipped(hits, gaps):
        cols = [F.transform(F.slice(gaps, 1, F.size(hits)), lambda x: F.length(x)).alias("gap"), hits.alias("hit")]
        if after:
            rest = F.transform(hits, lambda _, i: F.regexp_extract(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit(""))), after, 1))
            cols.append(rest.alias("then"))
        return F.arrays_zip(*cols)

    some = lambda h: _once(F.split(text, pattern, -1), lambda gaps: _once(zipped(h, gaps), chunks))
    return _once(hits, lambda h: F.when(F.size(h) > 0, some(h)).otherwise(none))


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def by_start(spans: Column) -> Column:
    return F.array_sort(spans)


def by_kind(spans: Column) -> Column:
    def order(a, b):
        before = (a["order"] < b["order"]) | ((a["order"] == b["order"]) & (a["start"] < b["start"]))
        same = (a["order"] == b["order"]) & (a["start"] == b["start"])
        return F.when(same, 0).when(before, -1).otherwise(1)

    return F.array_sort(spans, order)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
