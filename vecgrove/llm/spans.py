"""Positions of pattern matches as column expressions, and digests of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def prefix_sums(values: Column) -> Column:
    """[0, v0, v0 + v1, ...] of an array of long, in about n^1.5 steps: sums of blocks, then of the values in each."""

    def scan(items: Column, start: Column) -> Column:
        return F.aggregate(items, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def within(blocks: Column, starts: Column) -> Column:
        parts = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, s: F.slice(scan(b, s), F.lit(1), F.size(b)))
        return F.concat(F.flatten(parts), F.slice(starts, F.lit(-1), F.lit(1)))

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int")), lambda b: F.slice(v, b * w + 1, w)))

    def sums(blocks: Column) -> Column:
        return scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0).cast("long"))

    return let(values, lambda v: let(cut(v), lambda blocks: let(sums(blocks), lambda starts: within(blocks, starts))))


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches whose string passes ``keep``, in code points.

    Only a text with matches is also split at them; lengths of the pieces and of the matches then add up to positions.
    """

    def place(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        ends = F.slice(prefix_sums(lengths), F.lit(2), F.size(found))
        rows = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
        kept = F.filter(rows, lambda r: keep(r["match"])) if keep else rows
        return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def rendered(spans: Column) -> Column:
    """kind:start:end by start, then kind number, comma-joined; ``spans`` are (start, kind number, end, kind)."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
