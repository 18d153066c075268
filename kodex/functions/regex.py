"""All matches of a pattern with their offsets, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\x01", "\x02"
#: Elements that are added up in one piece: arrays grow by pieces, so that long ones aren't copied at every element.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, kind: str, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """array of join over all elements up to and with each one; `kind` is their SQL type, `zero` join's neutral element."""
    empty = F.array().cast(f"array<{kind}>")
    none = F.struct(zero.alias("at"), empty.alias("out"))
    step = lambda acc, x: let(join(acc["at"], x), lambda v: F.struct(v, F.concat(acc["out"], F.array(v))))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), none, step))
    chain = lambda acc, b: F.struct(join(acc["at"], b["at"]), F.concat(acc["out"], F.transform(b["out"], lambda x: join(acc["at"], x))))
    return F.when(F.size(values) == 0, empty).otherwise(F.aggregate(blocks, none, chain)["out"])


def sums(values: Column) -> Column:
    """Running sums of an array<int>."""
    return running(values, "int", lambda a, b: a + b, F.lit(0))


def find_all(text: Column, pattern: str, groups: tuple[str, ...] = ()) -> Column:
    """array<struct<raw, start, end, groups map>> of every match from left to right.

    Offsets are code points, end exclusive; an absent group isn't in the map. Matches are set between two control
    characters and the text is split there, so the lengths of the parts before a match add up to its start. Those two
    characters count as spaces in the text. Null text gives null, no match an empty array.
    """
    def hit(m: Column) -> Column:
        got = [F.struct(F.lit(g).alias("key"), F.regexp_extract(m["raw"], pattern, i + 1).alias("value")) for i, g in enumerate(groups)]
        found = F.map_from_entries(F.filter(F.array(*got), lambda e: e["value"] != "")) if groups else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return F.struct(m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"), found.alias("groups"))

    return F.transform(matches(text, pattern), hit)


def matches(text: Column, pattern: str) -> Column:
    """find_all without groups: array<struct<raw, start, end>>."""
    return F.when(text.isNotNull(), let(parted(text, pattern), located))


def parted(text: Column, pattern: str) -> Column:
    """The text cut before every match, whose end is marked; the first part has none."""
    return F.split(F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def located(parts: Column) -> Column:
    """matches of a text that is parted already."""
    # every part but the first begins with a match and holds one closing mark
    lengths = F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    entry = lambda p, at: let(F.substring_index(p, _CLOSE, 1), lambda raw: F.struct(raw.alias("raw"), at.alias("start"), (at + F.length(raw)).alias("end")))
    some = let(sums(lengths), lambda at: F.transform(tail, lambda p, i: entry(p, F.get(at, i))))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<struct<raw:string,start:int,end:int>>"))
