"""Spans of regular-expression matches as array columns, without leaving the JVM.

All of it is linear in a text and its spans, but for sorting: running values go over blocks of elements, and a
text is cut into pieces once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamworks.functions.text import let

SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
#: Elements that a running value goes over at once, and code points in a piece of a text.
BLOCK = 256
PIECE = 4096


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of an array of ints the combination of those before it.

    Blocks are combined first and then the elements of each, since an array that grows by one copies all it has.
    """

    def over(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda seen, v: F.struct(combine(seen["at"], v).cast("int").alias("at"), F.concat(seen["out"], F.array(seen["at"])).alias("out"))
        return F.aggregate(values, first, step, lambda seen: seen["out"])

    block = lambda values, b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    whole = lambda values, b: F.aggregate(block(values, b), F.lit(zero), lambda a, v: combine(a, v).cast("int"))

    def found(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        starts = over(F.transform(numbers, lambda b: whole(values, b)), F.lit(zero))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda start, b: over(block(values, b), start))))

    return let(values, lambda v: F.when(F.size(v) > 0, found(v)).otherwise(F.array().cast("array<int>")))


def match_spans(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, before, after), in code points, end exclusive.

    The text between matches and the matches themselves alternate, so running lengths give the positions; before and
    after are up to context characters of it on both sides. Null text gives null. Texts without a match pay for one
    scan only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    edges = lambda gaps: F.zip_with(
        gaps, F.slice(gaps, F.lit(2), F.size(gaps)), lambda g, after: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(context)).alias("before"), F.left(after, F.lit(context)).alias("after"))
    )
    near = let(F.split(text, pattern, -1), edges)
    cut = lambda found: F.zip_with(F.slice(near, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), F.length(m).alias("n"), m.alias("match")))

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: p["g"]["gap"] + p["n"]), lambda a, n: a + n, 0)

        def span(pair: Column, before: Column) -> Column:
            start = (before + pair["g"]["gap"]).cast("int")
            return F.struct(start.alias("start"), (start + pair["n"]).cast("int").alias("end"), pair["match"].alias("match"), pair["g"]["before"].alias("before"), pair["g"]["after"].alias("after"))

        return F.zip_with(pairs, ends, span)

    return F.when(text.rlike(pattern), let(let(found, cut), placed)).when(text.isNotNull(), F.array().cast(SPAN))


def untouched(spans: Column, others: Column) -> Column:
    """The spans that share no character with any of others; both are arrays of structs with start and end."""

    def free(spans: Column) -> Column:
        own = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.lit(1).alias("side"), s["end"].alias("end"), i.alias("at")))
        foreign = F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("side"), s["end"].alias("end"), F.lit(-1).alias("at")))

        def kept(line: Column) -> Column:
            reached = running(F.transform(line, lambda e: F.when(e["side"] == 0, e["end"]).otherwise(0)), F.greatest, 0)
            last = 2**31 - 1
            ahead = F.reverse(running(F.reverse(F.transform(line, lambda e: F.when(e["side"] == 0, e["start"]).otherwise(last))), F.least, last))
            bounds = F.zip_with(reached, ahead, lambda before, after: F.struct(before.alias("before"), after.alias("after")))
            marked = F.zip_with(line, bounds, lambda e, b: F.when((e["side"] == 1) & (b["before"] <= e["start"]) & (b["after"] >= e["end"]), e["at"]))
            return F.transform(F.array_sort(F.filter(marked, lambda at: at.isNotNull())), lambda at: F.get(spans, at))

        return let(F.array_sort(F.concat(own, foreign)), kept)

    return let(spans, lambda s: F.when((F.size(s) > 0) & (F.size(others) > 0), free(s)).otherwise(s))


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans that have a kind, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, sorted by start, replaced by its label; of overlapping spans the rest is dropped."""

    def taken(pieces: Column, start: Column, end: Column) -> Column:
        """The characters from start to end of a text in pieces."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        inner = F.array_join(F.slice(pieces, first + 2, last - first - 1), "")
        far = F.concat(F.substr(F.get(pieces, first), start % PIECE + 1), inner, F.coalesce(F.substr(F.get(pieces, last), F.lit(1), end % PIECE), F.lit("")))
        return F.when(end <= start, "").when(first == last, F.substr(F.get(pieces, first), start % PIECE + 1, end - start)).otherwise(far)

    def replaced(spans: Column, pieces: Column) -> Column:
        reached = running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
        out = F.zip_with(spans, reached, lambda s, at: F.concat(taken(pieces, at, s["start"]), F.when(s["end"] > at, s["label"]).otherwise("")))
        rest = taken(pieces, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(out, ""), rest)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(spans, lambda s: let(cut, lambda pieces: replaced(s, pieces)))).otherwise(text)
