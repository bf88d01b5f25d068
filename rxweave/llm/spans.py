"""Positions of regular expression matches, by built-in functions, in time that grows with the text and not with its square."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Items of an array that are folded together, and characters of a piece of text.
TOGETHER, PIECE = 256, 256


def running(values: Column) -> Column:
    """For each of an array of ints the sum of those before it.

    A fold that grows an array copies it at each step.  So the array is folded in blocks, whose own starts come from a fold over their sums.
    """
    none = F.array().cast("array<int>")
    step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["a"], acc["at"]).alias("a"))
    sums = lambda block, start: F.aggregate(block, F.struct(start.alias("at"), none.alias("a")), step, lambda acc: acc["a"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / TOGETHER).cast("int")), lambda b: F.slice(values, b * TOGETHER + 1, TOGETHER))

    def of_blocks(x: Column) -> Column:
        totals = F.transform(x, lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v))
        return let(sums(totals, F.lit(0)), lambda starts: F.flatten(F.transform(x, lambda b, i: sums(b, F.get(starts, i)))))

    return F.when(F.size(values) > 0, let(blocks, of_blocks)).otherwise(none)


#: A character that texts hardly ever have; those that do take another way.
MARK = "\x00"


def _parted(text: Column, pattern: str) -> Column:
    """array<struct<m, b>>: matches of a pattern in order, each with what lies between it and the one before.

    regexp_extract_all copies the text for each match that it finds.  So matches are put between marks, in one pass, and the text is split at these.  A text that
    has the mark itself is split at its matches instead.
    """
    def marked(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(x) - 1, F.lit(2)), lambda i: F.struct(F.get(x, i).alias("m"), F.get(x, i - 1).alias("b")))

    both = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), r"\x00", -1)
    slow = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b")), lambda p: p["m"].isNotNull())
    fast = let(both, lambda x: F.when(F.size(x) > 1, marked(x)).otherwise(F.array().cast("array<struct<m:string,b:string>>")))
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(fast)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, s, e>>: leftmost non-overlapping matches with their code points, end exclusive.

    Regular expression functions return no positions.  So the lengths of what lies between matches and of the matches are
    summed.  Patterns may look at what surrounds a match; none may match an empty string.
    """
    placed = lambda x: let(
        running(F.transform(x, lambda p: F.length(p["b"]) + F.length(p["m"]))),
        lambda at: F.transform(x, lambda p, i: let(F.get(at, i) + F.length(p["b"]), lambda s: F.struct(p["m"].alias("m"), s.alias("s"), (s + F.length(p["m"])).alias("e")))),
    )
    return let(_parted(text, pattern), placed)


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, for cut_out()."""
    slow = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    fast = F.split(F.regexp_replace(text, F.lit(f"(?s).{{{PIECE}}}"), F.lit(f"$0{MARK}")), r"\x00", -1)
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(fast)


def cut_out(parts: Column, begin: Column, n: Column | int) -> Column:
    """Up to PIECE characters of a text from a place (from 0) on, by its pieces: substring() would walk there from the text's start."""
    at = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    n = F.lit(n) if isinstance(n, int) else n
    return let(F.floor(begin / PIECE).cast("int"), lambda k: F.substring(F.concat(at(k), at(k + 1)), begin - k * PIECE + 1, n))
