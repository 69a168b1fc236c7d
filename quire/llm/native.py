"""Column helpers shared by the operators that stay on built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that parts words: space and the five controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it.

    A column that a lambda refers to is computed again for each element unless it is bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a block: what is quadratic in a block or in the number of blocks stays small for arrays of a million.
BLOCK = 256


def in_blocks(values: Column) -> Column:
    """``values`` as an array of arrays of ``BLOCK`` elements; none of an empty one."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))).otherwise(F.slice(F.array(values), 1, 0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of each of ``values``, ints of 0 or more, with all before it, 0 first: running sums or greatest ones.

    A growing array is copied at each step, so blocks are folded each for itself and then from what the ones before came to.
    """
    none = F.array().cast("array<int>")

    def fold(block: Column, start: Column) -> Column:
        step = lambda acc, x: let(combine(acc["at"], x), lambda e: F.struct(e.alias("at"), F.array_append(acc["out"], e).alias("out")))
        return F.aggregate(block, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
        return let(fold(ends, F.lit(0)), lambda upto: F.flatten(F.transform(blocks, lambda b, i: fold(b, F.coalesce(F.get(upto, i - 1), F.lit(0))))))

    return let(values, lambda v: let(in_blocks(v), of))


def parts_of(text: Column, spans: Column) -> Column:
    """The parts of a text at ``spans`` (s, e), which ascend and do not overlap.

    To find a place in a text, all before it is read, so the part with a block of spans is cut out first.
    """

    def block(x: Column) -> Column:
        part = lambda base: F.substring(text, base + 1, F.element_at(x, -1)["e"] - base)
        return let(F.struct(F.get(x, F.lit(0))["s"].alias("base"), part(F.get(x, F.lit(0))["s"]).alias("t")), lambda p: F.transform(x, lambda y: F.substring(p["t"], y["s"] - p["base"] + 1, y["e"] - y["s"])))

    return let(spans, lambda s: let(in_blocks(s), lambda blocks: F.flatten(F.transform(blocks, block))))


def words_of(text: Column) -> Column:
    """The words of a text, white space parting them; null has none."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_CLASS, -1), ""), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def window_starts(n: Column, width: int) -> Column:
    """0-based starts of the windows of ``width`` among ``n`` words."""
    return F.when(n >= width, F.sequence(F.lit(0), n - F.lit(width))).otherwise(F.array().cast("array<int>"))


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
