"""Exact percentiles of any number of values: the range that holds a rank is narrowed until it holds one value.

A round counts the values in ``CELLS`` equal parts of the range; the part with the rank, from its least to its greatest value,
is the next range. No task or driver holds more than the counts of the parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a range is counted in.
CELLS = 2048


def at_ranks(values: DataFrame, column: str, ranks: Sequence[int], least: float, greatest: float, cells: int = CELLS) -> dict[int, float]:
    """The values at ``ranks``, from 0, among those of ``column``, which are no nulls and lie between ``least`` and ``greatest``."""
    open_ = {r: (least, greatest, 0) for r in ranks}
    found: dict[int, float] = {}
    while True:
        found |= {r: lo for r, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {r: x for r, x in open_.items() if r not in found}
        if not open_:
            return found
        ranges = sorted({x[:2] for x in open_.values()})
        v = F.col(column)
        inside = F.filter(F.array(*(F.when((v >= lo) & (v <= hi), F.struct(F.lit(i).alias("i"), F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * cells), F.lit(cells - 1)).alias("cell"))) for i, (lo, hi) in enumerate(ranges))), lambda x: x.isNotNull())
        counts = values.select(v.alias("v"), F.explode(inside).alias("x")).groupBy("x.i", "x.cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        told: dict[int, list] = {}
        for row in counts.orderBy("i", "cell").collect():  # at most CELLS for each of a few ranges
            told.setdefault(row.i, []).append(row)
        for r, (lo, hi, below) in open_.items():
            for part in told[ranges.index((lo, hi))]:
                if r < below + part.n:
                    open_[r] = (part.lo, part.hi, below)
                    break
                below += part.n


def percentiles(values: DataFrame, column: str, shares: Sequence[float], cells: int = CELLS) -> list[float | None]:
    """The percentiles of a numeric column, with a straight line between neighbours; null and NaN have no part. None without values."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, least, greatest = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    known = at_ranks(v, "v", sorted({r for x in places for r in (floor(x), min(floor(x) + 1, n - 1))}), least, greatest, cells)
    return [known[floor(x)] + (known[min(floor(x) + 1, n - 1)] - known[floor(x)]) * (x - floor(x)) for x in places]
