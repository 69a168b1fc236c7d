"""Boxes in unit coordinates (H46, H47, B8, B9, D23, N3), bit distances (H43) and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(*a) + area(*b) - both), F.lit(0.0))


def overlap_ratio(token: tuple[Column, ...], roi: tuple[Column, ...]) -> Column:
    """The share of a token's box inside a region; 0 for a box without area."""
    return F.coalesce(F.try_divide(intersection(token, roi), area(*token)), F.lit(0.0))


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...], tolerance: float = 0.0) -> Column:
    return (inner[0] >= outer[0] - tolerance) & (inner[1] >= outer[1] - tolerance) & (inner[2] <= outer[2] + tolerance) & (inner[3] <= outer[3] + tolerance)


def expand(box: tuple[Column, ...], by: float) -> tuple[Column, ...]:
    """Larger by ``by`` on each side, within the page."""
    return (F.greatest(box[0] - by, F.lit(0.0)), F.greatest(box[1] - by, F.lit(0.0)), F.least(box[2] + by, F.lit(1.0)), F.least(box[3] + by, F.lit(1.0)))


def center(box: tuple[Column, ...]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def normalize(value: Column, size: Column) -> Column:
    return F.coalesce(F.try_divide(value, size), F.lit(0.0))


def denormalize(value: Column, size: Column) -> Column:
    return (value * size).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes, whatever their sign."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(vector: Column) -> Column:
    """64 bits: the signs of a vector's first 64 components, the first highest."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1) + F.when(x > 0, 1).otherwise(0).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
