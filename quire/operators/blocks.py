"""A stated query set against all rows, in blocks: rows and queries of a part are dealt so that each pair meets in one group.

A part is what the rows and the queries have to share: a list of an index, or nothing. Its rows go to as many row blocks as
their number calls for and its queries to as many query blocks; a row is sent once for each query block of its part and a
query once for each row block. So a part of any size is spread over many tasks, and each task compares two bounded tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_QUERIES = 1 << 13, 1 << 10
_KEYS = ["part", "_r", "_q"]


def _sizes(df: DataFrame, per: int, name: str) -> DataFrame:
    return df.groupBy("part").agg(F.ceil(F.count("*") / per).cast("int").alias(name)).withColumnRenamed("part", f"_{name}")


def in_blocks(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``compare(rows, queries)`` of each two blocks of a part; both tables have a column ``part``; a row for each of its values is broadcast."""
    parts = F.broadcast(_sizes(rows, block_rows, "nr").join(_sizes(queries, block_queries, "nq"), F.col("_nr") == F.col("_nq")).select(F.col("_nr").alias("_part"), "nr", "nq"))
    own = lambda df, key, n: df.join(parts, F.col("part") == F.col("_part")).withColumn("_own", F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own(rows, row_id, "nr").select(*rows.columns, F.col("_own").alias("_r"), every("nq").alias("_q"))
    right = own(queries, query_id, "nq").select(*(F.col(c).alias(c) for c in queries.columns), every("nr").alias("_r"), F.col("_own").alias("_q"))
    return left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(compare, schema)


def each_two_blocks(rows: DataFrame, key: str, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int) -> DataFrame:
    """``compare(left, right)`` of each two blocks of ``rows``, in one order only, and of each block with itself, which is when _r and _q are equal."""
    n = F.broadcast(rows.agg(F.greatest(F.ceil(F.count("*") / block_rows), F.lit(1)).cast("int").alias("n")))  # one row
    own = rows.crossJoin(n).withColumn("_own", F.pmod(F.xxhash64(key), F.col("n")).cast("int"))
    left = own.select(*rows.columns, F.col("_own").alias("_r"), F.explode(F.sequence(F.col("_own"), F.col("n") - 1)).alias("_q"))
    right = own.select(*(F.col(c).alias(c) for c in rows.columns), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_r"), F.col("_own").alias("_q"))
    return left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInArrow(compare, schema)


#: Hashes that are compared at once: few enough for a processor's cache.
TILE_LEFT, TILE_RIGHT = 16, 1 << 13


def near_hashes(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``left`` and ``right`` (64-bit hashes) of all that are at most ``most`` bits apart, and the bits: a few of ``left`` after another with all of ``right``."""
    a, b = left.view(np.uint64), right.view(np.uint64)
    for i in range(0, len(a), TILE_LEFT):
        found = []
        for j in range(0, len(b), TILE_RIGHT):
            part = b[None, j : j + TILE_RIGHT]
            apart = np.bitwise_count(a[i : i + TILE_LEFT, None] ^ part)
            at = np.flatnonzero(apart <= most)
            found.append((i + at // part.shape[1], j + at % part.shape[1], apart.ravel()[at].astype(np.int32)))
        if found:
            yield tuple(map(np.concatenate, zip(*found)))


def arrow(columns: list[tuple[np.ndarray, ...]], names: list[str], types: list[pa.DataType]) -> pa.Table:
    """Rows found piece by piece, each a tuple of columns, as one table."""
    whole = list(map(np.concatenate, zip(*columns))) if columns else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, whole, types)})
