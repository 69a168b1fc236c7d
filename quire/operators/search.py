"""Structured search (B13), vector search for one query (F5) and the Hamming join of perceptual hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.blocks import arrow, each_two_blocks, in_blocks, near_hashes


def structured(fields: DataFrame, text: str, limit: int = 20, job: int | None = None, tenant: str | None = None) -> DataFrame:
    """Fields whose key is, or whose value contains, the text, whatever its case; the most confident first, nulls last."""
    q = text.lower()
    found = fields.where((F.lower("field_key") == q) | F.lower("value").contains(q))
    found = found.where(F.col("job_id") == job) if job is not None else found
    found = found.where(F.col("tenant_id") == tenant) if tenant is not None else found
    return found.orderBy(F.col("confidence").desc_nulls_last(), "job_id", "field_key", "ord").limit(limit)


def nearest(embeddings: DataFrame, query: list[float], k: int = 10, job: int | None = None) -> DataFrame:
    """The k embeddings closest to a vector by cosine, exactly."""
    e = embeddings.where(F.col("job_id") == job) if job is not None else embeddings
    scored = e.withColumn("similarity", G.cosine(F.col("embedding"), F.lit(query).cast("array<double>")))
    return scored.orderBy(F.col("similarity").desc_nulls_last(), "embedding_id").limit(k)


#: Hashes of a block; two blocks are compared in one group of a task.
BLOCK = 1 << 15
_PAIR = (["left_id", "right_id", "distance"], [pa.int64(), pa.int64(), pa.int32()])
_ROW = "left_id long, right_id long, distance int"


def _compared(most: int, once: bool):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, x), (b, y) = ([t.column(c).to_numpy() for c in ("id", "hash")] for t in (left, right))
        same = once and len(a) and len(b) and left.column("_r")[0] == left.column("_q")[0]
        found = []
        for i, j, apart in near_hashes(x, y, most):
            m, n = a[i], b[j]
            keep = m < n if same else m != n
            found.append((np.minimum(m, n)[keep], np.maximum(m, n)[keep], apart[keep]) if once else (m, n, apart))
        return arrow(found, *_PAIR)

    return compare


def hamming_join(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(left id, right id, distance) of all hashes at most ``most`` bits apart.

    Bits are counted for all pairs, block by block. An equi-join of bands meets a fixed share of all pairs as well, some
    percent of them at ten bits and more, and a row of a join costs hundreds of times what a count does; so it is slower as
    soon as there are many hashes. Null hashes are near to nothing.
    """
    side = lambda df: df.where("hash IS NOT NULL").select(F.col("id").cast("long").alias("id"), "hash", F.lit(0).alias("part"))
    return in_blocks(side(left), side(right), "id", "id", _compared(most, False), _ROW, BLOCK, BLOCK)


def near_pairs(hashes: DataFrame, most: int) -> DataFrame:
    """``hamming_join`` of ``hashes`` (different ids) with themselves, each two of them once and with the smaller id left."""
    own = hashes.where("hash IS NOT NULL").select(F.col("id").cast("long").alias("id"), "hash")
    return each_two_blocks(own, "id", _compared(most, True), _ROW, BLOCK)


def match_score(orb, distance, threshold):
    """0.7 of the feature score and 0.3 of how near the hashes are."""
    return 0.7 * orb + 0.3 * F.greatest(1 - distance / (2.0 * threshold), F.lit(0.0))
