"""Near 64-bit hashes: classes of equal ones, pairs between classes, and the nearest of each query by a multi-index.

Equal hashes are one class, whose least id stands for it; all comparisons are between classes, so a hash that a great part
of the rows has is compared once.

The multi-index cuts a hash into bands. Two hashes at most ``bands * (s + 1) - 1`` bits apart differ in at most s bits of
one band, so looking bands up as they are, then with one bit and then with two bits turned, finds all hashes within a radius
that grows from round to round. A query is done when it has its k nearest within the radius, or the radius covers what was
asked for. What is still open after two turned bits is compared with all classes, in blocks.

Defined results: null hashes are no class and are never found; of equally near rows the smaller id comes first; rows that
repeat an id are found each for itself.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as G
from quire.operators.blocks import in_blocks
from quire.operators.search import near_pairs
from quire.sources.scratch import stored

BITS = 64
#: Most bits of a band that are turned, and classes of one band value that one task looks through.
TURNED, PER_SALT = 2, 4096
#: A band has about as many bits as tell the classes apart, between these.
LEAST_BITS, MOST_BITS = 8, 22


def classes(hashes: DataFrame) -> DataFrame:
    """``hash``, the least id that has it, and how many rows do."""
    return hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def links(hashes: DataFrame, most: int) -> DataFrame:
    """(left_id, right_id, distance): the rows of each class with its least id, and the least ids of each two different classes
    at most ``most`` bits apart."""
    each = stored(classes(hashes), "hash-classes")
    named = each.where("n > 1").select(F.col("hash").alias("_h"), F.col("id").alias("left_id"))
    same = hashes.join(named, F.col("hash") == F.col("_h")).where("id <> left_id").select("left_id", F.col("id").alias("right_id"), F.lit(0).alias("distance"))
    return same.unionByName(near_pairs(each, most))


def bands(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the bands for ``n`` classes."""
    count = ceil(BITS / min(MOST_BITS, max(LEAST_BITS, round(log2(max(2, n))))))
    ends = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _keyed(df: DataFrame, cut: list[tuple[int, int]], turned: int) -> DataFrame:
    """A row of ``df`` (hash, ...) for each of its bands with so many bits turned, in every way."""
    def parts(at: int, bits: int):
        value = F.shiftrightunsigned("hash", at).bitwiseAND(F.lit((1 << bits) - 1))
        masks = [sum(1 << i for i in c) for c in combinations(range(bits), turned)]
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: value.bitwiseXOR(m))

    every = F.array(*(parts(a, b) for a, b in cut))
    return df.select("*", F.posexplode(every).alias("band", "_parts")).select(*df.columns, "band", F.explode("_parts").alias("part"))


def _met(index: DataFrame, asked: DataFrame, per_salt: int) -> DataFrame:
    """``asked`` (q, band, part) with the hashes that ``index`` (hash, id, n, band, part) has there; a hot band value is spread over several keys."""
    key = ["band", "part"]
    hot = stored(index.groupBy(*key).agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts")).where("salts > 1"), "hot-bands")
    if not hot.head(1):
        return asked.join(index, key)
    salted = lambda df: df.join(hot, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    ours = salted(asked).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return ours.join(salted(index).withColumn("salt", F.pmod(F.xxhash64("hash"), "salts").cast("int")).drop("salts"), [*key, "salt"])


def _nearest(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _compared(k: int, most: int):
    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        h, ids, n = (rows.column(c).to_numpy() for c in ("hash", "id", "n"))
        q = queries.column("q").to_numpy()
        apart = np.bitwise_count(q.view(np.uint64)[:, None] ^ h.view(np.uint64)[None, :])
        out = []
        for i in range(len(q)):
            some = np.flatnonzero(apart[i] <= most)
            some = some[np.lexsort((ids[some], apart[i][some]))][:k]
            out.append((np.full(len(some), q[i]), h[some], ids[some], n[some], apart[i][some].astype(np.int32)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.int32)]
        return pa.Table.from_arrays(list(map(pa.array, columns)), names=["q", "hash", "id", "n", "distance"])

    return compare


FOUND = "q long, hash long, id long, n long, distance int"


def nearest_classes(each: DataFrame, queries: DataFrame, k: int, most: int, turned: int = TURNED, per_salt: int = PER_SALT) -> DataFrame:
    """Of each different hash ``q`` of ``queries`` the k nearest of ``each`` (``classes``), at most ``most`` bits away: hash, id, n and distance."""
    cut = bands(each.count())
    index = stored(_keyed(each, cut, 0), "hash-bands")
    open_ = stored(queries.where("hash IS NOT NULL").select(F.col("hash").alias("q")).distinct(), "open-queries")
    found = each.sparkSession.createDataFrame([], FOUND)
    done = []
    radius = -1
    for s in range(turned + 1):
        if radius >= most or not open_.head(1):
            break
        radius = len(cut) * (s + 1) - 1
        asked = _keyed(open_.withColumn("hash", F.col("q")), cut, s).select("q", "band", "part")
        new = _met(index, asked, per_salt).withColumn("distance", G.hamming(F.col("q"), F.col("hash"))).where(F.col("distance") <= most).select("q", "hash", "id", "n", "distance")
        found = stored(_nearest(found.join(open_, "q").unionByName(new).distinct(), k), "near-hashes")
        sure = found.where(F.col("distance") <= min(radius, most)).groupBy("q").agg(F.sum("n").alias("have")).where(F.lit(radius >= most) | (F.col("have") >= k)).select("q")
        certain = open_ if radius >= most else sure
        done.append(found.join(certain, "q", "left_semi"))
        open_ = stored(open_.join(certain, "q", "left_anti"), "open-queries")
    rest = in_blocks(each.withColumn("part", F.lit(0)), open_.withColumn("part", F.lit(0)), "hash", "q", _compared(k, most), FOUND)
    done.append(_nearest(rest, k))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest(hashes: DataFrame, queries: DataFrame, k: int = 5, most: int = BITS, **how) -> DataFrame:
    """Of each of ``queries`` (id, hash) the k nearest rows of ``hashes`` (id, hash), at most ``most`` bits away: left_id, right_id, distance and rank."""
    each = stored(classes(hashes), "hash-classes")
    near = stored(nearest_classes(each, queries, k, most, **how), "near-classes")
    wanted = near.select(F.col("hash").alias("_h")).distinct()
    # Of a class no more than k rows can be among a query's k nearest; Spark takes the first k before it shuffles.
    first = Window.partitionBy("hash").orderBy("id")
    some = hashes.join(wanted, F.col("hash") == F.col("_h"), "left_semi").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    some = some.select(F.col("hash").alias("_h"), F.col("id").alias("right_id"))
    rows = near.join(some, F.col("hash") == F.col("_h")).select("q", "right_id", "distance")
    w = Window.partitionBy("q").orderBy("distance", "right_id")
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("left_id"), F.col("hash").alias("_h")).join(ranked, F.col("_h") == F.col("q")).select("left_id", "right_id", "distance", "rank")
