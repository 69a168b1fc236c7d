"""An inverted-file index of vectors: centroids, the rows of each centroid's list, and searches that read a few lists.

The centroids are fitted on a sample of at most ``SAMPLE_ROWS`` rows, drawn by a hash of the id; every row is then assigned
to its nearest centroid and written partitioned by list. A query is compared with the centroids, probes the nearest lists,
and is compared exactly with every vector in them; with all lists probed the answer is that of a full scan. ``tuned`` finds
how many lists a share of the true neighbours takes.

Defined results: similarity is the cosine, rounded to six places; of equal ones the smaller id comes first. Rows without a
vector, of another length than the first one's, or of no length at all (all zero) have no similarity and are never found; a
query like that finds nothing. Rows that repeat an id are found each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.blocks import in_blocks

#: Most rows that the centroids are fitted on, most lists, and rounds of fitting.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 20_000, 4096, 8
#: Queries that ``tuned`` measures with.
TUNING_QUERIES = 200
FOUND = "query_id long, embedding_id long, similarity double"


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a usable vector, and those vectors at length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    ok = ~np.asarray(column.is_null()) & (sizes == (dims if dims else sizes.max(initial=0))) & (sizes > 0)
    rows = np.flatnonzero(ok)
    width = int(sizes[rows[0]]) if len(rows) else 1
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    some = np.isfinite(norm) & (norm > 0)
    return rows[some], flat[some] / norm[some, None]


def fitted(sample: np.ndarray, lists: int, seed: int = 42) -> np.ndarray:
    """Centroids of length 1 of vectors of length 1."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm == 0
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        norm[empty] = 1
        centers = sums / norm[:, None]
    return centers


@dataclass(frozen=True)
class VectorIndex:
    """An index in the folder ``path``: ``rows`` partitioned by list, ``centroids`` by number."""

    path: str
    centroids: np.ndarray
    schema: str

    @staticmethod
    def opened(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        return VectorIndex(path, np.array([r.vector for r in rows]), rows[0].rows_schema)

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def build(embeddings: DataFrame, path: str, lists: int | None = None, seed: int = 42) -> VectorIndex:
    """Fits, assigns and writes the index of ``embeddings`` (embedding_id, job_id, embedding) to ``path``.

    Without ``lists`` there are about as many as the root of the number of rows, at most ``MAX_LISTS``. A list that holds a
    large share of the rows is written in several files by as many tasks.
    """
    spark = embeddings.sparkSession
    lists = lists or min(MAX_LISTS, max(1, isqrt(embeddings.count())))
    sample = embeddings.select("embedding_id", "embedding").where("size(embedding) > 0").orderBy(F.xxhash64("embedding_id", F.lit(seed)), "embedding_id").limit(SAMPLE_ROWS).toArrow()
    first = embeddings.where("size(embedding) > 0").agg(F.min_by(F.size("embedding"), "embedding_id")).first()[0]
    vectors = _matrix(sample.column("embedding"), first)[1] if sample.num_rows else np.zeros((0, 1))
    centers = fitted(vectors, lists, seed) if len(vectors) else np.zeros((1, first or 1))
    placed = _assigned(embeddings.select("embedding_id", "job_id", "embedding"), centers)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    spark.createDataFrame([(i, c, schema) for i, c in enumerate(centers.tolist())], "list int, vector array<double>, rows_schema string").coalesce(1).write.parquet(f"{path}/centroids")
    placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    return VectorIndex(path, centers, schema)


def _assigned(embeddings: DataFrame, centers: np.ndarray) -> DataFrame:
    """``embeddings`` with the list of each, -1 for those without a similarity."""
    held = embeddings.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            own = np.full(len(b), -1, np.int32)
            rows, vectors = _matrix(b.column("embedding"), c.shape[1])
            own[rows] = (vectors @ c.T).argmax(axis=1) if len(rows) else 0
            yield b.append_column("list", pa.array(own))

    return embeddings.mapInArrow(assign, embeddings.withColumn("list", F.lit(0)).schema)


def _probes(queries: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """query_id, vector and ``part``, one of the ``probes`` lists nearest to each of ``queries`` (query_id, vector)."""
    held = queries.sparkSession.sparkContext.broadcast(centers)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            rows, vectors = _matrix(b.column("vector"), c.shape[1])
            n = min(probes, len(c))
            near = np.argpartition(-(vectors @ c.T), n - 1, axis=1)[:, :n] if len(rows) else np.zeros((0, n), int)
            again = pa.array(np.repeat(rows, n))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(again), b.column("vector").take(again), pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "part"])

    return queries.select("query_id", "vector").mapInArrow(probe, queries.select("query_id", "vector").withColumn("part", F.lit(0)).schema)


def _best(k: int):
    """The k rows of a block nearest to each of its queries."""

    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        qs, q = _matrix(queries.column("vector"))
        at, x = _matrix(rows.column("embedding"), q.shape[1] if len(qs) else None)
        ids, asked = rows.column("embedding_id").to_numpy()[at], queries.column("query_id").to_numpy()[qs]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(at) and len(qs):
            n = min(k, len(at))
            for who, near in zip(asked, np.round(q @ x.T, 6)):
                some = np.flatnonzero(near >= np.partition(near, len(near) - n)[len(near) - n])
                some = some[np.lexsort((ids[some], -near[some]))][:n]
                out.append((np.full(n, who), ids[some], near[some]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "embedding_id", "similarity"])

    return compare


def _ranked(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    found = in_blocks(rows.select("part", "embedding_id", "embedding"), queries, "embedding_id", "query_id", _best(k), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "embedding_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 8, job: int | None = None) -> DataFrame:
    """query_id, embedding_id, similarity and rank: of each of ``queries`` (query_id, vector) the k nearest in the lists it probes.

    Only the folders of lists that some query probes are read.
    """
    asked = _probes(queries, index.centroids, probes)
    rows = index.rows(spark).where("list >= 0").withColumnRenamed("list", "part")
    rows = rows.where(F.col("job_id") == job) if job is not None else rows
    if probes < index.lists:
        wanted = [r.part for r in asked.select("part").distinct().collect()]  # at most MAX_LISTS
        rows = rows.where(F.col("part").isin(wanted))
    return _ranked(rows, asked, k)


def nearest_of_each(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """As ``search``, over all of ``embeddings``: the plain scan, in blocks."""
    return _ranked(embeddings.withColumn("part", F.lit(0)), queries.select("query_id", "vector").withColumn("part", F.lit(0)), k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the neighbours in ``true`` that ``found`` has."""
    hit = found.select("query_id", "embedding_id", F.lit(1).alias("_hit"))
    n, m = true.join(hit, ["query_id", "embedding_id"], "left").agg(F.count("*"), F.count("_hit")).first()
    return m / n if n else 1.0


def tuned(spark: SparkSession, index: VectorIndex, k: int = 10, target: float = 0.95, seed: int = 7) -> int:
    """The fewest lists to probe for a recall of ``target``: by the ranks, among the lists, of those that hold the true neighbours
    of ``TUNING_QUERIES`` rows drawn by a hash of the id."""
    rows = index.rows(spark).where("list >= 0")
    some = rows.orderBy(F.xxhash64("embedding_id", F.lit(seed)), "embedding_id").limit(TUNING_QUERIES).select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("vector"))
    some = spark.createDataFrame(some.toArrow())
    true = nearest_of_each(rows, some, k).join(rows.select("embedding_id", "list"), "embedding_id").select("query_id", "list").toArrow().to_pydict()
    vectors = some.toArrow()
    _, q = _matrix(vectors.column("vector"))
    place = np.argsort(np.argsort(-(q @ index.centroids.T), axis=1), axis=1)
    row = {i: n for n, i in enumerate(vectors.column("query_id").to_pylist())}
    needed = sorted(int(place[row[i], part]) + 1 for i, part in zip(true["query_id"], true["list"]))
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1
