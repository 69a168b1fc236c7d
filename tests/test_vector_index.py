"""The inverted-file index: recall against the plain scan, all lists against brute force, and rows without a vector."""

import numpy as np
import pytest

from quire.operators import vector_index as V

SCHEMA = "embedding_id long, job_id int, embedding array<float>"


def rows(n, dims, clusters, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dims)) * 1.5
    return [(i, i % 5, (centers[r.integers(clusters)] + r.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def brute(data, asked, k):
    usable = [(i, np.array(v, np.float64)) for i, _, v in data if v is not None and len(v) == len(data[0][2]) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in usable])
    ids = np.array([i for i, _ in usable])
    out = []
    for q, v in asked:
        near = np.round(x @ (np.array(v, np.float64) / np.linalg.norm(v)), 6)
        out += [(q, int(ids[j]), float(near[j]), r + 1) for r, j in enumerate(np.lexsort((ids, -near))[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    some = rows(3000, 16, 30)
    some += [(5000 + i, 1, some[7][2]) for i in range(700)]  # a list that many equal rows fall into
    return some + [(9001, 0, None), (9002, 0, []), (9003, 0, [0.0] * 16), (9004, 0, [1.0] * 3), (9005, 0, some[3][2]), (9005, 0, some[3][2])]


def test_recall_and_exactness(spark, data, tmp_path):
    e = spark.createDataFrame(data, SCHEMA).repartition(6)
    asked = [(i, v) for i, _, v in data if i % 100 == 0]
    q = spark.createDataFrame(asked, "query_id long, vector array<float>")
    index = V.build(e, str(tmp_path / "index"))
    assert index.lists == 60 and index.rows(spark).count() == len(data)
    true = V.nearest_of_each(e, q, 10)
    assert sorted(map(tuple, true.select("query_id", "embedding_id", "similarity", "rank").collect())) == brute(data, asked, 10)
    every = V.search(spark, index, q, 10, index.lists)
    assert sorted(map(tuple, every.select("query_id", "embedding_id", "similarity", "rank").collect())) == brute(data, asked, 10)
    probes = V.tuned(spark, index)
    assert probes < index.lists / 2
    assert V.recall(V.search(spark, index, q, 10, probes), true) >= 0.9
    again = V.VectorIndex.opened(spark, str(tmp_path / "index"))
    assert np.array_equal(again.centroids, index.centroids)


def test_blocks_smaller_than_the_tables(spark, data, monkeypatch):
    from quire.operators import blocks

    monkeypatch.setattr(V, "in_blocks", lambda *a: blocks.in_blocks(*a, block_rows=300, block_queries=7))
    asked = [(i, v) for i, _, v in data if i % 100 == 0]
    q = spark.createDataFrame(asked, "query_id long, vector array<float>")
    got = V.nearest_of_each(spark.createDataFrame(data, SCHEMA), q, 4)
    assert sorted(map(tuple, got.select("query_id", "embedding_id", "similarity", "rank").collect())) == brute(data, asked, 4)


def test_only_probed_lists_are_read_and_one_job_is_searched(spark, data, tmp_path):
    e = spark.createDataFrame(data, SCHEMA)
    index = V.build(e, str(tmp_path / "index"), lists=20)
    q = spark.createDataFrame([(1, data[1][2])], "query_id long, vector array<float>")
    got = V.search(spark, index, q, 3, 2, job=1)
    assert {r.job_id for r in e.join(got.select("embedding_id"), "embedding_id").collect()} == {1}
    assert got.orderBy("rank").first().embedding_id == 1


def test_no_rows_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = V.build(none, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, vector array<float>")
    assert V.search(spark, index, q).collect() == [] == V.nearest_of_each(none, q).collect()
    some = spark.createDataFrame([(1, 1, [1.0, 0.0])], SCHEMA)
    assert V.nearest_of_each(some, q.where("query_id = 2")).collect() == []
