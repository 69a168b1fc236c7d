"""The committed table: versions, repeated batches, null and repeated keys, and two writers at once."""

import pytest
from pyspark.sql import functions as F

from quire.sources.committed import CommittedTable

SCHEMA = "k int, v string, at int"


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", 0), (None, "n", 0), (2, "b", 0), (2, "b2", 1), (9, "z", 0)], SCHEMA)
    return CommittedTable.create(first, str(tmp_path / "t"), ["k"], 4, "at")


def test_versions_and_batches(spark, table):
    assert rows(table) == [(1, "a", 0), (2, "b2", 1), (9, "z", 0), (None, "n", 0)]
    seen = table.read()
    changes = spark.createDataFrame([(1, "d", 3), (1, "e", 2), (None, "m", 1), (5, None, 0)], SCHEMA)
    gone = spark.createDataFrame([(9,), (1,), (77,)], "k int")
    assert table.apply("w", 4, changes, gone, "at") == 2
    after = [(1, "d", 3), (2, "b2", 1), (5, None, 0), (None, "m", 1)]
    assert rows(table) == after
    assert sorted(map(tuple, seen.collect()), key=str) == rows(table, 1)  # an older reader keeps its version
    assert table.apply("w", 4, changes.withColumn("v", F.lit("again"))) == 2 and table.apply("w", 3, changes) == 2
    assert rows(table) == after
    assert table.apply("other", 0, None, spark.createDataFrame([(None,)], "k int")) == 3
    assert rows(table) == after[:-1]
    assert table.apply("other", 1) == 4 and table.versions() == [1, 2, 3, 4]
    assert table.vacuum(1) > 0 and table.versions() == [4] and rows(table) == after[:-1]
    with pytest.raises(KeyError):
        table.read(1)


def test_the_second_of_two_writers_starts_from_the_first_ones_version(spark, table, tmp_path):
    other = CommittedTable(spark, str(tmp_path / "t"))
    calls = []

    def change(now):
        if not calls:  # while this batch is under way, another one is applied
            other.apply("first", 0, spark.createDataFrame([(1, "x", 5), (6, "y", 5)], SCHEMA))
        calls.append(1)
        return now.withColumn("v", F.concat("v", F.lit("!")))

    table.apply("second", 0, change)
    assert len(calls) == 2
    assert rows(table) == [(1, "x!", 5), (2, "b2!", 1), (6, "y!", 5), (9, "z!", 0), (None, "n!", 0)]


def test_a_table_is_created_once(spark, table, tmp_path):
    with pytest.raises(FileExistsError):
        CommittedTable.create(spark.createDataFrame([(1, "a", 0)], SCHEMA), str(tmp_path / "t"), ["k"])


def test_an_empty_table(spark, tmp_path):
    t = CommittedTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), ["k"])
    assert rows(t) == []
    t.apply("w", 0, spark.createDataFrame([(3, "c", 0)], SCHEMA))
    assert rows(t) == [(3, "c", 0)]
