"""Near hashes in blocks: every pair, also across blocks, and no rows but the pairs and the copies of a hash for each block."""

import random

import pytest

from quire.operators import matching as M
from quire.operators import search as S

signed = lambda x: x - (1 << 64) if x >> 63 else x
apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    monkeypatch.setattr(M, "BLOCK", 5)


def hashes(n):
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(12)]
    return [(i, signed(r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))))) for i in range(n)]


def test_each_two_once_across_blocks(spark, small):
    rows = hashes(150)
    df = spark.createDataFrame([*rows, (999, None)], "id long, hash long")
    got = [tuple(x) for x in S.near_pairs(df, 12).collect()]
    want = {(i, j, apart(x, y)) for i, x in rows for j, y in rows if i < j and apart(x, y) <= 12}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_pairs_are_not_joined_by_bands(spark):
    plan = S.hamming_join(spark.range(9).selectExpr("id", "id AS hash"), spark.range(9).selectExpr("id", "id AS hash"), 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_first_samples_of_a_page_across_blocks(spark, small):
    rows = hashes(60)
    samples = spark.createDataFrame([(i, "AB"[i % 2], h, 14 - i % 3) for i, h in rows[:40]], "sample_id long, _payer string, _sh long, _limit int")
    pages = spark.createDataFrame([(p, h) for _, h in rows for p in ("=A", "*")], "part string, hash long")
    got = sorted(map(tuple, M._nearest(pages, samples, 14).select("part", "hash", "distance", "sample_id").collect()))
    want = []
    for part in ("=A", "*"):
        for h in {h for _, h in rows}:
            near = sorted((apart(h, x), i) for i, x in rows[:40] if (part == "*" or i % 2 == 0) and apart(h, x) <= 14 - i % 3)
            want += [(part, h, d, i) for d, i in near[: M.TOP]]
    assert got == sorted(want)
