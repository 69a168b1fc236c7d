"""Nearest hashes by the multi-index against brute force, with dense, hot and far hashes, and links between classes."""

import random

import pytest

from quire.operators import hash_index as H

SCHEMA = "id long, hash long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def apart(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def table(seed, spread):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(25)]
    out = []
    for i in range(600):
        x = r.choice(base)
        for _ in range(r.randint(0, spread)):
            x ^= 1 << r.randrange(64)
        out.append((i, signed(x)))
    hot = signed(base[0])
    return out + [(1000 + i, hot) for i in range(300)] + [(2000, None), (2001, 0), (2002, -1), (2003, signed(r.getrandbits(64))), (5, hot)]


def brute(rows, asked, k, most):
    out = []
    for q, h in asked:
        if h is None:
            continue
        near = sorted((apart(h, x), i) for i, x in rows if x is not None and apart(h, x) <= most)[:k]
        out += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("spread,k,most,how", [(2, 5, 64, {}), (4, 3, 24, {"per_salt": 2}), (12, 5, 24, {}), (3, 400, 10, {}), (6, 5, 64, {"turned": 0}), (2, 1, 0, {})])
def test_nearest_is_that_of_brute_force(spark, spread, k, most, how):
    rows = table(spread, spread)
    asked = [r for r in rows if r[0] % 20 == 0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = H.nearest(df, spark.createDataFrame(asked, SCHEMA), k, most, **how)
    assert sorted(map(tuple, got.select("left_id", "right_id", "distance", "rank").collect())) == brute(rows, asked, k, most)


def test_links_are_between_classes(spark):
    rows = table(3, 3)
    least = {}
    for i, h in rows:
        if h is not None:
            least[h] = min(i, least.get(h, i))
    want = {(least[h], i, 0) for i, h in rows if h is not None and i != least[h]}
    want |= {(a, b, apart(x, y)) for x, a in least.items() for y, b in least.items() if a < b and apart(x, y) <= 6}
    assert set(map(tuple, H.links(spark.createDataFrame(rows, SCHEMA), 6).collect())) == want


def test_bands_cover_all_bits():
    for n in (0, 1, 300, 10**6, 10**12):
        cut = H.bands(n)
        assert cut[0][0] == 0 and sum(b for _, b in cut) == 64 and all(a + b == c for (a, b), (c, _) in zip(cut, cut[1:]))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.nearest(none, spark.createDataFrame([(1, 5)], SCHEMA)).collect() == [] == H.links(none, 5).collect()
