"""Percentiles against numpy's, for values of any spread; classes drawn again without a window over a class."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.operators import training as T
from quire.operators.quantiles import percentiles

CASES = [[1.0], [2.0, 1.0], [5.0] * 40, list(range(1000)), [1e300, -1e300, 0.0, 1e-300, 3.0], [random.Random(1).gauss(0, 1) for _ in range(3000)], [1.0] * 900 + [10.0**i for i in range(60)]]


@pytest.mark.parametrize("cells", [2, 2048])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_percentiles(spark, case, cells):
    values = [float(x) for x in CASES[case]]
    df = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "d double")
    shares = (0.0, 0.5, 0.95, 1.0)
    assert percentiles(df, "d", shares, cells) == pytest.approx(list(np.percentile(values, [100 * s for s in shares])), rel=1e-12)


def test_no_values(spark):
    assert percentiles(spark.createDataFrame([(None,)], "d double"), "d", (0.5,)) == [None]


def test_balanced(spark):
    r = random.Random(4)
    rows = [(i, "big" if i < 900 else "small" if i < 930 else None if i < 940 else "mid") for i in range(1200)]
    r.shuffle(rows)
    got = Counter()
    for x in T.balanced(spark.createDataFrame(rows, "id long, cls string"), "cls", "id").collect():
        got[x.id] = max(got[x.id], x.copy)
    for cls, n in (("big", 900), ("small", 30), ("mid", 260)):
        ids = sorted((i for i, c in rows if c == cls), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        whole, rest = divmod(900, n)
        assert [got[i] for i in ids] == [whole + (k < rest) for k in range(n)]
    assert not any(got[i] for i, c in rows if c is None)
