"""The nearest token against brute force, over characters of one to four bytes; bands against all pairs."""

import random

import pytest

from quire.operators import search as S, tokens as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_token(spark):
    r = random.Random(3)
    words = ["les", "lés", "LES", "LÉS", "le", "él", "them", "thém", "t\u4e2dem", "th\U0001f389m", "other", "l", "", "themes"]
    tokens = [(p, r.choice(words), n, k) for p in range(12) for n in range(3) for k in range(4)]
    values = [(p, w) for p in range(13) for w in ("them", "les", "lés")]
    got = T.nearest_token(spark.createDataFrame(tokens, "page_id long, token_text string, line_number int, word_number int"), spark.createDataFrame(values, "page_id long, word string"))
    want = []
    for p, w in values:
        near = [(edits(t.upper(), w.upper()), n, k, t) for q, t, n, k in tokens if q == p]
        near = [x for x in near if x[0] <= 2]
        want += [(p, w.upper(), *min(near))] if near else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [0, 5, 7, 8, 12, 13])
def test_hamming_join(spark, most):
    r = random.Random(most)
    base = [r.getrandbits(64) for _ in range(40)]
    rows = [(i, h) for i, h in enumerate(base)]
    for h in base:
        for flips in (1, most, most + 1):
            x = h
            for bit in r.sample(range(64), flips):
                x ^= 1 << bit
            rows.append((len(rows), x))
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in rows]
    df = spark.createDataFrame(signed, "id long, hash long")
    want = {(i, j, bin(x ^ y).count("1")) for i, x in rows for j, y in rows if bin(x ^ y).count("1") <= most}
    got = [tuple(x) for x in S.hamming_join(df, df, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want
