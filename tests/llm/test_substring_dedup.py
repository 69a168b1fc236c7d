"""Substring dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import substring_dedup as S, words as W

SCHEMA = "doc_id long, text string, sum string"


def brute(rows):
    docs = [(i, (t or "").encode().split()) for i, t, _ in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in docs for k in range(len(w) - 34))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append(str((i, len(w), len(gone), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    prose = lambda n: [word() for _ in range(n)]
    passage, base = prose(60), prose(300)
    out = [" ".join(prose(r.randint(0, 120))) for _ in range(20)]
    out += [" ".join(prose(r.randint(0, 50)) + passage[r.randint(0, 20) : r.randint(30, 60)] + prose(r.randint(0, 50))) for _ in range(30)]
    for _ in range(20):  # near copies, a few words changed
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(300)] = word()
        out.append("\n".join(copy))
    out += [" ".join(["x"] * 100), " ".join(["x", "y"] * 40), " ".join(passage[:34]), " ".join(passage[:35]), None, "", " \t\n", "a b " * 40]
    out += [" ".join(base)] * 3 + [" ".join(prose(30000) + passage)]
    return out


@pytest.mark.parametrize("seed,most", [(1, 0), (2, 48 << 20)])
def test_against_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", most)
    rows = [(i, t, "x") for i, t in enumerate(texts(seed))]
    rows += [(5, rows[40][1], None), (None, rows[41][1], None), (None, None, None), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(tuple(r)) for r in S.digest(df).collect()) == brute(rows)


def test_dedup_keeps_columns(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "head one " + a, "k"), (2, a + " tail  two", "k"), (3, "alone  here", "k"), (4, None, "k")]
    got = {r["doc_id"]: (r["text"], r["sum"]) for r in S.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("head one", "k"), 2: ("tail two", "k"), 3: ("alone  here", "k"), 4: (None, "k")}


def test_empty_table(spark):
    assert S.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_in_and_runs():
    r = np.random.default_rng(1)
    g = r.integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 28):
        assert [int(x) for x in W.least_in(g, width)] == [i + int(np.argmin(g[i : i + width])) for i in range(300 - width + 1)]
    (s,) = W.slices(["a b a b", None, "a b\x0bé"])
    roll = W.Rolling(s.h)
    runs = roll.runs(np.array([0, 2, 4]), np.array([2, 4, 6]))
    assert runs[0] == runs[1] == runs[2] and list(s.first) == [0, 4, 4, 7]
