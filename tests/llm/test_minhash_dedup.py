"""Near duplicates by bottom-k sketches against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from quire.llm import jaccard_join as J
from quire.llm import minhash_dedup as M
from tests.llm.test_jaccard_join import SCHEMA, corpus, shingles


def brute(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    of = [least.get(find(i)) if s else r[0] for i, (r, s) in enumerate(zip(rows, sets))]
    return sorted(str((r[0], len(s), c, r[0] is None or r[0] == c)) for r, s, c in zip(rows, sets, of))


def close(seed):
    """Texts with few changes, so that many pairs are near the limit on either side of it."""
    r = random.Random(seed)
    out = []
    for n in (6, 7, 12, 20, 40, 56, 57, 60, 64, 66, 70, 76, 90, 150, 900):
        base = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
        for k in range(8):
            cut = r.randint(0, max(1, n // 12))
            out.append(" ".join(base[cut:] + [f"e{r.random()}" for _ in range(r.randint(0, max(1, n // 10)))]))
    return out


@pytest.mark.parametrize("seed,group,most,short", [(1, 32, 48 << 20, 16), (2, 3, 0, 2), (3, 256, 48 << 20, 1)])
def test_against_brute_force(spark, seed, group, most, short, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_BYTES", most)
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(M, "LIST", short)
    rows = [(i * 3, t, "k") for i, t in enumerate(corpus(seed) + close(seed))]
    rows += [(rows[80][0], rows[90][1], None), (None, rows[100][1], None), (None, "lonely words without any match", "k"), rows[70], rows[70]]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(str(tuple(r)) for r in M.digest(df).collect()) == brute(rows)


def test_crowds_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP", 4)
    monkeypatch.setattr(M, "LIST", 3)
    r = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    rows = [(i, " ".join(base[: 160 - 2 * (i % 40)] + [f"own{i % 40}x{k}" for k in range(2 * (i % 40))] + [f"t{r.random()}"]), None) for i in range(120)]
    large = []
    blocks = J._blocks
    monkeypatch.setattr(J, "_blocks", lambda members: large.append(members.where("large").count()) or blocks(members))
    assert sorted(str(tuple(x)) for x in M.digest(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()) == brute(rows)
    assert large[0] > 0


def test_linked_sets_share_enough_retained_values():
    r = np.random.default_rng(5)
    pairs = 0
    for size in (*range(1, 90), 120, 200, 700):
        for _ in range(30):
            base = r.integers(0, 2**63, size, dtype=np.uint64)
            drop = int(r.integers(0, size * 15 // 100 + 1))
            other = np.concatenate((base[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, int(size * 0.17)))), dtype=np.uint64)))
            a, b = np.sort(base), np.sort(other)
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            pairs += 1
            shared = len(np.intersect1d(a[: M.K], b[: M.K]))
            for n in (len(a), len(b)):
                assert shared >= (math.ceil(n * 0.85 - 1e-9) if n * 100 < 85 * 65 else M.NEED)
    assert pairs > 900


def test_common_is_that_of_the_least_of_both():
    r = random.Random(2)
    sketches = [sorted(r.sample(range(150), r.randint(1, M.K))) for _ in range(80)]
    pack = lambda x: np.array(x, np.uint64).tobytes()
    a, b = sketches[:40], sketches[40:]
    both, union = M.common([pack(x) for x in a], [pack(x) for x in b])
    for x, y, got, n in zip(a, b, both, union):
        least = sorted({*x, *y})[: M.K]
        assert (got, n) == (sum(v in x and v in y for v in least), len(least))


def test_dedup_with_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "k", 1), (1, text + " more", "k", 1), (2, "other", "k", 1), (4, None, "k", 1), (None, text, "k", 1), (6, "twice", "b", 2), (6, "twice", "a", 3)]
    for kept in (M.dedup, J.keep_one):
        got = kept(spark.createDataFrame(rows, "doc_id long, text string, _id string, _sum int"))
        assert got.columns == ["doc_id", "text", "_id", "_sum"]
        assert sorted(str((r["doc_id"], r["_id"])) for r in got.collect()) == ["(1, 'k')", "(2, 'k')", "(4, 'k')", "(6, 'a')", "(None, 'k')"]


def test_empty_table(spark):
    assert M.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
