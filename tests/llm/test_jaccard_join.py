"""N-gram Jaccard join against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from quire.llm import components, jaccard_join as J, words as W

SCHEMA = "doc_id long, text string, root string"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(str((r[0], len(s), least.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghéÉ") for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    out = [" ".join(prose(n)) for n in [*range(0, 14), *range(20, 60, 3)]]
    passage = prose(40)
    out += [" ".join(prose(30) + passage + prose(r.randint(20, 50))) for _ in range(40)]  # share a passage, and no more
    for base in (prose(8), prose(15), prose(60), prose(200), prose(1200)):
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            copy += prose(r.randint(0, len(base) // 8))
            out.append(" ".join(copy).upper() if r.random() < 0.2 else "\n".join(copy))
    return out + [None, "", "  ", "one two", "ONE two", "x " * 500, "x " * 9]


@pytest.mark.parametrize("seed,group,most", [(1, 32, 48 << 20), (2, 3, 0)])
def test_against_brute_force(spark, seed, group, most, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", most)
    monkeypatch.setattr(J, "GROUP", group)  # in this process only the driver's part of it
    rows = [(i * 3, t, "k") for i, t in enumerate(corpus(seed))]
    rows += [(rows[80][0], rows[90][1], None), (None, rows[100][1], None), (None, "lonely words without any match", "k"), rows[70], rows[70]]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(str(tuple(r)) for r in J.digest(df).collect()) == brute(rows)


@pytest.mark.parametrize("level", J.LEVELS)
def test_linked_pairs_share_a_signature(level):
    r = np.random.default_rng(3)
    for size in (4, 5, 8, 13, 30, 77, 200, 700):
        for _ in range(40):
            base = r.integers(0, 2**63, size, dtype=np.uint64)
            drop = int(r.integers(0, size // 4 + 1))
            other = np.concatenate((base[drop:], r.integers(0, 2**63, max(0, int(size * 0.14) - drop), dtype=np.uint64)))
            both = len(np.intersect1d(base, other))
            if 100 * both < 75 * (len(base) + len(other) - both) or len(base) == len(other) == both:
                continue
            sets = [np.sort(base), np.sort(other)]
            sigs, own = J.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), level)
            assert len(np.intersect1d(sigs[own == 0], sigs[own == 1])), (size, drop)


def ways(n, most, largest=None):
    """The ways n shingles can lie in at most ``most`` cells that are alike: counts, falling."""
    if not n or not most:
        return [] if n else [()]
    return [(x, *rest) for x in range(min(n, largest or n), 0, -1) for rest in ways(n - x, most - 1, x)]


def split(total, n, parts):
    """The ways ``total`` shingles can fall into ``n`` partitions of ``parts`` parts: for each partition its counts."""
    if n == 1:
        return [(w,) for w in ways(total, parts)]
    return [(one, *rest) for first in range(total + 1) for one in ways(first, parts) for rest in split(total - first, n - 1, parts)]


@pytest.mark.parametrize("level", J.LEVELS)
@pytest.mark.parametrize("large,small", [(4, 3), (8, 6)])
def test_small_pairs_share_a_signature_however_they_fall(large, small, level):
    inst = int(J.band_of(large))
    n = int(J.partitions(np.array([inst]), level)[0])
    g = np.random.default_rng(7).integers(0, 2**63, 20000, dtype=np.uint64)
    h = W.mix(g ^ W.mix(np.array([inst + 1000 * level.n2], np.uint64)))
    place, part = (h % np.uint64(n)).astype(int), ((h >> np.uint64(40)) % np.uint64(level.n2)).astype(int)
    pool = {(p, q): g[(place == p) & (part == q)].tolist() for p in range(n) for q in range(level.n2)}
    if level.n2 == 1:
        falls = [[(p, 0) for p, k in enumerate(w) for _ in range(k)] for w in ways(large, n)]
    else:
        falls = [[(p, q) for p, w in enumerate(ws) for q, k in enumerate(w) for _ in range(k)] for ws in split(large, n, level.n2)]
    sets = []
    for cells in falls:
        base = [pool[c][cells[:i].count(c)] for i, c in enumerate(cells)]
        for kept in combinations(range(large), small):
            sets += [np.sort(np.array(base, np.uint64)), np.sort(np.array([base[i] for i in kept], np.uint64))]
    sigs, own = J.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), level)
    held = [set() for _ in sets]
    for x, i in zip(sigs.tolist(), own.tolist()):
        held[i].add(x)
    assert len(sets) >= 40 and not [i for i in range(0, len(sets), 2) if not held[i] & held[i + 1]]


def linked_pairs(seed):
    r = np.random.default_rng(seed)
    for size in (1, 3, 4, 5, 6, 8, 13, 30, 77, 200, 700, 3000):
        for _ in range(40):
            base = r.integers(0, 2**63, size, dtype=np.uint64)
            drop = int(r.integers(0, size // 4 + 1))
            other = np.concatenate((base[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, int(size * 0.3)))), dtype=np.uint64)))
            both = len(np.intersect1d(base, other))
            if 100 * both >= 75 * (len(base) + len(other) - both) and not len(base) == len(other) == both:
                yield np.sort(base), np.sort(other)


def test_linked_pairs_share_as_many_signatures_as_support_asks_for():
    refused = pairs = 0
    for sets in linked_pairs(5):
        sigs, own, extra, need = J.enumerated(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), J.LEVELS[0])
        for i in (0, 1):
            shared = [len(np.intersect1d(sigs[(own == i) & (extra == e)], sigs[own == 1 - i])) for e in (0, 1)]
            assert any(need[i][e] > 0 and shared[e] >= need[i][e] for e in (0, 1)), list(map(len, sets))
        pairs += 1
    for size in (30, 200, 900):
        one, two = (np.random.default_rng(size + k).integers(0, 2**63, size, dtype=np.uint64) for k in (0, 1))
        two[: size // 3] = one[: size // 3]  # a passage, and no more
        sets = [np.sort(one), np.sort(two)]
        sigs, own, extra, need = J.enumerated(np.concatenate(sets), np.cumsum([0, size, size]), J.LEVELS[0])
        refused += all(len(np.intersect1d(sigs[(own == 0) & (extra == e)], sigs[own == 1])) < need[0][e] for e in (0, 1) if need[0][e] > 0)
    assert pairs > 100 and refused == 3


def test_links_of_counts_common_shingles():
    sets = [s for pair in linked_pairs(11) for s in pair if len(s) < 300][:60] + [np.arange(7, dtype=np.uint64)]
    a, b = J.links_of(np.arange(len(sets)), sets)
    want = set()
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            want.add((i, j))
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 25


@pytest.mark.parametrize("chunk", [1 << 18, 3])
def test_components(spark, chunk, monkeypatch):
    r = random.Random(chunk)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(7, 7), (5, 4)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = spark.createDataFrame([p if r.random() < 0.5 else p[::-1] for p in pairs], "a long, b long").repartition(9)
    got = {tuple(x) for x in components.components(links).collect()}
    assert got == {(n, find(n)) for n in root if find(n) != n}


def test_shingle_sets():
    (s,) = W.slices(["a b c d e f", "A B C D E F", "a b", None, "a b c d e f a b c d e f"], lower=True)
    g, first = J.shingle_sets(s)
    assert list(np.diff(first)) == [2, 2, 1, 0, 6]
    assert (g[0:2] == g[2:4]).all()


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "k"), (1, text + " more", "k"), (2, "other", "k"), (4, None, "k"), (None, text, "k")]
    assert sorted(str(r["doc_id"]) for r in J.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == ["1", "2", "4", "None"]


def test_keep_one_tells_rows_with_one_id_apart(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "k"), (3, text + " x", "k"), (3, "unrelated words that nothing else has at all", "k"), (9, "said twice in this table, once stays", "k"), (9, "said twice in this table, once stays", "k")]
    rows += [(5, text.upper() + " one two three four five", "k"), (1, text + " y", "k")]
    got = sorted((r["doc_id"], r["text"][:9]) for r in J.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [g for g in got if g[0] != 1] == [(3, "unrelated"), (9, "said twic")] and [g[0] for g in got].count(1) == 1


def test_crowds_beyond_a_block(spark, monkeypatch):
    """Sets that share signatures with many others but link with few: both steps for large crowds have work to do."""
    monkeypatch.setattr(J, "GROUP", 4)
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 100 - 2 * (i % 40)] + [f"own{i % 40}x{k}" for k in range(2 * (i % 40))] + [f"t{r.random()}"]), None) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    large = []
    blocks = J._blocks
    monkeypatch.setattr(J, "_blocks", lambda members: large.append(members.where("large").count()) or blocks(members))
    assert sorted(str(tuple(x)) for x in J.digest(df).collect()) == brute(rows)
    assert large[0] > 0


def test_empty_table(spark):
    assert J.digest(spark.createDataFrame([], SCHEMA)).count() == 0
