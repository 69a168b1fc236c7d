"""Runs against a scan of every period, planted runs, odd texts, and texts in which hashes meet."""

import hashlib
import random

import numpy as np
import pytest

from quire.llm import periodic_runs as P


def brute(words):
    """Every stretch of every period, whose smallest period it is."""
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - start
            part = words[start : start + n]
            if i > start and n >= max(24, 3 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((start, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    out = []
    while len(out) < n:
        part = [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 12))]
        out += (part * rng.randint(1, 8))[: rng.randint(1, 60)]
        out += [f"v{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20))]
    return out[:n]


def test_runs_are_those_of_a_scan_of_every_period():
    rng = random.Random(3)
    for _ in range(60):
        texts = [some_words(rng, rng.randint(0, 250)) for _ in range(rng.randint(1, 5))]
        encoded = [[w.encode() for w in t] for t in texts]
        assert [r for _, r in P._found(iter(encoded))] == [brute(t) for t in texts]


@pytest.mark.parametrize("pairs", [1, 7])
def test_few_pairs_at_a_time(monkeypatch, pairs):
    monkeypatch.setattr(P, "PAIRS", pairs)
    words = some_words(random.Random(9), 200)
    assert [r for _, r in P._found(iter([[w.encode() for w in words]]))] == [brute(words)]


def test_hashes_that_meet_do_not_change_the_runs(monkeypatch):
    monkeypatch.setattr(P.W, "mix", lambda x: x.astype(np.uint64) & np.uint64(1))
    rng = random.Random(4)
    for _ in range(10):
        words = some_words(rng, 150)
        assert [r for _, r in P._found(iter([[w.encode() for w in words]]))] == [brute(words)]


def test_one_word_over_a_long_text_is_one_run():
    assert [r for _, r in P._found(iter([[b"a"] * 100_000]))] == [[(0, 100_000, 1)]]
    assert len(P.kept_words(100_000, [(0, 100_000, 1)])) == 1


def plant(doc_id, words):
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    a = h // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def test_digest_and_collapsed(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a", "a " * 24, "a " * 23, "A a " * 30, "x\x0by " * 12, "ä b " * 30, *[" ".join(some_words(rng, n)) for n in range(5, 400, 7)], "z q " * 40, "z q " * 40]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "b " * 30, "x", 1), (3, "c " * 30, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start long")
    got = sorted(tuple(r) for r in P.digest(docs).collect() if r.doc_id is not None and r.runs_sha256)
    want = []
    for i, t, *_ in rows:
        if i is None:
            continue
        words = [w.decode() for w in (t or "").encode().split()]
        words = plant(i, words)
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)))
    assert got == sorted(want)
    null = P.digest(docs.where("doc_id IS NULL")).first()
    assert (null.n_runs, null.length, null.period) == (1, 30, 1)
    out = {r.doc_id: r for r in P.collapsed(docs.where("text LIKE 'z%' OR text IS NULL OR text = 'a'")).collect()}
    assert [out[0].text, out[3].text] == [None, "a"] and {r.text for i, r in out.items() if i > 3} == {"z q"} and out[0].n_runs == "x"
    found = {tuple(r) for r in P.runs(docs.where("text LIKE 'z%' OR text = ''")).collect()}
    assert {r[1:] for r in found} == {(0, 80, 2)} and len(found) == 2


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.digest(none).collect() == P.runs(none).collect() == P.collapsed(none).collect() == []
