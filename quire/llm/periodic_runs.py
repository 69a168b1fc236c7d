"""Periodic run detection on a harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES`` periods long, that
no neighbouring word extends keeping the period. Words q apart are equal over all of a run but its last q words, that is
over at least 2q words in a row, so one of the grid points q, 2q, 3q, ... has all words up to the next one among them.

1. Grid. For every period q of a text up to a third of its words, the points k*q: n/1 + n/2 + n/3 + ... pairs (period,
   point). Those whose word, and then whose block up to the next point, equals what comes q words later stay.
2. How far the words go on being equal, backwards and forwards from each of the points that stay, is searched by halving
   for all pairs at once, by prefix hashes of the words' numbers.
3. What is found is checked word by word. Several points, and the multiples of a period, find one stretch; its smallest
   period is kept (a stretch of three periods q with a smaller period p has p dividing q, and the same ends for both).

Everything is done where the text lies: nothing is shuffled. Texts are taken in slices of about ``SLICE_WORDS`` words and
pairs ``PAIRS`` at a time, so the memory of a task follows the longest text and not the batch.

Defined results: null and empty texts, and texts without words, have no run and collapse to nothing; words are compared as
they are; a null id plants nothing (``digest``); rows that repeat an id are judged each for itself; other columns pass
through ``collapsed`` and are left out of the other results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm import words as W
from quire.llm.storage import text_batches

LEAST = 24
TIMES = 3
SLICE_WORDS = 1 << 17
PAIRS = 1 << 20
Run = tuple[int, int, int]


class _Numbers(dict):
    """Numbers words by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _furthest(same, most: np.ndarray) -> np.ndarray:
    """For each pair the greatest m up to ``most`` with ``same(m)``, which holds for 0 and up to some m."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        ok = same(middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    return low


def _on_grid(codes: np.ndarray, roll: W.Rolling, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text's begin and end, period and point of the pairs whose block is followed by an equal one.

    ``begin``, ``end`` and ``period`` have a row for each period of each text.
    """
    upto = np.cumsum((end - begin) // period - 1)
    done = 0
    while done < len(period):
        base = upto[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        count = np.diff(np.concatenate(([base], upto[done:stop])))
        q = np.repeat(period[done:stop], count)
        at = np.repeat(begin[done:stop] - period[done:stop] * (upto[done:stop] - count - base), count) + np.arange(len(q)) * q
        close = np.flatnonzero(codes[at] == codes[at + q])
        row = np.searchsorted(upto[done:stop] - base, close, "right") + done
        at, q = at[close], q[close]
        ok = roll.runs(at, at + q) == roll.runs(at + q, at + 2 * q)
        yield begin[row[ok]], end[row[ok]], q[ok], at[ok]
        done = stop


def runs_of(codes: np.ndarray, first: np.ndarray) -> list[list[Run]]:
    """The runs (start, length, period) of each text by start, then period; text j is ``codes[first[j]:first[j + 1]]``."""
    size = np.diff(first)
    most = np.where(size >= LEAST, size // TIMES, 0)
    found: list[list[Run]] = [[] for _ in size]
    text = np.repeat(np.arange(len(size)), most)
    if not len(text):
        return found
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    roll = W.Rolling(W.mix(codes.astype(np.uint64) + np.uint64(1)))
    held = set()
    for begin, end, q, at in _on_grid(codes, roll, first[text], first[text + 1], period):
        after = _furthest(lambda m: roll.runs(at, at + m) == roll.runs(at + q, at + q + m), end - at - q)
        before = _furthest(lambda m: roll.runs(at - m, at) == roll.runs(at + q - m, at + q), at - begin)
        start, stop = at - before, at + q + after
        ok = stop - start >= np.maximum(LEAST, TIMES * q)
        held.update(zip(start[ok].tolist(), stop[ok].tolist(), q[ok].tolist()))
    broken, seen = set(), set()
    for start, stop, q in sorted(held, key=lambda r: (r[2], r)):
        if (start, stop) in seen:  # by a multiple of its period
            continue
        j = int(np.searchsorted(first, start, "right")) - 1
        if not _is_run(codes, int(first[j]), int(first[j + 1]), start, stop, q):
            broken.add(j)
        else:
            seen.add((start, stop))
            found[j].append((start - int(first[j]), stop - start, q))
    for j in broken:
        found[j] = plain_runs(codes[first[j] : first[j + 1]])
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def _is_run(codes: np.ndarray, begin: int, end: int, start: int, stop: int, q: int) -> bool:
    """Whether the words bear out what the hashes say."""
    inside = np.array_equal(codes[start : stop - q], codes[start + q : stop])
    return inside and (start == begin or codes[start - 1] != codes[start - 1 + q]) and (stop == end or codes[stop] != codes[stop - q])


def plain_runs(codes: np.ndarray) -> list[Run]:
    """The runs of one text, each period over all its words; for texts in which two hashes have met."""
    held: dict[tuple[int, int], int] = {}
    for q in range(1, len(codes) // TIMES + 1 if len(codes) >= LEAST else 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], codes[:-q] == codes[q:], [0]))))
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if stop + q - start >= max(LEAST, TIMES * q):
                held.setdefault((start, stop + q), q)
    return sorted(((x, y - x, q) for (x, y), q in held.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Numbers of the words that stay of ``n`` when each run keeps its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.flatnonzero(np.cumsum(depth[:n]) == 0)


def _found(texts: Iterator[list[bytes]]) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words and runs of each text, a slice of texts at a time."""
    held: list[list[bytes]] = []
    size = 0

    def out() -> Iterator[tuple[list[bytes], list[Run]]]:
        numbers = _Numbers()
        codes = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in held])
        yield from zip(held, runs_of(codes, np.cumsum([0, *map(len, held)])))

    for w in texts:
        held.append(w)
        size += len(w)
        if size >= SLICE_WORDS:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, parted by the six white-space characters of ASCII."""
    return (text or "").encode().split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a run planted in a tenth of the documents, as the digest's definition says."""
    h, n = (0, 0) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(words))
    if not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def best(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equal ones the first, then the one of the smaller period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length and period, a row for each run of each document of ``docs``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [r for _, r in _found(map(words_of, b.column("text").to_pylist()))]
            rows = np.repeat(np.arange(len(each)), [len(r) for r in each])
            columns = np.array([x for r in each for x in r], np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, columns)], names=["doc_id", "start", "length", "period"])

    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("start", "length", "period"))])
    return text_batches(docs.select("doc_id", "text")).mapInArrow(find, schema)


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs``, the text of each document with a run being its kept words joined by one space; all other columns and texts stay."""
    at = docs.columns.index("text")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if not r else b" ".join([w[i] for i in kept_words(len(w), r)]).decode() for t, (w, r) in zip(texts, _found(map(words_of, texts)))]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    schema = StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType, True) for f in docs.schema.fields])
    return text_batches(docs).mapInArrow(collapse, schema)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    """A row per document: its runs, the best of them, and digests of all runs and of the collapsed text, once runs are planted."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for words, each in _found(map(planted, ids, map(words_of, b.column("text").to_pylist()))):
                top = best(each)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in each).encode()
                left = words if not each else [words[i] for i in kept_words(len(words), each)]
                rows.append((len(each), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(listed), sha(b" ".join(left))))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *map(pa.array, columns, kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return text_batches(docs.select("doc_id", "text")).mapInArrow(judge, DIGEST)
