"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct shingles of ``SHINGLE`` words. Two sets link when their Jaccard similarity is at
least 75 %. Then they differ in at most (|r| + |s|) / 7 shingles. Sizes fall into bands; in the instance of a band the
domain of shingles is partitioned by hash, each partition into n2 parts, and a set's signatures are what it has in each
choice of n2 - k2 parts of a partition. There are so many partitions that one of them differs in at most k2 shingles, so
some choice is equal in both. A linked pair meets in the band of its larger set, where both emit; small sets for which
such a choice might be empty also emit their empty ones.

The work goes in five steps, each a table or some in the shared folder:

1. Support (``LEVELS[0]``, partitions as they are). A pair that links differs in few partitions, so all but those must be
   shared. Each set counts how many of its signatures any other set has too; one with too few has no link and is done.
   Nothing but counts leaves this step, so a signature that a third of the corpus has is one entry a task.
2. Signatures by subsets (``LEVELS[1]``) of the sets that are left, each different set once. Of the sets that share a
   signature the least leads, within a task first and then over all, so a hot signature sends one entry a task. Leaders
   and members are the edges of crowds: a linked pair shares a signature and hence lies in one crowd.
3. Large crowds. Passages that many texts share hold unlike sets together, so a crowd beyond ``GROUP`` sets is parted
   further: linked sets also share one of their rarest shingles (``_rare``).
4. Crowds that are still large. Each set is compared with the leader it shares most signatures with. What is linked by
   now is one component; crowds of one component are done, as groups of near copies are.
5. Blocks. What is left of a crowd is dealt to blocks of about ``GROUP`` sets, in a large crowd by bands of sizes that can
   link; two blocks meet at a time, and all their pairs are compared. A crowd of at most ``GROUP`` sets is one block.

Every comparison counts the shingles of whole texts, as a product of block matrices. Step 5 is quadratic in what is left
of a crowd that has several components, and nothing is dropped there.

Defined results: null and empty texts, and texts without words, have no shingles and are components of their own; texts
of fewer than ``SHINGLE`` words have one shingle, the whole; equal sets link; a null id reaches the ids of its
component, and a component without ids has a null id; rows with equal ids are told apart by a checksum of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import words as W
from quire.llm.components import components, contracted
from quire.llm.storage import BROADCAST_BYTES, sized_broadcast, stored, text_batches
from quire.llm.substring_dedup import checksum

SHINGLE = 5
PERCENT = 75
GROUP = 256
BAND = 1.8
#: Shingles of a block; a block of long texts has fewer sets.
LOAD = 1 << 20
#: Signatures a task packs before it sends them to the buckets, and counts or edges it holds before it adds them up.
PACK = 1 << 20
_DOC, _BLOB, _LOCAL, _COUNT, _EDGE = range(5)
#: Owner of a signature whose owners in its own pack have been counted already.
_MARK = 0xFFFF
SUPPORT_ROWS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("sum", pa.int32()), ("n", pa.int64()), ("sid", pa.int64()), ("s2", pa.int64()), ("g", pa.int64()), ("need0", pa.int64()), ("need1", pa.int64()), ("bucket", pa.int32()), ("flush", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
JOIN_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])


@dataclass(frozen=True)
class Level:
    """``k2`` differences are let pass in a partition; ``n2`` parts of it, of which ``n2 - k2`` make a signature."""

    k2: int
    n2: int


LEVELS = (Level(0, 1), Level(1, 3))


def differ(size: np.ndarray | int):
    """Most shingles in which a set of this size can differ from a linked one that is not larger."""
    return 2 * size * (100 - PERCENT) // (100 + PERCENT)


def reach(size: np.ndarray | int, largest: np.ndarray | int):
    """Most shingles in which a set of this size can differ from any linked one of at most ``largest``, be it larger or not."""
    return (size + np.minimum(size * 100 // PERCENT, largest)) * (100 - PERCENT) // (100 + PERCENT)


def band_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BANDS, size, "right") - 1


def _bands() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * BAND) + 1)
    return np.array(out, np.int64)


_BANDS = _bands()


def partitions(band: np.ndarray, level: Level) -> np.ndarray:
    largest = _BANDS[band + 1] - 1
    if level.n2 == 1:
        return (largest * 33 + 99) // 100 + 6
    return differ(largest) // (level.k2 + 1) + 1


def shingle_sets(s: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice, by text and ascending, and where each text's begin."""
    n = np.diff(s.first)
    if not len(s.h):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    roll = W.Rolling(s.h)
    left = s.left()
    at = np.arange(len(s.h))
    whole = np.isin(at, s.first[:-1][(n > 0) & (n < SHINGLE)])
    at = at[(left >= SHINGLE) | whole]
    g = roll.runs(at, at + np.minimum(SHINGLE, left[at]))
    text = s.text_of[at]
    cuts = np.searchsorted(text, np.arange(len(n) + 1)).tolist()
    for x, y in zip(cuts, cuts[1:]):
        g[x:y].sort()
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])))
    g, text = g[new], text[new]
    return g, np.searchsorted(text, np.arange(len(n) + 1))


def set_hashes(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    sums = lambda x: np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    of = lambda x: W.mix((c := sums(x))[first[1:]] - c[first[:-1]] + np.diff(first).astype(np.uint64))
    return of(W.mix(g ^ np.uint64(0xA5A5A5A5DEADBEEF))), of(W.mix(g * np.uint64(0xD6E8FEB86659FD93) + np.uint64(77)))


def _sums(values: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums modulo 2^64 by cell, and which cells have any. Halves of 32 bits add up exactly as floats."""
    low = np.bincount(cell, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
    high = np.bincount(cell, (values >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
    return low + (high << np.uint64(32)), np.bincount(cell, minlength=cells) > 0


def enumerated(g: np.ndarray, first: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each set: hashes, the number of the set, and 0 or 1 for its own band or the next.

    Then, by set and band, how many of its signatures a linked set of that instance must share; -1 where it emits none.
    """
    size = np.diff(first)
    own = np.arange(len(size))
    need = np.full((len(size), 2), -1, np.int64)
    band = band_of(np.maximum(size, 1))
    up = (size > 0) & (size * 100 >= PERCENT * _BANDS[band + 1])  # can link to a set of the next band
    out, whose, extras = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for extra in (0, 1):
        sets = own[(up if extra else size > 0) & (differ(_BANDS[band + extra + 1] - 1) > 0)]
        if not len(sets):
            continue
        inst = band[sets] + extra
        n = partitions(inst, level)
        total = size[sets]
        most = reach(total, _BANDS[inst + 1] - 1)
        begin = np.cumsum(total) - total
        take = np.repeat(first[sets] - begin, total) + np.arange(int(total.sum()))
        h = W.mix(g[take] ^ np.repeat(W.mix(inst.astype(np.uint64) + np.uint64(1000 * level.n2)), total))
        place = (h % np.repeat(n, total).astype(np.uint64)).astype(np.int64)
        cells = n * level.n2
        offset = np.cumsum(cells) - cells
        if level.n2 > 1:
            place = place * level.n2 + ((h >> np.uint64(40)) % np.uint64(level.n2)).astype(np.int64)
        cell = place + np.repeat(offset, total)
        sums, filled = _sums(W.mix(h), cell, int(cells.sum()))
        label = W.mix(np.repeat(W.mix(inst.astype(np.uint64) * np.uint64(2) + np.uint64(level.n2)), cells) + (np.arange(len(sums)) - np.repeat(offset, cells)).astype(np.uint64))
        if level.n2 == 1:
            full = np.add.reduceat(filled.astype(np.int64), offset)
            need[sets, extra] = np.maximum(1, full - most)
            keep = filled | np.repeat(full <= most, cells)
            out.append(W.mix(sums + label)[keep])
            whose.append(np.repeat(sets, cells)[keep])
            extras.append(np.full(len(whose[-1]), extra))
            continue
        need[sets, extra] = 1
        marks = np.where(filled, W.mix(sums + label), np.uint64(0)).reshape(-1, level.n2)
        full, head, sig = filled.reshape(-1, level.n2), label.reshape(-1, level.n2)[:, 0], []
        part_of = np.repeat(sets, n)
        empty = np.zeros(len(full), bool)
        for chosen in combinations(range(level.n2), level.n2 - level.k2):
            some = full[:, chosen].any(axis=1)
            empty |= ~some
            sig.append((W.mix(marks[:, chosen].sum(axis=1, dtype=np.uint64) + head * np.uint64(sum(1 << c for c in chosen))), some))
        # A partition that matches only where both are empty is no use: a set with as many of those emits them too.
        spare = n - (most // (level.k2 + 1))
        weak = np.repeat(np.add.reduceat(empty.astype(np.int64), np.cumsum(n) - n) >= spare, n)
        for value, some in sig:
            keep = some | weak
            out.append(value[keep])
            whose.append(part_of[keep])
            extras.append(np.full(len(whose[-1]), extra))
    return np.concatenate(out), np.concatenate(whose), np.concatenate(extras), need


def signatures(g: np.ndarray, first: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    return enumerated(g, first, level)[:2]


def _batch(schema: pa.Schema, count: int, **given) -> pa.RecordBatch:
    """``count`` rows of ``schema``; columns that are not given are null."""
    of = lambda x, kind: x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([of(given[c.name], c.type) if c.name in given else pa.nulls(count, c.type) for c in schema], schema=schema)


def _by_bucket(sigs: np.ndarray, buckets: int, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, signature and, if given, node; the buckets and the other 48 bits in that order."""
    bucket, low = (sigs >> np.uint64(40)) % np.uint64(buckets), sigs & np.uint64((1 << 48) - 1)
    key = bucket << np.uint64(48) | low
    order = np.argsort(key) if node is None else np.lexsort((node, key))
    return order, bucket[order].astype(np.int32), low[order]


def _six(low: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6])


def _wide(six: bytes) -> np.ndarray:
    wide = np.zeros((len(six) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(len(keys[0]) + 1, bool)
    new[0] = new[-1] = True
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    return np.flatnonzero(new) if len(keys[0]) else np.zeros(1, np.int64)


def _blobs(schema: pa.Schema, bucket: np.ndarray, left: np.ndarray, right: np.ndarray, **given) -> Iterator[pa.RecordBatch]:
    """``left`` and ``right`` as one row a bucket, some at a time."""
    cuts = _runs(bucket)
    for i in range(0, len(cuts) - 1, 64):
        part = list(zip(cuts[i : i + 64], cuts[i + 1 : i + 65]))
        columns = {"kind": [_BLOB] * len(part), "bucket": bucket[[x for x, _ in part]], "x": [left[x:y].tobytes() for x, y in part], "y": [right[x:y].tobytes() for x, y in part]}
        yield _batch(schema, len(part), **columns, **{k: [v] * len(part) for k, v in given.items()})


def _support_scan(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per document (its set), and the signatures of each task's sets, packed by bucket, with what they share within a pack."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, flush, used, held, seen = TaskContext.get().partitionId(), 0, 0, [], set()

        def packed() -> Iterator[pa.RecordBatch]:
            sigs, own = (np.concatenate(x) for x in zip(*held))
            order, bucket, low = _by_bucket(sigs, buckets)
            own = own[order]
            cuts = _runs(bucket, low)
            several = np.diff(cuts) > 1
            times = np.bincount(own[np.repeat(several, np.diff(cuts))], minlength=1)
            who = np.flatnonzero(times)
            name = task << 22 | flush
            if len(who):
                yield _batch(SUPPORT_ROWS, 1, kind=[_LOCAL], bucket=[name % buckets], flush=[name], x=[who.astype(np.uint16).tobytes()], y=[times[who].astype(np.int32).tobytes()])
            at = cuts[:-1]
            yield from _blobs(SUPPORT_ROWS, bucket[at], _six(low[at]), np.where(several, _MARK, own[at]).astype(np.uint16), flush=name)

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for s in W.slices(texts, lower=True):
                g, first = shingle_sets(s)
                one, two = set_hashes(g, first)
                size = np.diff(first)
                fresh = []
                for j, sid in enumerate(one.tolist()):
                    if size[j] and sid not in seen:
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(sid)
                        fresh.append(j)
                numbers, need = np.full(len(size), -1, np.int64), np.full((len(size), 2), -1, np.int64)
                if fresh:
                    if used + len(fresh) >= _MARK >> 1:
                        if held:
                            yield from packed()
                        held, used, flush = [], 0, flush + 1
                    for i, j in enumerate(fresh):
                        numbers[j] = (task << 22 | flush) << 16 | (used + i) << 1
                    fresh = np.array(fresh)
                    sub = np.cumsum(np.concatenate(([0], size[fresh])))
                    pick = np.repeat(first[fresh] - sub[:-1], size[fresh]) + np.arange(int(sub[-1]))
                    sigs, own, extra, need[fresh] = enumerated(g[pick], sub, LEVELS[0])
                    if len(sigs):
                        held.append((sigs, (own + used) << 1 | extra))
                    used += len(fresh)
                yield _batch(
                    SUPPORT_ROWS, len(size), kind=np.full(len(size), _DOC, np.int32), doc_id=ids.take(pa.array(s.rows)), sum=[checksum(texts[i]) for i in s.rows],
                    n=size, sid=one.view(np.int64), s2=two.view(np.int64), g=numbers, need0=need[:, 0], need1=need[:, 1], bucket=(s.rows % buckets).astype(np.int32), flush=np.full(len(size), task << 22 | flush),
                )
                if sum(len(x) for x, _ in held) >= PACK:
                    yield from packed()
                    held, used, flush = [], 0, flush + 1
        if held:
            yield from packed()

    return text_batches(docs.select("doc_id", "text")).mapInArrow(parse, _ddl(SUPPORT_ROWS))


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary"}
    return ", ".join(f"{c.name} {names[str(c.type)]}" for c in schema)


def _support(rows: DataFrame) -> DataFrame:
    """Documents as they are, and how many of the signatures of each set others have, a row for each task's pack."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, found = [], None, _Sums(1)

        def shared() -> None:
            sigs = np.concatenate([_wide(x) for _, x, _ in held])
            own = np.concatenate([np.where((o := np.frombuffer(y, np.uint16).astype(np.int64)) == _MARK, -1, (flush << 16) + o) for flush, _, y in held])
            order = np.argsort(sigs)
            cuts = _runs(sigs[order])
            who = own[order][np.repeat(np.diff(cuts) > 1, np.diff(cuts))]
            who = who[who >= 0]
            found.add(np.ones(len(who), np.int64), who)

        def rows(sums) -> Iterator[pa.RecordBatch]:
            for n, g in sums:
                flush, own, n = g >> 16, (g & 0xFFFF).astype(np.uint16), n.astype(np.int32)
                cuts = _runs(flush)
                for i in range(0, len(cuts) - 1, 64):
                    part = list(zip(cuts[i : i + 64], cuts[i + 1 : i + 65]))
                    yield _batch(SUPPORT_ROWS, len(part), kind=[_COUNT] * len(part), flush=flush[[x for x, _ in part]], x=[own[x:y].tobytes() for x, y in part], y=[n[x:y].tobytes() for x, y in part])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == _DOC).any():
                yield batch.filter(pa.array(kind == _DOC))
            rest = batch.filter(pa.array(kind != _DOC))
            for what, at, flush, x, y in zip(*(rest.column(c).to_pylist() for c in ("kind", "bucket", "flush", "x", "y"))):
                if what == _LOCAL:
                    found.add(np.frombuffer(y, np.int32).astype(np.int64), (flush << 16) + np.frombuffer(x, np.uint16).astype(np.int64))
                    continue
                if at != bucket and held:
                    shared()
                    held = []
                bucket = at
                held.append((flush, x, y))
                if found.many():
                    yield from rows(found.out())
        if held:
            shared()
        yield from rows(found.out())

    return dealt.mapInArrow(meet, _ddl(SUPPORT_ROWS))


def _judged(rows: DataFrame) -> DataFrame:
    """The documents (doc_id, sum, n, sid, s2, g: null or the number of a set), and whether enough signatures of the set are shared."""
    dealt = rows.repartition("flush").sortWithinPartitions("flush", "kind")
    names = ["doc_id", "sum", "n", "sid", "s2", "g"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, held, shared = None, [], np.zeros(_MARK + 1, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for b in held:
                g = b.column("g").to_numpy()
                own = np.where(g < 0, 0, g & 0xFFFF)
                found = [(need > 0) & (shared[own | e] >= need) for e in (0, 1) for need in (b.column(f"need{e}").to_numpy(),)]
                columns = [b.column(c) for c in names[:-1]] + [pa.array(np.maximum(g, 0), pa.int64(), mask=g < 0), pa.array((found[0] | found[1]) & (g >= 0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "open"])

        for batch in batches:
            flushes = batch.column("flush").to_numpy()
            cuts = _runs(flushes)
            for x, y in zip(cuts, cuts[1:]):
                if flushes[x] != flush:
                    yield from out()
                    flush, held = flushes[x], []
                    shared[:] = 0
                part = batch.slice(x, y - x)
                kind = part.column("kind").to_numpy()
                if (kind == _DOC).any():
                    held.append(part.filter(pa.array(kind == _DOC)))
                for own, n in zip(*(part.filter(pa.array(kind == _COUNT)).column(c).to_pylist() for c in ("x", "y"))):
                    shared[np.frombuffer(own, np.uint16)] += np.frombuffer(n, np.int32)
        yield from out()

    return dealt.mapInArrow(judge, "doc_id long, sum int, n long, sid long, s2 long, g long, open boolean")


class _Sums:
    """Adds up numbers by one or two keys, a bounded number of entries at a time."""

    def __init__(self, keys: int):
        self.held: list[tuple] = []
        self.keys = keys

    def add(self, n: np.ndarray, *keys: np.ndarray) -> None:
        if len(n):
            self.held.append((n, *keys))

    def many(self) -> bool:
        return sum(len(x[0]) for x in self.held) >= PACK

    def out(self) -> Iterator[tuple]:
        if not self.held:
            return
        n, *keys = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        cuts = _runs(*keys)
        yield (np.add.reduceat(n[order], cuts[:-1]), *(k[cuts[:-1]] for k in keys))


def _join_scan(texts: DataFrame, buckets: int) -> DataFrame:
    """Signatures of the sets in ``texts`` (node, text), one entry each and pack; its owners there are edges already."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        edges = _Sums(2)

        def packed() -> Iterator[pa.RecordBatch]:
            sigs, node = (np.concatenate(x) for x in zip(*held))
            order, bucket, low = _by_bucket(sigs, buckets, node)
            node = node[order]
            cuts = _runs(bucket, low)
            _lead(cuts, node, edges)
            for n, a, b in edges.out():
                yield _batch(JOIN_ROWS, 1, kind=[_EDGE], bucket=[int(a[0] & 0x7FFFFFFF) % buckets], x=[a.tobytes()], y=[b.tobytes()], z=[n.tobytes()])
            yield from _blobs(JOIN_ROWS, bucket[cuts[:-1]], _six(low[cuts[:-1]]), node[cuts[:-1]])

        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for s in W.slices(batch.column("text").to_pylist(), lower=True):
                g, first = shingle_sets(s)
                sigs, own = signatures(g, first, LEVELS[1])
                if len(sigs):
                    held.append((sigs, nodes[s.rows][own]))
                if sum(len(x) for x, _ in held) >= PACK:
                    yield from packed()
                    held = []
        if held:
            yield from packed()

    return text_batches(texts.select("node", "text")).mapInArrow(parse, _ddl(JOIN_ROWS))


def _lead(cuts: np.ndarray, node: np.ndarray, edges: _Sums) -> None:
    """Adds the pairs of the first in each run with the others in it."""
    lengths = np.diff(cuts)
    lead = np.repeat(node[cuts[:-1]], lengths)
    ok = lead != node
    edges.add(np.ones(int(ok.sum()), np.int64), lead[ok], node[ok])


def _edges(rows: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: sets with the leaders of their signatures, and the number of signatures that lead them there."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, edges = [], None, _Sums(2)

        def lead() -> None:
            sigs, node = np.concatenate([_wide(x) for x, _ in held]), np.concatenate([np.frombuffer(y, np.int64) for _, y in held])
            order = np.lexsort((node, sigs))
            _lead(_runs(sigs[order]), node[order], edges)

        def rows() -> Iterator[pa.RecordBatch]:
            for n, a, b in edges.out():
                yield _batch(schema, len(a), a=a, b=b, n=n)

        for batch in batches:
            for kind, at, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "x", "y", "z"))):
                if kind == _EDGE:
                    edges.add(*(np.frombuffer(v, np.int64) for v in (z, x, y)))
                else:
                    if at != bucket and held:
                        lead()
                        held = []
                    bucket = at
                    held.append((x, y))
                if edges.many():
                    yield from rows()
        if held:
            lead()
        yield from rows()

    return dealt.mapInArrow(meet, _ddl(schema)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of ``sets`` have in common: products of matrices of 0 and 1."""
    both = np.zeros((len(sets), len(sets)), np.float32)  # exact: no count comes near 2^24
    if len(sets) == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return both
    every, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, own = every[order], own[order]
    cuts = _runs(every)
    several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    column = np.cumsum(np.concatenate(([False], every[several][1:] != every[several][:-1]))) if several.any() else np.zeros(0, np.int64)
    own = own[several]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, (start, start + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[own[x:y], column[x:y] - start] = 1
        both += has @ has.T
    return both


def links_of(nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of ``sets`` that link, as nodes."""
    size, both = np.array([len(s) for s in sets], np.int64), overlaps(sets)
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu(100 * both.astype(np.int64) >= percent * union.astype(np.int64), 1))
    return nodes[i], nodes[j]


def _texts(docs: DataFrame, side: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the columns of the stored ``side`` (_id, sum, ...), where document and checksum are equal."""
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) - F.lit(1 << 31) == F.col("sum"))
    return docs.select("doc_id", "text").join(sized_broadcast(side, BROADCAST_BYTES), on)


def _linked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (a, b) that make the components within each group of ``wanted`` (node, _id, sum, and its group: k, lane, x, y)."""
    group = ["k", "lane", "x", "y"]
    jobs = stored(wanted.groupBy("node", "_id", "sum").agg(F.collect_list(F.struct(*group)).alias("jobs")), "jobs")
    sent = _texts(docs, jobs).select("node", "text", F.explode("jobs").alias("job")).select("job.*", "node", "text")
    sent = sent.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = contracted(*links_of(np.array(list(held), np.int64), list(held.values())))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys, nodes = list(zip(*(batch.column(c).to_pylist() for c in group))), batch.column("node").to_pylist()
            for s in W.slices(batch.column("text").to_pylist(), lower=True):
                g, first = shingle_sets(s)
                for j, i in enumerate(s.rows):
                    if keys[i] != key:
                        yield from found()
                        key, held = keys[i], {}
                    held[nodes[i]] = g[first[j] : first[j + 1]].copy()
        yield from found()

    return text_batches(sent).mapInArrow(compare, "a long, b long")


def _buckets(spark) -> int:
    return min(1 << 16, 8 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _supported(docs: DataFrame) -> DataFrame:
    """doc_id, sum, n, sid, s2, g and ``open`` of every document; a set is open that shares as many signatures as a link takes."""
    buckets = _buckets(docs.sparkSession)
    return stored(_judged(_support(_support_scan(docs, buckets))), "support")


def _sets(rows: DataFrame) -> DataFrame:
    """Each different set: sid, s2, ``node`` (its number), n, one of its documents, its least id, and whether it may have a link."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sum")).alias("one")
    return rows.where("n > 0").groupBy("sid", "s2").agg(F.min("g").alias("node"), F.max("n").alias("n"), one, F.bool_or("open").alias("open"))


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (node, _id, sum, n, crowd, large), each with the groups (k, lane, x, y) of its crowd in which it is compared."""
    place = ["node", "_id", "sum"]
    small = members.where("NOT large").select(*place, F.col("crowd").alias("k"), *(F.lit(0).alias(c) for c in ("lane", "x", "y")))
    # Linked sets differ in size by a third at most, so they lie in one band or in two that adjoin.
    large = members.where("large").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int"))
    parts = large.groupBy("crowd", "band").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / LOAD)).cast("int").alias("parts"))
    parts = stored(parts, "block-counts")
    of = lambda shift, name: parts.select(F.col("crowd").alias("_c"), (F.col("band") - shift).alias("_b"), F.col("parts").alias(name))
    for shift, name in ((0, "here"), (1, "above"), (-1, "below")):
        large = large.join(of(shift, name), (F.col("crowd") == F.col("_c")) & (F.col("band") == F.col("_b")), "left").drop("_c", "_b")
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("here")).cast("int"))

    def each(n: str, lane: Column, x, y) -> Column:
        meets = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda q: F.struct(lane.cast("int").alias("lane"), x(q).alias("x"), y(q).alias("y")))
        return F.when(F.col(n) > 0, meets).otherwise(F.array().cast("array<struct<lane:int,x:int,y:int>>"))

    own, band = F.col("own"), F.col("band")
    meets = F.concat(
        each("here", band * 2, lambda q: F.least(own, q), lambda q: F.greatest(own, q)),
        each("above", band * 2 + 1, lambda q: own, lambda q: q),
        each("below", band * 2 - 1, lambda q: q, lambda q: own),
    )
    dealt = large.select(*place, F.col("crowd").alias("k"), F.explode(meets).alias("m")).select(*place, "k", "m.*")
    return small.unionByName(dealt)


def _crowds(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``sets`` (node, _id, sum, n, crowd) that have others in their crowd and under their root; ``crowd`` becomes the least of those."""
    joined = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "_node")
    placed = sets.join(joined, F.col("node") == F.col("_node")).withColumnRenamed("crowd", "_old").select("node", "_id", "sum", "n", "_old", "root")
    count = [F.count("*").alias("_m"), F.min("node").alias("crowd"), ((F.count("*") > GROUP) | (F.sum("n") > LOAD)).alias("large")]
    sizes = placed.groupBy(F.col("_old").alias("_o"), F.col("root").alias("_r")).agg(*count).where("_m > 1")
    return placed.join(sizes, (F.col("_old") == F.col("_o")) & (F.col("root") == F.col("_r"))).select("node", "_id", "sum", "n", "crowd", "large")


def _rare(texts: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of ``texts`` (node, n, text) that share one of their rare shingles.

    Linked sets share three in four of their shingles, so of those that occur least, in one order for all, the first
    quarter and one more of each have one in common. Passages that a great many texts have are hardly ever among them.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            for s in W.slices(batch.column("text").to_pylist(), lower=True):
                g, first = shingle_sets(s)
                at = np.repeat(s.rows, np.diff(first))
                for i in range(0, len(g), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at[part]]), pa.array(n[at[part]]), pa.array(g[part].view(np.int64))], names=["node", "n", "t"])

    each = stored(text_batches(texts.select("node", "n", "text")).mapInArrow(parse, "node long, n long, t long"), "shingles")
    often = each.groupBy(F.col("t").alias("_t")).agg(F.count("*").alias("often"), F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q")
    shared = each.join(often, F.col("t") == F.col("_t")).select("node", "n", "t", "often")
    own = Window.partitionBy("node")
    placed = shared.withColumn("place", F.dense_rank().over(own.orderBy("often", "t"))).withColumn("alike", F.max("place").over(own))
    # The shingles that no other set has come first of all.
    rare = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.col("alike")))
    rare = stored(rare.select("node", "t"), "rare-shingles")
    lead = rare.groupBy(F.col("t").alias("_t")).agg(F.min("node").alias("a"))
    return rare.join(lead, F.col("t") == F.col("_t")).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _with_leaders(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Each of ``members`` and the leader it shares most signatures with, in one group; a leader of many is in several."""
    best = edges.join(members.select(F.col("node").alias("b")), "b").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("minus"))).alias("m")).select("b", (-F.col("m.minus")).alias("a"))
    best = stored(best, "best-leaders")
    places = best.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("places"))
    follow = best.join(places, F.col("a") == F.col("_a")).select(F.col("b").alias("node"), F.col("a").alias("k"), F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("x"))
    lead = places.select(F.col("_a").alias("node"), F.col("_a").alias("k"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("x"))
    groups = follow.unionByName(lead).select("node", "k", F.lit(0).alias("lane"), "x", F.lit(0).alias("y"))
    return groups.join(members.select("node", "_id", "sum"), "node")


def classes_of_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the documents (doc_id, sum, n, sid, s2), the different sets, and ``node`` and ``root`` of the sets with links."""
    rows = _supported(docs)
    sets = stored(_sets(rows), "sets")
    open_ = stored(sets.where("open").select("node", F.col("one.doc_id").alias("_id"), F.col("one.sum").alias("sum"), "n"), "open-sets")
    edges = stored(_edges(_join_scan(_texts(docs, open_), _buckets(docs.sparkSession))), "leaders")
    members = stored(_crowds(open_.withColumn("crowd", F.lit(0)), components(edges)), "crowds")
    large = members.where("large")
    links = None
    if large.head(1):
        finer = stored(_crowds(large.drop("large"), components(_rare(_texts(docs, stored(large.drop("large"), "large-crowds"))))), "finer-crowds")
        members, large = members.where("NOT large").unionByName(finer.where("NOT large")), finer.where("large")
        links = stored(_linked(docs, _with_leaders(large, edges)), "links-of-leaders")
        roots = components(links)
        placed = large.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node"))
        apart = placed.groupBy(F.col("crowd").alias("_crowd")).agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("_crowd")
        members = members.unionByName(large.join(apart, F.col("crowd") == F.col("_crowd"), "left_semi"))
    found = _linked(docs, _blocks(members))
    links = found if links is None else links.unionByName(found)
    return rows.select("doc_id", "sum", "n", "sid", "s2"), sets, components(links)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, sum, n_shingles and component_id of every row of ``docs``."""
    rows, sets, roots = classes_of_sets(docs.select("doc_id", "text"))
    placed = sets.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("sid", "s2", F.coalesce("root", "node").alias("root"), F.col("one.doc_id").alias("least"))
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    answers = stored(placed.join(least, F.col("root") == F.col("_root")).select(F.col("sid").alias("_sid"), F.col("s2").alias("_s2"), "component_id"), "components")
    linked = rows.where("n > 0").join(sized_broadcast(answers, BROADCAST_BYTES), (F.col("sid") == F.col("_sid")) & (F.col("s2") == F.col("_s2")))
    out = linked.unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")), allowMissingColumns=True)
    return out.select("doc_id", "sum", F.col("n").alias("n_shingles"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``found`` (what ``classes`` returned): that of the smallest id, of equal
    ids that of the least checksum.

    A row without an id stays. Of rows that repeat id and text one stays, the least of their other columns. Other columns
    may have any names.
    """
    found = stored(found.where("doc_id IS NOT NULL"), "classes")
    first = found.where("doc_id = component_id").groupBy(F.col("component_id").alias("_c")).agg(F.min("sum").alias("_s"))
    gone = found.join(first, F.col("component_id") == F.col("_c")).where("doc_id <> component_id OR sum <> _s").select(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum")).distinct()
    gone = stored(gone, "gone")
    packed = docs.select(F.struct(*docs.columns).alias("_row"))
    check = F.crc32(F.encode(F.coalesce("_row.text", F.lit("")), "UTF-8")) - F.lit(1 << 31)
    of = lambda rows, side, how: rows.join(sized_broadcast(side, BROADCAST_BYTES), (F.col("_row.doc_id") == F.col("_id")) & (check == F.col("_sum")), how)
    kept = of(packed, gone, "left_anti")
    again = stored(found.groupBy(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum")).agg(F.count("*").alias("n")).where("n > 1").drop("n").join(gone, ["_id", "_sum"], "left_anti"), "repeated")
    if again.head(1):
        rest = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        least = F.min(F.struct(F.struct(*rest) if rest else F.lit(0), "_row")).alias("_least")
        once = of(packed, again, "left_semi").groupBy("_row.doc_id", "_row.text").agg(least).select("_least._row")
        kept = of(kept, again, "left_anti").unionByName(once)
    return kept.select("_row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of linked sets (``one_of_each``)."""
    return one_of_each(docs, classes(docs))
