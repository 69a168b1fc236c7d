"""Substring dedup: every window of words that starts elsewhere too, found through an index of phrases.

A window is ``WINDOW`` consecutive words; every word that a window covers whose words also start anywhere else, in the
same document or another, is a duplicate.

The method dealt out was relative Lempel-Ziv parsing of each document against every block of reference text. That meets
every text with every block, so its work grows with the square of the corpus; the README has the figures. It is replaced
here: the reference is not cut into blocks of text but into phrases between anchors that the words themselves choose, so
that a document meets only the entries that can match. What is left of the method is that runs of known phrases are
longest factors of a document, and that their ends are checked window by window.

1. Phrases. The least hash among the ``ANCHOR``-word runs of a window is its anchor. Consecutive windows with one anchor
   form a phrase. Equal windows choose equal anchors, so a window can occur elsewhere only in a phrase with an equal
   anchor, and no window is missed.
2. Index. The phrases are counted by anchor, partly before anything moves; phrases of anchors that occur once are done.
   The join back to the phrases has a table on either side, so that Spark can split the rows of a hot anchor.
3. Factors. Phrases that the index has twice or more are duplicates as a whole, and so is every run of them.
4. Ends of factors. Where an anchor is shared but the phrases around it differ, a factor ends inside a phrase. One
   occurrence of each such phrase gives its single windows, which are counted by 128-bit hashes; those that occur
   elsewhere make the factor reach up to the last word that is shared.

What is joined to the texts is the list of spans by document, broadcast only if its stored size is at most
``BROADCAST_BYTES`` and shuffled with the texts otherwise.

Defined results: null and empty texts have no words, nothing is removed and kept_sha256 is that of no bytes; documents
shorter than a window stay whole; rows with equal ids are told apart by a checksum of the text, and equal rows are each
other's duplicates; other columns pass through ``dedup``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.storage import BROADCAST_BYTES, sized_broadcast, stored, text_batches

WINDOW = 35
ANCHOR = 8
_BITS = 6  # of a packed span: first window << _BITS | number of windows
PHRASE = "a long, c long, doc_id long, sum int, p long"
WINDOWS = "w1 long, w2 long, doc_id long, sum int, p long, weight int"


def checksum(text: str | None) -> int:
    return zlib.crc32((text or "").encode()) - (1 << 31)


def _phrases(s: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and phrase hash, text, first window within the text, and number of windows, of each phrase."""
    none = np.zeros(0, np.int64)
    if len(s.h) < WINDOW:
        return none, none, none, none, none
    one, two = W.two_hashes(s.h)
    n = len(s.h)
    at = np.arange(n - ANCHOR + 1)
    g = one.runs(at, at + ANCHOR)
    least = W.least_in(g, WINDOW - ANCHOR + 1)
    ok = s.left()[: len(least)] >= WINDOW
    text = s.text_of
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, none, none
    new = np.concatenate(([True], (least[starts[1:]] != least[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)))
    begin = np.flatnonzero(new)
    first = starts[begin]
    count = np.diff(np.concatenate((begin, [len(starts)])))
    anchor = least[first]
    phrase = two.runs(first, first + count - 1 + WINDOW) ^ W.mix((anchor - first).astype(np.uint64))
    j = text[first]
    return g[anchor].view(np.int64), phrase.view(np.int64), j, first - s.first[j], count


def phrases(docs: DataFrame) -> DataFrame:
    """Every phrase of every document: anchor hash, phrase hash, document and packed span."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, base = batch.column("text").to_pylist(), batch.column("doc_id"), 0
            for s in W.slices(texts):
                a, c, j, first, count = _phrases(s)
                rows = s.rows[j] if len(j) else np.zeros(0, np.int64)
                sums = np.array([checksum(texts[i]) for i in s.rows], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c), ids.take(pa.array(rows)), pa.array(sums[j] if len(j) else np.zeros(0, np.int32)), pa.array(first << _BITS | count)],
                    names=["a", "c", "doc_id", "sum", "p"],
                )

    return text_batches(docs.select("doc_id", "text")).mapInArrow(parse, PHRASE)


def boundary_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The single windows of the phrases that ``wanted`` (doc_id, sum, cells) names."""
    met = _with_spans(docs.select("doc_id", "text"), wanted, "inner")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, cells = batch.column("text").to_pylist(), batch.column("doc_id"), batch.column("cells")
            for s in W.slices(texts):
                one, two = W.two_hashes(s.h)
                for j, row in enumerate(s.rows):
                    if checksum(texts[row]) != batch.column("sum")[int(row)].as_py():
                        continue
                    packed = np.array([x for c in cells[int(row)].as_py() for x in (c["p"], c["weight"])], np.int64).reshape(-1, 2)
                    count = packed[:, 0] & (1 << _BITS) - 1
                    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    pos = np.repeat(packed[:, 0] >> _BITS, count) + within
                    at = pos + s.first[j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.runs(at, at + WINDOW).view(np.int64)), pa.array(two.runs(at, at + WINDOW).view(np.int64)), ids.take(pa.array(np.full(len(at), row))),
                         pa.array(np.full(len(at), checksum(texts[row]), np.int32)), pa.array(pos << _BITS | 1), pa.array(np.repeat(packed[:, 1], count).astype(np.int32))],
                        names=["w1", "w2", "doc_id", "sum", "p", "weight"],
                    )

    return text_batches(met).mapInArrow(of, WINDOWS)


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``sum`` and the other columns of ``spans``, which is stored."""
    side = sized_broadcast(spans.withColumnRenamed("doc_id", "_id"), BROADCAST_BYTES)
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) - F.lit(1 << 31) == F.col("sum"))
    return docs.join(side, on, how).drop("_id")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, sum, ``spans``: packed runs of windows that also start elsewhere, one row per document that has any."""
    index = stored(phrases(docs), "phrases")
    shared = index.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1").select("a", (F.col("c0") == F.col("c1")).alias("same"))
    shared = stored(shared, "shared-anchors")  # as a table, so that the rows of a hot anchor can be split in the join
    met = stored(index.join(shared, "a"), "shared-phrases")
    mixed = met.where("NOT same").groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sum", "p")).alias("one"))
    mixed = stored(mixed, "boundary-phrases")
    again = met.where("NOT same").join(mixed.where("n > 1").select("a", "c"), ["a", "c"])
    factors = met.where("same").select("doc_id", "sum", "p").unionByName(again.select("doc_id", "sum", "p"))
    wanted = mixed.groupBy("one.doc_id", "one.sum").agg(F.collect_list(F.struct("one.p", F.least("n", F.lit(2)).cast("int").alias("weight"))).alias("cells"))
    windows = stored(boundary_windows(docs, stored(wanted, "wanted")), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2")
    edges = windows.where("weight = 1").join(twice, ["w1", "w2"]).select("doc_id", "sum", "p")
    return stored(factors.unionByName(edges).groupBy("doc_id", "sum").agg(F.collect_list("p").alias("spans")), "spans")


def covered(n: int, spans: list[int] | None) -> np.ndarray:
    """Which of ``n`` words the packed spans cover."""
    step = np.zeros(n + 1, np.int64)
    if spans:
        packed = np.array(spans, np.int64)
        first, count = packed >> _BITS, packed & (1 << _BITS) - 1
        np.add.at(step, first, 1)
        np.add.at(step, first + count - 1 + WINDOW, -1)
    return np.cumsum(step[:n]) > 0


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    slim = docs.select("doc_id", "text")
    joined = _with_spans(slim, duplicate_spans(slim), "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, out = batch.column("spans"), []
            for i, text in enumerate(batch.column("text")):
                found = (text.as_py() or "").encode().split()
                gone = covered(len(found), spans[i].as_py())
                kept = b" ".join(compress(found, ~gone) if gone.any() else found)
                out.append((len(found), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            n, removed, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return text_batches(joined).mapInArrow(of, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the duplicate words taken out of ``text``; texts that lose none stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = text_batches(docs).select("doc_id", "text", F.struct(F.lit(0), *rest).alias("_rest"))
    joined = _with_spans(packed, duplicate_spans(docs.select("doc_id", "text")), "left")

    @F.pandas_udf("string")
    def kept(text, spans):
        import pandas as pd

        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            found = t.encode().split()
            return b" ".join(compress(found, ~covered(len(found), list(s)))).decode()

        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    return joined.withColumn("text", kept("text", "spans")).select(*(c if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in docs.columns))
