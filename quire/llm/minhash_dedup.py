"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds its distinct shingles of five words, each as one 64-bit hash; its sketch is the ``K`` least of those
hashes, or all of a smaller set. Two sets link when their Jaccard similarity is at least ``PERCENT``. The ``K`` least hashes
of their union are a sample of it without replacement, and all that the two sets share among those is in both sketches.

1. Sketches. One row per document, and then one per different set.
2. Inverted lists. Each retained value lists the sets that have it. Linked sets have at least ``need`` retained values in
   common, so they meet in a list even if each is listed only under its rarest ``K - need + 1`` values, in one order for
   all. Values of passages that many texts share are hardly ever among those.
3. Overlaps. Lists of at most ``LIST`` sets give their pairs; a pair stays if the sketch of its union, the ``K`` least of
   both, has ``need`` values or more from either set. Longer lists give no pairs: their least set leads them.
4. Crowds. What the pairs and leaders join is compared: crowds of at most ``GROUP`` sets at once; in larger ones each set
   first with its leader, which joins groups of near copies, and then what is still apart in blocks. In a comparison,
   sketches tell which sets can link at all, and the links are confirmed on the whole sets of the texts.

``need`` is exact for sets whose partners' sketches hold all of them (up to 55 shingles). For larger sets it is ``NEED``:
the values shared among the ``K`` = 64 of a union are at least as many but in 1e-11 of pairs at the limit of 85 %, and far
less often in closer ones (the tail of a binomial of 64 draws at 0.85, which sampling without replacement stays below).

Step 4 is quadratic in what is left of a crowd that has several components; nothing is dropped there.

Defined results: null and empty texts, and texts without words, have no shingles and are components of their own; texts of
fewer than five words have one shingle, the whole; equal sets link; a null id reaches the ids of its component, a component
without ids has a null id, and rows without ids are kept; rows with equal ids are told apart by a checksum of the text;
columns beside doc_id and text take no part, and pass through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import jaccard_join as J
from quire.llm import words as W
from quire.llm.components import components, contracted
from quire.llm.storage import BROADCAST_BYTES, sized_broadcast, stored, text_batches
from quire.llm.substring_dedup import checksum

PERCENT = 85
K = 64
NEED = 32
#: Sets of a list that still gives its pairs.
LIST = 16


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, sum, n (size of the set), sid and s2 (the set) of each document; its sketch with the first document of a set in a task."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for s in W.slices(texts, lower=True):
                g, first = J.shingle_sets(s)
                one, two = J.set_hashes(g, first)
                size, out = np.diff(first), []
                for j, sid in enumerate(one.tolist()):
                    out.append(None if not size[j] or sid in seen else g[first[j] : min(first[j] + K, first[j + 1])].tobytes())
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(sid)
                sums = [checksum(texts[i]) for i in s.rows]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(s.rows)), pa.array(sums, pa.int32()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(out, pa.binary())],
                    names=["doc_id", "sum", "n", "sid", "s2", "sketch"],
                )

    return text_batches(docs).mapInArrow(sketch, "doc_id long, sum int, n long, sid long, s2 long, sketch binary")


def _sets(rows: DataFrame) -> DataFrame:
    """Each different set: sid, s2, n, sketch, one of its documents, its least id, and a number, which holds once the rows are stored."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sum")).alias("one")
    sets = rows.where("n > 0").groupBy("sid", "s2").agg(F.max("n").alias("n"), one, F.min("sketch").alias("sketch"))
    return stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets", few=True)


def needed(n: Column) -> Column:
    """Retained values that a set of ``n`` shingles has in common with each one it is linked to."""
    return F.when(n * 100 < PERCENT * (K + 1), F.ceil(n * PERCENT / 100)).otherwise(NEED)


def _rare(sets: DataFrame) -> DataFrame:
    """node and v: each set under those of its rarest retained values that a linked one must share one of."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("sketch").to_pylist()
            times = [len(x) // 8 for x in held]
            columns = [np.repeat(b.column(c).to_numpy(), times) for c in ("node", "n")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.frombuffer(b"".join(held), np.int64))], names=["node", "n", "v"])

    each = stored(sets.select("node", "n", "sketch").mapInArrow(entries, "node long, n long, v long"), "retained")
    often = each.groupBy(F.col("v").alias("_v")).agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, F.col("v") == F.col("_v")).select("node", "n", "v", "often")
    own = Window.partitionBy("node")
    placed = shared.withColumn("place", F.row_number().over(own.orderBy("often", "v"))).withColumn("alike", F.count("*").over(own))
    held = F.least("n", F.lit(K))
    # Values that no other set has come first of all.
    return stored(placed.where(F.col("place") <= held - needed(F.col("n")) + 1 - (held - F.col("alike"))).select("node", "v"), "rare-retained", few=True)


def common(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sketches, how many of the ``K`` least of both are in both, and how many those least are."""
    values = np.frombuffer(b"".join(a) + b"".join(b), np.uint64)
    pair = np.concatenate([np.repeat(np.arange(len(x)), [len(s) // 8 for s in x]) for x in (a, b)])
    order = np.lexsort((values, pair))
    values, pair = values[order], pair[order]
    again = np.concatenate(([False], (values[1:] == values[:-1]) & (pair[1:] == pair[:-1])))
    new = np.cumsum(~again)
    rank = new - new[np.searchsorted(pair, np.arange(len(a)))][pair]
    count = lambda which: np.bincount(pair[which & (rank < K)], minlength=len(a))
    return count(again), count(~again)


def _overlapping(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (a, b, n) of sets that meet in one of the short ``lists`` (v, node), whose union's sketch has n values of both, which is enough."""
    members = lists.groupBy("v").agg(F.array_sort(F.collect_list("node")).alias("who"))
    pairs = members.select(F.explode(F.flatten(F.transform("who", lambda a, i: F.transform(F.slice("who", i + 2, LIST), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    pairs = pairs.select("p.a", "p.b").distinct()
    of = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, union = common(b.column("sa").to_pylist(), b.column("sb").to_pylist())
            largest = np.maximum(b.column("na").to_numpy(), b.column("nb").to_numpy())
            ok = np.where(largest <= K, 100 * both >= PERCENT * union, both >= NEED)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both)], names=["a", "b", "n"]).filter(pa.array(ok))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(judge, "a long, b long, n long")


def _edges(sets: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: pairs that overlap enough, and the sets of long lists with their leaders."""
    rare = _rare(sets)
    lists = stored(rare.groupBy(F.col("v").alias("_v")).agg(F.count("*").alias("many"), F.min("node").alias("lead")).where("many > 1"), "lists", few=True)
    listed = rare.join(lists, F.col("v") == F.col("_v"))
    led = listed.where((F.col("many") > LIST) & (F.col("node") != F.col("lead"))).groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    return stored(_overlapping(sets, listed.where(F.col("many") <= LIST).select("v", "node")).unionByName(led), "overlaps", few=True)


def links_of(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``sets`` that link: those whose sketches overlap enough for it, confirmed on the whole sets."""
    size = np.array([len(s) for s in sets], np.int64)
    need = np.where(size * 100 < PERCENT * (K + 1), -(-size * PERCENT // 100), NEED)
    able = J.overlaps([s[:K] for s in sets]) >= np.maximum(need[:, None], need[None, :])
    np.fill_diagonal(able, False)
    some = np.flatnonzero(able.any(axis=1))
    if len(some) < 2:
        return nodes[:0], nodes[:0]
    return J.links_of(nodes[some], [sets[i] for i in some], PERCENT)


def _confirmed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (a, b) that make the components within each group of ``wanted`` (node, _id, sum, and its group: k, lane, x, y)."""
    group = ["k", "lane", "x", "y"]
    jobs = stored(wanted.groupBy("node", "_id", "sum").agg(F.collect_list(F.struct(*group)).alias("jobs")), "jobs", few=True)
    sent = J._texts(docs, jobs).select("node", "text", F.explode("jobs").alias("job")).select("job.*", "node", "text")
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
                g, first = J.shingle_sets(s)
                for j, i in enumerate(s.rows):
                    if keys[i] != key:
                        yield from found()
                        key, held = keys[i], {}
                    held[nodes[i]] = g[first[j] : first[j + 1]].copy()
        yield from found()

    return text_batches(sent).mapInArrow(compare, "a long, b long")


def _roots(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the sets that have links."""
    edges = _edges(sets)
    places = sets.select("node", F.col("one.doc_id").alias("_id"), F.col("one.sum").alias("sum"), "n", F.lit(0).alias("crowd"))
    members = stored(J._crowds(places, components(edges)), "crowds", few=True)
    large = members.where("large")
    if not large.head(1):
        return components(_confirmed(docs, J._blocks(members)))
    led = stored(_confirmed(docs, J._with_leaders(large, edges)), "links-of-leaders", few=True)
    placed = large.join(components(led).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy(F.col("crowd").alias("_crowd")).agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("_crowd")
    rest = members.where("NOT large").unionByName(large.join(apart, F.col("crowd") == F.col("_crowd"), "left_semi"))
    return components(led.unionByName(_confirmed(docs, J._blocks(rest))))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, sum, n_shingles and component_id of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = stored(_sketched(docs), "sketches")
    sets = _sets(rows)
    placed = sets.join(_roots(docs, sets).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("sid", "s2", F.coalesce("root", "node").alias("root"), F.col("one.doc_id").alias("least"))
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    answers = stored(placed.join(least, F.col("root") == F.col("_root")).select(F.col("sid").alias("_sid"), F.col("s2").alias("_s2"), "component_id"), "components", few=True)
    rows = rows.drop("sketch")
    linked = rows.where("n > 0").join(sized_broadcast(answers, BROADCAST_BYTES), (F.col("sid") == F.col("_sid")) & (F.col("s2") == F.col("_s2")))
    out = linked.unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")), allowMissingColumns=True)
    return out.select("doc_id", "sum", F.col("n").alias("n_shingles"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, and whether the document is the one that stays of its component."""
    return classes(docs).select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, as ``jaccard_join.keep_one`` chooses it."""
    return J.one_of_each(docs, classes(docs))
