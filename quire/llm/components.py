"""Connected components of a table of links, without collecting any: alternating large-star and small-star rounds.

A round deals the links out by node and sorts them, so that a node's least neighbour comes first and its other links
stream by: a hub of any number of links takes no more memory than another node. Each task replaces the links it sends
on, a bounded number at a time, by the stars of their components, so a round leaves at most a link a node and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import stored

#: Links that a task contracts at a time.
CHUNK = 1 << 18
LINKS = "u long, v long"
#: Stands for a link in rounds that are not the last.
_OPEN = -1


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: every node but the least of its component, and that least one."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


class _Chunks:
    """Links on their way out, contracted ``CHUNK`` at a time."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((u, v))
        if sum(len(x) for x, _ in self.held) >= CHUNK:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield _rows(*contracted(*(np.concatenate(x) for x in zip(*self.held))))
            self.held = []


def _rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = _Chunks()
    for b in batches:
        yield from chunks.add(b.column(0).to_numpy(), b.column(1).to_numpy())
    yield from chunks.out()


def _star(large: bool):
    """Over links sorted by (u, v): links u's larger neighbours, or with ``large=False`` all, to the least of u and its neighbours.

    A node with a smaller neighbour and another one besides shows that the links are not stars yet; then a row of
    ``_OPEN`` comes along.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, node, least, last, is_open = _Chunks(), None, None, None, False
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            is_open |= bool((u == _OPEN).any())
            u, v = u[u != _OPEN], v[u != _OPEN]
            if not len(u):
                continue
            first = np.concatenate(([True], u[1:] != u[:-1]))
            again = np.concatenate(([False], (u[1:] == u[:-1]) & (v[1:] == v[:-1])))
            starts = np.flatnonzero(first)
            m = np.minimum(u[starts], v[starts])
            if u[0] == node:
                m[0], first[0], again[0] = least, False, v[0] == last
            m = np.repeat(m, np.diff(np.concatenate((starts, [len(u)]))))
            node, least, last = u[-1], m[-1], v[-1]
            if large:
                is_open |= bool((~first & ~again & (m < u)).any())
                who = ~again & (v > u)
            else:
                who = ~again & (v != m)
                yield from chunks.add(u[first], m[first])
            yield from chunks.add(v[who], m[who])
        yield from chunks.out()
        if is_open:
            yield _rows(np.array([_OPEN]), np.array([_OPEN]))

    return step


def _dealt(edges: DataFrame) -> DataFrame:
    return edges.repartition("u").sortWithinPartitions("u", "v")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links`` (a, b; 0 or more) but the roots."""
    edges = stored(links.select("a", "b").where("a <> b").mapInArrow(_contract, LINKS), "edges", few=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _dealt(both).mapInArrow(_star(True), LINKS)
        after = stored(_dealt(large).mapInArrow(_star(False), LINKS), "edges", few=True)
        least = after.agg(F.min("u")).first()[0]
        if least is None or least != _OPEN:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
        edges = after.where(F.col("u") != _OPEN)
