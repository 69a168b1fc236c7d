"""Merkle manifest of a dataset, with a proof and a fold for every row.

H is the lower-case hex SHA-256 of its inputs, one after the other; digests go in as hex text. A row's leaf is H of its
columns, each with its length. The rows of a source, by id, are the leaves of a tree: every ``ARITY`` neighbours become
their H, until one node is left, the source's subroot; the subroots, by source, make the root in the same way.

1. Leaves are hashed inside the plan. Their places come from a partitioning by ranges of (source, id), so a source of any
   size is dealt to many tasks: a task numbers what it has, and running sums over the tasks' counts do the rest.
2. Large blocks. ``levels`` levels of a tree at a time are built where a block's ``ARITY ** levels`` neighbours meet; a
   block is one row, with its nodes as bytes. The blocks' roots are again nodes of the tree, and are built upon in the same
   way while more than ``top`` are left; where that is because there are many sources, their subroots become the leaves of
   one tree.
3. Upper tree. At most ``top`` nodes reach the driver, which builds what is above them and broadcasts each one's path to
   the root: at most 5 levels of 15 digests of 32 bytes, so 10 MB for 4,096.
4. Executors finish: every row's siblings within its block, then those of the block's path, are its proof, and folding a
   leaf with them gives a root.

Defined results: a null source is a source of its own and comes first; null ids come first; rows with equal ids are ordered
by leaf, and equal rows are so many equal leaves; an empty table has no row (``manifest``: none, no root); texts of any
length are hashed by one expression; columns beside ``COLUMNS`` take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.native import ascii_lower
from quire.llm.storage import sized_broadcast, stored, text_batches

ARITY = 16
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
HEX = 64
#: Siblings before and after a node in its run, as hex text.
Step = tuple[bytes, bytes]


@dataclass(frozen=True)
class Shape:
    """Levels that are built in one task, and most nodes that the driver builds upon."""

    levels: int = 3
    top: int = 4096

    @property
    def block(self) -> int:
        return ARITY**self.levels


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(*columns: Column) -> Column:
    """H of the columns: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def leaves(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """id, tree (the source), node (the leaf), forged (the leaf of the row with ``forged`` as its text, where that is not null)."""
    of = lambda text: leaf(*(F.col(c) for c in COLUMNS[:-1]), text)
    other = F.lit(None).cast("binary") if forged is None else F.when(forged.isNotNull(), of(forged))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("tree"), of(F.col("text")).alias("node"), other.alias("forged"))


def tampered(docs: DataFrame) -> Column:
    """The text in lower case for a fifth of the ids, else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, ascii_lower(F.col("text")))


def _placed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, id, node, forged) with ``pos``, the place by id and node within the tree, and ``total``, the tree's nodes."""
    # Equal rows are told apart by a number, so that a range can end between them; it is stored, and so stays what it is.
    nodes = stored(nodes.withColumn("seq", F.monotonically_increasing_id()), "nodes")
    order = ["tree", "id", "node", "seq"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), ..., 0
        for b in batches:
            local = []
            for tree in b.column("tree").to_pylist():
                n, last = (n + 1 if tree == last else 0), tree
                local.append(n)
            columns = [b.column(c) for c in ("tree", "id", "node", "forged")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(b), pa.int32()), pa.array(local, pa.int64())], names=["tree", "id", "node", "forged", "part", "local"])

    kind = nodes.schema["id"].dataType.simpleString()
    dealt = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.mapInArrow(numbered, f"tree string, id {kind}, node binary, forged binary, part int, local long"), "numbered")
    every = Window.partitionBy("tree")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("tree").alias("_t"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(every).alias("total"))
    on = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("part") == F.col("_p"))
    return rows.join(sized_broadcast(stored(counts, "counts")), on).select("tree", "id", "node", "forged", (F.col("base") + F.col("local")).alias("pos"), "total")


def height(total: int, shape: Shape) -> int:
    """Levels that a block builds of a tree of ``total`` nodes."""
    n = 0
    while total > 1 and n < shape.levels:
        total, n = -(-total // ARITY), n + 1
    return n


def _levels(nodes: list[bytes], high: int) -> list[list[bytes]]:
    """``nodes`` and the ``high`` levels above them, all but the top one as runs: the hex text of up to ``ARITY`` neighbours."""
    out = []
    for _ in range(high):
        out.append([b"".join(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [digest_of(run) for run in out[-1]]
    return [*out, nodes]


def _path(levels: list[list[bytes]], i: int) -> list[Step]:
    """What node i has beside it on its way up."""
    out = []
    for runs in levels[:-1]:
        run, at = runs[i // ARITY], i % ARITY * HEX
        out.append((run[:at], run[at + HEX :]))
        i //= ARITY
    return out


def fold(node: bytes, path: list[Step]) -> bytes:
    """The root that ``node`` and its siblings make."""
    for before, after in path:
        node = digest_of(before + node + after)
    return node


def _blocks(placed: DataFrame, shape: Shape) -> DataFrame:
    """``placed`` as a row a block: tree, block, total, ids, nodes and forged leaves in order, and the root."""
    kind = placed.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes, total = table.column("node").to_pylist(), table.column("total")[0].as_py()
        root = _levels([n.hex().encode() for n in nodes], height(total, shape))[-1][0]
        own = [[x] for x in (table.column("id").to_pylist(), nodes, table.column("forged").to_pylist())]
        of = lambda c: table.column(c).slice(0, 1).combine_chunks()
        some = [pa.array(x, pa.list_(table.schema.field(c).type)) for x, c in zip(own, ("id", "node", "forged"))]
        return pa.Table.from_arrays([of("tree"), of("block"), of("total"), *some, pa.array([bytes.fromhex(root.decode())], pa.binary())], names=["tree", "block", "total", "ids", "nodes", "forged", "root"])

    placed = placed.withColumn("block", F.floor(F.col("pos") / shape.block))
    schema = f"tree string, block long, total long, ids array<{kind}>, nodes array<binary>, forged array<binary>, root binary"
    return stored(placed.groupBy("tree", "block").applyInArrow(pack, schema), "blocks")


def _roots(blocks: DataFrame, shape: Shape) -> DataFrame:
    """The blocks' roots as nodes of their trees."""
    none = F.lit(None)
    return blocks.select("tree", none.cast("string").alias("id"), F.col("root").alias("node"), none.cast("binary").alias("forged"), F.col("block").alias("pos"), F.ceil(F.col("total") / shape.block).alias("total"))


PATHS = "_tree string, _block long, before array<binary>, after array<binary>, subroot binary, top binary"
_ARROW_PATHS = pa.schema([("_tree", pa.string()), ("_block", pa.int64()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary())), ("subroot", pa.binary()), ("top", pa.binary())])


def _raw(x: bytes) -> bytes:
    return bytes.fromhex(x.decode())


def _rows(tree: str | None, block: int, path: list[Step], subroot: bytes | None, top: bytes) -> tuple:
    return tree, block, [_raw(b) for b, _ in path], [_raw(a) for _, a in path], subroot and _raw(subroot), _raw(top)


def _upper(nodes: DataFrame, forest: bool) -> DataFrame:
    """The paths of at most ``top`` nodes: built here, and to be broadcast. ``forest``: the trees' subroots make one more tree."""
    held: dict[str | None, list[bytes]] = {}
    for r in sorted(nodes.select("tree", "pos", "node").collect(), key=lambda r: (r.tree is not None, (r.tree or "").encode(), r.pos)):
        held.setdefault(r.tree, []).append(bytes(r.node).hex().encode())
    whole = Shape(levels=64)
    built = {t: _levels(n, height(len(n), whole)) for t, n in held.items()}
    last = [x[-1][0] for x in built.values()]
    above = _levels(last, height(len(last), whole)) if forest else [last]
    rows = [_rows(t, i, _path(x, i) + _path(above, k), x[-1][0] if forest else None, above[-1][0]) for k, (t, x) in enumerate(built.items()) for i in range(len(held[t]))]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_PATHS)], schema=_ARROW_PATHS) if rows else _ARROW_PATHS.empty_table()
    return F.broadcast(nodes.sparkSession.createDataFrame(table, PATHS))


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return text_batches(blocks.join(paths, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block"))


def _climbs(b: pa.RecordBatch, shape: Shape) -> Iterator[tuple[dict, list[bytes], list[list[bytes]], list[Step]]]:
    """Of each block: its row, its nodes, its levels, and its own path."""
    for row in b.to_pylist():
        nodes = [n.hex().encode() for n in row["nodes"]]
        yield row, nodes, _levels(nodes, height(row["total"], shape)), [(x.hex().encode(), y.hex().encode()) for x, y in zip(row["before"], row["after"])]


def _below(blocks: DataFrame, paths: DataFrame, shape: Shape, forest: bool) -> DataFrame:
    """The paths of the nodes of ``blocks``. ``forest``: they are the subroots of the trees that ``ids`` names."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, nodes, levels, rest in _climbs(b, shape):
                top = row["top"].hex().encode()
                subroot = row["subroot"] and row["subroot"].hex().encode()
                base = row["block"] * shape.block
                out = [_rows(*((row["ids"][i], 0) if forest else (row["tree"], base + i)), _path(levels, i) + rest, n if forest else subroot, top) for i, n in enumerate(nodes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW_PATHS)], schema=_ARROW_PATHS)

    return sized_broadcast(stored(_with_paths(blocks, paths).mapInArrow(expand, PATHS), "paths"))


def _built(nodes: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """The blocks of the leaves, and the paths of those blocks."""
    first = blocks = _blocks(_placed(nodes), shape)
    done: list[tuple[DataFrame, bool]] = []
    forest = True
    while True:
        tops = _roots(blocks, shape)
        n, largest = tops.agg(F.count("*"), F.max("total")).first()
        if n <= shape.top:
            break
        joins = forest and largest == 1
        if joins:
            tops, forest = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "node", "forged")), False
        blocks = _blocks(tops, shape)
        done.append((blocks, joins))
    paths = _upper(tops, forest)
    for above, joins in reversed(done):
        paths = _below(above, paths, shape, joins)
    return first, paths


DIGEST = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, and the root that its leaf, tampered with or not, folds to."""
    blocks, paths = _built(leaves(docs, tampered(docs)), shape)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(c.split()[0] for c in DIGEST.split(", "))]
        for b in batches:
            ids = b.schema.field("ids").type.value_type
            for row, nodes, levels, rest in _climbs(b, shape):
                suffix, root = b"".join(x + y for x, y in rest), row["top"].hex()
                proofs, folded = [], []
                for i, (node, forged) in enumerate(zip(nodes, row["forged"])):
                    path = _path(levels, i)
                    proofs.append(digest_of(b"".join(x + y for x, y in path) + suffix).decode())
                    folded.append(fold(forged.hex().encode() if forged else node, path + rest).decode())
                n = len(nodes)
                columns = [[x.decode() for x in nodes], [row["subroot"].hex()] * n, [root] * n, proofs, folded]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], ids), *(pa.array(c, pa.string()) for c in columns), pa.array([x == root for x in folded])], names=names)

    return _with_paths(blocks, paths).mapInArrow(finish, f"doc_id {kind}, {DIGEST}")


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """source, n_rows, subroot and root of each source of ``docs``."""
    blocks, paths = _built(leaves(docs), shape)
    each = _with_paths(blocks.select("tree", "block", "total").where("block = 0"), paths)
    return each.select(F.col("tree").alias("source"), F.col("total").alias("n_rows"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("top")).alias("root"))


def proofs(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, ``before`` and ``after`` (of each level the siblings on either side, as hex text) and root of every row."""
    blocks, paths = _built(leaves(docs), shape)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.schema.field("ids").type.value_type
            for row, nodes, levels, rest in _climbs(b, shape):
                for start in range(0, len(nodes), ARITY * ARITY):
                    part = range(start, min(start + ARITY * ARITY, len(nodes)))
                    each = [[(x.decode(), y.decode()) for x, y in _path(levels, i) + rest] for i in part]
                    sides = [pa.array([[s[k] for s in path] for path in each], pa.list_(pa.string())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["ids"][i] for i in part], ids), pa.array([nodes[i].decode() for i in part]), *sides, pa.array([row["top"].hex()] * len(part))], names=["doc_id", "leaf", "before", "after", "root"])

    return _with_paths(blocks, paths).mapInArrow(tell, f"doc_id {kind}, leaf string, before array<string>, after array<string>, root string")


def verified(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id and ``verified`` of each row of ``told`` (what ``proofs`` returned): whether a row of ``docs`` with that id folds to the root."""
    now = leaves(docs).select(F.col("id").alias("_id"), F.lower(F.hex("node")).alias("_now"))
    steps = F.arrays_zip("before", "after")
    folded = F.aggregate(steps, F.col("_now"), lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))
    joined = told.join(now, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_ok", F.coalesce(folded == F.col("root"), F.lit(False)))
    return joined.groupBy("doc_id", "leaf", "before", "after").agg(F.bool_or("_ok").alias("verified")).select("doc_id", "verified")
