"""Manifest, proofs and folds against a tree built in one place, for shapes that take one task or many passes."""

import hashlib
import zlib

import pytest

from quire.llm import merkle_manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """The root, and of each node the siblings on its way there as (before, after)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run, k = nodes[a // 16 * 16 : a // 16 * 16 + 16], a % 16
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for r in rows:
        leaf = H(*map(field, r))
        bad = (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, H(*map(field, bad)), r[0]))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: climb([x[2] for x in sorted(trees[t])]) for t in names}
    root, above = climb([built[t][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for x, path in zip(sorted(trees[t]), built[t][1]):
            path, folded = path + above[k], x[3]
            for before, after in path:
                folded = H(before, folded, after)
            out.append((x[4], x[2], built[t][0], root, H(*(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=str)


def some_rows():
    rows = []
    for name, n in (("one", 1), ("sixteen", 16), ("seventeen", 17), ("Ä", 40), ("hot", 700), (None, 3), ("", 2)):
        rows += [(len(rows) + i, name, "en", 7, f"Text {i} of {name}") for i in range(n)]
    rows += [(5, "hot", None, None, None), (None, "hot", "en", 1, "A"), (None, "hot", "en", 1, "A"), (10**12, "hot", "en", 1, ""), (33, "hot", "en", 1, "long Text " * 5000)]
    rows += [(7, "same", "en", 1, "Same row")] * 50
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("shape", [M.Shape(), M.Shape(levels=1, top=3), M.Shape(levels=2, top=2), M.Shape(levels=1, top=60)])
def test_digest_is_that_of_a_tree_built_in_one_place(spark, shape):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", tree string, id long").repartition(7)
    got = M.digest(docs, shape)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_many_sources_join_in_passes(spark):
    rows = [(i, f"s{i % 300}", "en", 1, "Word") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, M.digest(docs, M.Shape(levels=1, top=4)).collect()), key=str) == expected(rows)


def test_manifest_and_proofs(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    told = {r.source: r for r in M.manifest(docs).collect()}
    assert len(told) == 8 and {r.subroot for r in told.values()} == {w[2] for w in want} and {r.root for r in told.values()} == {want[0][3]}
    assert (told["hot"].n_rows, told[None].n_rows, told["same"].n_rows) == (705, 3, 50)
    proofs = M.proofs(docs)
    assert sorted(H(*(b + a for b, a in zip(r.before, r.after))) for r in proofs.collect()) == sorted(w[4] for w in want)
    some = proofs.where("doc_id BETWEEN 100 AND 140 OR doc_id IS NULL")
    assert all(r.verified for r in M.verified(docs, some).collect())
    changed = docs.withColumn("text", docs.text.substr(1, 5)).where("doc_id <> 120")
    assert not any(r.verified for r in M.verified(changed, some.where("doc_id IS NOT NULL")).collect())


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(1, "a", "en", 1, "x")], SCHEMA)
    r = M.digest(one).first()
    assert r.leaf == r.subroot == r.root == H("1:1", "1:a", "2:en", "1:1", "1:x") and r.proof_sha256 == H("")
    none = spark.createDataFrame([], SCHEMA)
    assert M.digest(none).collect() == M.manifest(none).collect() == M.proofs(none).collect() == []
