"""Queries of the search operators, over candidates and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.functions import geometry as G
from quire.operators import hash_index as H
from quire.operators import search as S
from quire.operators import vector_index as V
from quire.plans.registry import query
from quire.sources.scratch import folder


@query(with_sql("candidate", "SELECT job_id, field_key, ord, value, method, confidence FROM candidate WHERE lower(field_key) = 'member_id' OR lower(value) LIKE '%member_id%' ORDER BY confidence DESC NULLS LAST, job_id, field_key, ord LIMIT 100"))
def b13_structured_search(spark, sf_dir):
    return S.structured(B.candidate(spark, sf_dir), "MEMBER_ID", 100).select("job_id", "field_key", "ord", "value", "method", "confidence")


_Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"


@query(with_sql("embedding", f"SELECT embedding_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QSQL}), 6) AS similarity FROM embedding ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) DESC, embedding_id LIMIT 10"))
def f5_vector_top_k(spark, sf_dir):
    return S.nearest(B.embedding(spark, sf_dir), _Q).select("embedding_id", F.round("similarity", 6).alias("similarity"))


def _asked(e):
    return e.where("embedding_id % 100 = 0").select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("vector"))


def _nearest_sql(k):
    return f"""SELECT query_id, embedding_id, similarity, rank FROM (SELECT query_id, e.embedding_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, e.embedding_id)::INTEGER AS rank FROM (
SELECT q.embedding_id AS query_id, e.embedding_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embedding e, embedding q WHERE q.embedding_id % 100 = 0) e) WHERE rank <= {k}"""


@query()
def f5_ivf_search(spark, sf_dir):
    """The ten nearest of all rows for every id divisible by 100, by an index whose lists are probed for a recall of 0.95."""
    e = B.embedding(spark, sf_dir)
    index = V.build(e, folder(spark, "vector-index"))
    return V.search(spark, index, _asked(e), 10, V.tuned(spark, index))


@query(with_sql("embedding", _nearest_sql(10)))
def f5_ivf_all_lists(spark, sf_dir):
    """The same index with every list probed, which is exact."""
    e = B.embedding(spark, sf_dir)
    index = V.build(e, folder(spark, "vector-index"))
    return V.search(spark, index, _asked(e), 10, index.lists)


@query(with_sql("embedding", _nearest_sql(5)))
def h45_nearest_of_each(spark, sf_dir):
    e = B.embedding(spark, sf_dir)
    return V.nearest_of_each(e, _asked(e))


# The signs of embeddings stand in for hashes; every third one occurs again with one or two bits turned.
_HASH = """hashes AS (SELECT embedding_id AS id, [x > 0 FOR x IN embedding[1:64]] AS bits FROM embedding UNION ALL
SELECT embedding_id + 1000000, [CASE WHEN i - 1 = embedding_id % 64 OR (embedding_id % 2 = 0 AND i - 1 = (embedding_id + 7) % 64) THEN NOT (x > 0) ELSE x > 0 END FOR x, i IN embedding[1:64]] FROM embedding WHERE embedding_id % 3 = 0)"""
_APART = "len(list_filter(list_zip(a.bits, b.bits), lambda z: z[1] <> z[2]))::INTEGER"
#: Bits that a page and a sample may differ in, and the wider distance that is tried when none does.
STRICT, ADAPTIVE = 5, 12


def _hashes(spark, sf_dir):
    e = B.embedding(spark, sf_dir).select(F.col("embedding_id").alias("id"), "embedding")
    turned = lambda x, i: F.when((i == F.col("id") % 64) | ((F.col("id") % 2 == 0) & (i == (F.col("id") + 7) % 64)), -x).otherwise(x)
    again = e.where("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), F.transform("embedding", turned).alias("embedding"))
    return e.unionByName(again).select("id", G.sign_hash(F.col("embedding")).alias("hash"))


# Equal hashes form a class with its least id, and pairs are between classes.
_LINKS = f"""class AS (SELECT bits, min(id) AS id FROM hashes GROUP BY bits)
SELECT c.id AS left_id, h.id AS right_id, 0 AS distance FROM hashes h JOIN class c USING (bits) WHERE h.id <> c.id
UNION ALL SELECT * FROM (SELECT a.id AS left_id, b.id AS right_id, {_APART} AS distance FROM class a, class b WHERE a.id < b.id)"""


@query(with_sql("embedding", f"WITH {_HASH}, {_LINKS} WHERE distance <= {STRICT}"))
def c10_hamming_join(spark, sf_dir):
    return H.links(_hashes(spark, sf_dir), STRICT)


@query(with_sql("embedding", f"WITH {_HASH}, {_LINKS} WHERE distance <= {ADAPTIVE}"))
def c10_adaptive_hamming_join(spark, sf_dir):
    return H.links(_hashes(spark, sf_dir), ADAPTIVE)


@query(with_sql("embedding", f"""WITH {_HASH} SELECT left_id, right_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id)::INTEGER AS rank FROM (
SELECT a.id AS left_id, b.id AS right_id, {_APART} AS distance FROM hashes a, hashes b WHERE a.id % 100 = 0) WHERE distance <= 24) WHERE rank <= 5"""))
def f4_top_templates(spark, sf_dir):
    """The five nearest of all hashes for every hash whose id is divisible by 100."""
    h = _hashes(spark, sf_dir)
    return H.nearest(h, h.where("id % 100 = 0"), 5, 24)


@query("SELECT p_partkey, round(0.7 * (p_size / 50.0::DOUBLE) + 0.3 * greatest(1 - (p_partkey % 20) / (2.0 * 6), 0), 6) AS score FROM part")
def i15_match_score(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select("p_partkey", F.round(S.match_score(F.col("p_size") / 50.0, F.col("p_partkey") % 20, 6), 6).alias("score"))
