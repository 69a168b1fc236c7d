"""Queries of sources, sinks and projections, over documents, pages and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.functions.text import inline_value, storage_key, strip_label
from quire.operators import lookups as L
from quire.operators import views as V
from quire.plans.registry import query
from quire.sources import files as S


@query("SELECT doc_id, source || '/' || strftime(TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INTEGER), '%Y/%m/%d') || '/' || sha256(text)[1:8] || '_' || lang || '.pdf' AS storage_key FROM documents")
def a4_storage_keys(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 365 * 86400)
    key = storage_key(F.col("source"), at, F.sha2("text", 256), F.concat("lang", F.lit(".pdf")))
    return B.table(spark, sf_dir, "documents").select("doc_id", key.alias("storage_key"))


@query("SELECT page_id, CASE WHEN strlen(html) >= 16 THEN CASE WHEN starts_with(html, '%PDF') THEN 'application/pdf' END END AS kind, strlen(html)::BIGINT AS bytes FROM pages")
def a2_magic_types(spark, sf_dir):
    from quire.functions.text import magic_type

    raw = F.encode("html", "UTF-8")
    return B.table(spark, sf_dir, "pages").select("page_id", magic_type(raw).alias("kind"), F.octet_length(raw).cast("long").alias("bytes"))


@query("SELECT 'q1' AS query_id, doc_id AS embedding_id, left(text, 500) AS cited_text, round(n_chars / 1000.0, 4) AS similarity FROM documents")
def a8_citations(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("embedding_id"), F.col("text").alias("source_text"), F.round(F.col("n_chars") / 1000.0, 4).alias("similarity"))
    return S.citations(d, "q1")


@query("SELECT 'READ' AS action, user_id, event_id AS resource_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE 'peer' || user_id END AS ip_address, props AS user_agent, value AS \"at\" FROM events")
def a9_audit_rows(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    fwd = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), "user_id", F.lit(", 1.1.1.1"))).when(F.col("event_id") % 3 == 1, " ")
    r = e.select("user_id", F.col("event_id").alias("resource_id"), fwd.alias("x_forwarded_for"), F.concat(F.lit("peer"), "user_id").alias("peer"), F.col("props").alias("user_agent"), F.col("value").alias("at"))
    return S.audit_rows(r, "READ")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'image/tiff' WHEN 3 THEN 'image/png' WHEN 4 THEN 'image/jpeg' END AS kind, (strlen(html) + CASE page_id % 6 WHEN 3 THEN 8 WHEN 4 THEN 3 WHEN 5 THEN 0 ELSE 4 END)::BIGINT AS bytes FROM pages WHERE strlen(html) >= 16""")
def a2_magic_headers(spark, sf_dir):
    """The pages behind the first bytes of five kinds of files."""
    from quire.functions.text import magic_type

    head = F.get(F.array(*(F.unhex(F.lit(h)) for h in ("25504446", "49492A00", "4D4D002A", "89504E470D0A1A0A", "FFD8FF", ""))), (F.col("page_id") % 6).cast("int"))
    p = B.table(spark, sf_dir, "pages").where("octet_length(html) >= 16").select("page_id", F.concat(head, F.encode("html", "UTF-8")).alias("raw"))
    return p.select("page_id", magic_type(F.col("raw")).alias("kind"), F.octet_length("raw").cast("long").alias("bytes"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def a13_page_scan(spark, sf_dir):
    return L.page_scan(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 200, 100)


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS "exists" FROM customer""")
def a13_exists(spark, sf_dir):
    """Customers that have an order."""
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return L.known(B.table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def a13_count_and_range(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(with_sql("candidate", """SELECT job_id, field_key, value, round(max(confidence), 4) AS confidence, CASE method WHEN 'TEMPLATE_OCR' THEN 'Template' WHEN 'LAYOUTLM' THEN 'LayoutLM' ELSE method END AS source, coalesce(trim(value), '') = '' AS not_present FROM candidate GROUP BY job_id, field_key, value, method"""))
def b21_client_projection(spark, sf_dir):
    return V.client_projection(B.candidate(spark, sf_dir))


@query(with_sql("candidate", """SELECT job_id, count(*) AS total, count(*) FILTER (c >= 0.85::DOUBLE) AS high, count(*) FILTER (c < 0.70::DOUBLE) AS low, count(*) FILTER (v = '') AS not_present FROM (
SELECT job_id, field_key, max(confidence) AS c, max(trim(value)) AS v FROM candidate GROUP BY ALL) GROUP BY 1"""))
def d19_field_metrics(spark, sf_dir):
    return V.field_metrics(B.candidate(spark, sf_dir))


@query(with_sql("candidate", "SELECT job_id, value, count(DISTINCT field_key) AS fields FROM candidate WHERE method = 'LAYOUTLM' AND value <> '' GROUP BY ALL HAVING count(DISTINCT field_key) >= 3"))
def d25_date_confusion(spark, sf_dir):
    return V.repeated_values(B.candidate(spark, sf_dir), "LAYOUTLM")


@query(with_sql("candidate", "SELECT job_id, field_key, string_agg(DISTINCT value, ' | ' ORDER BY value) AS evidence FROM candidate WHERE value <> '' GROUP BY ALL"))
def d24_merged_evidence(spark, sf_dir):
    return V.merged_evidence(B.candidate(spark, sf_dir))


@query("SELECT p_partkey, trim(regexp_replace('Member ID: ' || p_name, '(?i)^\\s*(?:member id)\\s*[:#|=.\\-]*\\s*', '')) AS stripped, trim(p_brand[7:]) AS inline FROM part")
def h20_label_strip(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    return p.select("p_partkey", strip_label(F.concat(F.lit("Member ID: "), "p_name"), "member id").alias("stripped"), inline_value(F.col("p_brand")).alias("inline"))


@query(r"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS codes FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{4}') AS l FROM documents)")
def e12_code_dedup(spark, sf_dir):
    found = V.distinct_codes(F.col("text"), "[A-Z][a-z]{4}")
    return B.table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("codes"))


@query("SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(lower(p_type) || ' red bolt ring', ' '), x)))::INTEGER AS outside, list_has_all(string_split('red blue small large bolt ring', ' '), string_split(p_name, ' ')) AS subset FROM part")
def g6_word_sets(spark, sf_dir):
    name = F.split("p_name", " ")
    known = F.split(F.concat(F.lower("p_type"), F.lit(" red bolt ring")), " ")
    return B.table(spark, sf_dir, "part").select("p_partkey", F.size(V.outside(name, known)).alias("outside"), V.is_subset(name, F.split(F.lit("red blue small large bolt ring"), " ")).alias("subset"))


@query("SELECT p_partkey, p_size > 25 AS landscape, round(p_size / 25.0::DOUBLE, 4) AS aspect, p_retailprice < 950 AS low_quality FROM part")
def b23_page_predicates(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    return p.withColumns(V.page_predicates(F.col("p_size"), F.lit(25), F.col("p_retailprice"), 950)).select("p_partkey", "landscape", "aspect", "low_quality")


@query("SELECT r_name, n_name, s_name, count(*) OVER (PARTITION BY n_name) AS samples FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def c6_template_tree(spark, sf_dir):
    roots, leaves = F.broadcast(B.table(spark, sf_dir, "region")), B.table(spark, sf_dir, "supplier")  # five regions
    t = V.tree(roots, B.table(spark, sf_dir, "nation"), leaves, ("n_regionkey", "r_regionkey"), ("n_nationkey", "s_nationkey"), "n_name")
    return t.select("r_name", "n_name", "s_name", "samples")


@query("SELECT o_orderkey, count(l_orderkey) AS items, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def c8_job_tokens(spark, sf_dir):
    return V.items_of_each(B.table(spark, sf_dir, "orders").select("o_orderkey"), B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey", "l_linenumber")
