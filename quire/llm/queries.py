"""The queries opN_<name> of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (
    chat_format,
    decontamination,
    jaccard_join,
    license_scans,
    merkle_manifest,
    minhash_dedup,
    periodic_runs,
    quality_rules,
    secret_scans,
    source_mixing,
    substring_dedup,
    token_counts,
    warc,
)
from quire.llm.storage import fresh_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages"))


#: Books and news count more than the web; a language or source counts as its siblings do, but for src0.
MIX = source_mixing.Mix(weights={"domain": {"books": 4.0, "news": 2.0, "web": 1.0}, "lang": {"en": 2.0}, "source": {"src0": 0.5}}, share=0.6, max_epochs=3, seed=42)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(_table(spark, sf_dir, "documents"), MIX)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(license_scans.as_files(_table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(_table(spark, sf_dir, "documents"), fresh_dir(spark, "token-rollup"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


#: Words of whole documents, for the twins below.
_WORDS_SQL = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY md5_number(k)) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM dup)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def _near_sql(percent: int, more: str = "") -> str:
    """Sets of shingles; pairs of different sets that share one of their rarest shingles, as each pair that links must; links by
    the whole sets; components by the smallest id handed on along the links.
    """
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(list_zip(w[:-5], w[2:-4], w[3:-3], w[4:-2], w[5:]), lambda z: concat_ws(' ', z[1], z[2], z[3], z[4], z[5]))) END) AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) ELSE 'empty ' || doc_id END AS node, s FROM k),
node AS MATERIALIZED (SELECT node, any_value(n) AS n, any_value(s) AS s FROM g GROUP BY node),
item AS MATERIALIZED (SELECT node, n, md5_number(t) AS t FROM (SELECT node, n, unnest(s) AS t FROM node)),
ranked AS (SELECT node, n, t, row_number() OVER (PARTITION BY node ORDER BY df, t) AS r FROM item JOIN (SELECT t, count(*) AS df FROM item GROUP BY t) USING (t)),
prefix AS MATERIALIZED (SELECT node, n, t FROM ranked WHERE r <= n - ({percent} * n + 99) // 100 + 1),
pair AS MATERIALIZED (SELECT DISTINCT a.node AS a, b.node AS b, a.n AS an, b.n AS bn FROM prefix a JOIN prefix b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN item x ON x.node = a JOIN item y ON y.node = b AND y.t = x.t GROUP BY a, b, an, bn HAVING 100 * count(*) >= {percent} * (an + bn - count(*))),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
low AS MATERIALIZED (SELECT node, min(doc_id) AS c FROM g GROUP BY node),
walk(node, c) USING KEY (node) AS (SELECT node, c FROM low
  UNION SELECT e.b, min(walk.c) FROM walk JOIN edge e ON e.a = walk.node JOIN recurring.walk r ON r.node = e.b WHERE walk.c < r.c GROUP BY e.b)
SELECT doc_id, n AS n_shingles, walk.c AS component_id{more} FROM g JOIN walk ON walk.node = g.node
"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN g USING (html)
"""


def _op5_sql() -> str:
    """The same tree, one level after the other."""
    levels, sql, up = ["domain", "lang", "source"], "", "SELECT floor(sum(tokens) * 0.6)::DOUBLE AS budget FROM sizes"
    weights = {"domain": "CASE domain WHEN 'books' THEN 4.0 WHEN 'news' THEN 2.0 ELSE 1.0 END", "lang": "CASE lang WHEN 'en' THEN 2.0 ELSE 1.0 END", "source": "CASE source WHEN 'src0' THEN 0.5 ELSE 1.0 END"}
    for i, level in enumerate(levels):
        at, parent = ", ".join(levels[: i + 1]), ", ".join(levels[:i]) or "1"
        sql += f"""
b{i} AS ({up}),
n{i} AS (SELECT *, cap / weight AS full_at FROM (SELECT {at}, sum(tokens * 3)::BIGINT AS cap, ({weights[level]})::DOUBLE AS weight FROM sizes GROUP BY {at}) {f"JOIN b{i} USING ({parent})" if i else f"CROSS JOIN b{i}"}),
l{i} AS (SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER w, 0)) AS line
  FROM n{i} WINDOW w AS (PARTITION BY {parent} ORDER BY full_at, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g{i} AS (SELECT {at}, CASE WHEN full_at <= line THEN cap::DOUBLE ELSE weight * max(line) FILTER (full_at > line) OVER (PARTITION BY {parent}) END AS got FROM l{i}),"""
        up = f"SELECT {at}, got AS budget FROM g{i}"
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) < 5 THEN 'books' WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) < 10 THEN 'news' ELSE 'web' END AS domain,
  lang, source, len({_WORDS_SQL})::BIGINT AS n_tokens FROM documents),
sizes AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),{sql}
leaf AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS partial, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END * tokens AS rest
  FROM (SELECT domain, lang, source, tokens, floor(got + 1e-6)::BIGINT AS budget FROM g2 JOIN sizes USING (domain, lang, source))),
p AS (SELECT d.*, partial, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || partial || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN leaf USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, partial))::INTEGER AS epoch FROM p WHERE partial > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, partial::INTEGER AS epoch FROM p WHERE rest > 0 AND upto <= rest
"""


OP8_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS_SQL} AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|\x{{2026}})[\x20\x09-\x0D]*\z'))) AS n_ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullets,
    length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT *, CASE WHEN n_words < 10 THEN 'few_words' WHEN n_repeat_words * 100 > n_words * 20 THEN 'repeated_windows'
    WHEN n_symbols * 100 > n_words * 50 THEN 'symbols' WHEN n_dup_lines * 100 > n_lines * 50 THEN 'duplicate_lines'
    WHEN n_words > 0 AND (word_chars < n_words * 2 OR word_chars > n_words * 20) THEN 'word_length'
    WHEN n_ellipsis * 100 > n_lines * 30 THEN 'ellipsis_lines' WHEN n_bullets * 100 > n_lines * 90 THEN 'bullet_lines'
    WHEN n_letters * 100 < word_chars * 50 THEN 'letters' END AS rejected_by
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed, rejected_by IS NULL AS kept, rejected_by
FROM v
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(conversations.unionByName(extra))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(_table(spark, sf_dir, "documents"))

OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>)', '\1\\\2\3', 'g') AS safe FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + length(role) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digest(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(_table(spark, sf_dir, "documents"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.digest(_table(spark, sf_dir, "documents"))


#: CRC-32 of the decimal digits of doc_id.
_CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295))"""


def _op11_sql() -> str:
    """One level after the other: of each node the run it is in and its place there; a tree of one node goes on as it is."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    of = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars']))} || {field(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH d AS (SELECT doc_id, source, {of('text')} AS leaf, CASE WHEN {_CRC_SQL} % 5 = 0 THEN {of(lower)} ELSE {of('text')} END AS folded FROM documents),
a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n0 AS MATERIALIZED (SELECT source AS tree, i, leaf AS h FROM a0),"""
    walk, joins, proof, folded = 5, "", [], "a0.folded"
    for k in range(walk + 3):
        if k == walk:
            sql += f"\nsub AS MATERIALIZED (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS s FROM n{k}),\nu{k} AS (SELECT '' AS tree, s AS i, subroot AS h FROM sub),"
            joins += " JOIN sub ON sub.source IS NOT DISTINCT FROM a0.source"
        of_k = f"u{k}" if k == walk else f"n{k}"
        sql += f"""
r{k} AS MATERIALIZED (SELECT tree, i // 16 AS run, string_agg(h, '' ORDER BY i) AS cat, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {of_k}) GROUP BY tree, i // 16),
n{k + 1} AS MATERIALIZED (SELECT tree, run AS i, CASE WHEN c = 1 THEN cat ELSE sha256(cat) END AS h FROM r{k}),"""
        at, tree = ("a0.i", "a0.source") if k < walk else ("sub.s", "''")
        place = f"({at} // {16 ** (k if k < walk else k - walk)})"
        joins += f" JOIN r{k} ON r{k}.tree IS NOT DISTINCT FROM {tree} AND r{k}.run = {place} // 16"
        before, after = f"left(r{k}.cat, 64 * ({place} % 16))", f"substring(r{k}.cat, 64 * ({place} % 16) + 65)"
        proof.append(f"CASE WHEN r{k}.c = 1 THEN '' ELSE {before} || {after} END")
        folded = f"CASE WHEN r{k}.c = 1 THEN {folded} ELSE sha256({before} || {folded} || {after}) END"
    return sql + f"""
f AS (SELECT a0.doc_id, a0.leaf, subroot, sha256({' || '.join(proof)}) AS proof_sha256, {folded} AS folded_root FROM a0{joins})
SELECT doc_id, leaf, subroot, h AS root, proof_sha256, folded_root, folded_root = h AS verified FROM f, (SELECT h FROM n{walk + 3})
"""


def _op12_sql() -> str:
    """Windows of 1, 2, 4, 8, ... words, a window's key made of its halves' keys.

    A run of smallest period q has a window length m with q <= m <= 2q (16 for the small ones) whose windows in the run come
    again first after q words, as anything nearer would be a smaller period; consecutive ones make up the run.
    """
    lengths = [16 << i for i in range(13)]
    keys = "\nk1 AS (SELECT doc_id, unnest(range(0, len(w))) AS i, hash(unnest(w)) AS k FROM p WHERE len(w) >= 24),"
    for m in [2, 4, 8, *lengths]:
        keys += f"\nk{m} AS MATERIALIZED (SELECT doc_id, i, hash(k, other) AS k FROM (SELECT *, lead(k, {m // 2}) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM k{m // 2}) WHERE other IS NOT NULL),"
    again = " UNION ALL ".join(f"SELECT doc_id, i, q, {m} AS m FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) - i AS q FROM k{m}) WHERE q <= {m}{f' AND q > {m // 2}' if m > 16 else ''}" for m in lengths)
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w, {_CRC_SQL} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) > 0 AND h % 10 = 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS c FROM d),
p AS MATERIALIZED (SELECT doc_id, CASE WHEN planted THEN list_select(w, list_transform(range(0, len(w)), lambda i: 1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // c) END)) ELSE w END AS w FROM g),{keys}
again AS ({again}),
run AS MATERIALIZED (SELECT doc_id, min(i) AS start, count(*) + m - 1 + q AS length, q AS period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, m, q ORDER BY i) AS island FROM again) GROUP BY doc_id, m, q, island HAVING count(*) + m - 1 + q >= greatest(24, 3 * q)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM p) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM p LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_decontamination, op4_warc, op5_source_mixing, op6_license_scans, op7_token_counts, op8_quality_rules, op9_chat_formatting, op10_secret_scans, op11_merkle_manifest, op12_periodic_runs, op13_minhash_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_jaccard_join": _near_sql(75), "op3_decontamination": OP3_SQL, "op4_warc": OP4_SQL, "op5_source_mixing": _op5_sql(), "op8_quality_rules": OP8_SQL, "op9_chat_formatting": OP9_SQL, "op11_merkle_manifest": _op11_sql(), "op12_periodic_runs": _op12_sql(), "op13_minhash_dedup": _near_sql(85, ", doc_id = walk.c AS kept")}
