"""The pipeline against brute force: each stage by the plain versions of the operators' tests."""

import ast
import re

import corpus_pipeline as P
from quire.llm import quality_rules, secret_scans

from tests.llm import test_jaccard_join as jaccard, test_quality_rules as quality, test_secret_scans as secrets

KEY = "AKIA" + "Q" * 16
ITEM = "what is the answer to the question about the seven red lamps in the hall"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def verdict(text):
    w = words(text)
    n, lines = len(w), [x for x in (text or "").split("\n") if words(x)]
    wins = [tuple(w[i : i + 5]) for i in range(n - 4)]
    again = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 5)}
    symbols, chars = sum(c in "#*$%&|<>" for c in text or ""), sum(map(len, w))
    return not (n < 10 or len(again) * 100 > n * 20 or symbols * 100 > n * 50 or (len(lines) - len(set(lines))) * 100 > len(lines) * 50 or chars < 2 * n or chars > 20 * n or quality.prose_fails(text or ""))


def tables(spark, tmp_path):
    prose = lambda k, n=60: " ".join(f"{k}word{i * 7 % 97}x{i}" for i in range(n))
    docs = [(i, prose(f"d{i}"), "en" if i % 2 else None, f"src{i % 12}", 0) for i in range(40)]
    docs += [(100, prose("d3") + " tail", "en", "src1", 0), (101, prose("d5"), "de", "src2", 0), (102, "short one", "en", "src1", 0), (103, "same line\n" * 30, "en", "src1", 0)]
    docs += [(104, prose("e") + " " + ITEM.upper() + " end", "en", "src3", 0), (105, prose("f") + f" {KEY} end", "en", "src4", 0), (106, None, "en", "src1", 0), (107, "", None, None, 0), (108, prose("g") + " # $ " * 60, "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return [d for d in docs]


def test_stages_against_brute_force(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [r for r in rows if verdict(r[1])]
    least = {i: root for i, _, root in map(ast.literal_eval, jaccard.brute([r[:3] for r in want]))}
    want = [r for r in want if least[r[0]] == r[0]]
    want = [r for r in want if ITEM not in (r[1] or "").lower()]
    want = {r[0]: r[1].replace(KEY, "[REDACTED]") for r in want}
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == P.COLUMNS
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert secrets.brute(f"x {KEY} y")[1] == 1


def test_run_mixes_what_is_left(spark, tmp_path):
    rows = tables(spark, tmp_path)
    got = P.run(spark, str(tmp_path)).collect()
    kept = {r[0] for r in rows if verdict(r[1])} - {100, 101, 104}
    assert {r["doc_id"] for r in got} <= kept and len({(r["doc_id"], r["epoch"]) for r in got}) == len(got) > 10
    assert all(KEY not in r["text"] for r in got)


def test_cascade_is_the_verdict_in_any_order(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        kept = docs.where(quality_rules.first_rejection(docs["text"], rules).isNull() & docs["text"].isNotNull())
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if verdict(r[1]))
    assert secret_scans.KINDS[0] == "assign"


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    prose = lambda k, n=60: " ".join(f"{k}word{i * 7 % 97}x{i}" for i in range(n))
    rows = [(1, prose("a"), None, None, 0, "x"), (1, prose("a"), None, None, 0, "y"), (None, prose("a"), "en", "src1", 0, "x"), (3, None, None, None, None, "x"), (4, prose("b"), "en", None, None, "x")]
    folder = str(tmp_path / "some")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, epoch string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert sorted(str((r.doc_id, r.lang)) for r in docs.collect()) == ["(1, None)", "(4, 'en')", "(None, 'en')"]
    assert set(P.run(spark, folder).columns) >= {"doc_id", "text", "epoch"}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
