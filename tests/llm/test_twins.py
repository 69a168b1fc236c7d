"""The queries that SQL can express agree with their twins, row by row, on the driver's smallest tables and on odd texts."""

import os

import duckdb
import pytest

from quire.llm import queries as Q

SF = "/root/testdata/sf0.001"


def agree(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    want = con.execute(Q.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    df = Q.queries()[name](spark, folder)
    assert sorted(df.columns) == columns
    say = lambda v: "" if v is None else str(v)
    assert sorted(tuple(say(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(say(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_its_twin(spark, name):
    agree(spark, SF, name, [f[: -len(".parquet")] for f in os.listdir(SF)])


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op13_minhash_dedup"])
def test_near_duplicate_twins_on_odd_texts(spark, tmp_path, name):
    eight = "a b c d e f g h"
    texts = [None, "", " \t", "One", "one", "a b c d", "A b\tc  d", eight, eight[:-2], eight[2:], eight + " i", "Ä b c d e", "ä b c d e", "x\x0by", "x y", "x y", *[" ".join(f"w{(i * k) % 91}" for i in range(40)) for k in (1, 1, 2, 3)]]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    agree(spark, str(tmp_path), name, ["documents"])
