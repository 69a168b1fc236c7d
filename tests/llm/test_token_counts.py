"""Token rollups against counts over the final state; commits that repeat or break off."""

from collections import Counter

from quire.llm import storage, token_counts as T

SCHEMA = "doc_id long, source string, lang string, text string, tokenizer string"
ROWS = [
    (1, "a", "en", "hello  world", "x"), (2, "a", "en", "hello  world", "x"), (3, "a", None, None, "x"), (4, None, "de", "", "x"),
    (5, "b", "en", "tok " * 5000, "x"), (6, "b", "en", "<|endoftext|> a  b", None), (6, "b", "en", "again", None),
]


def test_digest_is_the_final_state(spark):
    enc = T.encoder(T.VOCABULARY)
    import re

    first = {}
    for r in sorted(ROWS, key=lambda r: r[0]):
        first.setdefault(r[3], r[0])
    want = Counter()
    for i, s, l, t, _ in ROWS:
        if t is None or first[t] == i:
            new = re.sub(" {2,}", " ", t or "")
            for name, n in (("byte_bpe_50k", len(enc.encode_ordinary(new))), ("words", len(new.split()))):
                want[(s, l, name, "d")] += 1
                want[(s, l, name, "n")] += n
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in T.digest(df, storage.fresh_dir(spark, "roll")).collect()}
    assert got == {k[:3]: (want[(*k[:3], "d")], want[(*k[:3], "n")]) for k in want}


def test_commits(spark):
    delta = lambda n: spark.createDataFrame([("s", "en", "words", 1, n)], T.DELTA)
    roll = T.Rollup(spark, storage.fresh_dir(spark, "roll"))
    assert roll.totals().count() == 0
    assert roll.commit("a", delta(5)) and not roll.commit("a", delta(7)) and roll.commit("b", delta(2))
    delta(9).write.parquet(f"{roll.folder}/deltas/c-broken")  # an attempt without a marker
    assert [tuple(r)[3:] for r in roll.totals().collect()] == [(2, 7)]
    assert roll.compact("fold") and not roll.commit("b", delta(2))
    assert [tuple(r)[3:] for r in roll.totals().collect()] == [(2, 7)]


def test_empty_table(spark):
    assert T.digest(spark.createDataFrame([], SCHEMA), storage.fresh_dir(spark, "roll")).count() == 0


def test_of_two_compactions_that_fold_the_same_batch_one_counts(spark):
    delta = lambda n: spark.createDataFrame([("s", "en", "words", 1, n)], T.DELTA)
    total = lambda roll: [tuple(r)[3:] for r in roll.totals().collect()]
    roll = T.Rollup(spark, storage.fresh_dir(spark, "roll"))
    roll.commit("a", delta(5))
    roll.commit("z1", roll.totals(), ["a"])
    roll.commit("z2", roll.totals(), ["a"])  # as by a second driver that began before the first was done
    assert total(roll) == [(1, 5)]
    roll.commit("b", delta(2))
    assert roll.compact("early") and total(roll) == [(2, 7)] and list(roll.live()) == ["early"]
    roll.commit("later", delta(1), ["z2"])  # replaces what is void
    assert total(roll) == [(2, 7)]


def test_a_marker_that_was_not_written_does_not_count(spark):
    delta = lambda n: spark.createDataFrame([("s", "en", "words", 1, n)], T.DELTA)
    roll = T.Rollup(spark, storage.fresh_dir(spark, "roll"))
    roll.commit("a", delta(5))
    roll._fs.create(roll._path("commits/b"), False).close()
    assert [tuple(r)[3:] for r in roll.totals().collect()] == [(1, 5)]
    assert roll.commit("b", delta(3)) and [tuple(r)[3:] for r in roll.totals().collect()] == [(2, 8)]
    assert not roll._mark("b", {"data": "x", "replaces": []})


def test_sums_and_keys_are_single_files_however_many_partitions_a_shuffle_has(spark):
    from pathlib import Path

    docs = spark.createDataFrame([(i, f"s{i % 40}", "en", f"text  {i % 100}") for i in range(300)], "doc_id long, source string, lang string, text string")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    shared = Path(storage.shared_dir(spark).removeprefix("file://"))
    held = lambda: set(shared.rglob("part-*.parquet"))
    there, folder = held(), storage.fresh_dir(spark, "roll")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        totals = T.digest(docs, folder)
        files = Counter(f.parent.name for f in held() - there)
        assert len(files) == 5 and set(files.values()) == {1}  # counts, three batches and the texts that have copies
        assert totals.rdd.getNumPartitions() == 1
        assert totals.where("tokenizer = 'words'").agg({"n_docs": "sum", "n_tokens": "sum"}).first() == (100, 200)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_packed_tables_of_many_rows_are_several_files(spark, monkeypatch):
    monkeypatch.setattr(storage, "FILE_ROWS", 100)
    got = storage.packed(spark.range(1000).repartition(16), "packed")
    assert len(got.inputFiles()) == 11 and got.agg({"id": "sum"}).first()[0] == 499500


def test_repeated_ids_of_a_copied_text_stay_and_markers_may_leave_out_the_rows(spark):
    docs = spark.createDataFrame([(7, "a", "en", "q  q"), (7, "a", "en", "q  q"), (8, "b", "en", "q  q"), (9, "b", "en", "r")], "doc_id long, source string, lang string, text string")
    words = lambda df: sorted((r["source"], r["n_docs"], r["n_tokens"]) for r in df.where("tokenizer = 'words'").collect())
    folder = storage.fresh_dir(spark, "roll")
    assert words(T.digest(docs, folder)) == [("a", 2, 4), ("b", 1, 1)]
    roll = T.Rollup(spark, folder)
    load = roll.live()["load"]
    roll._mark("load-again", {k: load[k] for k in ("data", "replaces")})  # as written before markers said how many rows there are
    assert words(roll.totals()) == [("a", 4, 8), ("b", 3, 4)]


def test_digest_without_broadcasts(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = lambda: sorted(map(str, T.digest(df, storage.fresh_dir(spark, "roll")).collect()))
    want = rows()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    assert rows() == want


def test_columns_of_any_name_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "two words", 9, "t", "b"), (2, "w " * 40_000, 9, "t", "b"), (3, None, 9, "t", "b")], "doc_id long, text string, n_words int, _text string, n_bpe string")
    got = {r.doc_id: r for r in T.counted(docs).collect()}
    assert got[1].n_words == 2 and got[1]._text == "t" and got[2].n_words == 40_000 and got[2].n_bpe >= 40_000 and (got[3].n_words, got[3].n_bpe) == (0, 0)
    assert T.counted(docs).columns == ["doc_id", "_text", "n_words", "n_bpe"]


def test_tidy_folds_markers_and_keeps_totals_and_names(spark):
    delta = lambda n: spark.createDataFrame([("s", "en", "words", 1, n)], T.DELTA)
    total = lambda roll: [tuple(r)[3:] for r in roll.totals().collect()]
    roll = T.Rollup(spark, storage.fresh_dir(spark, "roll"))
    for name, n in (("a", 5), ("b", 2), ("c", 1)):
        roll.commit(name, delta(n))
    roll.compact("fold")
    assert roll.tidy() == 4 and roll.committed() == {} and total(roll) == [(3, 8)]
    assert len([s for s in roll._fs.listStatus(roll._path("deltas"))]) == 1
    assert not roll.commit("b", delta(7)) and not roll.commit("fold", delta(7)) and roll.commit("d", delta(4)) and total(roll) == [(4, 12)]
    again = T.Rollup(spark, roll.folder)
    assert again.compact("fold-2") and again.tidy() == 2 and total(again) == [(4, 12)] and not again.commit("a", delta(1))
    assert [n for n in again.live()] == ["fold-2"]
