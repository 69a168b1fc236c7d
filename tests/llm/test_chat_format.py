"""Chat formatting: exact round trips, branch ranking, cycles and odd rows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
MSG = "tree long, node long, parent long, role string, text string, score double"


def brute(rows):
    """Per conversation: turns, their digest, learned characters and digest."""
    key = lambda x: (x is not None, x or "")
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, key(r[2]), key(r[3])))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    learned = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len(learned), sha(learned)


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|a", "[\\\\INST]", None, "", "<|" * 3, "é<|im_end|>🎉", "a\n\nb", "%0A%25\\n"]


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "e") for i, t in enumerate(NASTY)]
    rows += [(2, None, None, "x", "e"), (2, 0, "odd\nrole%0A<|im_end|>", "y", "e"), (2, 0, "assistant", "y", "e"), (None, 0, "assistant", "z", "e")]
    rows += [(3, 0, "assistant", "dup", "e")] * 3 + [(4, i, "assistant", f"t{i}", "e") for i in range(70)]
    got = {r[0]: tuple(r)[1:5] for r in C.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: brute([r for r in rows if r[0] == k]) for k in {r[0] for r in rows}}


def test_empty_table(spark):
    assert C.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_control_string_is_left(spark):
    texts = spark.createDataFrame([(t,) for t in NASTY if t], "text string")
    for (safe,) in texts.select(C.escape("text")).collect():
        assert not any(x in safe for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_escape_is_reversible(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="<[\\|/s>INST]a", max_size=30), min_size=1, max_size=60))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert all(a == b for a, b in df.select("text", C.unescape(C.escape(df["text"]))).collect())

    check()


def test_branches_rank_by_score_and_cycles_go(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.0),
        (1, 5, 4, "assistant", "end", 0.5), (2, 1, 2, "user", "a", 1.0), (2, 2, 1, "user", "b", 1.0), (2, 3, 2, "user", "c", 1.0),
        (3, 7, 99, "assistant", "orphan", None),
    ]
    out = C.format_trees(spark.createDataFrame(rows, MSG)).collect()
    texts = {r["tree"]: r["formatted"] for r in out}
    assert set(texts) == {1, 3}
    assert [t.split("\n")[1].removesuffix("<|im_end|>") for t in texts[1].split("<|im_start|>")[1:]] == ["q", "good", "more", "end"]
    both = C.format_trees(spark.createDataFrame(rows, MSG), top=2).where("tree = 1").orderBy("path").collect()
    assert [r["path"] for r in both] == [1, 2] and "bad" in both[1]["formatted"]


OTHERS = [C.Template(open="### ", sep=": ", close="\n"), C.Template(open="<|start_header_id|>", sep="<|end_header_id|>\n\n", close="<|eot_id|>"), C.Template(open="ab#", sep="=>", close="$")]


@pytest.mark.parametrize("template", OTHERS)
def test_other_templates_read_back(spark, template):
    texts = [*(t or "" for t in NASTY), template.open, template.open * 3, "x" + template.sep + "y" + template.close, template.open[:-1], "#" * 9 + " ", template.open[0] + "\\" + template.open[1:], "ab" * 4 + "#=>$ab"]
    roles = ["user", "assistant", template.sep + "%3A" + template.open, "###"]
    rows = [(k, i, i - 1 if i else None, r.choice(roles), r.choice(texts), 0.0) for r in [random.Random(4)] for k in range(8) for i in range(9)]
    back = C.read_back(C.format_trees(spark.createDataFrame(rows, MSG), template), template)
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in back.collect()}
    assert got == {k: [(role, text) for t, _, _, role, text, _ in rows if t == k] for k in range(8)}


@pytest.mark.parametrize("bad", [{"open": "#"}, {"open": "aa"}, {"open": "a\\b"}, {"sep": ""}, {"open": "ab", "sep": "xa"}, {"open": "xab", "close": "b"}, {"open": "a<", "sep": ":"}])
def test_templates_that_cannot_be_read_back_are_refused(bad):
    with pytest.raises(ValueError):
        C.Template(**bad)


def test_many_turns_in_one_conversation(spark):
    """20,000 turns: masks and texts under them are linear in the conversation."""
    import time

    turns = spark.range(20_000).selectExpr("struct(id % 2 = 1 AS learned, '<h>' AS head, concat('turn ', id) AS text) AS t").groupBy().agg({"t": "collect_list"}).toDF("turns")
    began = time.perf_counter()
    masked = turns.select(C.F.array_join(C.F.transform("turns", lambda x: C.F.concat(x["head"], x["text"], C.F.lit("</>"))), "").alias("formatted"), C.loss_mask(C.F.col("turns"), 3).alias("mask"))
    r = masked.select("mask", C.parts_of(C.F.col("formatted"), C.F.col("mask")).alias("parts")).first()
    took = time.perf_counter() - began
    assert len(r.mask) == 10_000 and sorted(r.parts) == sorted(f"turn {i}" for i in range(1, 20_000, 2)) and took < 20, took
    print("20,000 turns:", took)


def test_running_and_parts(spark):
    from quire.llm.native import running

    df = spark.range(1).selectExpr("transform(sequence(1, 1000), x -> CAST(x % 7 AS int)) AS v", "CAST(array() AS array<int>) AS none", "'0123456789' AS t")
    r = df.select(running(C.F.col("v"), lambda a, x: a + x), running(C.F.col("v"), lambda a, x: C.F.greatest(a, x)), running(C.F.col("none"), lambda a, x: a + x), C.parts_of(C.F.col("t"), C.F.expr("array(named_struct('s', 1, 'e', 3), named_struct('s', 3, 'e', 3), named_struct('s', 8, 'e', 10))"))).first()
    values = [i % 7 for i in range(1, 1001)]
    assert r[0] == [sum(values[: i + 1]) for i in range(1000)] and r[1] == [max(values[: i + 1]) for i in range(1000)] and r[2] == [] and r[3] == ["12", "", "89"]
