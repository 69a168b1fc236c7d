"""Source mixing against a plain water-filling and a plain prefix."""

import hashlib
from collections import defaultdict

import pytest

from quire.llm import source_mixing as S

SCHEMA = "doc_id long, text string, lang string, source string, epoch string"


def rows():
    out = []
    for i in range(300):
        out.append((i, "w " * (i * 7 % 40), ["en", "de", "fr", None][i % 4], f"src{i * i % 13}", "x"))
    return out + [(i, "w " * 30, "en", "src11", "x") for i in range(300, 700)] + [(900, None, "en", "src1", "x"), (901, "", "xx", None, "x"), (5, rows_text(), "en", "src11", None), (7, "w " * 30, "en", "src11", "x"), (7, "w " * 30, "en", "src11", "x")]


def rows_text():
    return "long " * 20000


def fill(budget, caps, weights):
    """Deals a budget out again and again among those that are not full."""
    got, open_ = {k: 0.0 for k in caps}, {k for k in caps if weights[k] > 0}
    while open_ and budget > 1e-9:
        total, share = sum(weights[k] for k in open_), budget
        full = {k for k in open_ if caps[k] - got[k] <= share * weights[k] / total + 1e-12}
        if not full:
            for k in open_:
                got[k] += share * weights[k] / total
            return got
        for k in full:
            budget -= caps[k] - got[k]
            got[k] = caps[k]
        open_ -= full
    return got


def brute(data, mix):
    domain = lambda s: "web" if s is None or not s[3:].isdigit() else "books" if int(s[3:]) < 5 else "news" if int(s[3:]) < 10 else "web"
    docs = [(d, (domain(s), lang, s), len((t or "").split())) for d, t, lang, s, _ in data]
    tokens = defaultdict(int)
    for _, leaf, n in docs:
        tokens[leaf] += n
    budgets = {(): float(int(sum(tokens.values()) * mix.share))}
    for depth, level in enumerate(mix.levels, 1):
        caps = defaultdict(int)
        for leaf, n in tokens.items():
            shut = any(mix.weights.get(x, {}).get(v, 1.0) == 0 for x, v in zip(mix.levels, leaf))
            caps[leaf[:depth]] += 0 if shut else n * mix.max_epochs
        now = {}
        for parent, budget in budgets.items():
            kids = {k: c for k, c in caps.items() if k[:-1] == parent}
            now |= fill(budget, kids, {k: mix.weights.get(level, {}).get(k[-1], 1.0) for k in kids})
        budgets = now
    out = []
    for leaf, n in tokens.items():
        budget, mine = int(budgets[leaf] + 1e-6), [(d, m) for d, x, m in docs if x == leaf]
        epochs = budget // n if n else 1
        out += [(d, *leaf, m, e) for e in range(epochs) for d, m in mine]
        rest, upto = budget - epochs * n, 0
        for d, m in sorted(mine, key=lambda x: (hashlib.md5(f"{mix.seed}:{epochs}:{x[0]}".encode()).hexdigest(), x)):
            upto += m
            if rest > 0 and upto <= rest:
                out.append((d, *leaf, m, epochs))
    return sorted(map(str, out))


@pytest.mark.parametrize("share,epochs,digits", [(0.6, 3, 4), (0.9, 1, 1), (2.5, 4, 0), (0.0, 2, 2)])
def test_against_brute_force(spark, share, epochs, digits, monkeypatch):
    monkeypatch.setattr(S, "CELL_DIGITS", digits)
    mix = S.Mix(weights={"domain": {"books": 4.0, "news": 0.0}, "lang": {"en": 2.0}, "source": {"src0": 0.5}}, share=share, max_epochs=epochs)
    data = rows()
    got = S.mixed(spark.createDataFrame(data, SCHEMA), mix)
    assert sorted(str((r["doc_id"], r["domain"], r["lang"], r["source"], r["n_tokens"], r["epoch"])) for r in got.collect()) == brute(data, mix)


def test_empty_table(spark):
    assert S.mixed(spark.createDataFrame([], SCHEMA), S.Mix()).count() == 0


def test_what_a_closed_subtree_cannot_take_goes_to_its_siblings(spark):
    data = [(i, "w " * 50, "xx", "src1", "x") for i in range(10)] + [(i, "w " * 50, "en", "src20", "x") for i in range(10, 20)]
    mix = S.Mix(weights={"lang": {"xx": 0.0}}, share=0.5, max_epochs=1)
    got = S.mixed(spark.createDataFrame(data, SCHEMA), mix).collect()
    assert sum(r["n_tokens"] for r in got) == 500 and {r["domain"] for r in got} == {"web"}


def test_mixed_documents_has_the_rows_that_mixed_has(spark):
    data = [(1, "one two three four five", "en", "src1", "x")] * 4
    df = spark.createDataFrame(data, SCHEMA)
    mix = S.Mix(share=0.5, max_epochs=1)
    assert S.mixed(df, mix).count() == 2 == S.mixed_documents(df, mix).count()
    mix, df = S.Mix(weights={"lang": {"en": 2.0}}, share=0.9, max_epochs=2), spark.createDataFrame(rows(), SCHEMA)
    key = lambda r: (str(r["doc_id"]), str(r["lang"]), str(r["source"]), r["epoch"])
    got = S.mixed_documents(df, mix)
    assert sorted(map(key, S.mixed(df, mix).collect())) == sorted(map(key, got.collect()))
    assert got.columns == ["doc_id", "text", "lang", "source", "epoch"]


def test_mixed_documents_passes_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "src1", "h", "r", "d")], "doc_id long, text string, lang string, source string, _h string, _row string, domain string")
    assert [tuple(r) for r in S.mixed_documents(df, S.Mix(share=1.0)).collect()] == [(1, "a b c d", "en", "src1", "h", "r", "d", 0)]
