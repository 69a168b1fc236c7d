"""Token shapes, answer spans and staged template matches against golden rows and brute force."""

import random

import pytest

from quire.operators import matching as M
from quire.operators import spans as P
from quire.sources import shapes as N


def test_shapes(spark):
    payloads = [
        '{"token_text": "a", "bbox_x0": 0.1, "bbox_y0": "0.2", "bbox_x1": 0.3, "bbox_y1": 0.4, "confidence": 0.9, "line_number": 3}',
        '{"text": "b", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "confidence": 0.5}',
        '{"text": "c", "x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": 0.4, "confidence": 1, "line_number": 2}',
        '{"token_text": "d", "confidence": null}', '{"text": "", "x0": 1}', "{broken", "[1, 2]", '{"word": "x"}', '{"text": "e", "x0": "left"}', None, '"text"',
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    got = [tuple(r) for r in N.normalised(df).orderBy("id").collect()]
    none = (None,) * 8
    assert got == [
        (0, "a", 0.1, 0.2, 0.3, 0.4, 0.9, 3, "stored", None), (1, "b", 1.0, 2.0, 3.0, 4.0, 0.5, 0, "detected", None), (2, "c", 0.1, 0.2, 0.3, 0.4, 1.0, 2, "flat", None),
        (3, "d", 0.0, 0.0, 0.0, 0.0, 0.0, 0, "loose", None), (4, "", 1.0, 0.0, 0.0, 0.0, 0.0, 0, "flat", None), (5, *none, "no json"), (6, *none, "no object"), (7, *none, "no text"),
        (8, *none, "no number"), (9, *none, "no json"), (10, *none, "no object"),
    ]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def span(words, answer):
    words, a = [w.lower() for w in words], " ".join(answer.split()).lower()
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    if a in " ".join(words):
        c = " ".join(words).find(a)
        place = lambda c: next(i for i, w in enumerate(words) if starts[i] <= c <= starts[i] + len(w))
        return place(c), place(c + len(a) - 1), 0
    n, found = len(a.split()), []
    for i in range(len(words)):
        for m in {max(n - 1, 1), n, n + 1}:
            if i + m <= len(words) and (d := edits(" ".join(words[i : i + m]), a)) <= len(a) // 5:
                found.append((d, i, i + m - 1))
    return (min(found)[1], min(found)[2], min(found)[0]) if found else None


def test_answer_spans(spark):
    r = random.Random(2)
    vocabulary = ["Anna", "Smith", "member", "ID:12", "0l/02/1980", "of", "Birth", "x", "provider", "Smyth"]
    pages = {p: [r.choice(vocabulary) for _ in range(r.randint(1, 40))] for p in range(12)}
    words = spark.createDataFrame([(p, i, w) for p, ws in pages.items() for i, w in enumerate(ws)], "page_id long, place int, text string")
    answers = ["anna  smith", "Anna Smithe", "01/02/1980", "12", "provider of Birth", "ember", "nowhere at all", "", "  "]
    labels = spark.createDataFrame([(p, f"f{k}", a) for p in (*pages, 99) for k, a in enumerate(answers)], "page_id long, field_key string, answer string")
    got = {(x.page_id, x.answer): (x.first, x.last, x.distance) for x in P.answer_spans(words, labels).collect()}
    assert got == {(p, a): s for p, ws in pages.items() for a in answers if a.strip() and (s := span(ws, a))} and any(v[2] for v in got.values())


def test_text_spans_shuffle_no_words(spark):
    r = random.Random(4)
    vocabulary = ["Anna", "Smith", "member", "ID:12", "0l/02/1980", "of", "Birth", "x", "provider", "Smyth"]
    pages = {p: [r.choice(vocabulary) for _ in range(r.randint(0, 40))] for p in range(12)}
    text = {p: "\n" + " \t".join(ws) + " " for p, ws in pages.items()} | {99: None}
    answers = ["anna  smith", "Anna Smithe", "01/02/1980", "12", "provider of Birth", "ember", "nowhere at all", "", "  ", None]
    asked = spark.createDataFrame([(p, f"f{k}", a, t) for p, t in text.items() for k, a in enumerate(answers)], "page_id long, field_key string, answer string, text string")
    found = P.text_spans(asked)
    got = {(x.page_id, x.answer): (x.first, x.last, x.distance) for x in found.collect()}
    assert got == {(p, a): s for p, ws in pages.items() for a in answers if a and a.strip() and (s := span(ws, a))} and any(v[2] for v in got.values())
    rows = P.rows_of(found, {f"f{k}": ("What?", "Which?") for k in range(len(answers))})
    assert len(rows.collect()) == 2 * len(got) and "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_n21_shuffles_no_texts(spark):
    from quire.plans.drivers import n21_answer_spans

    df = n21_answer_spans(spark, "/root/testdata/sf0.001")
    assert df.count() and "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_hold_the_span(spark):
    spans = spark.createDataFrame([(1, "f", "a", x, x + n, 0) for x in range(0, 900, 13) for n in (0, 5, 380, 400)], "page_id long, field_key string, answer string, first long, last long, distance int")
    rows = P.windows(spans).collect()
    assert all(0 <= r.start <= r.end < P.WINDOW and r.start + r.window * P.STRIDE == r["first"] for r in rows)
    assert {r["last"] - r["first"] for r in rows} == {0, 5, 380}
    words = spark.createDataFrame([(1, i, f"w{i}") for i in range(600)], "page_id long, place int, text string")
    labels = spark.createDataFrame([(1, "f", "w500 w501")], "page_id long, field_key string, answer string")
    out = P.training_rows(words, labels, {"f": ("What?", "Which?")}).collect()
    assert len(out) == 2 and all(r.window * P.STRIDE + r.start == 500 and r.end - r.start == 1 for r in out)


def brute(pages, samples, orb):
    def one(job, hint, wider, stricter, boost):
        pairs = []
        for _, n, h, _ in (p for p in pages if p[0] == job):
            for s, v, payer, sh, thr, least, inl in samples:
                if h is not None and sh is not None and (not hint or payer == hint):
                    d = ((h ^ sh) & ((1 << 64) - 1)).bit_count()
                    if d <= int(thr * wider):
                        pairs.append((d, n, s, v, thr, least, inl))
        best = None
        for d, n, s, v, thr, least, inl in sorted(pairs)[:8]:
            if (job, n, s) in orb:
                o, inliers = orb[job, n, s]
                score = 0.7 * o + 0.3 * max(1 - d / (2 * thr), 0)
                if inliers >= int(inl * stricter) and score >= least + boost and (best is None or score > best[0]):
                    best = (score, v, s, n, d)
        return best

    out = {}
    for job in {p[0] for p in pages}:
        hint = next(p[3] for p in pages if p[0] == job)
        hint = hint if any(s[2] == hint for s in samples) else None
        got, wide = one(job, hint, 1.0, 1.0, 0.0), False
        if not got and hint:
            got, wide = one(job, hint, M.WIDER, M.STRICTER, M.BOOST), True
        if got:
            out[job] = (*got[1:4], round(got[0], 9), got[4], wide)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_staged_matches(spark, seed):
    r = random.Random(seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(6)]

    def near(k):
        x = r.choice(base)
        for b in r.sample(range(64), k):
            x ^= 1 << b
        return signed(x)

    samples = [(s, s // 2, r.choice(["A", "B", None]), near(r.randint(0, 2)), 6, 0.4, 10) for s in range(12)] + [(90, 45, "A", None, 6, 0.4, 10)]
    pages = []
    for job in range(60):
        hint = r.choice(["A", "B", "Z", None])
        pages += [(job, n, near(r.randint(0, 14)) if r.random() < 0.95 else None, hint) for n in range(1, 4)]
    orb = {(p[0], p[1], s[0]): (r.random(), r.randint(5, 25)) for p in pages for s in samples if r.random() < 0.7}
    got = M.matched(
        spark.createDataFrame(pages, "job_id long, page_number int, hash long, payer_hint string"),
        spark.createDataFrame(samples, "sample_id long, version_id long, payer string, hash long, phash_threshold int, min_score double, orb_min_matches int"),
        spark.createDataFrame([(*k, *v) for k, v in orb.items()], "job_id long, page_number int, sample_id long, orb_score double, inliers int"),
    )
    rows = {x.job_id: (x.version_id, x.sample_id, x.page_number, round(x.score, 9), x.distance, x.wide) for x in got.collect()}
    want = brute(pages, samples, orb)
    assert rows == want and {w[-1] for w in want.values()} == {True, False}


def test_objects_and_what_is_none(spark):
    payloads = [' \t\r\n{"text": "a", "x0": "1e1"}', "{}", ' [{"text": "a"}]', '{"text": "a", "x0": true}', '{"text": "a", "bbox": "left"}', '{"text": 1.10}', '{"text": "a", "text": "b"}', '{"text": "a", "bbox": {"y1": "?"}}', "", " ", "null"]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    got = [(r.text, r.x0, r["shape"], r.reason) for r in N.normalised(df).orderBy("id").collect()]
    none = (None,) * 3
    assert got[0] == ("a", 10.0, "flat", None) and got[5][0] == "1.1"
    assert got[1] == (*none, "no text") and got[2] == (*none, "no object") and got[3] == (*none, "no number") and got[4] == ("a", 0.0, "loose", None)
    assert got[6] == (*none, "no json") and got[7] == (*none, "no number") and [g[3] for g in got[8:]] == ["no json", "no json", "no object"]


def test_records_are_read_by_compiled_code(spark):
    plan = N.normalised(spark.range(1).selectExpr("id", "'{}' AS payload"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "schema_of_variant" not in plan


def test_tokens_are_dealt_by_page(spark):
    from quire.plans.drivers import n1_token_shapes

    plan = n1_token_shapes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of texts; tokens are not shuffled
