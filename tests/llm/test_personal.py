"""Personal data: the base against Python's patterns, the method against cases made for it."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty_docs, hard_docs
from veritrail.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = [int(c) for c in re.sub("[^0-9]", "", hit)]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d * 2 > 9) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def written_out(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def card(rng):
    digits = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(d * 2 - 9 * (d * 2 > 9) if i % 2 == 0 else d for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def phone(rng):
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04d}"


HARD = [
    None, "", "a@b.c_d@e.f@g.h", "x@y", "a.b%c+d-e@f-g.h.i. z@q.", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.001 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (212) 555-0100 99 +12345678 +1-2-3",
    "é漢😀a@b.cc 😀+49 30 1234567😀 4111111111111111漢", "0" * 5000, "1.1." * 3000 + "1", "a" * 20000 + "@" + "b." * 4000 + "c", "+1" + " ()" * 3000, "@@..@a.b 1-1-1-1-1-1-1-1-1-1-1-1-1-1", "a@b.c" * 700,
]


def kind_of(i):
    """Items that run into a neighbour (3) and bracketed addresses (5) are rare."""
    return (3 if i % 90 == 3 else 5 if i % 90 == 5 else (0, 1, 2, 4)[i % 4])


@pytest.fixture(scope="module")
def corpus():
    """Documents with spaced items, items that run into a neighbour, and numbers that are none."""
    rng, docs, planted = random.Random(9), [], {}
    word = lambda: rng.choice(["harbour", "stone", "winter", "lamp", "river"])
    for i in range(900):
        kind = kind_of(i)
        parts = {0: [card(rng)], 1: [phone(rng)], 2: [f"{word()}{i}@mail{i % 7}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.7.9"], 3: [phone(rng), card(rng)], 4: ["".join(rng.choice("0123456789") for _ in range(16)), f"build {i}{rng.randrange(10**6)}"], 5: [f"{word()}{i} [at] mail{i % 7}.example [dot] com"]}[kind]
        text = " ".join(word() for _ in range(rng.randrange(3, 20)))
        docs.append((i, text + " " + " ".join(parts) + " " + word()))
        planted[i] = parts
    return docs, planted


@pytest.fixture(scope="module")
def model(spark, corpus):
    return personal.learned(spark.createDataFrame(corpus[0], "doc_id long, text string"))


def test_base_is_that_of_the_plain_patterns(spark, model):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab1234567890.@+- ()_é漢😀") for _ in range(rng.randrange(400))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in personal.report(personal.spans(docs, model)).collect()}
    for i, text in enumerate(texts):
        want = base(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(written_out(want).encode()).hexdigest(), (i, (text or "")[:80])
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert set(written_out(want).split(",")) <= set(rows[i]["spans"].split(","))


def test_method_adds_what_neighbours_hide_and_nothing_else(spark, corpus, model):
    docs, planted = corpus
    found = personal.spans(spark.createDataFrame(docs, "doc_id long, text string"), model)
    rows = {r["doc_id"]: r for r in personal.report(found).collect()}
    for i, text in docs:
        spans = {text[int(s) : int(e)] for _, s, e in (x.split(":") for x in rows[i]["spans"].split(",") if x)}
        if kind_of(i) < 4:
            assert set(planted[i]) <= spans, (i, spans)
        if kind_of(i) == 5:
            assert spans == set(planted[i])
        if kind_of(i) == 4:
            assert spans == {text[s:e] for _, s, e in base(text)}
    told = {r["doc_id"]: r["text"] for r in personal.redacted(found).collect()}
    assert told[3] == docs[3][1].replace(" ".join(planted[3]), "[phone] [card]")
    assert told[2] == docs[2][1].replace(" ".join(planted[2]), "[email] [ip]")
    assert told[5] == docs[5][1].replace(planted[5][0], "[email]")


def test_scores_in_expressions_are_those_of_the_trees(spark, model):
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(1)
    x = [tuple(rng.randrange(20) for _ in personal.FEATURES) for _ in range(50)]
    rows = spark.createDataFrame(x, ", ".join(f"{f} int" for f in personal.FEATURES)).select(F.struct(*personal.FEATURES).alias("c")).select(model.score(F.col("c"))).collect()
    assert np.allclose([r[0] for r in rows], model.of(np.array(x)))
    assert len(model.trees) == personal.TREES


def test_pooling_makes_scores_monotone():
    import numpy as np

    score = np.array([0.1, 0.2, 0.3, 0.4])
    assert personal.calibrated(score, np.array([100.0] * 4), np.array([0.0, 95.0, 80.0, 100.0])) == 0.4
    assert personal.calibrated(score, np.array([100.0] * 4), np.array([0.0, 95.0, 97.0, 100.0])) == 0.2
    assert personal.calibrated(score, np.array([5.0] * 4), np.array([0.0, 5.0, 5.0, 5.0])) is None


def test_hard_documents(spark, model):
    docs = hard_docs(spark)
    own = personal.learned(docs)
    assert own.least == [None] * 4
    rows = personal.report(personal.spans(docs, model)).collect()
    assert len(rows) == 10 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert personal.report(personal.spans(empty_docs(spark), personal.learned(empty_docs(spark)))).collect() == []


def test_plan_has_no_python(spark, model, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = personal.report(personal.spans(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_no_description_is_left_out_of_learning(spark, corpus, model, monkeypatch):
    """However many descriptions there are, the trees are fitted on the candidates of all of them."""
    monkeypatch.setattr(personal, "MOST", 3, raising=False)
    fitted = []
    monkeypatch.setattr(personal, "boosted", lambda x, n, right, of=personal.boosted: fitted.append(n.sum()) or of(x, n, right))
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    assert personal.learned(docs) == model
    every = personal.proposed(docs).select(F.inline("candidates")).where("fold <> 0").count()
    assert fitted == [every] and every > 100
