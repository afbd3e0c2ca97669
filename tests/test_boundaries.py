"""Units and numbers that are pieces of something longer."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veritrail.functions import places
from veritrail.operators import boundaries

UNIT_CASES = [
    # text, quote, quantity, value span, violation
    ("T = 1023 K", "K", "temperature", None, None),
    ("T [K] 1023", "K", "temperature", None, None),
    ("T (K) 1023", "K", "temperature", None, None),
    ("T = 1023K", "K", "temperature", None, "unit_digit_glue_no_value_span"),
    ("T = 1023K", "K", "temperature", (4, 8), None),
    ("T = 1023K", "K", "temperature", (4, 7), "unit_digit_glue_value_span_mismatch"),
    ("T = 1023K", "K", "temperature", (8, 8), "unit_digit_glue_value_span_malformed"),
    ("T = 1023K", "K", "temperature", (4, 99), "unit_digit_glue_value_span_malformed"),
    ("T = 1023K", "K", "temperature", (5, 8), "unit_digit_glue_value_span_not_clean_numeral"),
    ("p = 2 kbar", "bar", "pressure", None, "unit_leading_not_maximal"),
    ("p = 2 §bar", "bar", "pressure", None, "unit_leading_unclassified_char"),
    ("p = 2 bar(a)", "bar", "pressure", None, "unit_trailing_unclassified_char"),
    ("T = 1023 K*", "K", "temperature", None, None),
    ("T = 1023 K*cm", "K", "temperature", None, "unit_trailing_not_maximal"),
    ("T = 1023 K¹", "K", "temperature", None, "unit_trailing_exponent_or_footnote_ambiguous"),
    ("V = 3 cm³", "cm", "length", None, "unit_trailing_exponent_or_footnote_ambiguous"),
    ("t = 3 s−1", "s", "time", None, "unit_trailing_not_maximal"),
    ("u = 10 furlong", "furlong", "length", None, "unit_not_in_vocabulary"),
    ("u = 10 bar", "bar", "length", None, "unit_not_in_vocabulary"),
    ("u = 10 cm s^-1", "cm", "length", None, "unit_not_maximal_forward"),
    ("u = 10 cm  \n s^-1", "cm", "length", None, "unit_not_maximal_forward"),
    ("u = 10 cm s^-1", "cm s^-1", "velocity", None, None),
    ("T = 10 deg  C", "C", "temperature", None, "unit_not_maximal_backward"),
    ("", "", "temperature", None, "unit_not_in_vocabulary"),
]


def test_units(spark):
    rows = [(i, t, t.rindex(q), t.rindex(q) + len(q), k, *(v or (None, None)), w or "") for i, (t, q, k, v, w) in enumerate(UNIT_CASES)]
    rows.append((99, None, 0, 1, "length", None, None, ""))
    spans = spark.createDataFrame(rows, "n int, text string, start int, end int, quantity string, value_start int, value_end int, want string")
    got = boundaries.unit_violations(spans).collect()
    assert len(got) == len(rows)
    assert [(r["n"], r["text"], r["violation"] or "") for r in got if (r["violation"] or "") != r["want"]] == []


def test_constructs_hold_their_pieces(spark):
    text = "at 307 6 10 K, from 1000 - 1200 or 1000-1200, k = 3.94 x 10 03 s, alone 77, 5 –6 6 7" + " pad" * 40 + " 8 6 9"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spans = [(1, m.start(), m.end(), m.group()) for m in re.finditer(r"[0-9.]*[0-9]", text)] + [(1, text.index("307"), text.index(" K"), "whole"), (2, 0, 1, "x"), (None, 0, 1, "y")]
    rows = boundaries.enclosed(spark.createDataFrame(spans + spans[:1], "doc_id long, start int, end int, hit string"), boundaries.constructs(docs)).collect()
    assert len(rows) == len(spans) + 1
    of = {(r["hit"], r["start"]): r["construct"] for r in rows}
    at = lambda s, k=0: (s, text.index(s, k))
    assert of[at("307")] == of[at("10")] == "ascii6_uncertainty" and of[("whole", text.index("307"))] is None
    assert of[at("1200")] == "spaced_range" and of[at("3.94")] == of[at("03")] == "flattened_scientific" and of[at("77")] is None
    assert of[("8", len(text) - 5)] == "ascii6_uncertainty" and of[("x", 0)] is None and of[("y", 0)] is None


def test_spans_meet_constructs_without_a_join(spark):
    rng = random.Random(3)
    docs = [(i % 5, "".join(rng.choice(["6", "12", "x 10", " - ", " ", " 6 ", "-", "; "]) for _ in range(rng.randrange(60)))) for i in range(12)] + [(None, "7 6 7"), (9, None)]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    found = boundaries.constructs(texts)
    spans = [(k, a, a + n) for k in (0, 1, 2, 3, 4, None) for a in range(0, 70, 2) for n in (1, 2, 5)]
    got = boundaries.enclosed(spark.createDataFrame(spans, "doc_id long, start int, end int"), found)
    at = [tuple(r) for r in found.collect()]
    first = lambda k, a, b: min(((p, c) for key, p, c, x, y in at if key == k and k is not None and x <= a and y >= b and (x < a or y > b)), default=(0, None))[1]
    want = sorted(((*s, first(*s)) for s in spans), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len({w[3] for w in want}) == 4
    matches = boundaries.enclosed_matches(texts, "[0-9]+")
    numbers = [(k, m.start(), m.end()) for k, t in docs if t for m in re.finditer("[0-9]+", t)]
    assert sorted((tuple(r) for r in matches.collect()), key=str) == sorted(((*s, first(*s)) for s in numbers), key=str)
    assert not any("Join" in df._jdf.queryExecution().executedPlan().toString() for df in (got, matches))


@pytest.mark.parametrize("pattern", [r"a+", r"[0-9]+", r"b|c"])
def test_places_are_those_of_the_matches(spark, pattern):
    rng = random.Random(7)
    texts = ["", None, "a", "aba" * 3000, "é😀a漢12"] + ["".join(rng.choice("ab1c😀é ") for _ in range(rng.randrange(900))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", places.found(F.col("text"), pattern).alias("at")).collect()
    for n, at in rows:
        want = None if texts[n] is None else [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, texts[n])]
        assert (None if at is None else [tuple(m) for m in at]) == want
