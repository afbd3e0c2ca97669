import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.functions import canonical, chem, numerals, text, units, web


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def apply(df, expression):
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB ﬁ-\n\tß漢①é é")))
def test_offsets_point_at_the_source_of_each_character(t):
    made, offsets = text.fold_with_map(t)
    offsets = offsets.tolist()
    assert len(made) == len(offsets) and offsets == sorted(offsets) and all(0 <= o < len(t) for o in offsets)
    assert made == made.strip() and "  " not in made and "\n" not in made
    for c, o in zip(made, offsets, strict=True):
        assert c == " " or c in unicodedata.normalize("NFKC", t[o]).casefold() or t[o] in text.LIGATURES


def test_normalization_joins_broken_words_and_expands_ligatures(spark):
    df = column(spark, ["combus-\n tion ﬂame", " A B ", "STRASSE Straße", "end-\n", None, ""])
    made = apply(df, text.normalized_with_map(F.col("x")))
    assert [m.text if m else None for m in made] == ["combustion flame", "a b", "strasse strasse", "end-", None, ""]
    span = df.where("i = 0").select(text.raw_span(text.normalized_with_map("x").offsets, F.lit(0), F.lit(10), F.length("x")).alias("s")).first().s
    assert (span.start, span.end) == (0, 13)


def test_spacing_and_readability(spark):
    lost, fine = "averyveryverylongtoken " * 200, "a short word " * 200
    df = spark.createDataFrame([(0, lost, "pdf:x", 3), (1, fine, "plain", None), (2, "", "plain", None), (3, "tiny", "pdf:x", 9), (4, fine, "pdf:unavailable", 1), (5, None, "plain", 1)], "i long, x string, e string, p int")
    assert apply(df, text.unreadable_reason(F.col("x"), F.col("e"), F.col("p"))) == ["spacing_lost", None, "no_text", "no_text_layer", "no_extractor", "no_text"]


def test_names_and_identifiers(spark):
    df = column(spark, ["https://doi.org/10.1/ABC", "doi:10.2/x", "10.3/y z", "isbn 1", None])
    assert apply(df, text.normalized_doi(F.col("x"))) == ["10.1/abc", "10.2/x", "10.3/y z", None, None]
    assert apply(df, text.doi_prefix(F.col("x"))) == ["10.1", "10.2", "10.3", None, None]
    assert apply(column(spark, ["Smith, J.", "Jane van Doe", "Plato"]), text.surname(F.col("x"))) == ["Smith", "Doe", "Plato"]
    assert apply(column(spark, ["a.si", "a.si.12", "a", "b.si.x"]), text.supplement_ordinal(F.col("x"))) == [None, 12, None, None]
    index = spark.createDataFrame([(0, {"world": [1, 3], "hello": [0], "big": [2]})], "i long, x map<string, array<int>>")
    assert apply(index, text.abstract_from_index(F.col("x"))) == ["hello world big world"]
    assert apply(column(spark, ["http://a/(b)", "javascript:x"]), text.safe_url(F.col("x"))) == ["http://a/%28b%29", None]


CASES = [
    ("1.50", "scalar", "1.50", 1.5, None), ("/C0 3", "scalar", "-3", -3.0, None), ("−4", "scalar", "-4", -4.0, None), ("7.000Eþ17", "scalar", "7.000e+17", 7e17, None),
    ("10-20", "range", None, None, None), ("20–10", "unresolvable", None, None, "bounds_reversed"), ("1e400", "unresolvable", "1e+400", None, "value_not_finite"), ("", "unresolvable", None, None, "empty"),
    ("NaN", "unresolvable", None, None, "not_finite_literal"), ("1_000", "unresolvable", None, None, "digit_separator"), ("307 6 10", "unresolvable", None, None, "possible_plus_minus"),
    ("5 %", "unresolvable", None, None, "not_a_clean_numeral"), ("1e2.5", "unresolvable", None, None, "decimal_exponent"), ("1e-7", "scalar", "1e-7", 1e-7, None), (" 2 ", "scalar", "2", 2.0, None),
    ("1e-7-2e-7", "range", None, None, None), ("5-x", "unresolvable", None, None, "high_bound_not_a_clean_numeral"),
]


def test_numerals(spark):
    df = column(spark, [c[0] for c in CASES])
    assert [(p.kind, p.text, p.value, p.reason) for p in apply(df, numerals.parsed(F.col("x")))] == [c[1:] for c in CASES]
    assert apply(df.limit(1), numerals.parsed(F.lit("/C0 3"))["repairs"]) == [["slash_c0_to_minus"]]
    quarantined = numerals.parsed(F.lit("12e5"), F.lit(True), F.lit(True))
    assert apply(df.limit(1), quarantined["reason"]) == ["quarantined_bare_exponent"]


def test_candidates_keep_ranges_whole_and_leave_labels_alone(spark):
    df = column(spark, ["H2O at 1000-1200 K, run 3a: −5.2e3 and 1,000 or 1023K"])
    assert apply(df, numerals.candidates(F.col("x"))) == [["1000-1200", "−5.2e3"]]
    assert apply(df, numerals.extents(F.col("x"))) == [["1000-1200", "3", "−5.2e3", "1023"]]


UNITS = [
    ("25", "temperature", "C", "298.15", "298"), ("1.50", "pressure", "atm", "151987.50", "1.52E+5"), ("12.5", "length", "cm", "0.125", "0.125"), ("2.5", "length", "mm", "0.0025", "0.0025"),
    ("300", "temperature", "K", "300", "300"), ("5", "pressure", "torr", None, None), ("abc", "length", "cm", None, None), ("0.125", "mole_fraction", "%", "0.00125", "0.00125"),
]


def test_conversion_is_exact_and_rounds_by_significance(spark):
    rows = units.converted(spark.createDataFrame([(i, *u[:3]) for i, u in enumerate(UNITS)], "i long, value string, quantity string, unit string")).orderBy("i").collect()
    for r, u in zip(rows, UNITS, strict=True):
        assert (None if r.exact is None else Decimal(r.exact), None if r.rounded is None else Decimal(r.rounded)) == (u[3] and Decimal(u[3]), u[4] and Decimal(u[4]))
    assert [rows[5].status, rows[6].status] == ["no_rule", "not_canonical"]


def test_spellings_and_what_they_may_mean(spark):
    known = {r.spelling: r.quantities for r in units.quantities_of(spark).collect()}
    assert known["%"] == ["mass_fraction", "mole_fraction", "relative_uncertainty"] and known["K"] == ["temperature"]
    rows = units.normalized_units(spark.createDataFrame([("time", " μs "), ("time", "US")], "quantity string, unit_raw string")).collect()
    assert {(r.unit_raw, r.unit, r.unit_status) for r in rows} == {(" μs ", "us", "known"), ("US", None, "unknown_unit")}


def test_canonical_text(spark):
    df = column(spark, ["1.500", "01.5", "1e3", "x", "1" * 1200, None, "-0"])
    assert apply(df, canonical.canonical_decimal(F.col("x"))) == ["1.500", "1.5", "1E+3", None, None, None, "-0"]
    df = column(spark, ['{"b":1,"a":null}', '{"a":1.5}', "[1", '{"é":[true,"x"]}', None])
    assert apply(df, canonical.canonical_json(F.col("x"))) == ['{"a":null,"b":1}\n', None, None, '{"é":[true,"x"]}\n', None]


def test_hosts_and_secrets(spark):
    df = spark.createDataFrame([(0, "https://a.Example.com./x"), (1, "https://notexample.com"), (2, "ftp://u@example.com:21/"), (3, None), (4, "x")], "i long, url string")
    hosts = spark.createDataFrame([("example.com",)], "host string")
    assert [r.admissible for r in web.admissible(df, hosts).orderBy("i").collect()] == [True, False, True, False, False]
    assert apply(df, web.is_safe_url(F.col("url"))) == [True, True, False, False, False]
    assert apply(column(spark, ["8.8.8.8", "10.0.0.1", "::1", "x", None]), web.is_global("x")) == [True, False, False, False, None]
    df = column(spark, ['{"api_key":"v","n":[{"x":"sk-abcdef123"}],"ok":"plain"}', "no json", '"Abcdefghij0123456789xyz"'])
    assert apply(df, web.redacted_json("x")) == ['{"api_key": "[REDACTED]", "n": [{"x": "[REDACTED]"}], "ok": "plain"}', None, '"[REDACTED]"']
    kept = web.provenance(spark.createDataFrame([("r", "secret prompt", "sk-abcdef12345")], "run_id string, prompt string, model_name string"))
    assert kept.columns == ["run_id", "model_name"] and kept.first().model_name == "[REDACTED]"


def test_structures_without_their_library(spark):
    pytest.importorskip("pandas")
    made = apply(column(spark, ["C", None]), chem.structure("x"))
    assert all(m.available in (True, False) for m in made) and all(m.canonical is None for m in made if not m.available)


def test_slugs_strip_white_space_of_any_kind(spark):
    df = column(spark, ["On Flames", "On Flames\n", "\t\u00a0On Flames \x1c", " On Flames "])
    assert len(set(apply(df, text.slug(F.lit(None).cast("string"), F.col("x"))))) == 1
