"""Anchors that evidence must hold, and joins of numbers within a tolerance."""

import math
import random

from pyspark.sql import functions as F

from veritrail.operators import anchors


def unmet(spark, window, required):
    rows = spark.createDataFrame([(1, window, required)], "claim_id int, window string, required array<array<string>>")
    return anchors.unmet(rows).first()["missing"]


def test_numbers_are_met_by_value(spark):
    window = "At 1200 K, 1.0e3 Pa; −5; 10-20 bar and 2e50%CO; zero 0. INFINITE Shock-Tube data (st)."
    cases = [
        (["1200.0"], True), (["1.2e3"], True), (["1000"], True), (["-5"], True), (["10-20"], True), (["10-30"], False), (["0"], True), (["1e-12"], False), (["2e50"], False), (["120"], False),
        (["inf"], False), (["nan"], False), (["0.6e1.0"], False), (["1_200"], False), (["infinite"], True), (["shock-tube  data"], True), (["jsr"], False), (["jsr", "st"], True), (["jsr", "dat"], False),
    ]
    got = unmet(spark, window, [a for a, _ in cases])
    assert got == [" | ".join(a) for a, met in cases if not met]
    assert unmet(spark, window, []) == ["no_anchor"] and unmet(spark, window, None) == ["no_anchor"] and unmet(spark, None, [["a"]]) == ["a"]


def test_values_are_those_of_parsed_spans(spark):
    """What is read without ``numerals.parsed`` is what that gives; numbers may share a percent sign; a window is read once."""
    from veritrail.functions import numerals, places

    rng = random.Random(11)
    parts = ["1", "20", "3.50", "007", "-", "–", "−", "+", "%", "%%", " ", "e5", "E-3", ".", ",", "/C0 ", "x", "٣", "9" * 320]
    texts = ["1e5%2e5%3", "2e5%7%8e2", "10-2 2-10 3–4 4–3", "1-2\n", "Inf", "-nan", "2e5", "1.5E-3", "1e400", "12e+99", None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)

    def plainly(window):
        beside = lambda m: (F.substr(window, m["start"], F.when(m["start"] > 0, 1).otherwise(0)) == "%") | (F.substr(window, m["end"] + 1, F.lit(1)) == "%")
        kept = F.filter(places.found(window, f"(?U){numerals.CANDIDATE}"), lambda m: ~(F.contains(F.lower(m["hit"]), F.lit("e")) & beside(m)))
        return F.flatten(F.transform(kept, lambda m: places.let(numerals.parsed(m["hit"]), anchors._bounds)))

    text = F.col("text")
    got = rows.select("n", anchors.values_in(text).alias("a"), plainly(text).alias("b"), anchors.bounds(text).alias("c"), anchors._bounds(numerals.parsed(text)).alias("d")).collect()
    assert [(texts[r["n"]], r["a"], r["b"], r["c"], r["d"]) for r in got if r["a"] != r["b"] or r["c"] != r["d"]] == []
    flags = [F.lit(True), F.lit(True)]
    flagged = rows.select("n", anchors.bounds(text, *flags).alias("c"), anchors._bounds(numerals.parsed(text, *flags)).alias("d")).collect()
    assert [texts[r["n"]] for r in flagged if r["c"] != r["d"]] == [] and {texts[r["n"]]: r["c"] for r in flagged}["2e5"] == []
    assert {r["n"]: r["a"] for r in got}[0] == [3.0] and sum(bool(r["a"]) for r in got) > 100
    claims = spark.createDataFrame([(1, "1 2", [["1"], ["1-2"], ["a", "b"]])], "claim_id int, window string, required array<array<string>>")
    plan = anchors.unmet(claims)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(numerals.CANDIDATE) == 1


FIELDS = """category string, observable_raw string, reactor_type string, measured array<struct<value: double, unit: string>>, species array<string>, temperature_range_K array<double>,
    pressure_range_bar array<double>, equivalence_ratio_range array<double>, residence_time_s double, apparatus string, n_data_points int, level_of_theory string, result struct<value: double, unit: string>,
    reaction_label string, property string, software string, model_name string, n_species int, n_reactions int, mechanism_url string, fuel_species array<string>, validation_targets array<string>"""


def test_required_anchors_by_category(spark):
    names = [f.name for f in spark.createDataFrame([], FIELDS).schema]
    experiment = dict(category="experimental_benchmark", observable_raw="delay", reactor_type="rcm", measured=[(1.5, "ms"), (2.0, "s")], species=["H2", "CO"], temperature_range_K=[900.0, 1200.0], n_data_points=7)
    computed = dict(category="qm_calculation", level_of_theory="CCSD(T)", result=(3.5, "kJ"), species=["OH"], reaction_label="R1", property="entropy")
    model = dict(category="prior_model", model_name="GRI", n_species=53, fuel_species=["CH4"], validation_targets=["flame"])
    rows = [experiment, dict(experiment, species=[]), dict(experiment, measured=None), computed, dict(computed, species=None, reaction_label=""), dict(computed, property="other"), model, dict(model, n_species=None), dict(category=None)]
    frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS).select(anchors.required(F.struct(*names)).alias("r"))
    got = [r["r"] for r in frame.collect()]
    rcm = ["rapid compression machine", "rcm"]
    assert got[0] == [["delay"], rcm, ["1.5"], ["ms"], ["2.0"], ["s"], ["H2"], ["CO"], ["900.0"], ["1200.0"], ["7"]]
    assert got[1] == got[2] == got[4] == got[7] == got[8] == []
    assert got[3] == [["CCSD(T)"], ["3.5"], ["kJ"], ["OH", "R1"], ["entropy"]] and got[5] == got[3][:-1]
    assert got[6] == [["GRI"], ["53"], ["CH4"], ["flame"]]


def test_close_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(150)] + [0.0, 0.0, 1.0, 1.0 + 1e-9, 1.0 - 2e-9, 5e-324, float("nan"), float("inf")]
    other = [x * (1 + rng.choice([0, 9e-10, -9e-10, 1.1e-9, 3e-9])) for x in base] + [-x for x in base[:20]] + [None]
    left = spark.createDataFrame(list(enumerate(base)), "i int, x double")
    right = spark.createDataFrame([(j, y) for j, y in enumerate(other)], "j int, y double")
    got = sorted((r["i"], r["j"]) for r in anchors.close_pairs(left, right, "x", "y").select("i", "j").collect())
    close = lambda x, y: x == y == 0 or (x != 0 and y != 0 and math.isclose(x, y, rel_tol=1e-9))
    assert got == sorted((i, j) for i, x in enumerate(base) for j, y in enumerate(other) if y is not None and math.isfinite(x) and math.isfinite(y) and close(x, y))
