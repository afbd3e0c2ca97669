"""The walk over nested schemas, and the replay of envelopes made by hand."""

import pytest
from pyspark.sql import functions as F

from veritrail.operators import envelopes

REF = "struct<node_id: string, locator: struct<kind: string, start: int, end: int>>"
VALUE = f"struct<quantity_kind: string, raw_text: string, value_ref: {REF}, unit_raw: string, unit_ref: {REF}>"
SCHEMA = f"""id int, attribution string, attribution_ref {REF}, subject struct<label_raw: string, label_ref: {REF}, reason: string, reason_ref: {REF}>,
    scalar_claims array<struct<label_raw: string, label_ref: {REF}, value: {VALUE}, uncertainty: struct<kind: string, basis: string, scale: string, upper: {VALUE}, lower: {VALUE}>>>,
    categorical_claims array<struct<label_raw: string, label_ref: {REF}, token_raw: string, token_ref: {REF}>>,
    unextracted array<struct<label_raw: string, label_ref: {REF}, reason: string, statement_ref: {REF}>>"""
TEXT = "At T = 1023K and 11023 Pa the flame; shock tube; not given."


def ref(quote, node="n", start=None, kind="char_span"):
    at = TEXT.index(quote) if start is None else start
    return (node, (kind, at, at + len(quote)))


def claim(raw="1023", at=None, unit="K", quantity="temperature", label="T", node="n", uncertainty=None):
    value = (quantity, raw, ref(raw, node, at), unit, ref(unit, node, TEXT.index(unit, TEXT.index(raw) if at is None else at)))
    return (label, ref("T", start=TEXT.index("T =")), value, uncertainty and (*uncertainty, value, None))


def envelope(i, claims=(), categorical=(), unextracted=(), subject=("flame", None, None, None), attribution=None):
    subject = ("flame", ref("flame"), None, None) if subject[0] else subject
    return (i, "measured", attribution or ref("At"), subject, list(claims), list(categorical), list(unextracted))


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, "n", TEXT, None) for i in range(20)] + [(i, "bad", TEXT, "failed") for i in range(20)], "id int, node_id string, text string, problem string")


def replay(spark, nodes, *rows):
    frame = spark.createDataFrame(list(rows), SCHEMA)
    found = {}
    for r in envelopes.findings(frame, nodes, "id").collect():
        found.setdefault(r["id"], set()).add((r["path"], r["finding"], r["category"]))
    return {r["id"]: r for r in envelopes.replayed(frame, nodes, "id").collect()}, found


def test_replay(spark, nodes):
    reports, found = replay(
        spark, nodes,
        envelope(1, [claim()], [("T", ref("T", start=3), "shock tube", ref("shock tube"))]),
        envelope(2, [claim(raw="1023", at=TEXT.index("11023") + 1, unit="Pa", quantity="pressure")]),
        envelope(3, [claim(unit="K", quantity="pressure")]),
        envelope(4, [claim(node="lost")]),
        envelope(5, [claim(node="bad")]),
        envelope(6, [], [("X", ref("T", start=3), "tube", ("n", ("char_span", 50, 99)))], subject=(None, None, "ambiguous", ref("flame"))),
        envelope(7, subject=(None, None, "ambiguous", ref("flame", kind="figure"))),
        envelope(8, [], [], [("T", ref("T", start=3), "not_given", ref("not given"))]),
        envelope(9, [claim(uncertainty=("standard_deviation", "absolute", None))]),
        (10, None, None, None, None, [], None),
    )
    assert 1 not in found and reports[1]["evidence"] == "verified" and reports[1]["overall"] == "unverifiable" and reports[1]["n_claims"] == 1
    assert reports[1]["n_total"] == 7 and reports[1]["n_checked"] == 6 and reports[1]["n_unchecked"] == 0
    assert found[2] == {("scalar_claims[0].value.value_ref", "value_not_whole", "failed")}
    assert found[3] == {("scalar_claims[0].value.unit_ref", "unit_not_in_vocabulary", "failed")}
    assert {f[1:] for f in found[4]} == {("unknown_node", "unverifiable")} and reports[4]["evidence"] == "unverifiable"
    assert {f[1:] for f in found[5]} == {("node_problem", "failed")}
    assert found[6] == {("categorical_claims[0].label_ref", "differs", "failed"), ("categorical_claims[0].token_ref", "out_of_range", "failed"), ("", "nothing_checked", "unverifiable")}
    assert found[7] == {("", "nothing_checked", "unverifiable")} and reports[7]["n_support_only"] == 1 and reports[7]["n_claims"] == 2
    assert 8 not in found and reports[8]["n_claims"] == 2 and reports[8]["n_support_only"] == 2
    assert reports[9]["n_claims"] == 3 and 9 not in found
    assert found[10] == {("", "nothing_checked", "unverifiable")} and reports[10]["n_total"] == 0 and len(reports) == 10


def test_no_envelopes(spark, nodes):
    frame = spark.createDataFrame([], SCHEMA)
    assert envelopes.replayed(frame, nodes, "id").collect() == [] and envelopes.findings(frame, nodes, "id").collect() == []


def test_the_walk_reaches_arrays_in_arrays_and_maps(spark):
    kind = "struct<node_id: string, locator: string>"
    frame = spark.createDataFrame(
        [(1, [[("a", "x")], [], [("b", "x"), None]], {"k": ("c", "y")}, (("d", "z"), [("e", "w")]), "no"), (2, None, None, None, None)],
        f"id int, deep array<array<{kind}>>, named map<string, {kind}>, both struct<one: {kind}, some: array<{kind}>>, other string",
    )
    rows = envelopes.walked(frame, "id", envelopes.REF, envelopes.REF).collect()
    assert {(r["path"], r["node_id"]) for r in rows} == {("deep[0][0]", "a"), ("deep[2][0]", "b"), ("named[k]", "c"), ("both.one", "d"), ("both.some[0]", "e")}
    with pytest.raises(ValueError, match="holds a struct"):
        envelopes.walked(frame, "id", ("nothing",), ("nothing",))


def test_inventory_and_walk_are_reconciled(spark, nodes):
    """A reference that no inventory names is found; one that stands where the inventory looks is not."""
    frame = spark.createDataFrame([envelope(1, [claim()])], SCHEMA).withColumn("stray", F.col("attribution_ref"))
    rows = envelopes.unreconciled(frame, nodes, "id").collect()
    assert [(r["path"], r["finding"]) for r in rows] == [("stray", "never_named")]


def test_a_replay_reads_its_envelopes_once(spark, nodes):
    """Counts and claims come of one walk over the rows and one join with the nodes, and nothing is written on the way."""
    frame = spark.createDataFrame([envelope(1, [claim()])], SCHEMA)
    for df in (envelopes.replayed(frame, nodes, "id"), envelopes.claims(frame, nodes, "id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate inline") <= 2 and "Relation [" not in plan  # the envelopes and, in the replay, the vocabulary
    both = envelopes.semantic_claims(frame, nodes, "id").unionByName(envelopes.derived_claims(frame, "id"))
    assert sorted(map(repr, envelopes.claims(frame, nodes, "id").collect())) == sorted(map(repr, both.collect()))


def test_whole_numerals_as_extents_tell(spark):
    """One pass over the matches tells what their list tells, for every span of a text."""
    from veritrail.operators import boundaries

    texts = ["1.5e3 K and 12-14", "a7 7", "", "-3–4 5", "é 10 ± 2", None]
    spans = [(t, s, e) for t in texts for s in range(-1, len(t or "") + 1) for e in range(s, len(t or "") + 2)]
    frame = spark.createDataFrame(spans, "text string, s int, e int")
    listed = F.exists(boundaries.numeral_extents(F.col("text")), lambda n: (n["start"] == F.col("s")) & (n["end"] == F.col("e")))
    rows = frame.select("text", "s", "e", boundaries.whole_numeral(F.col("text"), F.col("s"), F.col("e")).alias("got"), listed.alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == [] and sum(bool(r["want"]) for r in rows) > 5


def test_references_meet_their_nodes_beside_the_envelope(spark, nodes):
    """No join or shuffle is of references, nothing is written on the way, and what the schema tells is not asked of each row."""
    frame = spark.createDataFrame([envelope(1, [claim()])], SCHEMA)
    for made in (envelopes.replayed, envelopes.findings, envelopes.claims):
        plan = made(frame, nodes, "id")._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert not any("node_id" in line for line in joins) and "Relation [" not in plan and "array_except" not in plan, made
    stray = envelopes.findings(frame.withColumn("stray", F.col("attribution_ref")), nodes, "id")
    assert {(r["path"], r["finding"]) for r in stray.collect()} == {("stray", "never_named")}


def test_many_nodes_on_shelves(spark):
    """Each of many nodes is found by its id, a lost one is not, and an id that stands twice is judged twice."""
    rows = [(1, f"n{k}", f"{TEXT} {k}", None) for k in range(300)] + [(1, "n7", "other", None), (1, None, TEXT, None)]
    many = spark.createDataFrame(rows, "id int, node_id string, text string, problem string")
    cited = [(f"{TEXT} {k}", (f"n{k}", ("char_span", 0, len(f"{TEXT} {k}"))), "tube", (f"lost{k}", ("char_span", 0, 4))) for k in range(300)]
    found = envelopes.checked_pairs(spark.createDataFrame([envelope(1, [], cited)], SCHEMA), many, "id").collect()
    labels = [r for r in found if r["path"].startswith("categorical") and r["path"].endswith("label_ref")]
    assert sorted(r["finding"] for r in labels if r["finding"]) == ["out_of_range"] and len(labels) == 301
    assert {r["finding"] for r in found if r["path"].endswith("token_ref")} == {"unknown_node"} and len(found) == 602


def test_lines_are_dealt_out_once(spark, sf):
    """Envelopes are made where their lines were dealt to: neither they nor their nodes are shuffled again."""
    from veritrail.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["condition_set_claims"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange " in line]
    assert sum("REPARTITION_BY_NUM" in line for line in shuffles) == 2 and len(shuffles) <= 4
