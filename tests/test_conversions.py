"""Conversion tables under content addresses."""

import hashlib
from decimal import Decimal

from veritrail.operators import conversions

RULES = "version int, quantity string, unit string, base string, scale string, offset string"


def test_values_are_converted_by_the_table_that_they_cite(spark):
    rules = spark.createDataFrame([(1, "p", "atm", "Pa", "101325", "0"), (1, "T", "C", "K", "1", "273.15"), (2, "p", "atm", "Pa", "101326", "0"), (2, "p", "atm", "Pa", "101326", "0")], RULES)
    aliases = spark.createDataFrame([(1, "T", "degC", "C")], "version int, quantity string, spelling string, unit string")
    made = {r["version"]: r for r in conversions.addressed(rules, aliases).collect()}
    assert made[1]["payload"].startswith('{"aliases":[{"quantity":"T","spelling":"degC","unit":"C"}],"rules":[{"base":"K"')
    assert all(r["table_sha"] == hashlib.sha256(r["payload"].encode()).hexdigest() for r in made.values()) and len(made) == 2
    stored = [(r["table_sha"], r["payload"]) for r in made.values()] + [("f" * 64, made[1]["payload"]), (hashlib.sha256(b"{}").hexdigest(), "{}"), (made[1]["table_sha"], made[1]["payload"]), ("a", None)]
    got_rules, got_aliases, problems = conversions.read(spark.createDataFrame(stored, "table_sha string, payload string"))
    assert sorted(r["problem"] for r in problems.collect()) == ["not_a_table", "wrong_address", "wrong_address"] and got_rules.count() == 3
    one, two = made[1]["table_sha"], made[2]["table_sha"]
    rows = [(1, one, "p", "atm", "2"), (2, two, "p", " atm\n", "2"), (3, one, "T", "degC", "20.5"), (4, two, "T", "C", "1"), (5, "f" * 64, "p", "atm", "1"), (6, one, "p", "ATM", "1"), (7, one, "p", "atm", None), (8, None, "p", "atm", "1")]
    values = spark.createDataFrame([(i, t, q, u, v and Decimal(v)) for i, t, q, u, v in rows], "i int, table_sha string, quantity string, unit_raw string, value decimal(18,6)")
    found = {r["i"]: (r["status"], r["in_base"] and float(r["in_base"])) for r in conversions.converted(values, got_rules, got_aliases).collect()}
    assert found == {1: ("converted", 202650.0), 2: ("converted", 202652.0), 3: ("converted", 293.65), 4: ("unknown_unit", None), 5: ("unknown_table", None), 6: ("unknown_unit", None), 7: ("no_value", None), 8: ("unknown_table", None)}
