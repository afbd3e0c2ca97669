"""Steps whose tables grow: the same results, with less held, sent and repeated."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import dedupe, diagnostics, inventories, series
from veritrail.sources import tables


def test_rings_end_once_nothing_is_lost(spark, monkeypatch):
    rounds, stored = [], tables.stored
    monkeypatch.setattr(dedupe.tables, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    # a ring of 100 with a tail of 5, a node on itself, a chain that leads out
    edges = [(n, (n + 1) % 100) for n in range(100)] + [(200 + n, 201 + n if n < 4 else 7) for n in range(5)] + [(300, 300), (400, 401), (401, 402)]
    found = dedupe.on_rings(spark.createDataFrame(edges, "node long, next long"))
    assert sorted(r["node"] for r in found.collect()) == [*range(100), 300]
    assert len(rounds) <= 5
    assert dedupe.on_rings(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "node long, next long")).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_closure_of_repeated_ways(spark):
    found = dedupe.closure(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 2), (5, None)], "node long, next long"))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 3, 1), (2, 4, 2), (2, 2, 3), (3, 4, 1), (3, 2, 2), (3, 3, 3), (4, 2, 1), (4, 3, 2), (4, 4, 3)}
    assert found.count() == 12


def test_lacking_meets_in_one_aggregate(spark):
    axes = spark.createDataFrame([(1, "c"), (1, "c"), (2, "o"), (None, "c"), (3, None)], "s int, role string")
    found = series.lacking(axes, axes.unionByName(spark.createDataFrame([(9, "c")], "s int, role string")), "s", F.col("role") == "c")
    assert sorted((r["s"] for r in found.collect()), key=str) == [2, 3, None]
    itself = series.lacking(axes, axes, "s", F.col("role") == "c")
    assert sorted((r["s"] for r in itself.collect()), key=str) == [2, 3, None]
    assert "Join" not in plan_of(itself)


def test_quality_meets_in_one_aggregate(spark):
    of = lambda *rows: spark.createDataFrame(rows, "g int, x string")
    found = diagnostics.quality(of((1, "a"), (1, "a"), (1, "b"), (2, None), (2, "c")), of((1, "a"), (2, None), (2, "c"), (7, "z")), of((1, "a"), (1, "b"), (2, "c"), (2, None)), "g", "x")
    got = {r["g"]: (r["n_requested"], r["n_succeeded"], r["n_converged"], r["missing"], r["ok"]) for r in found.collect()}
    assert got == {1: (2, 1, 2, ["b"], False), 2: (2, 1, 1, [], False)}
    assert "Join" not in plan_of(found)


def test_a_batch_of_maps_takes_few_bytes_a_character():
    given = pa.array([None, "", "ﬁn-\nal  É", *["some words and more of them. " * 200] * 300])
    size = sum(len(t) for t in given.to_pylist() if t)
    tracemalloc.start()
    made = text.normalized_with_map.func(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[:3].to_pylist() == [{"text": None, "offsets": None}, {"text": "", "offsets": []}, {"text": "final é", "offsets": [0, 0, 1, 4, 5, 6, 8]}]
    assert peak < 10 * size


def test_inventories_write_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(inventories, "stored", lambda df, name: names.append(name) or df)
    of = lambda schema: spark.createDataFrame([], schema)
    fragments = of("page int, fragment_id string, text string, x_start double, x_end double, baseline_y double, font_height double, rotated boolean, mapped boolean")
    footprints = of("footprint_id int, page int, x_start double, x_end double, y_top double, y_bottom double, caption_text string, caption_x_start double, caption_baseline_y double")
    inventories.built(fragments, footprints, of("page int, available boolean, complete boolean"))
    assert len(names) == 1
