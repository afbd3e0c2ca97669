"""Ties that a query's order leaves open: the row that stands first in the file, as in DuckDB."""

import duckdb
from pyspark.sql import functions as F

from veritrail.operators import diagnostics
from veritrail.plans import catalog


def test_first_occurrence_among_equal_places(spark, tmp_path):
    """Lines with one number in one order, of one part: the first in the file, wherever their quantities stand."""
    rows = [(k % 50, k % 7, 1, float((k * 37) % 101)) for k in range(3500)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").coalesce(1)
    lines.write.parquet(f"file://{tmp_path}/made")
    (part,) = tmp_path.glob("made/*.parquet")
    part.rename(tmp_path / "lineitem.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["first_occurrence"](spark, str(tmp_path)).select("l_partkey", "l_quantity", "ord").collect())
    sql = catalog.ORACLES["first_occurrence"].replace("FROM lineitem", f"FROM read_parquet('{tmp_path}/lineitem.parquet')")
    assert got == sorted(duckdb.sql(sql).fetchall())
    assert {r[0]: r[1] for r in got} == {p: next(q for o, of, _, q in rows if of == p and o == min(x for x, y, *_ in rows if y == p)) for p in range(7)}


def test_first_occurrence_hangs_on_no_arrival(spark):
    """Without a place to part ties, the columns do; rows without an order are the last choice."""
    rows = [(1, 5, 2.0), (1, 5, 1.0), (1, 9, 0.0), (1, None, -1.0), (2, None, 3.0)]
    for way in (1, -1):
        frame = spark.createDataFrame(rows[::way], "k long, ord long, v double").repartition(3, F.rand(7))
        found = {r.k: (r.v, r.ord) for r in diagnostics.first_occurrence(frame, "k", "ord", ["v"]).collect()}
        assert found == {1: (1.0, 5), 2: (None, None)}


def test_first_occurrence_passes_over_missing_values(spark, tmp_path):
    """As in SQL a line without a quantity gives none, but its place counts; lines without a place give neither."""
    rows = [(k if k % 11 else None, k % 40, 1 + k // 200, None if k < 60 or k % 5 == 0 or k % 40 == 7 else float(k)) for k in range(400)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").coalesce(1)
    lines.write.parquet(f"file://{tmp_path}/made")
    (part,) = tmp_path.glob("made/*.parquet")
    part.rename(tmp_path / "lineitem.parquet")
    got = sorted((tuple(r) for r in catalog.QUERIES["first_occurrence"](spark, str(tmp_path)).select("l_partkey", "l_quantity", "ord").collect()), key=repr)
    sql = catalog.ORACLES["first_occurrence"].replace("FROM lineitem", f"FROM read_parquet('{tmp_path}/lineitem.parquet')")
    assert got == sorted(duckdb.sql(sql).fetchall(), key=repr)
    assert None in {q for _, q, _ in got} and len({q for _, q, _ in got}) > 1
