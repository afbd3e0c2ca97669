"""Every query with SQL gives what DuckDB gives on the same tables; the others run and have rows and a stable schema."""

import decimal

import duckdb
import pytest

from veritrail.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"bibliography_regions", "quote_near", "redact_secrets"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, result.fetchall())
    assert got or name in MAY_BE_EMPTY or name in catalog.ORACLES


def test_the_entry_holds_all_queries(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["item_id", "doc_id", "q_start"]


def test_nothing_but_the_entry_knows_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "veritrail"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"veritrail\.llm|corpus_pipeline", path.read_text()), path
