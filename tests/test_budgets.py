"""Budgets as ordered state: cases of one ledger, and that nothing hangs on batches."""

from veritrail.operators import budgets

LIMITS = {"model_calls": 2, "tokens": 100, "cost_usd": 100, "fetches": 1, "index_lookups": 1, "fetch_bytes": 50, "session_cost_usd": 150, "daily_cost_usd": 120}
SCHEMA = "ledger long, seq long, session string, run string, op string, kind string, reservation string, tokens long, micros long, bytes long, day string"


def events(*rows):
    return [(1, n, s, r, op, kind, name, tokens, micros, size, day) for n, (s, r, op, kind, name, tokens, micros, size, day) in enumerate(rows)]


CASES = events(
    ("s", "a", "reserve", "model_call", "m1", 60, 60, None, "d1"),
    ("s", "a", "reserve", "model_call", "m2", 50, 10, None, "d1"),  # tokens
    ("s", "a", "settle", "model_call", "m1", 70, 20, None, "d1"),
    ("s", "a", "settle", "model_call", "m1", 70, 20, None, "d1"),  # closed already
    ("s", "a", "reserve", "model_call", "m3", 10, 80, None, "d1"),
    ("s", "b", "reserve", "model_call", "m4", 10, 60, None, "d1"),  # session 160 > 150: given back to the run alone
    ("t", "c", "reserve", "model_call", "m5", 10, 10, None, "d1"),  # day 170 > 120
    ("t", "c", "reserve", "model_call", "m6", 10, 10, None, "d2"),  # a new day
    ("s", "c", "abandon", "model_call", "m3", None, None, None, "d2"),  # refund of another day: the session's alone, and run a's
    ("t", "c", "settle", "model_call", "m6", 200, 5, None, "d2"),  # tokens exceeded
    ("t", "c", "reserve", "fetch", "f1", None, None, 40, "d2"),
    ("t", "c", "reserve", "fetch", "f2", None, None, 1, "d2"),  # fetches
    ("t", "c", "reserve", "index_lookup", "l1", None, None, 20, "d2"),  # bytes
    ("t", "c", "abandon", "fetch", "f1", None, None, 10, "d2"),  # keeps the count
    ("t", "c", "reserve", "index_lookup", "l1", None, None, 20, "d2"),
    ("t", "c", "reserve", "index_lookup", "l1", None, None, 20, "d2"),  # still open
    ("t", "c", "settle", "index_lookup", "l1", None, None, 90, "d2"),  # bytes exceeded
    ("t", "c", "grant", None, None, None, None, None, None),
)
WANT = [
    ("admitted", None), ("refused", "tokens"), ("settled", None), ("problem", "no_open_reservation"), ("admitted", None), ("refused", "session_cost_usd"), ("refused", "daily_cost_usd"), ("admitted", None),
    ("abandoned", None), ("settled", "tokens"), ("admitted", None), ("refused", "fetches"), ("refused", "fetch_bytes"), ("abandoned", None), ("admitted", None), ("problem", "reservation_is_open"),
    ("settled", "fetch_bytes"), ("problem", "unknown_op"),
]


def test_a_ledger(spark):
    rows = sorted(budgets.admitted(spark.createDataFrame(CASES[::-1], SCHEMA), LIMITS).collect(), key=lambda r: r["seq"])
    assert [(r["status"], r["dimension"]) for r in rows] == WANT
    assert [r["session_micros"] for r in rows[:6]] == [60, 60, 20, 20, 100, 160] and [r["day_micros"] for r in rows[5:10]] == [160, 170, 10, 10, 5]
    assert (rows[8]["calls"], rows[8]["tokens"], rows[8]["micros"], rows[8]["session_micros"]) == (1, 70, 20, 80)
    assert (rows[13]["fetches"], rows[13]["bytes"]) == (1, 10) and (rows[16]["lookups"], rows[16]["bytes"]) == (1, 100)


def test_ledgers_and_batches_are_apart(spark):
    """Many ledgers over small batches give what each gives alone; rows without a place have none."""
    many = [(k, *e[1:]) for k in range(30) for e in CASES] + [(None, *CASES[0][1:]), (3, None, *CASES[0][2:])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = budgets.admitted(spark.createDataFrame(many, SCHEMA), LIMITS).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = {(r["ledger"], r["seq"]): (r["status"], r["dimension"]) for r in rows}
    assert found == {(k, n): w for k in range(30) for n, w in enumerate(WANT)} and len(rows) == 30 * len(WANT)
    assert budgets.admitted(spark.createDataFrame([], SCHEMA), LIMITS).collect() == []


def test_a_stream_takes_its_pieces_in_order(spark, sf):
    """However fast the pieces are written, each ledger's events arrive by seq: the stream gives what the batch gives."""
    from veritrail.plans import budget_queries

    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(budget_queries.stream_budgets(spark, sf)) == rows(budget_queries.budget_ledger(spark, sf))
