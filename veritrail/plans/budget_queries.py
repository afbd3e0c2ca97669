"""Driver queries over budgets: the events of a user are a ledger; every twentieth starts a run and every fortieth a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import budgets
from veritrail.sources.tables import shared_dir, stored, table
from veritrail.streaming import logs

#: Files of a batch: all that have arrived.
WHOLE = 2**31 - 1
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


LIMITS = {"model_calls": 6, "tokens": 900, "cost_usd": 900, "fetches": 2, "index_lookups": 2, "fetch_bytes": 800, "session_cost_usd": 1300, "daily_cost_usd": 700}
#: SQL of both engines: clicks, views and sign-ups reserve; purchases settle and errors abandon the event before, or the one before that.
_LOG = """
    SELECT ledger, seq, (seq - 1 - (seq - 1) % 40) AS session, (seq - 1 - (seq - 1) % 20) AS run, op, CASE event_type WHEN 'view' THEN 'fetch' WHEN 'signup' THEN 'index_lookup' ELSE 'model_call' END AS kind,
        CASE WHEN op = 'reserve' THEN seq ELSE seq - 1 - event_id % 2 END AS reservation, v AS tokens, v AS micros, CASE WHEN op = 'abandon' AND event_id % 3 = 0 THEN NULL ELSE v END AS bytes, day
    FROM (SELECT user_id AS ledger, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
            CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 20 IN (1, 2) THEN 'reserve' WHEN event_type = 'purchase' THEN 'settle' WHEN event_type = 'error' THEN 'abandon' ELSE 'reserve' END AS op,
            CAST(floor(value) AS BIGINT) AS v, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day FROM {events}) AS numbered"""
#: SQL of DuckDB: one step of a ledger after the other. State: counters of the run, totals of session (s) and of a day (d, dday), open reservations.
_FOLD = f"""
WITH RECURSIVE log AS MATERIALIZED ({_LOG.format(events="events")}),
steps AS (
    SELECT ledger, 0::BIGINT AS seq, NULL::VARCHAR AS status, NULL::VARCHAR AS dimension, -1::BIGINT AS run, -1::BIGINT AS session, ''::VARCHAR AS dday, 0::BIGINT AS calls, 0::BIGINT AS tokens,
        0::BIGINT AS fetches, 0::BIGINT AS lookups, 0::BIGINT AS bytes, 0::BIGINT AS s, 0::BIGINT AS d, []::STRUCT(id BIGINT, kind VARCHAR, v BIGINT, day VARCHAR)[] AS held FROM log WHERE seq = 1
    UNION ALL
    SELECT ledger, seq,
        CASE WHEN op = 'reserve' THEN CASE WHEN ok THEN 'admitted' ELSE 'refused' END WHEN h IS NULL THEN 'problem' WHEN op = 'settle' THEN 'settled' ELSE 'abandoned' END,
        CASE WHEN op = 'reserve' THEN coalesce(first, shared) WHEN h IS NULL THEN 'no_open_reservation' WHEN op = 'abandon' THEN NULL WHEN h.kind = 'model_call' THEN coalesce(shared, CASE WHEN n_tokens > 900 THEN 'tokens' END) WHEN n_bytes > 800 THEN 'fetch_bytes' END,
        run, session, n_dday, n_calls, n_tokens, n_fetches, n_lookups, n_bytes, n_s, n_d,
        CASE WHEN op <> 'reserve' THEN list_filter(held, lambda x: x.id <> reservation) WHEN ok THEN list_append(held, {{'id': reservation, 'kind': kind, 'v': v, 'day': today}}) ELSE held END
    FROM (
        SELECT *, CASE WHEN ok AND kind = 'model_call' THEN calls + 1 WHEN op = 'abandon' AND h.kind = 'model_call' THEN greatest(0, calls - 1) ELSE calls END AS n_calls,
            CASE WHEN ok AND kind = 'model_call' THEN tokens + v WHEN op = 'settle' AND h.kind = 'model_call' THEN greatest(0, tokens + v - h.v) WHEN op = 'abandon' AND h.kind = 'model_call' THEN greatest(0, tokens - h.v) ELSE tokens END AS n_tokens,
            fetches + (ok AND kind = 'fetch')::BIGINT AS n_fetches, lookups + (ok AND kind = 'index_lookup')::BIGINT AS n_lookups,
            CASE WHEN ok AND kind <> 'model_call' THEN bytes + v WHEN op <> 'reserve' AND h.kind <> 'model_call' THEN greatest(0, bytes + coalesce(b, h.v) - h.v) ELSE bytes END AS n_bytes
        FROM (
            SELECT *, op = 'reserve' AND first IS NULL AND shared IS NULL AS ok FROM (
                SELECT *, CASE WHEN delta IS NULL THEN NULL WHEN n_s > 1300 THEN 'session_cost_usd' WHEN n_d > 700 THEN 'daily_cost_usd' END AS shared FROM (
                    SELECT *, greatest(0, s + coalesce(delta, 0)) AS n_s, CASE WHEN delta IS NULL THEN d WHEN delta < 0 AND h.day <> today THEN base ELSE greatest(0, base + delta) END AS n_d, CASE WHEN delta IS NULL THEN dday ELSE today END AS n_dday FROM (
                        SELECT *, CASE WHEN dday = today THEN d ELSE 0 END AS base,
                            CASE WHEN op = 'reserve' AND kind = 'model_call' AND first IS NULL THEN v WHEN op = 'settle' AND h.kind = 'model_call' THEN v - h.v WHEN op = 'abandon' AND h.kind = 'model_call' THEN -h.v END AS delta
                        FROM (
                            SELECT *, CASE WHEN op <> 'reserve' THEN NULL WHEN kind = 'model_call' THEN CASE WHEN calls + 1 > 6 THEN 'model_calls' WHEN tokens + v > 900 THEN 'tokens' END
                                WHEN kind = 'fetch' THEN CASE WHEN fetches + 1 > 2 THEN 'fetches' WHEN bytes + v > 800 THEN 'fetch_bytes' END WHEN lookups + 1 > 2 THEN 'index_lookups' WHEN bytes + v > 800 THEN 'fetch_bytes' END AS first
                            FROM (
                                SELECT e.ledger, e.seq, e.op, e.kind, e.run, e.session, e.day AS today, e.reservation, e.tokens AS v, e.bytes AS b, p.dday, p.d, p.held, list_filter(p.held, lambda x: x.id = e.reservation)[1] AS h,
                                    CASE WHEN p.run = e.run THEN p.calls ELSE 0 END AS calls, CASE WHEN p.run = e.run THEN p.tokens ELSE 0 END AS tokens, CASE WHEN p.run = e.run THEN p.fetches ELSE 0 END AS fetches,
                                    CASE WHEN p.run = e.run THEN p.lookups ELSE 0 END AS lookups, CASE WHEN p.run = e.run THEN p.bytes ELSE 0 END AS bytes, CASE WHEN p.session = e.session THEN p.s ELSE 0 END AS s
                                FROM steps p JOIN log e ON e.ledger = p.ledger AND e.seq = p.seq + 1))))))) AS done)
SELECT ledger, seq, status, dimension, calls, tokens, tokens AS micros, fetches, lookups, bytes, s AS session_micros, d AS day_micros FROM steps WHERE seq > 0"""


@query(_FOLD)
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each reservation, settlement and give-back, under ceilings of run, session and day together."""
    return budgets.admitted(spark.sql(_LOG, events=table(spark, sf_dir, "events")), LIMITS)


@query(f"SELECT * FROM ({_FOLD}) AS whole")
def stream_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the events, which arrive in three batches by seq, with each ledger as state."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    log = stored(spark.sql(_LOG, events=table(spark, sf_dir, "events")), "ledgers")
    # Pieces of seq arrive one after another, and the stream is drained after each: files that are written
    # at once get their times in any order, and a stream takes files by their times.
    ends = [int(e) for e in log.approxQuantile("seq", [1 / 3, 2 / 3], 0.01)]
    for first, last in zip([None, *ends], [*ends, None], strict=True):
        after = F.lit(True) if first is None else F.col("seq") > first
        piece = log.where(after if last is None else after & (F.col("seq") <= last))
        piece.write.mode("append").parquet(f"{base}/in")
        logs.drained(budgets.admissions(logs.table_stream(spark, f"{base}/in", log.schema, WHOLE), LIMITS), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(budgets.RESULT).parquet(f"{base}/out")
