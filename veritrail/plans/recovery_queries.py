"""Driver queries over crash recovery: the lines of an order are the actions of a plan, some of them left running."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import recovery
from veritrail.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: SQL of both engines. Attempts began so many seconds before 100000; a tenth of the running ones is locked.
_ACTIONS = """SELECT plan, position, CASE WHEN p % 5 = 0 THEN 'running' WHEN p % 5 = 1 THEN 'pending' WHEN p % 5 = 2 THEN 'failed' ELSE 'succeeded' END AS execution,
    CASE WHEN p % 5 = 2 THEN CASE WHEN s % 2 = 0 THEN 'failed_blocking' ELSE 'failed_nonblocking' END WHEN p % 5 > 2 THEN 'done' ELSE 'none' END AS outcome, s % 2 = 0 AS blocking, p % 5 = 0 AND s % 10 = 0 AS locked, 100000 - p % 1000 AS started, p, s
    FROM (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position, l_partkey AS p, l_suppkey AS s FROM {lineitem}) AS lines"""
#: Results of attempts: of a third of the actions the latest one's, of another third only that of one before.
_ATTEMPTS = "SELECT plan, position, started - CASE WHEN s % 3 = 1 THEN 5 ELSE 0 END AS started, CASE WHEN p % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN p % 2 = 0 THEN 'done' ELSE 'failed_nonblocking' END AS outcome FROM {actions} WHERE s % 3 < 2"
_PLANS = "SELECT o_orderkey AS plan, CAST(min(o_custkey) % 3 AS BIGINT) AS cursor, CASE WHEN min(o_orderstatus) = 'O' THEN 'approved_for_execution' ELSE 'running_t3' END AS state FROM {orders} GROUP BY o_orderkey"
_DUCK = f"""a AS MATERIALIZED ({_ACTIONS.format(lineitem="lineitem")}), t AS ({_ATTEMPTS.format(actions="a")}), p AS ({_PLANS.format(orders="orders")}),
    live AS (SELECT DISTINCT plan FROM a WHERE execution = 'running' AND (locked OR 100000 - started < 60)),
    done AS (SELECT a.plan, a.position, a.execution AS before, a.outcome AS had, a.blocking, t.status, t.outcome AS got, CASE WHEN a.plan IN (SELECT plan FROM live) THEN NULL WHEN a.execution = 'running' AND t.status IS NOT NULL THEN 'attempt_adopted'
        WHEN a.execution = 'running' THEN 'attempt_recovered' WHEN a.outcome = 'failed_blocking' AND p.state = 'approved_for_execution' THEN 'action_reset_for_retry' END AS event FROM a LEFT JOIN t ON a.plan = t.plan AND a.position = t.position AND a.started = t.started LEFT JOIN p ON a.plan = p.plan),
    after AS (SELECT plan, position, CASE event WHEN 'attempt_adopted' THEN status WHEN 'attempt_recovered' THEN 'failed' WHEN 'action_reset_for_retry' THEN 'pending' ELSE before END AS execution,
        CASE event WHEN 'attempt_adopted' THEN got WHEN 'attempt_recovered' THEN CASE WHEN blocking THEN 'failed_blocking' ELSE 'failed_nonblocking' END WHEN 'action_reset_for_retry' THEN 'none' ELSE had END AS outcome, event FROM done)"""


def _recovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    actions = spark.sql(_ACTIONS, lineitem=table(spark, sf_dir, "lineitem"))
    plans = spark.sql(_PLANS, orders=table(spark, sf_dir, "orders"))
    return recovery.reconciled(actions.drop("p", "s"), spark.sql(_ATTEMPTS, actions=actions), plans, F.lit(100000), 60)


@query(f"WITH {_DUCK} SELECT plan, position, execution, outcome, event FROM after")
def recovered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each action after a crash."""
    return _recovered(spark, sf_dir)[0]


@query(f"""
    WITH {_DUCK}, s AS (SELECT p.plan, p.cursor, least(p.cursor, coalesce((SELECT min(position) FROM after WHERE after.plan = p.plan AND event = 'action_reset_for_retry'), p.cursor)) AS start, p.plan IN (SELECT plan FROM live) AS in_flight FROM p)
    SELECT plan, CASE WHEN in_flight THEN cursor ELSE coalesce((SELECT min(position) FROM after WHERE after.plan = s.plan AND position >= start AND execution IN ('pending', 'running')), greatest(start, (SELECT count(*) FROM after WHERE after.plan = s.plan))) END AS cursor, in_flight FROM s""")
def recovered_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each plan goes on, or that one of its attempts is still at work."""
    return _recovered(spark, sf_dir)[1]
