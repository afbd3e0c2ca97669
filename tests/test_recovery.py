"""Recovery of plans: each crash point once, and that a second pass changes nothing."""

from pyspark.sql import functions as F

from veritrail.operators import recovery

ACTIONS = "plan string, position int, execution string, outcome string, blocking boolean, locked boolean, started long"
ATTEMPTS, PLANS = "plan string, position int, started long, status string, outcome string", "plan string, cursor long, state string"


def run(spark, actions, attempts, plans):
    done, cursors = recovery.reconciled(spark.createDataFrame(actions, ACTIONS), spark.createDataFrame(attempts, ATTEMPTS), spark.createDataFrame(plans, PLANS), F.lit(1000), 60)
    return {(r["plan"], r["position"]): (r["execution"], r["outcome"], r["event"]) for r in done.collect()}, {r["plan"]: (r["cursor"], r["in_flight"]) for r in cursors.collect()}


def test_crash_points(spark):
    actions = [
        ("adopt", 0, "succeeded", "done", True, None, 1), ("adopt", 1, "running", "none", True, False, 900), ("adopt", 2, "pending", "none", True, None, None),
        ("old", 0, "running", "none", True, None, 900), ("soft", 0, "running", "none", False, None, None), ("locked", 0, "running", "none", True, True, 1), ("fresh", 0, "running", "none", True, None, 990), ("fresh", 1, "failed", "failed_blocking", True, None, 1),
        ("again", 0, "succeeded", "done", True, None, 1), ("again", 1, "failed", "failed_blocking", True, None, 2), ("again", 2, "failed", "failed_nonblocking", True, None, 3), ("kept", 0, "failed", "failed_blocking", True, None, 1), ("ended", 0, "skipped", "none", False, None, 1),
    ]
    attempts = [("adopt", 1, 900, "succeeded", "done"), ("adopt", 1, 800, "failed", "failed_blocking"), ("old", 0, 800, "succeeded", "done")]
    plans = [("adopt", 1, "running_t3"), ("old", 0, "running_t3"), ("soft", 0, "running_t3"), ("locked", 0, "running_t3"), ("fresh", 0, "approved_for_execution"), ("again", 3, "approved_for_execution"), ("kept", 0, "failed"), ("ended", 0, "failed"), ("empty", 0, "draft")]
    done, cursors = run(spark, actions, attempts, plans)
    assert done["adopt", 1] == ("succeeded", "done", "attempt_adopted") and done["old", 0] == ("failed", "failed_blocking", "attempt_recovered") and done["soft", 0] == ("failed", "failed_nonblocking", "attempt_recovered")
    assert done["locked", 0][2] is None and done["fresh", 0] == ("running", "none", None) and done["fresh", 1] == ("failed", "failed_blocking", None)
    assert done["again", 1] == ("pending", "none", "action_reset_for_retry") and done["again", 2][2] is None and done["kept", 0][2] is None
    assert cursors == {"adopt": (2, False), "old": (1, False), "soft": (1, False), "locked": (0, True), "fresh": (0, True), "again": (1, False), "kept": (1, False), "ended": (1, False), "empty": (0, False)}
    second = [(*a[:2], *done[a[0], a[1]][:2], *a[4:]) for a in actions]
    again, same = run(spark, second, attempts, [(p, cursors[p][0], s) for p, _, s in plans])
    assert {k: v[:2] for k, v in again.items()} == {k: v[:2] for k, v in done.items()} and same == cursors and not any(v[2] for v in again.values())


def test_empty(spark):
    assert run(spark, [], [], []) == ({}, {})
