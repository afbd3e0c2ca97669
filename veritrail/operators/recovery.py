"""Recovery of plans after a crash: what became of actions that were left running, which are tried again, and where the cursor stands.

Actions: (plan, position, execution, outcome, blocking, locked, started), positions from 0 without gaps. Attempts: (plan, position, started, status,
outcome), persisted results of attempts. Plans: (plan, cursor, state). Names of states, outcomes and events are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Executions after which nothing follows, and the state from which blocking failures are tried again.
TERMINAL, RETRIED_FROM = ("succeeded", "failed", "skipped"), "approved_for_execution"


def is_live(locked: Column, started: Column, now: Column, stale_after: int) -> Column:
    """Whether a running attempt may still be at work: its lock is held, or it began less than stale_after seconds ago."""
    return F.coalesce(locked, F.lit(False)) | F.coalesce(now.cast("long") - started.cast("long") < stale_after, F.lit(False))


def reconciled(actions: DataFrame, attempts: DataFrame, plans: DataFrame, now: Column, stale_after: int) -> tuple[DataFrame, DataFrame]:
    """(actions, plans) after recovery, which done twice gives the same.

    actions: (plan, position, execution, outcome, event): a running one takes the result of its latest attempt if that was persisted
    (attempt_adopted), else it fails (attempt_recovered), blocking or not as it was declared. A blocking failure from before is
    pending again where its plan was approved again (action_reset_for_retry). plans: (plan, cursor, in_flight): the cursor goes back
    to the first action that is tried again, and then beyond all that have ended. A plan with a live attempt is in flight:
    nothing in it changes. Each action meets the latest of its own attempts in an equi-join (the newest, as of its start).
    """
    latest = attempts.groupBy("plan", "position").agg(F.max_by(F.struct("status", "outcome", F.col("started").alias("of")), F.col("started")).alias("_last"))
    running = F.col("execution") == "running"
    met = actions.join(latest, ["plan", "position"], "left").join(plans.select("plan", "state"), "plan", "left")
    live = actions.where(running & is_live(F.col("locked"), F.col("started"), now, stale_after)).select("plan").distinct().withColumn("in_flight", F.lit(True))
    met = met.join(live, "plan", "left").withColumn("in_flight", F.coalesce("in_flight", F.lit(False)))
    own = F.col("_last.of").eqNullSafe(F.col("started")) & F.col("_last.status").isNotNull()
    retried = (F.col("outcome") == "failed_blocking") & (F.col("state") == RETRIED_FROM) & ~running
    event = F.when(F.col("in_flight"), None).when(running & own, "attempt_adopted").when(running, "attempt_recovered").when(retried, "action_reset_for_retry")
    failed = F.when(F.coalesce("blocking", F.lit(False)), "failed_blocking").otherwise("failed_nonblocking")
    judged = met.withColumn("event", event)
    by_event = lambda adopted, recovered, reset, held: F.when(F.col("event") == "attempt_adopted", adopted).when(F.col("event") == "attempt_recovered", recovered).when(F.col("event") == "action_reset_for_retry", reset).otherwise(held)
    done = judged.select(
        "plan", "position", by_event(F.col("_last.status"), F.lit("failed"), F.lit("pending"), F.col("execution")).alias("execution"),
        by_event(F.col("_last.outcome"), failed, F.lit("none"), F.col("outcome")).alias("outcome"), "event", "in_flight",
    )
    back = done.groupBy("plan").agg(F.min(F.when(F.col("event") == "action_reset_for_retry", F.col("position"))).alias("_back"), F.bool_or("in_flight").alias("in_flight"), F.count("*").alias("_n"))
    starts = plans.select("plan", "cursor").join(back, "plan", "left").withColumn("_from", F.least("cursor", F.coalesce("_back", "cursor")))
    ahead = done.where(~F.coalesce(F.col("execution").isin(*TERMINAL), F.lit(False))).join(starts.select("plan", "_from"), "plan").where(F.col("position") >= F.col("_from"))
    first = ahead.groupBy("plan").agg(F.min("position").alias("_first"))
    moved = F.coalesce("_first", F.greatest("_from", F.coalesce("_n", F.lit(0))))
    cursors = starts.join(first, "plan", "left").select("plan", F.when(F.coalesce("in_flight", F.lit(False)), F.col("cursor")).otherwise(moved).cast("long").alias("cursor"), F.coalesce("in_flight", F.lit(False)).alias("in_flight"))
    return done.drop("in_flight"), cursors
