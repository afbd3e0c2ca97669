"""Spend, budgets, approvals and state machines over logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.sources.tables import stored

#: Failures before a launch, which cost nothing.
PRE_LAUNCH = ("tool_not_found", "input_build_error")
#: Dimensions of a run's budget, in the order in which exhaustion is told.
DIMENSIONS = ("model_calls", "tokens", "cost_usd", "fetches", "index_lookups", "fetch_bytes", "wall_clock_s")
#: Legal steps of a campaign.
STEPS = {
    "draft": ("validated", "failed"),
    "validated": ("ready_for_planning", "failed"),
    "ready_for_planning": ("plan_pending_approval", "approved_for_execution", "failed"),
    "plan_pending_approval": ("approved_for_execution", "blocked", "failed"),
    "approved_for_execution": ("running_t3", "running_arc", "running_literature", "blocked", "failed"),
    "running_literature": ("literature_ready", "failed", "blocked"),
    "literature_ready": ("running_t3", "running_literature", "completed_phase1", "blocked", "failed"),
    "running_t3": ("diagnostics_ready", "failed"),
    "running_arc": ("results_ready", "failed"),
    "diagnostics_ready": ("completed_phase1", "running_literature", "failed"),
    "results_ready": ("completed_phase1", "failed"),
    "completed_phase1": (),
    "blocked": ("ready_for_planning", "failed"),
    "failed": ("ready_for_planning",),
}
#: Where a campaign that failed in a state may go on besides planning.
RESUMES = {
    "running_t3": "approved_for_execution",
    "running_arc": "approved_for_execution",
    "running_literature": "approved_for_execution",
    "approved_for_execution": "approved_for_execution",
    "diagnostics_ready": "diagnostics_ready",
    "results_ready": "results_ready",
}


def run_cost(actual: Column, estimate: Column, status: Column, failure: Column) -> Column:
    """The actual cost if it is finite and not negative; the estimate if it is corrupt or absent; nothing before a launch."""
    plausible = F.coalesce(~F.isnan(actual) & (actual >= 0) & (actual < float("inf")), F.lit(False))
    return F.when(plausible, actual).when(actual.isNull() & (status == "failed") & failure.isin(*PRE_LAUNCH), F.lit(0.0)).otherwise(estimate)


def spend(runs: DataFrame, group: list[str]) -> DataFrame:
    """(group, consumed) over all runs; retries of one action all count. Sums are decimal, so order does not matter."""
    cost = run_cost(F.col("actual"), F.col("estimate"), F.col("status"), F.col("failure"))
    return runs.groupBy(*group).agg(F.sum(cost.cast("decimal(28,6)")).alias("consumed"))


def admitted(requests: DataFrame, run: str, order: str, amount: str, limit: float, calls: int) -> DataFrame:
    """requests with ``admitted`` and ``used``: each is admitted if calls and amount still fit; a refused one uses nothing.

    The fold depends on the order within a run, so a run's requests go to one task, as they are few by the limit
    of calls; runs are independent.
    """
    import pandas as pd

    kept = requests.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used, n, flags, totals = 0.0, 0, [], []
        for x in pdf[amount]:
            fits = n < calls and used + x <= limit
            used, n = (used + x, n + 1) if fits else (used, n)
            flags.append(fits)
            totals.append(used)
        return pdf.assign(admitted=flags, used=totals)

    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes) + ", admitted boolean, used double"
    return requests.select(*kept).groupBy(run).applyInPandas(fold, schema)


def admitted_natively(requests: DataFrame, run: str, order: str, amount: str, limit: float, calls: int) -> DataFrame:
    """(run, n_requests, n_admitted, used) by a fold over each run's sorted requests, all in expressions."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(amount).cast("double").alias("a"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("used"))
    fits = lambda acc, x: (acc["n"] < calls) & (acc["used"] + x["a"] <= limit)
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["n"] + 1).alias("n"), (acc["used"] + x["a"]).alias("used"))).otherwise(acc)
    grouped = requests.groupBy(run).agg(F.count("*").alias("n_requests"), listed.alias("l"))
    return grouped.withColumn("r", F.aggregate("l", start, step)).select(run, "n_requests", F.col("r.n").alias("n_admitted"), F.col("r.used").alias("used"))


def exhausted(used: dict[str, Column], limits: dict[str, Column]) -> Column:
    """The first exhausted dimension in the fixed order, or null."""
    return F.coalesce(*[F.when(used[d] >= limits[d], F.lit(d)) for d in DIMENSIONS if d in used])


def daily_totals(charges: DataFrame, ts: str, amount: str, reserved: str | None = None) -> DataFrame:
    """(day, total, n): charges by day; a refund of another day's reservation is dropped, a charge never is."""
    day = F.to_date(ts)
    late = F.lit(False) if reserved is None else (F.col(amount) < 0) & (F.to_date(reserved) != day)
    return charges.where(~late).groupBy(day.alias("day")).agg(F.sum(F.col(amount).cast("decimal(28,6)")).alias("total"), F.count("*").alias("n"))


def latest_decision(log: DataFrame, action: str, order: str, status: str, human: tuple[str, ...] = ("approved", "rejected")) -> DataFrame:
    """(action, status): the latest decision of a person; automatic and pending entries do not count."""
    return log.where(F.col(status).isin(*human)).groupBy(action).agg(F.max_by(status, order).alias(status))


def illegal_steps(log: DataFrame, legal: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    """Steps (entity, previous, state) of a log that are not in legal (previous, state)."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    steps = log.withColumn("previous", before).where("previous IS NOT NULL")
    return steps.join(legal.select("previous", state).distinct(), ["previous", state], "left_anti")


def can_step(current: Column, target: Column, failed_from: Column) -> Column:
    """Whether a step is legal; out of failure, to planning or to where RESUMES lets a campaign that failed there go on."""
    legal = reduce(lambda a, b: a | b, [(current == a) & target.isin(*targets) for a, targets in STEPS.items() if targets])
    resumed = reduce(lambda a, b: a | b, [(failed_from == a) & (target == b) for a, b in RESUMES.items()])
    return F.coalesce(legal, F.lit(False)) | ((current == "failed") & F.coalesce(resumed, F.lit(False)))


def illegal_campaign_steps(log: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    """(entity, order, previous, state): steps of campaigns that are not legal; a resumed one failed in the state before its failure."""
    w = Window.partitionBy(entity).orderBy(*order)
    steps = log.withColumns({"previous": F.lag(state).over(w), "_origin": F.lag(state, 2).over(w)}).where("previous IS NOT NULL")
    return steps.where(~can_step(F.col("previous"), F.col(state), F.col("_origin"))).drop("_origin")


def paths(spark: SparkSession, legal: DataFrame) -> DataFrame:
    """(origin, target, length, path): a shortest legal path between any two states, the least in text order.

    By levels: each round extends the paths that the last one found by a step to states not reached yet and keeps the least
    for each pair, as long as there are any. A state's way back to itself is no path.
    """
    steps = legal.select("previous", "state").where("previous IS NOT NULL AND state IS NOT NULL").distinct()
    known = new = stored(steps.where("previous <> state").select(F.col("previous").alias("origin"), F.col("state").alias("target"), F.lit(1).alias("length"), F.array("previous", "state").alias("path")), "paths")
    while not new.isEmpty():
        longer = new.join(steps, F.col("target") == F.col("previous")).where("state <> origin")
        longer = longer.select("origin", F.col("state").alias("target"), (F.col("length") + 1).alias("length"), F.concat("path", F.array("state")).alias("path"))
        fresh = longer.groupBy("origin", "target").agg(F.min("length").alias("length"), F.min("path").alias("path"))
        new = stored(fresh.join(known.select("origin", "target"), ["origin", "target"], "left_anti"), "paths")
        known = known.unionByName(new)
    return known


def islands(rows: DataFrame, group: str, order: str, flag: Column) -> DataFrame:
    """(group, island, first, last, n): runs of neighbouring rows for which flag holds."""
    w = Window.partitionBy(group).orderBy(order)
    numbered = rows.withColumns({"_n": F.row_number().over(w), "_f": flag}).where("_f")
    marked = numbered.withColumn("_i", F.col("_n") - F.row_number().over(w))
    return marked.groupBy(group, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_i")


def plan_state(actions: DataFrame, plan: str) -> DataFrame:
    """(plan, state) of actions (execution, outcome, approval, blocking, passed, executable).

    failed if an action's outcome blocks; completed if the cursor has passed all, one succeeded and so did all
    blocking ones; blocked if none can be executed and one was rejected; else none.
    """
    done = F.coalesce(F.col("execution") == "succeeded", F.lit(False))
    rejected = F.coalesce(F.col("approval") == "rejected", F.lit(False)) | F.coalesce(F.col("outcome") == "rejected", F.lit(False))
    state = (
        F.when(F.bool_or(F.coalesce(F.col("outcome") == "failed_blocking", F.lit(False))), "failed")
        .when(F.bool_and("passed") & F.bool_or(done) & F.bool_and(done | ~F.col("blocking")), "completed_phase1")
        .when(~F.bool_or("executable") & F.bool_or(rejected), "blocked")
    )
    return actions.groupBy(plan).agg(F.coalesce(state, F.lit("none")).alias("state"))


def cursor(actions: DataFrame, plan: str, order: str, status: str, terminal: tuple[str, ...] = ("succeeded", "failed", "skipped")) -> DataFrame:
    """(plan, cursor): the first action that has not ended; null if all have."""
    return actions.groupBy(plan).agg(F.min(F.when(~F.col(status).isin(*terminal), F.col(order))).alias("cursor"))


def approval(kind: Column, estimate: Column, automatic: tuple[str, ...], within: Column) -> Column:
    """Whether an action may run by itself: its kind is automatic and its estimate within the budget."""
    return F.when(kind.isin(*automatic) & (estimate <= within), "auto_approved").otherwise("requires_approval")


def model_cost(calls: DataFrame, prices: DataFrame, worst: float = 5.0) -> DataFrame:
    """calls (model, input_tokens, output_tokens) with ``cost_usd`` by prices (pattern, input_rate, output_rate, place) per million.

    The first pattern that a model's name fits counts; without one, or without usage, the worst case does.
    """
    fitted = calls.select("model").distinct().join(prices, F.expr("model RLIKE pattern"))
    rate = fitted.groupBy("model").agg(F.min_by(F.struct("input_rate", "output_rate"), "place").alias("rate"))
    cost = (F.col("input_tokens") * F.col("rate.input_rate") + F.col("output_tokens") * F.col("rate.output_rate")) / 1_000_000
    return calls.join(rate, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(worst))).drop("rate")


def requirement(kind: Column, cpu_hours: Column, spend: Column, budget: Column, policy: dict[str, Column]) -> Column:
    """auto_approved or requires_approval of an action by kind, estimates and the approval policy; an unknown kind needs a person.

    policy: t3_hours, arc_hours, experiments, literature (whether they need a person) and literature_usd.
    """
    tool = kind.isin("t3_run", "arc_run")
    free = (
        F.when(tool & (cpu_hours > budget), False)
        .when(kind == "t3_run", cpu_hours <= policy["t3_hours"])
        .when(kind == "arc_run", cpu_hours <= policy["arc_hours"])
        .when(kind == "experiment", ~policy["experiments"])
        .when(kind.isin("literature_search", "literature_corpus_pass"), ~policy["literature"] & (spend <= policy["literature_usd"]))
    )
    return F.when(F.coalesce(free, F.lit(False)), "auto_approved").otherwise("requires_approval")


def usage(log: DataFrame, run: str, limits: dict[str, float]) -> DataFrame:
    """(run, calls, tokens, cost_usd, fetch_bytes, exceeded) of reservations and what became of them.

    log: (run, reservation, kind, state, tokens, cost_usd, bytes, actual_tokens, actual_cost_usd, actual_bytes); state is
    open, settled or abandoned. An open one counts as reserved, a settled one as used; an abandoned model call gives all back
    and an abandoned fetch only the bytes that did not come. Each reservation counts once, sums are decimal.
    """
    model, ended = F.col("kind") == "model_call", F.col("state") != "open"
    gone = model & (F.col("state") == "abandoned")
    spent = lambda actual, reserved: F.when(gone, 0).when(ended, F.coalesce(actual, reserved)).otherwise(reserved)
    once = log.groupBy(run, "reservation").agg(*[F.max_by(c, F.col("state") != "open").alias(c) for c in log.columns if c not in (run, "reservation")])
    used = once.groupBy(run).agg(
        F.count_if(model & ~gone).alias("calls"),
        F.coalesce(F.sum(F.when(model, spent(F.col("actual_tokens"), F.col("tokens")))), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(F.when(model, spent(F.col("actual_cost_usd"), F.col("cost_usd")).cast("decimal(28,6)"))), F.lit(0)).cast("decimal(28,6)").alias("cost_usd"),
        F.coalesce(F.sum(F.when(~model, spent(F.col("actual_bytes"), F.col("bytes")))), F.lit(0)).cast("long").alias("fetch_bytes"),
    )
    over = [F.when(F.col(c) > limits[c], F.lit(c)) for c in ("calls", "tokens", "cost_usd", "fetch_bytes") if c in limits]
    return used.withColumn("exceeded", F.coalesce(*over) if over else F.lit(None).cast("string"))
