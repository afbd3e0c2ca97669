"""Driver queries over relational tables: dedupe, joins, ledgers, integrity, versions, layout, diagnostics, streams.

The tables stand in for the engine's records; each docstring says as what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import units
from veritrail.operators import dedupe, diagnostics, integrity, layout, ledger, ranking, replay, versions
from veritrail.sources.tables import shared_dir, table
from veritrail.streaming import logs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for DuckDB if it can be put so."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY text")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return dedupe.first_wins(docs, ["sha"], ["doc_id"])


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F')::INT, o_orderkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS position FROM orders)
    SELECT o_custkey, o_orderkey, o_orderstatus, position FROM r WHERE n = 1""")
def dedupe_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits by key (customer): a later hit with full text (status F) takes the first one's place."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return dedupe.upgraded(orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS position FROM events GROUP BY user_id")
def latest_wins_first_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species by label (user): the latest values at the first position."""
    return dedupe.latest_wins(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (unlabelled ones) that no pass has covered."""
    return dedupe.uncovered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("""
    SELECT coalesce(c.k, o.k) AS custkey, CASE WHEN o.k IS NULL THEN 'declared_not_used' ELSE 'used_not_declared' END AS problem
    FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON c.k = o.k WHERE c.k IS NULL OR o.k IS NULL""")
def exact_cover_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared constants (customers in credit) against used ones (of orders with status P)."""
    declared = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return dedupe.cover_violations(declared, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("""
    SELECT coalesce(o.k, c.c_custkey) AS custkey, coalesce(o.status, c.c_mktsegment) AS note, coalesce(c.c_name, 'new-' || o.k) AS owner
    FROM (SELECT c_custkey, c_mktsegment, c_name FROM customer WHERE c_acctbal > 0) c
    FULL JOIN (SELECT o_custkey AS k, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.k""")
def upsert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (customers in credit) merged with fresh metadata (orders): notes are filled, owners are kept."""
    held = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("note"), F.col("c_name").alias("owner"))
    fresh = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_orderstatus").alias("note"))
    return dedupe.merged(held, fresh.withColumn("owner", F.concat(F.lit("new-"), F.col("custkey"))), "custkey", ["note"], ["owner"])


@query(r"""
    WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS words FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.words AS now, b.words AS before FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
    SELECT conv_id, turn, len(list_filter(now, lambda x: NOT list_contains(before, x))) + len(list_filter(before, lambda x: NOT list_contains(now, x))) AS n_changed FROM p""")
def symmetric_diff_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that two neighbouring turns do not share, as the check of a near match compares them."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != ""))
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("now"))
    before = w.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("now").alias("before"))
    changed = F.size(F.array_except("now", "before")) + F.size(F.array_except("before", "now"))
    return w.join(before, ["conv_id", "turn"]).select("conv_id", "turn", changed.cast("long").alias("n_changed"))


@query("""
    WITH u AS (SELECT s_nationkey AS nation, s_name AS url, 0 AS tier, 0 AS provider, s_suppkey AS position FROM supplier
               UNION ALL SELECT c_nationkey, c_name, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 2 END, 1, c_custkey FROM customer),
    o AS (SELECT *, row_number() OVER (PARTITION BY nation, url ORDER BY tier, provider, position) AS n FROM u),
    r AS (SELECT nation, url, tier, provider, position, row_number() OVER (PARTITION BY nation ORDER BY tier, provider, position, url) AS place FROM o WHERE n = 1)
    SELECT nation, url, tier, provider, position, place FROM r WHERE place <= 5""")
def union_tier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a paper (nation) from two providers (suppliers, customers) by tier, the first five."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("url"), F.lit(0).alias("tier"), F.col("s_suppkey").alias("position"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("url"), F.when(F.col("c_acctbal") > 5000, 1).otherwise(2).alias("tier"), F.col("c_custkey").alias("position"))
    return ranking.resolved([a, b], "nation").where("place <= 5").select("nation", "url", "tier", "provider", "position", "place")


@query("""
    SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'complete' END AS coverage FROM orders GROUP BY o_custkey""")
def lookup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete the look-ups (orders) of a paper (customer) were; status P stands for a failed one."""
    outcome = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("answered")
    return ranking.coverage(table(spark, sf_dir, "orders").select("o_custkey", outcome.alias("outcome")), "o_custkey")


_COST = """CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 0.0 ELSE o_totalprice / 2 END"""


@query(f"SELECT o_orderpriority AS priority, sum(({_COST})::DECIMAL(28,6)) AS consumed FROM orders GROUP BY 1")
def spend_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (orders): F has an actual cost, even P failed before a launch, all others pay their estimate."""
    status, even = F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 0
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("priority"),
        F.when(status == "F", F.col("o_totalprice")).alias("actual"),
        (F.col("o_totalprice") / 2).alias("estimate"),
        F.when(status == "P", "failed").otherwise("succeeded").alias("status"),
        F.when(even, "tool_not_found").otherwise("timeout").alias("failure"),
    )
    return ledger.spend(runs, ["priority"])


@query("SELECT ts::DATE AS day, sum(value::DECIMAL(28,6)) AS total, count(*) AS n FROM events GROUP BY 1")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges (events) by day."""
    return ledger.daily_totals(table(spark, sf_dir, "events"), "ts", "value")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, 0::BIGINT AS n, 0::INT AS calls, 0.0::DOUBLE AS used FROM e GROUP BY user_id
          UNION ALL SELECT e.user_id, e.n, f.calls + (f.calls < 20 AND f.used + e.value <= 500)::INT, CASE WHEN f.calls < 20 AND f.used + e.value <= 500 THEN f.used + e.value ELSE f.used END
          FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, max(n) AS n_requests, arg_max(calls, n) AS n_admitted, round(arg_max(used, n), 6) AS used FROM f GROUP BY user_id""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (events) of a run (user), admitted in order while 20 calls and 500 in sum fit; a refused one uses nothing."""
    done = ledger.admitted_natively(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 500.0, 20)
    return done.withColumn("used", F.round("used", 6))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest decision (click or purchase) about an action (user); other entries do not count."""
    return ledger.latest_decision(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ("click", "purchase"))


@query("""
    WITH s AS (SELECT user_id, event_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
    SELECT user_id, event_id, previous, state FROM s WHERE previous IS NOT NULL AND NOT (previous, state) IN (('view', 'click'), ('click', 'purchase'), ('view', 'view'))""")
def transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a campaign (user) that are not legal."""
    legal = spark.sql("SELECT * FROM VALUES ('view', 'click'), ('click', 'purchase'), ('view', 'view') AS t(previous, state)")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    return ledger.illegal_steps(log, legal, "user_id", ["event_id"], "state").select("user_id", "event_id", "previous", "state")


@query("""
    WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM n WHERE value > 50)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, i""")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring events above 50."""
    return ledger.islands(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 50)


@query("""
    WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus IN ('F', 'O') AND o_orderkey % 7 <> 0 AS done, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS bad, o_orderkey % 5 = 0 AS rejected, o_orderkey % 3 = 0 AS blocking FROM orders)
    SELECT o_custkey, CASE WHEN bool_or(bad) THEN 'failed' WHEN bool_and(done) AND bool_and(done OR NOT blocking) THEN 'completed_phase1'
            WHEN bool_and(done OR rejected) AND bool_or(rejected) THEN 'blocked' ELSE 'none' END AS state,
        min(CASE WHEN NOT done THEN o_orderkey END) AS cursor
    FROM a GROUP BY o_custkey""")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and cursor of plans (customers) over their actions (orders)."""
    key = F.col("o_orderkey")
    done, rejected = F.col("o_orderstatus").isin("F", "O") & (key % 7 != 0), key % 5 == 0
    actions = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(done, "succeeded").otherwise("pending").alias("execution"), F.when((F.col("o_orderstatus") == "P") & (key % 2 == 0), "failed_blocking").alias("outcome"),
        F.when(rejected, "rejected").otherwise("approved").alias("approval"), (key % 3 == 0).alias("blocking"), done.alias("passed"), (~done & ~rejected).alias("executable"),
    )
    return ledger.plan_state(actions, "o_custkey").join(ledger.cursor(actions, "o_custkey", "o_orderkey", "execution"), "o_custkey")


@query("""
    WITH RECURSIVE legal AS (SELECT n_nationkey AS previous, (n_nationkey * 7 + 3) % 25 AS state FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 20 FROM nation),
    w AS (SELECT previous AS origin, state AS target, 1 AS length FROM legal WHERE previous <> state UNION SELECT w.origin, l.state, w.length + 1 FROM w JOIN legal l ON l.previous = w.target WHERE w.length < 25 AND l.state <> w.origin)
    SELECT origin, target, min(length) AS length FROM w GROUP BY origin, target""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest ways along a graph of nations, of which each leads to two others."""
    n = F.col("n_nationkey").cast("long")
    nations = table(spark, sf_dir, "nation")
    legal = nations.select(n.alias("previous"), ((n * 7 + 3) % 25).alias("state")).unionByName(nations.select(n.alias("previous"), ((n + 1) % 20).alias("state")))
    return ledger.paths(spark, legal).select("origin", "target", "length")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def ref_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References (line items) to nodes (parts of size up to 45) that do not exist."""
    nodes = table(spark, sf_dir, "part").where("p_size <= 45")
    return integrity.dangling(table(spark, sf_dir, "lineitem"), nodes, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
    SELECT id, count(*) AS n FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) GROUP BY id HAVING count(*) > 1""")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that three collections share."""
    named = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))]
    return integrity.duplicates(named, "id")


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS previous FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, previous FROM p WHERE previous IS NOT NULL AND previous >= l_partkey""")
def sorted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (line items) that are not in order of their keys (parts) within a series (order)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.unsorted_rows(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


_FOREST = "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 0 THEN NULL ELSE 'r0' END FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    tag = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    rows = n.select(tag("n", "n_nationkey").alias("node"), tag("r", "n_regionkey").alias("parent"))
    rows = rows.unionByName(r.select(tag("r", "r_regionkey").alias("node"), F.when(F.col("r_regionkey") != 0, F.lit("r0")).alias("parent")))
    return rows.unionByName(s.select(tag("s", "s_suppkey").alias("node"), tag("n", "s_nationkey").alias("parent")))


@query(f"""
    WITH RECURSIVE f AS ({_FOREST}), up(node, ancestor, depth) AS (
        SELECT node, parent, 1 FROM f WHERE parent IS NOT NULL UNION ALL SELECT up.node, f.parent, up.depth + 1 FROM up JOIN f ON f.node = up.ancestor WHERE f.parent IS NOT NULL)
    SELECT node, ancestor, depth FROM up""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors in a source graph: suppliers under nations under regions under one root."""
    return integrity.ancestors(spark, _forest(spark, sf_dir))


@query("""
    WITH RECURSIVE e AS (SELECT n_nationkey AS node, CASE WHEN n_regionkey <> 0 THEN (n_nationkey * 7 + 3) % 25 END AS parent FROM nation),
    w(origin, node, depth) AS (SELECT node, parent, 1 FROM e WHERE parent IS NOT NULL UNION ALL SELECT w.origin, e.parent, w.depth + 1 FROM w JOIN e ON e.node = w.node WHERE e.parent IS NOT NULL AND w.node <> w.origin AND w.depth < 100)
    SELECT DISTINCT origin AS node FROM w WHERE origin = node""")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles of a graph over nations; those of the first region are roots."""
    n = F.col("n_nationkey")
    parent = F.when(F.col("n_regionkey") != 0, (n * 7 + 3) % 25)
    return integrity.on_cycles(spark, table(spark, sf_dir, "nation").select(n.alias("node"), parent.alias("parent")))


@query("""
    SELECT o_orderpriority AS series, count(DISTINCT c_nationkey % 5) AS n_roots FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT c_nationkey % 5) > 1""")
def single_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series (priorities) whose members (orders) come from several roots."""
    members = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_custkey").alias("node"))
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 5).alias("root"))
    return integrity.several_roots(members, roots, "series")


@query("""
    SELECT l_orderkey, sum((l_discount * 10)::DECIMAL(18,6)) AS total FROM lineitem GROUP BY l_orderkey HAVING abs(sum((l_discount * 10)::DECIMAL(18,6)) - 1) > 0.001""")
def mole_fraction_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures (orders) whose fractions (ten times the discounts) do not sum to one."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("fraction"))
    return integrity.wrong_sums(parts, "l_orderkey", "fraction")


@query("""
    WITH r AS (SELECT o_custkey AS sha, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS bad, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') AS cur,
                      max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN o_orderkey END) AS x FROM orders GROUP BY o_custkey),
    k AS (SELECT c_custkey AS sha, CASE WHEN n IS NULL THEN 'no_records_stored' WHEN bad > 0 THEN 'unusable_record_present' WHEN cur = 0 THEN 'no_current_record' WHEN cur > 1 THEN 'multiple_current_records' ELSE 'selected' END AS kind, x
          FROM customer LEFT JOIN r ON c_custkey = r.sha)
    SELECT sha, kind, CASE WHEN kind = 'selected' THEN x END AS extraction FROM k""")
def exactly_one_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts (customers) with their records (orders; urgent ones are current, P is unusable): selected only if one is."""
    artifacts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sha"))
    records = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sha"), F.col("o_orderkey").alias("extraction"), F.lit("plain").alias("extractor"), F.col("o_orderpriority").alias("code_sha"), (F.col("o_orderstatus") != "P").alias("usable")
    )
    return versions.current_selection(artifacts, records, spark.sql("SELECT 'plain' AS extractor, '1-URGENT' AS code_sha"))


@query("""
    WITH s AS (SELECT doc_id, lang AS k, length(text) AS n FROM documents),
    c AS (SELECT doc_id, CASE WHEN k = 'fr' THEN 'no_text' WHEN n < 40 THEN 'out_of_range' WHEN k = 'de' THEN 'differs' ELSE 'matches' END AS chk FROM s)
    SELECT doc_id, count(*) AS n_checks, count(*) FILTER (WHERE chk IN ('differs', 'out_of_range')) AS n_failed, count(*) FILTER (WHERE chk = 'no_text') AS n_unverifiable,
        CASE WHEN count(*) FILTER (WHERE chk IN ('differs', 'out_of_range')) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE chk = 'no_text') > 0 THEN 'unverifiable' ELSE 'verified' END AS outcome
    FROM c GROUP BY doc_id""")
def replay_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded spans of documents re-sliced: French ones have lost their text, German ones were altered."""
    docs = table(spark, sf_dir, "documents")
    recorded = F.when(F.col("lang") == "de", F.lit("altered")).otherwise(F.substring("text", 11, 30))
    spans = docs.select("doc_id", F.lit(10).alias("start"), F.lit(40).alias("end"), recorded.alias("recorded"))
    return replay.outcomes(replay.checked_spans(spans, docs.where("lang <> 'fr'")), "doc_id")


_PTS = "SELECT event_id, user_id, value AS y, (event_id % 400)::DOUBLE AS x FROM events"


@query(f"""
    WITH p AS ({_PTS}), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY user_id ORDER BY y) <= 0.5 THEN 0 ELSE 1 END AS new FROM p)
    SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS band FROM g""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments (events of a user as a page) clustered into bands by their height (value)."""
    points = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("y"))
    return layout.bands(points, ["user_id"], "y").select("event_id", "user_id", "band")


@query(f"""
    WITH p AS (SELECT user_id, x AS x_start, x + y / 10 AS x_end FROM ({_PTS})),
    g AS (SELECT *, max(x_end) OVER (PARTITION BY user_id ORDER BY x_start, x_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
    b AS (SELECT *, sum(CASE WHEN reach IS NULL OR x_start - reach >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x_start, x_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM g)
    SELECT user_id, block::BIGINT AS block, min(x_start) AS x_start, max(x_end) AS x_end, count(*) AS n FROM b GROUP BY user_id, block""")
def column_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a page: unions of intervals with valleys between them."""
    x = (F.col("event_id") % 400).cast("double")
    spans = table(spark, sf_dir, "events").select("user_id", x.alias("x_start"), (x + F.col("value") / 10).alias("x_end"))
    return layout.merged_intervals(spans, ["user_id"])


@query(f"""
    WITH p AS ({_PTS}), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY user_id ORDER BY y) <= 0.5 THEN 0 ELSE 1 END AS new FROM p),
    b AS (SELECT user_id, y, sum(new) OVER (PARTITION BY user_id ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM g),
    r AS (SELECT user_id, band, min(y) AS y FROM b GROUP BY user_id, band), d AS (SELECT user_id, y - lag(y) OVER (PARTITION BY user_id ORDER BY y) AS gap FROM r)
    SELECT user_id, round(median(gap), 9) AS pitch FROM d WHERE gap IS NOT NULL GROUP BY user_id""")
def row_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median distance of rows of a page."""
    points = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("y"))
    return layout.row_pitch(layout.bands(points, ["user_id"], "y"), ["user_id"], "y").withColumn("pitch", F.round("pitch", 9))


@query("""
    SELECT o_custkey, max_by(o_orderstatus, o_orderdate) AS o_orderstatus, min(o_orderdate) AS position FROM (
        SELECT o_custkey, o_orderstatus, o_orderkey AS o_orderdate FROM orders) GROUP BY o_custkey""")
def iteration_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (customers) over iterations (orders): latest values, first position."""
    return diagnostics.labels(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"])


@query("SELECT l_partkey, min_by(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY l_partkey")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks (parts) as they first occur; lines of one number in one order come as they stand in the file."""
    ord_ = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", ord_, "_metadata.file_path", "_metadata.row_index")
    return diagnostics.first_occurrence(items, "l_partkey", "ord", ["l_quantity"], ("file_path", "row_index"))


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
    j AS (SELECT r.l_orderkey, s.l_partkey AS s, c.l_partkey AS c FROM r LEFT JOIN s USING (l_orderkey, l_partkey) LEFT JOIN c USING (l_orderkey, l_partkey))
    SELECT l_orderkey, count(*) AS n_requested, count(s) AS n_succeeded, count(c) AS n_converged, bool_and(s IS NOT NULL AND c IS NOT NULL) AS ok FROM j GROUP BY l_orderkey""")
def requested_vs_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested labels (parts of an order) against those that succeeded and converged."""
    items = table(spark, sf_dir, "lineitem")
    done = diagnostics.quality(items, items.where("l_returnflag <> 'R'"), items.where("l_linestatus = 'F'"), "l_orderkey", "l_partkey")
    return done.drop("missing")


@query("""
    SELECT s_suppkey, 'pressure' AS quantity, CASE s_suppkey % 4 WHEN 0 THEN 'atm' WHEN 1 THEN 'bar' WHEN 2 THEN 'kPa' END AS unit, CASE WHEN s_suppkey % 4 = 3 THEN 'unknown_unit' ELSE 'known' END AS unit_status FROM supplier""")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of pressure, one spelling in four unknown."""
    raw = F.element_at(F.array(*[F.lit(x) for x in (" atm", "bar ", "kPa", "torr")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("pressure").alias("quantity"), raw.alias("unit_raw"))
    return units.normalized_units(rows).drop("unit_raw")


@query("""
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::DECIMAL(12,2) * 0.01::DECIMAL(4,2) WHEN 1 THEN l_quantity::DECIMAL(12,2) * 0.001::DECIMAL(5,3) ELSE l_quantity::DECIMAL(12,2) END::DECIMAL(20,6) AS metres FROM lineitem""")
def unit_convert_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths (quantities) in cm, mm and m into metres by exact native arithmetic."""
    k = F.col("l_linenumber") % 3
    unit = F.when(k == 0, "cm").when(k == 1, "mm").otherwise("m")
    metres = units.in_base(F.col("l_quantity").cast("decimal(12,2)"), unit, "length").cast("decimal(20,6)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", metres.alias("metres"))


@query()
def unit_convert_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as temperatures and pressures, exact and rounded by significance."""
    k = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("string").alias("value"), F.when(k, "temperature").otherwise("pressure").alias("quantity"), F.when(k, "C").otherwise("atm").alias("unit")
    )
    return units.converted(rows)


def _streamed(spark: SparkSession, build, mode: str = "append") -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    logs.drained(build, f"{base}/out", f"{base}/state", mode)
    return spark.read.parquet(f"{base}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").option("recursiveFileLookup", True).parquet(sf_dir)


@query("SELECT ts::DATE AS day, sum(value::DECIMAL(28,6)) AS total, count(*) AS n FROM events GROUP BY 1")
def stream_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily ledger as a stream, in complete mode, against the batch sum."""
    return _streamed(spark, logs.daily_totals(_event_stream(spark, sf_dir), "ts", "value"), "complete")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def stream_filtered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a log passed on exactly once."""
    return _streamed(spark, _event_stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "event_type"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, false AS admitted, 0::INT AS calls, 0.0::DOUBLE AS used FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.n, e.event_id, e.value, f.calls < 20 AND f.used + e.value <= 500, f.calls + (f.calls < 20 AND f.used + e.value <= 500)::INT, CASE WHEN f.calls < 20 AND f.used + e.value <= 500 THEN f.used + e.value ELSE f.used END
          FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, value, admitted, used FROM f WHERE n > 0""")
def stream_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered admission of requests as a stream with two numbers of state for each run."""
    return _streamed(spark, logs.admissions(_event_stream(spark, sf_dir), "user_id", "event_id", "value", 500.0, 20))
