"""Driver queries over rules of records: addresses, campaigns, plans, verdicts, names, series, references, budgets, approvals.

Their relations are made of the driver's tables by SQL that both engines read; keys of rows choose among shapes, so that every outcome
occurs and the work grows with the tables. The SQL beside a query states the rule anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text, web
from veritrail.operators import acquisition, integrity, ledger, providers, quotes, replay, series
from veritrail.plans.boundary_queries import chosen
from veritrail.sources import extraction
from veritrail.sources.tables import dealt, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "documents")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation of a query over the driver's tables, named in braces."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def given(name: str, sql: str) -> str:
    """The same relation as a common table of DuckDB."""
    return f"{name} AS ({sql.format(**{t: t for t in TABLES})})"


_FIRST, _SECOND = ["8", "10", "127", "169", "172", "192", "223", "224", "240", "0"], ["168", "254", "16", "31", "32", "1"]
ADDRESSES = f"""SELECT c_custkey, CASE c_custkey % 7 WHEN 5 THEN {chosen("c_custkey", ["fe80::", "fc00::", "ff0e::", "2001:4860:4860::", "::ffff:8.8.4."])} || CAST(c_custkey % 100 AS VARCHAR(9)) WHEN 6 THEN c_name
    ELSE {chosen("c_custkey", _FIRST)} || '.' || {chosen("c_nationkey", _SECOND)} || '.7.' || CAST(c_custkey % 200 + 1 AS VARCHAR(9)) END AS address FROM {{customer}}"""


@query(rf"""
    WITH {given("t", ADDRESSES)}, p AS (SELECT *, TRY_CAST(split_part(address, '.', 1) AS INT) AS a, TRY_CAST(split_part(address, '.', 2) AS INT) AS b FROM t)
    SELECT c_custkey, address, CASE WHEN contains(address, '#') THEN false WHEN contains(address, ':') THEN starts_with(address, '2001:4860:') OR starts_with(address, '::ffff:8.')
        ELSE NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) END AS public FROM p""")
def global_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a request may go to."""
    return rows(spark, sf_dir, ADDRESSES).withColumn("public", web.is_global("address"))


_STATES = "draft validated ready_for_planning plan_pending_approval approved_for_execution running_literature literature_ready running_t3 running_arc diagnostics_ready results_ready completed_phase1 blocked failed".split()
EDGES = """('draft', 'validated'), ('draft', 'failed'), ('validated', 'ready_for_planning'), ('validated', 'failed'), ('ready_for_planning', 'plan_pending_approval'), ('ready_for_planning', 'approved_for_execution'),
    ('ready_for_planning', 'failed'), ('plan_pending_approval', 'approved_for_execution'), ('plan_pending_approval', 'blocked'), ('plan_pending_approval', 'failed'), ('approved_for_execution', 'running_t3'),
    ('approved_for_execution', 'running_arc'), ('approved_for_execution', 'running_literature'), ('approved_for_execution', 'blocked'), ('approved_for_execution', 'failed'), ('running_literature', 'literature_ready'),
    ('running_literature', 'failed'), ('running_literature', 'blocked'), ('literature_ready', 'running_t3'), ('literature_ready', 'running_literature'), ('literature_ready', 'completed_phase1'), ('literature_ready', 'blocked'),
    ('literature_ready', 'failed'), ('running_t3', 'diagnostics_ready'), ('running_t3', 'failed'), ('running_arc', 'results_ready'), ('running_arc', 'failed'), ('diagnostics_ready', 'completed_phase1'),
    ('diagnostics_ready', 'running_literature'), ('diagnostics_ready', 'failed'), ('results_ready', 'completed_phase1'), ('results_ready', 'failed'), ('blocked', 'ready_for_planning'), ('blocked', 'failed'), ('failed', 'ready_for_planning')"""
RESUMED = """('running_t3', 'approved_for_execution'), ('running_arc', 'approved_for_execution'), ('running_literature', 'approved_for_execution'), ('approved_for_execution', 'approved_for_execution'),
    ('diagnostics_ready', 'diagnostics_ready'), ('results_ready', 'results_ready')"""
_LEGAL = f"e(a, b) AS (VALUES {EDGES}), r(a, b) AS (VALUES {RESUMED})"
STEPS = f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE {chosen('o_custkey', _STATES)} END AS current, {chosen('o_orderkey', _STATES)} AS target, {chosen('(o_custkey + o_orderkey)', _STATES)} AS origin FROM {{orders}}"


@query(f"""
    WITH {given("t", STEPS)}, {_LEGAL}
    SELECT *, EXISTS (SELECT 1 FROM e WHERE e.a = current AND e.b = target) OR (current = 'failed' AND EXISTS (SELECT 1 FROM r WHERE r.a = origin AND r.b = target)) AS legal FROM t""")
def campaign_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a campaign may step from one state to another, by where it had failed."""
    return rows(spark, sf_dir, STEPS).withColumn("legal", ledger.can_step(F.col("current"), F.col("target"), F.col("origin")))


LOG = f"SELECT l_orderkey AS campaign, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_partkey % 4 = 0 THEN 'failed' ELSE {chosen('(l_partkey + l_linenumber)', _STATES)} END AS state FROM {{lineitem}}"


@query(f"""
    WITH {given("t", LOG)}, {_LEGAL}, s AS (SELECT *, lag(state) OVER (PARTITION BY campaign ORDER BY n) AS previous, lag(state, 2) OVER (PARTITION BY campaign ORDER BY n) AS origin FROM t)
    SELECT campaign, n, state, previous FROM s WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.a = previous AND e.b = state)
        AND NOT (previous = 'failed' AND EXISTS (SELECT 1 FROM r WHERE r.a = origin AND r.b = state))""")
def campaign_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of logged campaigns (the lines of an order) that are not legal."""
    return ledger.illegal_campaign_steps(rows(spark, sf_dir, LOG), "campaign", ["n"], "state").select("campaign", "n", "state", "previous")


ACTIONS = """SELECT l_orderkey AS plan, CASE l_suppkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'skipped' ELSE 'succeeded' END AS execution, CASE WHEN l_partkey % 31 = 0 THEN 'failed_blocking' WHEN l_partkey % 17 = 0 THEN 'rejected' END AS outcome,
    CASE WHEN l_partkey % 13 = 0 THEN 'rejected' ELSE 'approved' END AS approval, l_linenumber % 2 = 0 AS blocking, l_suppkey % 5 <> 0 OR l_linenumber = 1 AS passed, l_suppkey % 5 = 0 AND l_partkey % 13 <> 0 AS executable FROM {lineitem}"""


@query(f"""
    WITH {given("t", ACTIONS)}
    SELECT plan, CASE WHEN count(*) FILTER (outcome = 'failed_blocking') > 0 THEN 'failed'
        WHEN bool_and(passed) AND count(*) FILTER (execution = 'succeeded') > 0 AND count(*) FILTER (blocking AND execution <> 'succeeded') = 0 THEN 'completed_phase1'
        WHEN NOT bool_or(executable) AND count(*) FILTER (approval = 'rejected' OR outcome = 'rejected') > 0 THEN 'blocked' ELSE 'none' END AS state FROM t GROUP BY plan""")
def plan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each plan (an order) by its actions (the lines)."""
    return ledger.plan_state(rows(spark, sf_dir, ACTIONS), "plan")


GATE = """SELECT o_orderkey, o_orderpriority || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE ' of a quote that is long enough' END AS quote, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 11 <> 1 END AS r, o_orderkey % 3 = 0 AS e, o_orderkey % 3 = 1 AS f, o_orderkey % 2 = 0 AS d,
    CASE WHEN o_custkey % 7 = 0 THEN 'references' ELSE 'body' END AS s, o_custkey % 6 <> 0 AS i, o_orderkey % 5 = 0 AS m, o_custkey % 13 = 0 AS g FROM {orders}"""


@query(f"""
    WITH {given("t", GATE)}, x AS (SELECT *, CASE WHEN r IS NULL THEN 'no_artifact' WHEN NOT r AND NOT e AND NOT f THEN 'artifact_unreadable' WHEN length(quote) < 20 OR NOT (e OR f) THEN 'quote_not_found' WHEN g THEN 'artifact_degraded'
        WHEN s = 'references' THEN 'references_only' WHEN NOT i THEN 'identity_mismatch' WHEN m THEN 'spans_missing' WHEN e THEN 'grounded_exact' ELSE 'grounded_fuzzy' END AS status FROM t)
    SELECT o_orderkey, status, CASE WHEN status = 'quote_not_found' THEN CASE WHEN length(quote) < 20 THEN 'too_short' WHEN d THEN 'semantic_discrepancy' END END AS reason FROM x""")
def verdict_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status of the grounding gate, with the reason behind it if there is one."""
    v = quotes.verdict(*[F.col(c) for c in ("quote", "r", "e", "f", "d", "s", "i", "m", "g")])
    return rows(spark, sf_dir, GATE).select("o_orderkey", v.alias("v")).select("o_orderkey", "v.status", "v.reason")


NAMES = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '10.1016/J.' || p_name || '(' || p_brand || ')' WHEN 1 THEN '' WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN '...' END ELSE NULL END AS doi,
    CASE p_partkey % 5 WHEN 0 THEN '  On ' || p_name || ': A Study of ' || p_type || chr(10) WHEN 1 THEN '漢字' || p_size WHEN 2 THEN repeat(p_name || ', ', 12) WHEN 3 THEN '_' || p_brand || '.v' || p_size ELSE p_type END AS title FROM {part}"""


@query(f"""
    WITH {given("t", NAMES)}, u AS (SELECT id, doi, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title FROM t),
    f AS (SELECT id, coalesce(doi, '') <> '' AS by_doi, trim(regexp_replace(lower(trim(coalesce(doi, ''))), '[^a-z0-9._-]+', '-', 'g'), '-') AS d,
        trim(left(trim(regexp_replace(lower(title), '[^a-z0-9._-]+', '-', 'g'), '-'), 80), '-') AS stem, left(sha256(lower(title)), 8) AS digest FROM u),
    c AS (SELECT id, coalesce(nullif(trim(left(CASE WHEN by_doi THEN d WHEN stem <> '' THEN stem || '-' || digest ELSE 'paper-' || digest END, 180), '-.'), ''), 'paper') AS c FROM f)
    SELECT id, CASE WHEN regexp_full_match(c, '[a-z0-9][a-z0-9._-]{{0,180}}') THEN c ELSE 'paper-' || left(sha256(c), 16) END AS slug FROM c""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of papers by DOI, or by title and its hash."""
    return rows(spark, sf_dir, NAMES.replace("chr(10)", "char(10)")).select("id", text.slug(F.col("doi"), F.col("title")).alias("slug"))


ARTICLES = "SELECT doc_id, repeat(text, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 20 END) || CASE doc_id % 4 WHEN 0 THEN chr(10) || '7. References' || chr(10) || '[1]' WHEN 1 THEN chr(10) || '  BIBLIOGRAPHY ' WHEN 2 THEN chr(10) || 'References to prior work' ELSE '' END AS body FROM {documents} WHERE text IS NOT NULL"


@query(rf"WITH {given('t', ARTICLES)} SELECT doc_id, length(body) >= 9000 AND regexp_matches(body, '(?im)^\s*(?:[0-9]+[.\s]*)?(?:references|bibliography|works cited|literature cited)\s*$') AS full_article FROM t")
def full_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with a heading or without, that are full articles."""
    return rows(spark, sf_dir, ARTICLES.replace("chr(10)", "char(10)")).select("doc_id", text.is_full_article(F.col("body")).alias("full_article"))


TITLES = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN {chosen('p_partkey', ['article', 'letter', 'dataset', 'editorial', 'Peer-Review', 'grant', 'paratext'])} END AS kind, CASE WHEN p_partkey % 10 <> 0 THEN {chosen('p_size', ['  Decision letter: ', 'Response to review of ', 'Growth in response to review of ', 'Author response ', 'Responses to ', ''])} || p_name END AS title FROM {{part}}"


@query(f"WITH {given('t', TITLES)} SELECT id, coalesce(lower(kind) IN ('editorial', 'grant', 'paratext', 'peer-review'), false) OR coalesce(regexp_matches(title, '(?i)^\\s*(author response|decision letter|reviewer response|response to review)\\b'), false) AS no_paper FROM t")
def non_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of an index that are no papers, by type or title."""
    return rows(spark, sf_dir, TITLES).select("id", providers.non_paper(F.col("kind"), F.col("title")).alias("no_paper"))


_HEADS = ["%PDF-1.7 ", "%PDF", "  <HTML>", "<!DOCTYPE article>", "<?xml ?>", "a <html>", "<article>", "<!doctype html>", ""]
BYTES = f"SELECT p_partkey AS id, {chosen('p_partkey', _HEADS)} || p_name || CASE WHEN p_size % 5 = 0 THEN repeat(p_type, 400) ELSE '' END AS content, p_size % 7 = 0 AS broken FROM {{part}}"


@query(f"""
    WITH {given("t", BYTES)}, h AS (SELECT *, lower(regexp_replace(content, '^\\s+', '')) AS head FROM t)
    SELECT id, CASE WHEN broken THEN 'application/octet-stream' WHEN starts_with(content, '%PDF-') THEN 'application/pdf' WHEN starts_with(head, '<html') OR starts_with(head, '<!doctype') THEN 'text/html' ELSE 'text/plain' END AS fetched,
        CASE WHEN broken THEN 'application/octet-stream' WHEN starts_with(content, '%PDF') THEN 'application/pdf' WHEN starts_with(head, '<?xml') OR starts_with(head, '<article') OR starts_with(head, '<!doctype article') THEN 'application/xml'
            WHEN starts_with(head, '<!doctype html') OR starts_with(head, '<html') THEN 'text/html' ELSE 'text/plain' END AS dropped FROM h""")
def byte_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of bytes, as fetched and as dropped; broken ones begin with bytes of no encoding."""
    made = rows(spark, sf_dir, BYTES).withColumn("raw", F.concat(F.when(F.col("broken"), F.unhex(F.lit("FFFE00"))).otherwise(F.unhex(F.lit(""))), F.encode("content", "UTF-8")))
    return made.select("id", extraction.fetched_type(F.col("raw")).alias("fetched"), extraction.content_type(F.col("raw")).alias("dropped"))


PAPERS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Erratum. ' ELSE '' END || p_name || ' of ' || p_type || CASE WHEN p_partkey % 4 = 0 THEN ' doi 10.1/' || p_partkey ELSE '' END AS body, CASE WHEN p_partkey % 8 <> 1 THEN '10.1/' || p_partkey END AS doi, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'A study of the ' || p_name || ' and methane' WHEN 2 THEN 'of the' ELSE p_type || ' speeds of hydrogen' END AS title FROM {part}"


@query(f"""
    WITH {given("t", PAPERS)}, w AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND x NOT IN ('and', 'for', 'from', 'the', 'with', 'using', 'via', 'study', 'studies', 'analysis', 'effect', 'effects', 'new', 'novel', 'high', 'low'))) AS words FROM t),
    s AS (SELECT *, CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda x: contains(lower(body), x)))::DOUBLE / len(words) END AS share, coalesce(contains(lower(body), doi), false) AS doi_found FROM w)
    SELECT id, share, doi_found, share >= CASE WHEN doi_found THEN 0.4 ELSE 0.8 END AND NOT contains(lower(body), 'erratum') AS ok FROM s""")
def paper_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is the paper that was asked for, by title and DOI."""
    i = acquisition.identity(F.col("body"), F.col("doi"), F.col("title"))
    return rows(spark, sf_dir, PAPERS).select("id", i.alias("i")).select("id", "i.share", "i.doi_found", "i.ok")


@query("SELECT a.p_partkey AS node, b.p_partkey AS ancestor, a.p_partkey - b.p_partkey AS depth FROM part a JOIN part b ON b.p_partkey < a.p_partkey AND b.p_partkey >= a.p_partkey - a.p_partkey % 150")
def long_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors along chains of 150 parts."""
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 150 > 0 THEN p_partkey - 1 END AS parent")
    return integrity.ancestors(spark, nodes).select("node", "ancestor", F.col("depth").cast("long").alias("depth"))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey % 140 < 130 AND c_custkey - c_custkey % 140 + 129 <= (SELECT max(c_custkey) FROM customer)")
def long_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of rings of 130 customers, and none of the chains that lead to them; the last ring may be open."""
    nodes = table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "CASE WHEN c_custkey % 140 = 129 THEN c_custkey - 129 WHEN c_custkey % 140 > 129 THEN c_custkey - c_custkey % 140 + 5 ELSE c_custkey + 1 END AS parent")
    return integrity.on_cycles(spark, nodes)


_ROLE, _QUANTITY = chosen("l_linenumber", ["coordinate", "observation", "constant"]), chosen("l_linenumber", ["temperature", "speed", "pressure"])
AXES = f"SELECT DISTINCT l_orderkey AS series, concat('x', l_linenumber) AS axis_id, {_ROLE} AS role, {_QUANTITY} AS quantity FROM {{lineitem}}"
VALUES = f"""SELECT l_orderkey AS series, l_suppkey % 3 AS point_id, concat('x', l_linenumber) AS axis_id, {_ROLE} AS role, CASE WHEN l_partkey % 7 = 0 THEN 'length' ELSE {_QUANTITY} END AS quantity, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS value,
    CASE WHEN l_suppkey % 2 = 0 THEN 'x' END AS uncertainty, {chosen("l_partkey", ["table_cell", "char_span", "bbox"])} AS locator FROM {{lineitem}}"""


@query(f"WITH {given('a', AXES)} SELECT series, 'no_coordinate' AS problem FROM a GROUP BY series HAVING count(*) FILTER (role = 'coordinate') = 0 UNION ALL SELECT series, 'no_observation' FROM a GROUP BY series HAVING count(*) FILTER (role = 'observation') = 0")
def series_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series (orders) without an axis of coordinates or of observations."""
    axes = spark.sql(AXES, lineitem=dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey"))
    of = lambda role: series.lacking(axes, axes, "series", F.col("role") == role).withColumn("problem", F.lit(f"no_{role}"))
    return of("coordinate").unionByName(of("observation"))


@query(f"WITH {given('v', VALUES)} SELECT series, point_id FROM v WHERE role = 'observation' GROUP BY series, point_id HAVING bool_and(value IS NULL)")
def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that record no observed value."""
    return series.points_without_value(rows(spark, sf_dir, VALUES))


@query(f"WITH {given('a', AXES)}, {given('v', VALUES)} SELECT v.series, point_id, v.axis_id, v.quantity, a.quantity AS declared FROM v JOIN a ON v.series = a.series AND v.axis_id = a.axis_id WHERE value IS NOT NULL AND v.quantity <> a.quantity")
def series_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of another quantity than their axis."""
    return series.wrong_quantities(rows(spark, sf_dir, VALUES), rows(spark, sf_dir, AXES))


@query(f"WITH {given('v', VALUES)} SELECT series, point_id, axis_id, 'uncertain_without_value' AS problem FROM v WHERE uncertainty IS NOT NULL AND value IS NULL UNION ALL SELECT series, point_id, axis_id, 'char_span_value' FROM v WHERE locator = 'char_span' AND value IS NOT NULL")
def series_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertainties of absent values, and values that characters of a text ground."""
    values, keys = rows(spark, sf_dir, VALUES), ["series", "point_id", "axis_id"]
    bare = series.uncertain_without_value(values).select(*keys, F.lit("uncertain_without_value").alias("problem"))
    return bare.unionByName(series.spans_as_series_values(values).select(*keys, F.lit("char_span_value").alias("problem")))


BOUNDS = f"""SELECT concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey) AS path, {_QUANTITY} AS quantity, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS value, CASE l_suppkey % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'relative' END AS basis,
    CASE WHEN l_partkey % 7 <> 0 THEN l_tax END AS upper, CASE WHEN l_partkey % 2 = 0 THEN 'relative_uncertainty' ELSE {_QUANTITY} END AS upper_quantity, CASE WHEN l_suppkey % 4 = 0 THEN l_discount - 0.02 END AS lower, {_QUANTITY} AS lower_quantity FROM {{lineitem}}"""


@query(f"""
    WITH {given("t", BOUNDS)}, b AS (SELECT path, 'upper' AS bound, quantity, value, basis, upper AS x, upper_quantity AS k FROM t UNION ALL SELECT path, 'lower', quantity, value, basis, lower, lower_quantity FROM t),
    p AS (SELECT path, bound, CASE WHEN x <= 0 THEN 'not_positive' WHEN value IS NOT NULL AND basis IS NOT NULL AND k <> CASE basis WHEN 'absolute' THEN quantity ELSE 'relative_uncertainty' END THEN 'wrong_quantity' END AS problem FROM b WHERE x IS NOT NULL)
    SELECT * FROM p WHERE problem IS NOT NULL""")
def uncertainty_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds (tax and discount of a line) that are no magnitudes or of a wrong quantity."""
    return series.wrong_bounds(rows(spark, sf_dir, BOUNDS))


NODES = f"SELECT s_suppkey AS node_id, {chosen('s_suppkey', ['paper_pdf', 'jats_xml', 'figure_crop', 'si_member'])} AS kind, CASE WHEN s_nationkey % 3 <> 0 THEN s_name END AS extraction FROM {{supplier}}"
REFS = f"SELECT concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey) AS path, l_suppkey AS node_id, {chosen('l_partkey', ['char_span', 'table_cell', 'bbox', 'xpath'])} AS locator, {chosen('l_linenumber', ['textual', 'tabular', 'digitized'])} AS form FROM {{lineitem}}"
#: Which locators may target which nodes.
FITS = "('char_span', 'paper_pdf'), ('char_span', 'jats_xml'), ('table_cell', 'paper_pdf'), ('table_cell', 'jats_xml'), ('char_span', 'si_member'), ('table_cell', 'si_member'), ('bbox', 'paper_pdf'), ('bbox', 'si_member'), ('bbox', 'figure_crop'), ('xpath', 'jats_xml')"


@query(f"""
    WITH {given("n", NODES)}, {given("r", REFS)}, f(locator, kind) AS (VALUES {FITS}), j AS (SELECT r.*, n.kind, n.extraction, f.kind IS NOT NULL AS fits FROM r JOIN n ON r.node_id = n.node_id LEFT JOIN f ON f.locator = r.locator AND f.kind = n.kind)
    SELECT path, CASE WHEN NOT fits THEN 'incompatible' ELSE 'no_extraction' END AS problem FROM j WHERE NOT fits OR (locator = 'char_span' AND extraction IS NULL)""")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References (lines) that may not target their node (supplier), or cite characters that were never extracted."""
    return series.incompatible_refs(rows(spark, sf_dir, REFS), rows(spark, sf_dir, NODES), spark.sql(f"SELECT * FROM VALUES {FITS} AS t(locator, kind)"))


@query(f"""
    WITH {given("n", NODES)}, {given("r", REFS)}
    SELECT path, form FROM r JOIN n ON r.node_id = n.node_id WHERE (form = 'tabular' AND locator <> 'table_cell') OR (form = 'digitized' AND kind <> 'figure_crop') OR (form = 'textual' AND (locator = 'table_cell' OR kind = 'figure_crop'))""")
def reference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose source form their locator or node contradicts."""
    return series.wrong_forms(rows(spark, sf_dir, REFS), rows(spark, sf_dir, NODES))


CELLS = "SELECT l_orderkey AS inventory, l_linenumber % 3 AS `row`, l_partkey % 2 AS `column` FROM {lineitem} WHERE l_returnflag = 'N'"
CITED = "SELECT l_orderkey AS inventory, l_linenumber % 4 AS `row`, l_partkey % 2 AS `column`, concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey) AS path FROM {lineitem}"


@query(f"WITH {given('g', CELLS.replace('`', chr(34)))}, {given('t', CITED.replace('`', chr(34)))} SELECT path FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.inventory = t.inventory AND g.\"row\" = t.\"row\" AND g.\"column\" = t.\"column\")")
def cited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of table cells that are not there."""
    return series.missing_cells(rows(spark, sf_dir, CITED), rows(spark, sf_dir, CELLS)).select("path")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded texts that don't hash to their address: those of every third document are cited under another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    sha = F.sha2(F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), "UTF-8"), 256)
    return series.wrong_embeddings(docs.withColumn("sha", sha)).select("doc_id")


UNITS = "SELECT DISTINCT concat('t', p_size % 3) AS table_sha, lower(p_brand) AS spelling, p_brand AS unit FROM {part} WHERE p_size % 4 <> 0"
MEASURED = "SELECT concat(p_partkey, '') AS path, concat('t', p_size % 4) AS table_sha, lower(p_brand) AS unit_raw, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS unit_normalized FROM {part}"


@query(f"""
    WITH {given("u", UNITS)}, {given("t", MEASURED)}, p AS (SELECT path, CASE WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.table_sha = t.table_sha) THEN 'unknown_table'
        WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.table_sha = t.table_sha AND u.spelling = unit_raw) THEN 'unknown_unit' WHEN EXISTS (SELECT 1 FROM u WHERE u.table_sha = t.table_sha AND u.spelling = unit_raw AND u.unit <> unit_normalized) THEN 'differs' END AS problem FROM t)
    SELECT * FROM p WHERE problem IS NOT NULL""")
def recorded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded units against the answers of the table that they name: brands, in tables by size."""
    return series.unit_answers(rows(spark, sf_dir, MEASURED), rows(spark, sf_dir, UNITS))


LISTED = "SELECT concat(l_orderkey, '.', l_linenumber) AS path, l_partkey % 2 AS n FROM {lineitem} WHERE l_suppkey % 10 <> 0"
WALKED = "SELECT concat(l_orderkey, '.', l_linenumber) AS path, l_partkey % 2 AS n FROM {lineitem} WHERE l_suppkey % 10 <> 1"


@query(f"WITH {given('l', LISTED)}, {given('w', WALKED)} SELECT *, 'not_walked' AS problem FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM w) UNION ALL SELECT *, 'not_listed' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM l)")
def reconciled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one list that the other lacks, counted with repeats."""
    return series.unreconciled(rows(spark, sf_dir, LISTED), rows(spark, sf_dir, WALKED), ["path", "n"])


REPORTS = "SELECT o_orderkey AS report, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'verified' ELSE 'unverifiable' END AS evidence FROM {orders}"
CLAIMS = "SELECT l_orderkey AS report, l_partkey AS claim FROM {lineitem} WHERE l_returnflag = 'R'"
ATTEMPTS = "SELECT l_orderkey AS report, 'not_refuted' AS status FROM {lineitem} WHERE l_partkey % 9 = 0"


@query(f"""
    WITH {given("r", REPORTS)}, {given("c", CLAIMS)}, {given("a", ATTEMPTS)}
    SELECT report, CASE WHEN evidence = 'failed' THEN 'failed' WHEN report IN (SELECT report FROM c UNION SELECT report FROM a) THEN 'unverifiable' ELSE evidence END AS overall FROM r""")
def overall_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report of checks (an order) can claim at most."""
    return series.overall(rows(spark, sf_dir, REPORTS), rows(spark, sf_dir, CLAIMS), rows(spark, sf_dir, ATTEMPTS), "report")


RESERVED = """SELECT l_orderkey AS run, concat(l_linenumber, '.', l_partkey, '.', l_suppkey) AS reservation, CASE WHEN l_partkey % 3 = 0 THEN 'fetch' ELSE 'model_call' END AS kind, s.state, CAST(l_quantity AS BIGINT) AS tokens, CAST(l_suppkey % 10 AS DOUBLE) AS cost_usd, l_partkey % 1000 AS bytes,
    CASE WHEN s.state = 'settled' THEN CAST(l_quantity * 2 AS BIGINT) END AS actual_tokens, CASE WHEN s.state = 'settled' AND l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 7 AS DOUBLE) END AS actual_cost_usd, CASE WHEN s.state <> 'open' AND l_suppkey % 3 = 0 THEN l_partkey % 10 END AS actual_bytes
    FROM {lineitem} JOIN (SELECT 'open' AS state UNION ALL SELECT 'settled' UNION ALL SELECT 'abandoned') AS s ON s.state = 'open' OR s.state = CASE l_suppkey % 3 WHEN 0 THEN 'settled' WHEN 1 THEN 'abandoned' END"""


@query(f"""
    WITH {given("t", RESERVED)}, o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run, reservation ORDER BY (state <> 'open')::INT DESC) = 1),
    u AS (SELECT run, count(*) FILTER (kind = 'model_call' AND state <> 'abandoned') AS calls,
        coalesce(sum(CASE WHEN state = 'abandoned' THEN 0 WHEN state = 'open' THEN tokens ELSE coalesce(actual_tokens, tokens) END) FILTER (kind = 'model_call'), 0)::BIGINT AS tokens,
        coalesce(sum(CASE WHEN state = 'abandoned' THEN 0 WHEN state = 'open' THEN cost_usd ELSE coalesce(actual_cost_usd, cost_usd) END) FILTER (kind = 'model_call'), 0)::DOUBLE AS cost_usd,
        coalesce(sum(CASE WHEN state = 'open' THEN bytes ELSE coalesce(actual_bytes, bytes) END) FILTER (kind <> 'model_call'), 0)::BIGINT AS fetch_bytes FROM o GROUP BY run)
    SELECT *, CASE WHEN calls > 2 THEN 'calls' WHEN tokens > 90 THEN 'tokens' WHEN cost_usd > 5 THEN 'cost_usd' END AS exceeded FROM u""")
def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations (lines) of each run (order), settled, abandoned and open, against limits."""
    used = ledger.usage(rows(spark, sf_dir, RESERVED), "run", {"calls": 2, "tokens": 90, "cost_usd": 5.0})
    return used.withColumn("cost_usd", F.col("cost_usd").cast("double"))


WISHES = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {chosen('l_partkey', ['t3_run', 'arc_run', 'experiment', 'literature_search', 'literature_corpus_pass', 'other'])} AS kind, l_quantity AS hours, l_tax * 20 AS usd FROM {{lineitem}}"


@query(f"""WITH {given("t", WISHES)} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (kind = 't3_run' AND hours <= 10) OR (kind = 'arc_run' AND hours <= 20) OR (kind IN ('literature_search', 'literature_corpus_pass') AND usd <= 1) THEN 'auto_approved' ELSE 'requires_approval' END AS requirement FROM t""")
def approval_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which actions (lines) need a person under a policy of 10 and 20 hours, 1 USD and a budget of 100 hours."""
    policy = {"t3_hours": F.lit(10.0), "arc_hours": F.lit(20.0), "experiments": F.lit(True), "literature": F.lit(False), "literature_usd": F.lit(1.0)}
    need = ledger.requirement(F.col("kind"), F.col("hours"), F.col("usd"), F.lit(100.0), policy)
    return rows(spark, sf_dir, WISHES).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", need.alias("requirement"))


SPANS = "SELECT doc_id, concat('e', doc_id % 50) AS envelope, CAST(doc_id % 20 AS INT) AS `start`, CAST(CASE WHEN doc_id % 11 = 0 THEN 10000000 ELSE doc_id % 20 + 5 END AS INT) AS `end`, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE substr(text, CAST(doc_id % 20 + 1 AS INT), 5) END AS recorded FROM {documents} WHERE length(text) >= 30"
SOURCES = "SELECT doc_id, text FROM {documents} WHERE doc_id % 7 <> 0"


@query(f"""
    WITH {given("s", SPANS.replace("`", chr(34)))}, {given("t", SOURCES)}, c AS (SELECT envelope, CASE WHEN t.text IS NULL THEN 'open' WHEN s."end" > length(t.text) OR substr(t.text, s."start" + 1, s."end" - s."start") <> recorded THEN 'wrong' END AS found FROM s LEFT JOIN t ON s.doc_id = t.doc_id)
    SELECT envelope, count(*) AS n_checks, count(*) FILTER (found = 'wrong') AS n_failed, count(*) FILTER (found = 'open') AS n_unverifiable,
        CASE WHEN count(*) FILTER (found = 'wrong') > 0 THEN 'failed' WHEN count(*) FILTER (found = 'open') > 0 THEN 'unverifiable' ELSE 'verified' END AS outcome FROM c GROUP BY envelope""")
def span_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of re-slicing spans that are recorded of documents, some of which are lost."""
    return replay.outcomes(replay.checked_spans(rows(spark, sf_dir, SPANS), rows(spark, sf_dir, SOURCES)), "envelope")
