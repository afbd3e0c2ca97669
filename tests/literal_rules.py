"""Literal cases that show every outcome of a rule, with SQL or answers beside them; `test_literal_rules` runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text, web
from veritrail.operators import acquisition, integrity, ledger, providers, quotes, replay, series
from veritrail.sources import extraction

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, values: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def given(name: str, values: str, columns: str) -> str:
    """The same rows as a common table of DuckDB."""
    return f"{name}({columns}) AS (VALUES {values})"


ADDRESSES = """('8.8.8.8', true), ('1.1.1.1', true), ('2001:4860:4860::8888', true), ('10.0.0.1', false), ('127.0.0.1', false), ('169.254.1.1', false), ('192.168.0.9', false),
    ('224.0.0.1', false), ('239.1.1.1', false), ('240.0.0.1', false), ('0.0.0.0', false), ('::1', false), ('::', false), ('ff02::1', false), ('ff0e::1', false), ('fe80::1', false),
    ('fec0::1', false), ('fc00::1', false), ('64:ff9b::7f00:1', false), ('::ffff:127.0.0.1', false), ('::ffff:8.8.8.8', true), ('x', false), ('', false)"""


@query(f"WITH {given('t', ADDRESSES, 'address, public')} SELECT * FROM t")
def global_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a request may go to."""
    return rows(spark, ADDRESSES, "address, public").select("address", web.is_global("address").alias("public"))


_STATES = "draft validated ready_for_planning plan_pending_approval approved_for_execution running_literature literature_ready running_t3 running_arc diagnostics_ready results_ready completed_phase1 blocked failed".split()
STATES = ", ".join(f"('{s}')" for s in _STATES)
EDGES = """('draft', 'validated'), ('draft', 'failed'), ('validated', 'ready_for_planning'), ('validated', 'failed'), ('ready_for_planning', 'plan_pending_approval'), ('ready_for_planning', 'approved_for_execution'),
    ('ready_for_planning', 'failed'), ('plan_pending_approval', 'approved_for_execution'), ('plan_pending_approval', 'blocked'), ('plan_pending_approval', 'failed'), ('approved_for_execution', 'running_t3'),
    ('approved_for_execution', 'running_arc'), ('approved_for_execution', 'running_literature'), ('approved_for_execution', 'blocked'), ('approved_for_execution', 'failed'), ('running_literature', 'literature_ready'),
    ('running_literature', 'failed'), ('running_literature', 'blocked'), ('literature_ready', 'running_t3'), ('literature_ready', 'running_literature'), ('literature_ready', 'completed_phase1'), ('literature_ready', 'blocked'),
    ('literature_ready', 'failed'), ('running_t3', 'diagnostics_ready'), ('running_t3', 'failed'), ('running_arc', 'results_ready'), ('running_arc', 'failed'), ('diagnostics_ready', 'completed_phase1'),
    ('diagnostics_ready', 'running_literature'), ('diagnostics_ready', 'failed'), ('results_ready', 'completed_phase1'), ('results_ready', 'failed'), ('blocked', 'ready_for_planning'), ('blocked', 'failed'), ('failed', 'ready_for_planning')"""
RESUMED = """('running_t3', 'approved_for_execution'), ('running_arc', 'approved_for_execution'), ('running_literature', 'approved_for_execution'), ('approved_for_execution', 'approved_for_execution'),
    ('diagnostics_ready', 'diagnostics_ready'), ('results_ready', 'results_ready')"""


@query(f"""
    WITH {given('s', STATES, 'state')}, {given('e', EDGES, 'a, b')}, {given('r', RESUMED, 'a, b')}
    SELECT x.state AS current, y.state AS target, z.state AS origin,
        EXISTS (SELECT 1 FROM e WHERE e.a = x.state AND e.b = y.state) OR (x.state = 'failed' AND EXISTS (SELECT 1 FROM r WHERE r.a = z.state AND r.b = y.state)) AS legal
    FROM s x, s y, s z""")
def campaign_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step between the states of a campaign, by where it had failed."""
    s = rows(spark, STATES, "state")
    every = s.select(F.col("state").alias("current")).withColumn("target", F.explode(F.array(*map(F.lit, _STATES)))).withColumn("origin", F.explode(F.array(*map(F.lit, _STATES))))
    return every.withColumn("legal", ledger.can_step(F.col("current"), F.col("target"), F.col("origin")))


LOG = """('a', 1, 'draft'), ('a', 2, 'validated'), ('a', 3, 'running_t3'), ('b', 1, 'running_t3'), ('b', 2, 'failed'), ('b', 3, 'approved_for_execution'), ('b', 4, 'completed_phase1'),
    ('c', 1, 'draft'), ('c', 2, 'failed'), ('c', 3, 'approved_for_execution'), ('d', 1, 'blocked'), ('d', 2, 'ready_for_planning'), ('e', 1, 'diagnostics_ready'), ('e', 2, 'failed'), ('e', 3, 'results_ready')"""


@query(f"WITH {given('t', LOG, 'campaign, n, state')} SELECT campaign, n, state, lag(state) OVER (PARTITION BY campaign ORDER BY n) AS previous FROM t QUALIFY (campaign, n) IN (('a', 3), ('b', 4), ('c', 3), ('e', 3))")
def campaign_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of logged campaigns that are not legal."""
    return ledger.illegal_campaign_steps(rows(spark, LOG, "campaign, n, state"), "campaign", ["n"], "state").select("campaign", "n", "state", "previous")


ACTIONS = """('all', 'succeeded', 'done', 'approved', true, true, false), ('all', 'skipped', NULL, 'approved', false, true, false), ('skips', 'skipped', NULL, 'approved', false, true, false),
    ('fails', 'failed', 'failed_blocking', 'approved', true, true, false), ('fails', 'pending', NULL, 'approved', true, false, true), ('stopped', 'pending', NULL, 'rejected', true, false, false),
    ('stopped', 'succeeded', 'done', 'approved', true, true, false), ('open', 'pending', NULL, 'rejected', true, false, false), ('open', 'pending', NULL, 'approved', true, false, true),
    ('half', 'failed', 'failed_nonblocking', 'approved', true, true, false), ('half', 'succeeded', 'done', 'approved', true, true, false), ('outcome', 'pending', 'rejected', 'pending', false, false, false)"""
_ACTIONS = "plan, execution, outcome, approval, blocking, passed, executable"


@query(f"""
    WITH {given('t', ACTIONS, _ACTIONS)}
    SELECT plan, CASE WHEN count(*) FILTER (outcome = 'failed_blocking') > 0 THEN 'failed'
        WHEN bool_and(passed) AND count(*) FILTER (execution = 'succeeded') > 0 AND count(*) FILTER (blocking AND execution <> 'succeeded') = 0 THEN 'completed_phase1'
        WHEN NOT bool_or(executable) AND count(*) FILTER (approval = 'rejected' OR outcome = 'rejected') > 0 THEN 'blocked' ELSE 'none' END AS state FROM t GROUP BY plan""")
def plan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.plan_state(rows(spark, ACTIONS, _ACTIONS), "plan")


GATE = """(30, NULL, false, false, false, 'body', true, false, false, 'no_artifact'), (30, false, false, false, false, 'body', true, false, false, 'artifact_unreadable'), (5, true, true, false, false, 'body', true, false, false, 'quote_not_found too_short'),
    (30, true, false, false, true, 'body', true, false, false, 'quote_not_found semantic_discrepancy'), (30, true, false, false, false, 'body', true, false, false, 'quote_not_found'), (30, true, true, false, false, 'references', true, false, true, 'artifact_degraded'),
    (30, true, true, false, false, 'references', false, true, false, 'references_only'), (30, true, true, false, false, 'body', false, true, false, 'identity_mismatch'), (30, true, true, false, false, 'body', true, true, false, 'spans_missing'),
    (30, true, true, false, false, 'body', true, false, false, 'grounded_exact'), (30, true, false, true, false, 'body', true, false, false, 'grounded_fuzzy')"""


@query(f"WITH {given('t', GATE, 'n, r, e, f, d, s, i, m, g, status')} SELECT row_number() OVER () AS place, status FROM t")
def verdict_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status of the grounding gate, with the reason behind it if there is one."""
    t = spark.sql(f"SELECT posexplode(array{GATE.join('()')})").select((F.col("pos") + 1).cast("long").alias("place"), *[F.col(f"col.col{k}").alias(c) for k, c in enumerate(("n", "r", "e", "f", "d", "s", "i", "m", "g"), 1)])
    status = quotes.verdict(F.repeat(F.lit("q"), F.col("n")), *[F.col(c) for c in ("r", "e", "f", "d", "s", "i", "m", "g")])
    return t.select("place", F.concat_ws(" ", status["status"], status["reason"]).alias("status"))


NAMES = """(1, '10.1016/J.Fuel.2020', 'x'), (2, NULL, '  On Flames: A Study of Ignition  '), (3, '', '漢字'), (4, NULL, 'v1.2_final-draft'), (5, '10.1/(x)..', 'y'),
    (6, NULL, 'a very long title of a paper that goes on and on about laminar flame speeds of many blends and more'), (7, '_x/1', 'z'), (8, '...', 'w')"""


@query(f"""
    WITH {given('t', NAMES, 'id, doi, title')},
    f AS (SELECT id, coalesce(doi, '') <> '' AS by_doi, trim(regexp_replace(lower(trim(coalesce(doi, ''))), '[^a-z0-9._-]+', '-', 'g'), '-') AS d,
        trim(left(trim(regexp_replace(lower(trim(title)), '[^a-z0-9._-]+', '-', 'g'), '-'), 80), '-') AS stem, left(sha256(lower(trim(title))), 8) AS digest FROM t),
    c AS (SELECT id, coalesce(nullif(trim(left(CASE WHEN by_doi THEN d WHEN stem <> '' THEN stem || '-' || digest ELSE 'paper-' || digest END, 180), '-.'), ''), 'paper') AS c FROM f)
    SELECT id, CASE WHEN regexp_full_match(c, '[a-z0-9][a-z0-9._-]{{0,180}}') THEN c ELSE 'paper-' || left(sha256(c), 16) END AS slug FROM c""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, NAMES, "id, doi, title").select("id", text.slug(F.col("doi"), F.col("title")).alias("slug"))


ARTICLES = r"""(1, repeat('a ', 5000) || chr(10) || '7. References' || chr(10) || '[1] x'), (2, repeat('a ', 5000) || chr(10) || 'References to prior work are many'), (3, 'References'),
    (4, repeat('a ', 5000) || chr(10) || '  BIBLIOGRAPHY  ' || chr(10)), (5, repeat('a ', 5000))"""


@query(f"WITH {given('t', ARTICLES, 'id, body')} SELECT id, length(body) >= 9000 AND id IN (1, 4) AS full_article FROM t")
def full_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, ARTICLES.replace("chr(10)", "char(10)"), "id, body").select("id", text.is_full_article(F.col("body")).alias("full_article"))


TITLES = "(1, 'article', 'On flames'), (2, 'letter', 'On flames'), (3, 'dataset', 'x'), (4, 'erratum', 'Correction to: x'), (5, 'editorial', 'x'), (6, 'Peer-Review', 'x'), (7, 'article', '  Decision letter: x'), (8, NULL, 'Response to reviewer two'), (9, NULL, NULL), (10, 'article', 'Growth in response to strain'), (11, 'grant', 'x'), (12, 'article', 'Supplementary material')"


@query(f"WITH {given('t', TITLES, 'id, kind, title')} SELECT id, coalesce(lower(kind) IN ('editorial', 'grant', 'paratext', 'peer-review'), false) OR coalesce(regexp_matches(title, '(?i)^\\s*(author response|decision letter|reviewer response|response to review)\\b'), false) AS no_paper FROM t")
def non_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, TITLES, "id, kind, title").select("id", providers.non_paper(F.col("kind"), F.col("title")).alias("no_paper"))


BYTES = """(1, '255044462D312E37', 'application/pdf', 'application/pdf'), (2, '25504446', 'text/plain', 'application/pdf'), (3, '504B0304AA', 'application/octet-stream', 'application/zip'),
    (4, '504B03045B436F6E74656E745F54797065735D2E786D6C', 'text/plain', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'), (5, '0A20203C48544D4C3E', 'text/html', 'text/html'),
    (6, '3C21444F43545950452061727469636C653E', 'text/html', 'application/xml'), (7, '3C3F786D6C203F3E3C68746D6C3E', 'text/plain', 'application/xml'), (8, '61203C68746D6C3E', 'text/plain', 'text/plain'),
    (9, 'FFFE00', 'application/octet-stream', 'application/octet-stream'), (10, '3C61727469636C653E', 'text/plain', 'application/xml')"""


@query(f"WITH {given('t', BYTES, 'id, hex, fetched, dropped')} SELECT id, fetched, dropped FROM t")
def byte_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of bytes, as fetched and as dropped."""
    raw = F.unhex("hex")
    return rows(spark, BYTES, "id, hex, a, b").select("id", extraction.fetched_type(raw).alias("fetched"), extraction.content_type(raw).alias("dropped"))


PAPERS = """(1, 'Laminar flame speeds of ammonia. doi 10.1/abc', '10.1/abc', 'Laminar flame speeds of hydrogen and methane'), (2, 'Erratum. Laminar flame speeds 10.1/abc', '10.1/abc', 'Laminar flame speeds'),
    (3, 'laminar flame speeds of ammonia', NULL, 'A study of the laminar flame speeds of ammonia'), (4, 'ammonia', NULL, 'laminar flame speeds of ammonia'), (5, 'of the', NULL, 'of the')"""


@query(f"""
    WITH {given('t', PAPERS, 'id, body, doi, title')}, w AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND x NOT IN ('and', 'for', 'from', 'the', 'with', 'using', 'via', 'study', 'studies', 'analysis', 'effect', 'effects', 'new', 'novel', 'high', 'low'))) AS words FROM t),
    s AS (SELECT *, CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda x: contains(lower(body), x)))::DOUBLE / len(words) END AS share, coalesce(contains(lower(body), doi), false) AS doi_found FROM w)
    SELECT id, share, doi_found, share >= CASE WHEN doi_found THEN 0.4 ELSE 0.8 END AND NOT contains(lower(body), 'erratum') AS ok FROM s""")
def paper_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = acquisition.identity(F.col("body"), F.col("doi"), F.col("title"))
    return rows(spark, PAPERS, "id, body, doi, title").select("id", i.alias("i")).select("id", "i.share", "i.doi_found", "i.ok")


@query("SELECT a.range AS node, b.range AS ancestor, a.range - b.range AS depth FROM range(150) a JOIN range(150) b ON b.range < a.range")
def long_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors along a chain deeper than any limit on recursion."""
    nodes = spark.range(150).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    return integrity.ancestors(spark, nodes).select("node", "ancestor", F.col("depth").cast("long").alias("depth"))


@query("SELECT range AS node FROM range(130)")
def long_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a long ring, and none of a chain that leads to it."""
    nodes = spark.range(140).select(F.col("id").alias("node"), F.when(F.col("id") == 129, 0).when(F.col("id") >= 130, 5).otherwise(F.col("id") + 1).cast("long").alias("parent"))
    return integrity.on_cycles(spark, nodes)


AXES = "('s', 'T', 'coordinate', 'temperature'), ('s', 'u', 'observation', 'speed'), ('s', 'p', 'constant', 'pressure'), ('flat', 'u', 'observation', 'speed'), ('bare', 'T', 'coordinate', 'temperature')"
VALUES = """('s', 'c', 'p', 'constant', 'pressure', 1.0, NULL, 'table_cell'), ('s', '1', 'T', 'coordinate', 'temperature', 300.0, NULL, 'table_cell'), ('s', '1', 'u', 'observation', 'speed', 0.4, 'x', 'char_span'),
    ('s', '2', 'T', 'coordinate', 'pressure', 400.0, NULL, 'table_cell'), ('s', '2', 'u', 'observation', 'speed', NULL, 'y', 'table_cell'), ('s', '3', 'u', 'observation', 'length', NULL, NULL, 'char_span'), ('flat', '1', 'u', 'observation', 'speed', NULL, NULL, 'bbox')"""
_AXES, _VALUES = "series, axis_id, role, quantity", "series, point_id, axis_id, role, quantity, value, uncertainty, locator"


@query(f"WITH {given('a', AXES, _AXES)} SELECT series, 'no_coordinate' AS problem FROM a GROUP BY series HAVING count(*) FILTER (role = 'coordinate') = 0 UNION ALL SELECT series, 'no_observation' FROM a GROUP BY series HAVING count(*) FILTER (role = 'observation') = 0")
def series_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series without an axis of coordinates or of observations."""
    axes = rows(spark, AXES, _AXES)
    of = lambda role: series.lacking(axes, axes, "series", F.col("role") == role).withColumn("problem", F.lit(f"no_{role}"))
    return of("coordinate").unionByName(of("observation"))


@query(f"WITH {given('v', VALUES, _VALUES)} SELECT series, point_id FROM v WHERE role = 'observation' GROUP BY series, point_id HAVING bool_and(value IS NULL)")
def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that record no observed value."""
    return series.points_without_value(rows(spark, VALUES, _VALUES))


@query(f"WITH {given('a', AXES, _AXES)}, {given('v', VALUES, _VALUES)} SELECT v.series, point_id, v.axis_id, v.quantity, a.quantity AS declared FROM v JOIN a ON v.series = a.series AND v.axis_id = a.axis_id WHERE value IS NOT NULL AND v.quantity <> a.quantity")
def series_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of another quantity than their axis."""
    return series.wrong_quantities(rows(spark, VALUES, _VALUES), rows(spark, AXES, _AXES))


@query(f"WITH {given('v', VALUES, _VALUES)} SELECT series, point_id, axis_id, 'uncertain_without_value' AS problem FROM v WHERE uncertainty IS NOT NULL AND value IS NULL UNION ALL SELECT series, point_id, axis_id, 'char_span_value' FROM v WHERE locator = 'char_span' AND value IS NOT NULL")
def series_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertainties of absent values, and values that characters of a text ground."""
    values, keys = rows(spark, VALUES, _VALUES), ["series", "point_id", "axis_id"]
    bare = series.uncertain_without_value(values).select(*keys, F.lit("uncertain_without_value").alias("problem"))
    return bare.unionByName(series.spans_as_series_values(values).select(*keys, F.lit("char_span_value").alias("problem")))


BOUNDS = """('a', 'speed', 1.0, 'absolute', 0.1, 'speed', 0.2, 'speed'), ('b', 'speed', 1.0, 'relative', 0.1, 'relative_uncertainty', NULL, NULL), ('c', 'speed', 1.0, 'absolute', 0.1, 'length', -0.2, 'speed'),
    ('d', 'speed', NULL, 'absolute', 0.1, 'length', 0.0, 'length'), ('e', 'speed', 1.0, NULL, 0.1, 'length', NULL, NULL), ('f', 'speed', 1.0, 'relative', 0.1, 'speed', 0.1, 'relative_uncertainty')"""
_BOUNDS = "path, quantity, value, basis, upper, upper_quantity, lower, lower_quantity"


@query(f"""
    WITH {given('t', BOUNDS, _BOUNDS)}, b AS (SELECT path, 'upper' AS bound, quantity, value, basis, upper AS x, upper_quantity AS k FROM t UNION ALL SELECT path, 'lower', quantity, value, basis, lower, lower_quantity FROM t),
    p AS (SELECT path, bound, CASE WHEN x <= 0 THEN 'not_positive' WHEN value IS NOT NULL AND basis IS NOT NULL AND k <> CASE basis WHEN 'absolute' THEN quantity ELSE 'relative_uncertainty' END THEN 'wrong_quantity' END AS problem FROM b WHERE x IS NOT NULL)
    SELECT * FROM p WHERE problem IS NOT NULL""")
def uncertainty_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.wrong_bounds(rows(spark, BOUNDS, _BOUNDS))


NODES = "('p', 'paper_pdf', 'x'), ('q', 'paper_pdf', NULL), ('j', 'jats_xml', 'y'), ('c', 'figure_crop', NULL)"
REFS = """('r1', 'p', 'char_span', 'textual'), ('r2', 'q', 'char_span', 'textual'), ('r3', 'c', 'char_span', 'textual'), ('r4', 'c', 'bbox', 'digitized'), ('r5', 'p', 'table_cell', 'tabular'), ('r6', 'p', 'char_span', 'tabular'),
    ('r7', 'j', 'xpath', 'textual'), ('r8', 'p', 'xpath', 'digitized'), ('r9', 'p', 'table_cell', 'textual')"""
FITS = "('char_span', 'paper_pdf'), ('char_span', 'jats_xml'), ('table_cell', 'paper_pdf'), ('table_cell', 'jats_xml'), ('char_span', 'si_member'), ('table_cell', 'si_member'), ('bbox', 'paper_pdf'), ('bbox', 'si_member'), ('bbox', 'figure_crop'), ('xpath', 'jats_xml')"


@query(f"""
    WITH {given('n', NODES, 'node_id, kind, extraction')}, {given('r', REFS, 'path, node_id, locator, form')}, {given('f', FITS, 'locator, kind')},
    j AS (SELECT r.*, n.kind, n.extraction FROM r JOIN n ON r.node_id = n.node_id)
    SELECT path, CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.locator = j.locator AND f.kind = j.kind) THEN 'incompatible' ELSE 'no_extraction' END AS problem FROM j
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.locator = j.locator AND f.kind = j.kind) OR (locator = 'char_span' AND extraction IS NULL)""")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that may not target their node, or cite characters that were never extracted."""
    return series.incompatible_refs(rows(spark, REFS, "path, node_id, locator, form"), rows(spark, NODES, "node_id, kind, extraction"), rows(spark, FITS, "locator, kind"))


@query(f"""
    WITH {given('n', NODES, 'node_id, kind, extraction')}, {given('r', REFS, 'path, node_id, locator, form')}
    SELECT path, form FROM r JOIN n ON r.node_id = n.node_id WHERE (form = 'tabular' AND locator <> 'table_cell') OR (form = 'digitized' AND kind <> 'figure_crop') OR (form = 'textual' AND (locator = 'table_cell' OR kind = 'figure_crop'))""")
def reference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.wrong_forms(rows(spark, REFS, "path, node_id, locator, form"), rows(spark, NODES, "node_id, kind, extraction"))


CELLS, CITED = "('i', 0, 0), ('i', 0, 1), ('k', 2, 2)", "('a', 'i', 0, 1), ('b', 'i', 3, 0), ('c', 'z', 0, 0)"


@query(f"WITH {given('g', CELLS, 'i, r, c')}, {given('t', CITED, 'path, inventory, row_no, col_no')} SELECT path FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.i = inventory AND g.r = row_no AND g.c = col_no)")
def cited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of table cells that are not there."""
    return series.missing_cells(rows(spark, CITED, "path, inventory, row, column"), rows(spark, CELLS, "inventory, row, column")).select("path")


UNITS, MEASURED = "('t1', 'K', 'K'), ('t1', 'kelvin', 'K'), ('t2', 'atm', 'atm')", "('a', 't1', 'kelvin', 'K'), ('b', 't1', 'kelvin', 'C'), ('c', 't1', 'atm', 'atm'), ('d', 't9', 'K', 'K')"


@query(f"""
    WITH {given('u', UNITS, 's, w, n')}, {given('t', MEASURED, 'path, sha, raw, norm')}, p AS (SELECT path, CASE WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.s = sha) THEN 'unknown_table'
        WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.s = sha AND u.w = raw) THEN 'unknown_unit' WHEN EXISTS (SELECT 1 FROM u WHERE u.s = sha AND u.w = raw AND u.n <> norm) THEN 'differs' END AS problem FROM t) SELECT * FROM p WHERE problem IS NOT NULL""")
def recorded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded units against the answers of the table that they name."""
    return series.unit_answers(rows(spark, MEASURED, "path, table_sha, unit_raw, unit_normalized"), rows(spark, UNITS, "table_sha, spelling, unit"))


LISTED, WALKED = "('a', 1), ('a', 1), ('b', 2)", "('a', 1), ('b', 2), ('c', 3)"


@query(f"WITH {given('l', LISTED, 'path, n')}, {given('w', WALKED, 'path, n')} SELECT *, 'not_walked' AS problem FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM w) UNION ALL SELECT *, 'not_listed' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM l)")
def reconciled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.unreconciled(rows(spark, LISTED, "path, n"), rows(spark, WALKED, "path, n"), ["path", "n"])


REPORTS, CLAIMS, ATTEMPTS = "('a', 'verified'), ('b', 'failed'), ('c', 'verified'), ('d', 'verified'), ('e', 'unverifiable')", "('b', 'x'), ('c', 'x')", "('d', 'not_refuted'), ('b', 'refuted')"


@query(f"""
    WITH {given('r', REPORTS, 'report, evidence')}, {given('c', CLAIMS, 'report, claim')}, {given('a', ATTEMPTS, 'report, status')}
    SELECT report, CASE WHEN evidence = 'failed' THEN 'failed' WHEN report IN (SELECT report FROM c UNION SELECT report FROM a) THEN 'unverifiable' ELSE evidence END AS overall FROM r""")
def overall_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report of checks can claim at most."""
    return series.overall(rows(spark, REPORTS, "report, evidence"), rows(spark, CLAIMS, "report, claim"), rows(spark, ATTEMPTS, "report, status"), "report")


RESERVED = """('r', 1, 'model_call', 'open', 100, 1.5, 0, NULL, NULL, NULL), ('r', 1, 'model_call', 'settled', 100, 1.5, 0, 80, 1.0, NULL), ('r', 2, 'model_call', 'open', 50, 0.5, 0, NULL, NULL, NULL), ('r', 2, 'model_call', 'abandoned', 50, 0.5, 0, NULL, NULL, NULL),
    ('r', 3, 'fetch', 'open', 0, 0.0, 1000, NULL, NULL, NULL), ('r', 4, 'fetch', 'abandoned', 0, 0.0, 1000, NULL, NULL, 10), ('q', 1, 'model_call', 'settled', 10, 0.1, 0, 500, 9.0, NULL)"""
_RESERVED = "run, reservation, kind, state, tokens, cost_usd, bytes, actual_tokens, actual_cost_usd, actual_bytes"


@query(f"""
    WITH {given('t', RESERVED, _RESERVED)}, o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run, reservation ORDER BY (state <> 'open')::INT DESC) = 1)
    SELECT run, count(*) FILTER (kind = 'model_call' AND state <> 'abandoned') AS calls,
        coalesce(sum(CASE WHEN state = 'abandoned' THEN 0 WHEN state = 'open' THEN tokens ELSE coalesce(actual_tokens, tokens) END) FILTER (kind = 'model_call'), 0)::BIGINT AS tokens,
        coalesce(sum(CASE WHEN state = 'abandoned' THEN 0 WHEN state = 'open' THEN cost_usd ELSE coalesce(actual_cost_usd, cost_usd) END) FILTER (kind = 'model_call'), 0)::DOUBLE AS cost_usd,
        coalesce(sum(CASE WHEN state = 'open' THEN bytes ELSE coalesce(actual_bytes, bytes) END) FILTER (kind <> 'model_call'), 0)::BIGINT AS fetch_bytes, CASE run WHEN 'q' THEN 'tokens' END AS exceeded FROM o GROUP BY run""")
def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations settled, abandoned and open, against limits."""
    used = ledger.usage(rows(spark, RESERVED, _RESERVED), "run", {"calls": 10, "tokens": 400, "cost_usd": 5.0})
    return used.withColumn("cost_usd", F.col("cost_usd").cast("double"))


WISHES = """(1, 't3_run', 5.0, 0.0), (2, 't3_run', 50.0, 0.0), (3, 't3_run', 500.0, 0.0), (4, 'arc_run', 20.0, 0.0), (5, 'arc_run', 21.0, 0.0), (6, 'experiment', 0.0, 0.0), (7, 'literature_search', 0.0, 0.5), (8, 'literature_search', 0.0, 5.0), (9, 'other', 0.0, 0.0)"""


@query(f"WITH {given('t', WISHES, 'id, kind, hours, usd')} SELECT id, CASE WHEN id IN (1, 4, 7) THEN 'auto_approved' ELSE 'requires_approval' END AS requirement FROM t")
def approval_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which actions need a person under a policy of 10 and 20 hours, 1 USD and a budget of 100 hours."""
    policy = {"t3_hours": F.lit(10.0), "arc_hours": F.lit(20.0), "experiments": F.lit(True), "literature": F.lit(False), "literature_usd": F.lit(1.0)}
    return rows(spark, WISHES, "id, kind, hours, usd").select("id", ledger.requirement(F.col("kind"), F.col("hours"), F.col("usd"), F.lit(100.0), policy).alias("requirement"))


SPANS = "('e1', 1, 0, 4, 'lami'), ('e1', 1, 2, 6, 'mina'), ('e2', 1, 0, 4, 'xxxx'), ('e3', 2, 0, 4, 'any '), ('e4', 1, 5, 99, 'r')"


@query("SELECT * FROM (VALUES ('e1', 2, 0, 0, 'verified'), ('e2', 1, 1, 0, 'failed'), ('e3', 1, 0, 1, 'unverifiable'), ('e4', 1, 1, 0, 'failed')) t(envelope, n_checks, n_failed, n_unverifiable, outcome)")
def span_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of re-slicing recorded spans."""
    texts = rows(spark, "(1, 'laminar')", "doc_id, text")
    spans = spark.sql(f"SELECT * FROM VALUES {SPANS} AS t(envelope, doc_id, start, end, recorded)")
    return replay.outcomes(replay.checked_spans(spans, texts), "envelope")
