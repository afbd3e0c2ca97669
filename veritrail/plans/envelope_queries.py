"""Driver queries over nested envelopes of evidence, made of orders (the envelope) and lineitem (its claims and texts).

Each line is a node with a text (`T3 = 17 K end`) and a claim that cites label, number and unit in it. Keys decide which
claims are wrong: a text that differs, a piece of a number, a place beyond the text, a node that is lost or unsound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import envelopes
from veritrail.plans.boundary_queries import _SPELLINGS, chosen
from veritrail.sources.tables import dealt, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_UNITS, _KINDS = ["K", "%", "bar", "cm s^-1", "s", "cm"], ["temperature", "mole_fraction", "pressure", "velocity", "time", "velocity"]
#: SQL of both engines: a line's node, claim and places.
_ITEMS = f"""
    SELECT *, label || ' = ' || value || ' ' || unit || ' end' AS text, 'n' || i AS own, CASE WHEN s % 19 = 0 THEN 'lost' ELSE 'n' || i END AS node,
        CASE WHEN p % 23 = 0 THEN 'table_cell' ELSE 'char_span' END AS label_kind, length(label) + 3 AS value_at, length(label) + 4 + length(value) AS unit_at,
        CASE WHEN p % 13 = 0 AND length(value) > 1 THEN 1 ELSE 0 END AS less, CASE WHEN s % 17 = 0 THEN 100 ELSE 0 END AS beyond,
        CASE WHEN p % 11 = 0 THEN value || '9' WHEN p % 13 = 0 AND length(value) > 1 THEN left(value, length(value) - 1) ELSE value END AS raw,
        CASE WHEN s % 29 = 0 THEN 'failed' WHEN s % 31 = 0 THEN 'unverifiable' END AS problem,
        CASE WHEN n % 2 = 0 THEN 'standard_deviation' ELSE 'unknown' END AS u_kind, CASE WHEN p % 2 = 0 THEN 'absolute' END AS u_basis, CASE WHEN p % 3 = 0 THEN 'linear' END AS u_scale,
        CASE WHEN p % 5 = 0 THEN 'figure_region' ELSE 'char_span' END AS said_kind
    FROM (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) - 1 AS i,
            l_partkey AS p, l_suppkey AS s, l_linenumber AS n, 'T' || l_linenumber AS label, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS value,
            {chosen("l_partkey", _UNITS)} AS unit, {chosen("l_partkey", _KINDS)} AS quantity FROM {{lineitem}}) AS lines"""


def _ref(node: str, start: str, end: str, kind: str = "'char_span'") -> str:
    return f"struct({node} AS node_id, struct({kind} AS kind, {start} AS start, {end} AS end) AS locator)"


def _envelopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The envelopes by order, and the nodes that they cite. Lines are dealt out by order once; envelopes and nodes keep its place and meet there."""
    items = spark.sql(_ITEMS, lineitem=dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"))
    value = lambda raw, less: f"struct(quantity AS quantity_kind, {raw} AS raw_text, {_ref('node', 'value_at', f'value_at + length(value) - {less}')} AS value_ref, unit AS unit_raw, {_ref('node', 'unit_at', 'unit_at + length(unit) + beyond')} AS unit_ref)"
    label = f"label AS label_raw, {_ref('node', '0', 'length(label)', 'label_kind')} AS label_ref"
    uncertain = f"struct(u_kind AS kind, u_basis AS basis, u_scale AS scale, {value('value', '0')} AS upper, CASE WHEN false THEN {value('value', '0')} END AS lower)"
    claims = items.selectExpr(
        "k", "i", f"struct({label}, {value('raw', 'less')} AS value, CASE WHEN n % 3 = 0 THEN {uncertain} END AS uncertainty) AS scalar",
        f"struct({label}, unit AS token_raw, {_ref('node', 'unit_at', 'unit_at + length(unit)')} AS token_ref) AS categorical",
        f"struct({label}, 'no_unit' AS reason, {_ref('node', '0', 'length(text)', 'said_kind')} AS statement_ref) AS said",
    )
    grouped = claims.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "scalar", "categorical", "said"))).alias("_in_order"))
    grouped = grouped.select("k", F.col("_in_order.scalar").alias("scalar_claims"), F.col("_in_order.categorical").alias("categorical_claims"), F.col("_in_order.said").alias("unextracted"))
    first = _ref("'n0'", "0", "1")
    subject = f"struct(CASE WHEN labelled THEN 'T' END AS label_raw, CASE WHEN labelled THEN {first} END AS label_ref, CASE WHEN NOT labelled THEN 'ambiguous' END AS reason, CASE WHEN NOT labelled THEN {_ref(chr(39) + 'n0' + chr(39), '0', '2')} END AS reason_ref)"
    heads = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderpriority AS attribution", "o_orderstatus = 'F' AS labelled").dropDuplicates(["k"])
    rows = grouped.join(heads, "k").selectExpr("k", "attribution", f"{first} AS attribution_ref", f"{subject} AS subject", "scalar_claims", "categorical_claims", "unextracted")
    return rows, items.select("k", F.col("own").alias("node_id"), "text", "problem")


#: SQL of DuckDB: every reference of every envelope, flat, with the text beside it.
_REFS = f"""items AS MATERIALIZED ({_ITEMS.format(lineitem="lineitem")}),
    heads AS (SELECT k, any_value(attribution) AS attribution, any_value(labelled) AS labelled FROM (SELECT o_orderkey AS k, o_orderpriority AS attribution, o_orderstatus = 'F' AS labelled FROM orders) GROUP BY k),
    x AS (SELECT items.* FROM items JOIN heads USING (k)), kept AS (SELECT heads.* FROM heads WHERE k IN (SELECT k FROM items)),
    refs(k, path, node, kind, s, e, recorded, paired) AS (
        SELECT k, 'scalar_claims[' || i || '].label_ref', node, label_kind, 0, length(label), label, true FROM x
        UNION ALL SELECT k, 'scalar_claims[' || i || '].value.value_ref', node, 'char_span', value_at, value_at + length(value) - less, raw, true FROM x
        UNION ALL SELECT k, 'scalar_claims[' || i || '].value.unit_ref', node, 'char_span', unit_at, unit_at + length(unit) + beyond, unit, true FROM x
        UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty.upper.value_ref', node, 'char_span', value_at, value_at + length(value), value, true FROM x WHERE n % 3 = 0
        UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty.upper.unit_ref', node, 'char_span', unit_at, unit_at + length(unit) + beyond, unit, true FROM x WHERE n % 3 = 0
        UNION ALL SELECT k, 'categorical_claims[' || i || '].label_ref', node, label_kind, 0, length(label), label, true FROM x
        UNION ALL SELECT k, 'categorical_claims[' || i || '].token_ref', node, 'char_span', unit_at, unit_at + length(unit), unit, true FROM x
        UNION ALL SELECT k, 'unextracted[' || i || '].label_ref', node, label_kind, 0, length(label), label, true FROM x
        UNION ALL SELECT k, 'unextracted[' || i || '].statement_ref', node, said_kind, 0, length(text), NULL, false FROM x
        UNION ALL SELECT k, 'attribution_ref', 'n0', 'char_span', 0, 1, NULL, false FROM kept
        UNION ALL SELECT k, 'subject.label_ref', 'n0', 'char_span', 0, 1, 'T', true FROM kept WHERE labelled
        UNION ALL SELECT k, 'subject.reason_ref', 'n0', 'char_span', 0, 2, NULL, false FROM kept WHERE NOT labelled),
    located AS (SELECT refs.*, items.text, items.problem FROM refs LEFT JOIN items ON refs.k = items.k AND refs.node = items.own)"""
#: The measured values, flat: (path, number's end, whether the text of the number is a piece of it).
_VALUES = """values_ AS (
        SELECT k, 'scalar_claims[' || i || '].value' AS path, * EXCLUDE (k) FROM x
        UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty.upper', * EXCLUDE (k) REPLACE (0 AS less) FROM x WHERE n % 3 = 0)"""


@query(f"""
    WITH {_REFS}, {_VALUES}
    SELECT k, path, 'reference' AS kind FROM refs UNION ALL SELECT k, path, 'value' FROM values_
    UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty', 'uncertainty' FROM x WHERE n % 3 = 0""")
def envelope_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference, measured value and uncertainty of the envelopes with its path."""
    rows, _ = _envelopes(spark, sf_dir)
    kinds = {"reference": envelopes.REF, "value": envelopes.VALUE, "uncertainty": envelopes.UNCERTAINTY}
    return envelopes.kinds_walked(rows, "k", kinds)


_FOUND = f"""{_REFS}, {_VALUES}, known(q, spelling) AS (VALUES {_SPELLINGS}),
    judged AS (SELECT *, CASE WHEN kind <> 'char_span' THEN 'not_a_char_span' WHEN problem IS NOT NULL THEN 'node_problem' WHEN text IS NULL THEN 'unknown_node'
            WHEN e > length(text) THEN 'out_of_range' WHEN substr(text, s + 1, e - s) <> recorded THEN 'differs' END AS finding FROM located WHERE paired),
    found(k, path, finding, category) AS (
        SELECT k, path, finding, CASE finding WHEN 'node_problem' THEN problem WHEN 'not_a_char_span' THEN 'unverifiable' WHEN 'unknown_node' THEN 'unverifiable' ELSE 'failed' END FROM judged WHERE finding IS NOT NULL
        UNION ALL SELECT k, path || '.value_ref', 'value_not_whole', 'failed' FROM values_ WHERE problem IS NULL AND node <> 'lost' AND less = 1
        UNION ALL SELECT k, path || '.unit_ref', 'unit_not_in_vocabulary', 'failed' FROM values_ v WHERE problem IS NULL AND node <> 'lost' AND beyond = 0 AND NOT EXISTS (SELECT 1 FROM known WHERE q = quantity AND spelling = unit)
        UNION ALL SELECT k, '', 'nothing_checked', 'unverifiable' FROM kept WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.k = kept.k AND j.finding IS NULL))"""


@query(f"WITH {_FOUND} SELECT k, path, finding, category FROM found")
def condition_set_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replay of each envelope finds wrong or cannot verify."""
    rows, nodes = _envelopes(spark, sf_dir)
    return envelopes.findings(rows, nodes, "k")


_CLAIMS = """claims(k, path, claim, gap) AS (
        SELECT k, regexp_replace(replace(path, 'attribution_ref', 'attribution'), '\\.[a-z_]*$', ''), CASE WHEN path = 'attribution_ref' THEN attribution WHEN path = 'subject.reason_ref' THEN 'ambiguous' ELSE 'no_unit' END,
            CASE WHEN kind = 'char_span' AND problem IS NULL AND e <= length(text) THEN 'support_unrecorded' ELSE 'location_unresolved' END FROM located JOIN kept USING (k) WHERE NOT paired
        UNION ALL SELECT k, path || '.quantity_kind', quantity, 'no_support_offered' FROM values_ WHERE (SELECT count(DISTINCT q) FROM known WHERE spelling = unit) > 1
        UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty.kind', u_kind, 'no_support_offered' FROM x WHERE n % 3 = 0 AND u_kind <> 'unknown'
        UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty.basis', u_basis, 'no_support_offered' FROM x WHERE n % 3 = 0 AND u_basis IS NOT NULL
        UNION ALL SELECT k, 'scalar_claims[' || i || '].uncertainty.scale', u_scale, 'no_support_offered' FROM x WHERE n % 3 = 0 AND u_scale IS NOT NULL)"""


@query(f"WITH {_FOUND}, {_CLAIMS} SELECT k, path, claim, gap FROM claims")
def condition_set_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each envelope that nothing recorded supports."""
    rows, nodes = _envelopes(spark, sf_dir)
    return envelopes.claims(rows, nodes, "k").select("k", "path", "claim", "gap")


@query(f"""
    WITH {_FOUND}, {_CLAIMS},
    counted AS (SELECT k, (SELECT count(*) FROM refs r WHERE r.k = kept.k AND kind = 'char_span') AS n_total, (SELECT count(*) FROM judged j WHERE j.k = kept.k AND finding IS NULL) AS n_checked,
            (SELECT count(*) FROM claims c WHERE c.k = kept.k AND gap = 'support_unrecorded') AS n_support_only, (SELECT count(*) FROM claims c WHERE c.k = kept.k) AS n_claims,
            (SELECT count(*) FROM found f WHERE f.k = kept.k AND category = 'failed') AS n_failed, (SELECT count(*) FROM found f WHERE f.k = kept.k AND category = 'unverifiable') AS n_unverifiable FROM kept)
    SELECT *, n_total - n_checked - n_support_only AS n_unchecked, CASE WHEN n_failed > 0 THEN 'failed' WHEN n_unverifiable > 0 OR n_checked = 0 THEN 'unverifiable' ELSE 'verified' END AS evidence,
        CASE WHEN n_failed > 0 THEN 'failed' WHEN n_unverifiable > 0 OR n_checked = 0 OR n_claims > 0 THEN 'unverifiable' ELSE 'verified' END AS overall
    FROM counted""")
def condition_set_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each envelope's replay."""
    rows, nodes = _envelopes(spark, sf_dir)
    return envelopes.replayed(rows, nodes, "k")
