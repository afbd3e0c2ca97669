"""Driver queries over spans of text: units and numbers that are pieces of something longer.

Sentences of measurements are made of lineitem (its quantities as values, its keys choose units and what stands
around them), as one text for each order; documents serve as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import units
from veritrail.operators import boundaries
from veritrail.sources.tables import table

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


def chosen(key: str, listed: list[str]) -> str:
    """SQL of both engines: one of the listed texts by the remainder of a key."""
    cases = " ".join("WHEN {} THEN '{}'".format(i, x.replace("'", "''")) for i, x in enumerate(listed))
    return f"CASE {key} % {len(listed)} {cases} END"


_UNITS = ["K", "cm", "cm s^-1", "bar", "s", "Pa", "%", "m/s", "deg C", "C", "furlong", "-", "L", "ppm"]
_QUANTITIES = ["temperature", "length", "velocity", "pressure", "time", "pressure", "mole_fraction", "velocity", "temperature", "temperature", "length", "mole_fraction", "volume", "mass_fraction"]
_GLUES = [" ", "", "(", "k", " deg ", "§", " cm\t", "["]
_TAILS = ["", " s^-1 here", "*", "*cm", "¹", "(a)", ")", "€", "^2", "--- end", "m", ", then"]
#: A sentence for each line: a value, what glues it to a unit, the unit, what follows; and which value span is claimed.
_LINES = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, head || glue || unit || tail AS text, length(head || glue) AS u_start, length(head || glue || unit) AS u_end, quantity,
        CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN place ELSE 1 + place END AS v_start,
        CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 4 THEN length(head) - 1 ELSE length(head) END AS v_end
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3 + l_linenumber % 2 AS place,
            CASE WHEN l_linenumber % 2 = 1 THEN 'T = ' ELSE 'at ' END || CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '' END || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS head,
            {chosen("(l_partkey + l_linenumber)", _GLUES)} AS glue, {chosen("(l_suppkey + l_linenumber)", _UNITS)} AS unit,
            {chosen("(l_suppkey + l_linenumber)", _QUANTITIES)} AS quantity, {chosen("(l_orderkey + l_partkey)", _TAILS)} AS tail FROM {{lineitem}}) AS made"""
_SPELLINGS = ", ".join(
    "('{}', '{}')".format(q, s) for q, s in sorted({(q, u) for q, u in units.BASE_UNITS.items()} | {(q, u) for q, u, *_ in units.RULES} | {(q, u) for q, u, _ in units.ALIASES})
)
_TOKEN, _DELIMITED = r"[\p{L}\p{N}%°_/^*·⁻−–-]", r"[\s\[\]\"''“”=:,;.]"


@query(rf"""
    WITH known(q, s) AS (VALUES {_SPELLINGS}), lines AS ({_LINES.format(lineitem="lineitem")}),
    marked AS (
        SELECT *, CASE WHEN u_start > 0 THEN substr(text, u_start, 1) ELSE '' END AS b, substr(text, u_start + 1, u_end - u_start) AS quote,
            regexp_extract(substr(text, u_end + 1), '^[*/^·−–-]*') AS run, substr(text, u_end + length(run) + 1, 1) AS past,
            CASE WHEN run <> '' AND regexp_full_match(past, '[\p{{L}}\p{{N}}]') THEN substr(text, u_end + length(run), 1) ELSE past END AS a,
            regexp_extract(substr(text, v_start + 1), '^[0-9]+') = substr(text, v_start + 1, v_end - v_start) AND NOT regexp_full_match(substr(text, v_start, 1), '[0-9a-zA-Z.,]') AS whole FROM lines)
    SELECT l_orderkey, l_linenumber, text, quote, quantity, CASE
        WHEN regexp_full_match(b, '[0-9]') AND v_start IS NULL THEN 'unit_digit_glue_no_value_span'
        WHEN regexp_full_match(b, '[0-9]') AND NOT (v_start < v_end AND v_end <= length(text)) THEN 'unit_digit_glue_value_span_malformed'
        WHEN regexp_full_match(b, '[0-9]') AND v_end <> u_start THEN 'unit_digit_glue_value_span_mismatch'
        WHEN regexp_full_match(b, '[0-9]') AND NOT whole THEN 'unit_digit_glue_value_span_not_clean_numeral'
        WHEN NOT regexp_full_match(b, '[0-9]') AND regexp_full_match(b, '{_TOKEN}') THEN 'unit_leading_not_maximal'
        WHEN NOT regexp_full_match(b, '[0-9]') AND b <> '' AND NOT regexp_full_match(b, '{_DELIMITED}|\(') THEN 'unit_leading_unclassified_char'
        WHEN regexp_full_match(a, '[⁰¹²³⁴⁵⁶⁷⁸⁹₀-₉]') THEN 'unit_trailing_exponent_or_footnote_ambiguous'
        WHEN regexp_full_match(a, '{_TOKEN}') THEN 'unit_trailing_not_maximal'
        WHEN a <> '' AND NOT regexp_full_match(a, '{_DELIMITED}|\)') THEN 'unit_trailing_unclassified_char'
        WHEN NOT EXISTS (SELECT 1 FROM known WHERE q = quantity AND s = quote) THEN 'unit_not_in_vocabulary'
        WHEN EXISTS (SELECT 1 FROM known WHERE length(s) > length(quote) AND starts_with(regexp_replace(substr(text, u_start + 1), '\s+', ' ', 'g'), s)) THEN 'unit_not_maximal_forward'
        WHEN EXISTS (SELECT 1 FROM known WHERE length(s) > length(quote) AND ends_with(regexp_replace(substr(text, 1, u_end), '\s+', ' ', 'g'), s)) THEN 'unit_not_maximal_backward'
        END AS violation
    FROM marked""")
def unit_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quoted unit with the reason why it is only a piece of what stands there, or null."""
    lines = spark.sql(_LINES, lineitem=table(spark, sf_dir, "lineitem"))
    spans = lines.withColumnsRenamed({"u_start": "start", "u_end": "end", "v_start": "value_start", "v_end": "value_end"})
    quote = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("quote")
    return boundaries.unit_violations(spans).select("l_orderkey", "l_linenumber", "text", quote, "quantity", "violation")


#: A clause for each line, by its part: numbers alone, in ranges, in uncertainties, in flattened powers.
_CLAUSE = """CASE l_partkey % 6 WHEN 0 THEN q || ' 6 ' || n WHEN 1 THEN q || ' - ' || n WHEN 2 THEN q || ' x 10 ' || n WHEN 3 THEN 'T ' || q || ' K' WHEN 4 THEN q || '-' || n ELSE q || '– ' || n || ' 6 ' || q END"""
_TEXTS = f"""
    SELECT l_orderkey AS doc_id, {{joined}} AS text
    FROM (SELECT l_orderkey, l_linenumber, {_CLAUSE} AS clause FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS q, CAST(l_linenumber AS VARCHAR(9)) AS n FROM {{lineitem}}) AS parts) AS clauses
    GROUP BY l_orderkey"""
_SINGLE, _MORE = r"(?:/[cC]0\s*|[-+−–])?\d+(?:\.\d+)?(?:[eE][-+]?\d+(?:\.\d+)?)?", r"\d+(?:\.\d+)?(?:[eE][-+]?\d+(?:\.\d+)?)?"
_PATTERNS = [r"\d+\s+6\s+\d+", _SINGLE + r"(?:\s+[-–]\s*|[-–]\s+)" + _MORE, _SINGLE + r"\s*[x×*]\s*10\s+" + _MORE]


def _found(name: str, pattern: str, source: str) -> str:
    """SQL of DuckDB: doc_id, start and end of each match of a pattern in a table's texts."""
    return rf"""{name} AS (
        SELECT doc_id, before + length(hit) AS c_end, before AS c_start FROM (
            SELECT doc_id, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda h: length(h))), 0)))::BIGINT AS before
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM {source})))"""


def _enclosed_sql(source: str) -> str:
    found = ", ".join(_found(f"c{i}", p, source) for i, p in enumerate(_PATTERNS))
    holds = lambda i: f"EXISTS (SELECT 1 FROM c{i} c WHERE c.doc_id = s.doc_id AND c.c_start <= s.c_start AND c.c_end >= s.c_end AND (c.c_start < s.c_start OR c.c_end > s.c_end))"
    return f"""{_found("numbers", "[0-9]+", source)}, {found}
    SELECT doc_id, s.c_start AS start, s.c_end AS "end", CASE WHEN {holds(0)} THEN 'ascii6_uncertainty' WHEN {holds(1)} THEN 'spaced_range' WHEN {holds(2)} THEN 'flattened_scientific' END AS construct
    FROM numbers s"""


@query(f"""WITH texts AS ({_TEXTS.format(lineitem="lineitem", joined="string_agg(clause, '; ' ORDER BY l_linenumber, clause)")}), {_enclosed_sql("texts")}""")
def enclosing_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of digits in the measurement texts of orders, with the construct that it is a piece of."""
    joined = "array_join(sort_array(collect_list(struct(l_linenumber, clause))).clause, '; ')"
    texts = spark.sql(_TEXTS.format(lineitem="{lineitem}", joined=joined), lineitem=table(spark, sf_dir, "lineitem"))
    return boundaries.enclosed_matches(texts, "[0-9]+")


@query(f"""WITH {_enclosed_sql("documents")}""")
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of digits in documents, with the construct that it is a piece of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return boundaries.enclosed_matches(docs, "[0-9]+")
