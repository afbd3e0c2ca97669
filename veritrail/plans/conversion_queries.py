"""Driver queries over conversion tables: brands of parts are units, of which three versions of a table give different scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import conversions
from veritrail.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: SQL of both engines: rules of versions 0 to 2 and aliases; values are lines that cite a version, or one that was never shipped.
_RULES = "SELECT DISTINCT p_partkey % 3 AS version, 'length' AS quantity, p_brand AS unit, 'm' AS base, concat(length(p_brand) + p_partkey % 3, '.5') AS scale, concat(p_partkey % 3, '') AS offset FROM {part}"
_ALIASES = "SELECT DISTINCT p_partkey % 3 AS version, 'length' AS quantity, lower(p_brand) AS spelling, p_brand AS unit FROM {part} WHERE p_partkey % 3 > 0"
_VALUES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_suppkey % 4 AS version, 'length' AS quantity, CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN concat(' ', lower(p_brand), ' ') ELSE upper(p_type) END AS unit_raw, l_quantity AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
_DUCK = f"""r AS ({_RULES.format(part="part")}), a AS ({_ALIASES.format(part="part")}), v AS ({_VALUES.format(part="part", lineitem="lineitem")}),
    rj AS (SELECT version, string_agg('{{"base":"' || base || '","offset":"' || "offset" || '","quantity":"' || quantity || '","scale":"' || scale || '","unit":"' || unit || '"}}', ',' ORDER BY quantity, unit, base, "offset", scale) AS j FROM r GROUP BY version),
    aj AS (SELECT version, string_agg('{{"quantity":"' || quantity || '","spelling":"' || spelling || '","unit":"' || unit || '"}}', ',' ORDER BY quantity, unit, spelling) AS j FROM a GROUP BY version),
    p AS (SELECT rj.version, '{{"aliases":[' || coalesce(aj.j, '') || '],"rules":[' || rj.j || ']}}' AS payload FROM rj LEFT JOIN aj ON rj.version = aj.version)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    values = spark.sql(_VALUES, part=parts, lineitem=table(spark, sf_dir, "lineitem"))
    return conversions.addressed(spark.sql(_RULES, part=parts), spark.sql(_ALIASES, part=parts)), values


@query(f"WITH {_DUCK} SELECT version, sha256(payload) AS table_sha, payload FROM p")
def table_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity and address of each version of a conversion table."""
    return _tables(spark, sf_dir)[0]


@query(f"""
    WITH {_DUCK}, x AS (SELECT v.*, EXISTS (SELECT 1 FROM r WHERE r.version = v.version) AS known, coalesce((SELECT min(unit) FROM r WHERE r.version = v.version AND r.unit = trim(unit_raw)), (SELECT min(unit) FROM a WHERE a.version = v.version AND a.spelling = trim(unit_raw))) AS unit FROM v)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, x.unit, r.base, (value::DECIMAL(18,6) * r.scale::DECIMAL(9,1) + r."offset"::INT)::DECIMAL(38,12) AS in_base, CASE WHEN NOT known THEN 'unknown_table' WHEN x.unit IS NULL THEN 'unknown_unit' ELSE 'converted' END AS status
    FROM x LEFT JOIN r ON r.version = x.version AND r.unit = x.unit""")
def converted_by_cited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in their base unit by the version of the table that each cites; the stored payloads are read again and checked."""
    stored, values = _tables(spark, sf_dir)
    rules, aliases, _ = conversions.read(stored)
    cites = values.join(stored.select("version", "table_sha"), "version", "left").withColumn("table_sha", F.coalesce("table_sha", F.lit("0" * 64)))
    cites = cites.withColumn("value", F.col("value").cast("decimal(18,6)"))
    return conversions.converted(cites, rules, aliases).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "unit", "base", "in_base", "status")
