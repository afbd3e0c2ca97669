"""Driver queries over numbers: anchors of claims by value, and joins of numbers within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import anchors
from veritrail.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""
    SELECT c_custkey, c_acctbal, o_orderkey, o_totalprice FROM customer JOIN orders ON sign(c_acctbal) = sign(o_totalprice)
        AND CASE WHEN c_acctbal = 0 OR o_totalprice = 0 THEN c_acctbal = o_totalprice ELSE abs(c_acctbal - o_totalprice) <= 1e-5 * greatest(abs(c_acctbal), abs(o_totalprice)) END""")
def close_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances and totals that are equal up to a hundred-thousandth."""
    balances, totals = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return anchors.close_pairs(balances, totals, "c_acctbal", "o_totalprice", 1e-5)


#: SQL of both engines: a claim for each line, its anchors and the text of the line that should hold them.
_CLAIMS = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, n, 'Ignition in a shock tube: T = ' || q || ' K and ' || n || '-' || CAST(l_linenumber + 40 AS VARCHAR(9)) || ' bar, 2e5% left' AS text,
        CASE l_suppkey % 8 WHEN 0 THEN q || '.0' WHEN 1 THEN q || '.5' WHEN 2 THEN 'inf' WHEN 3 THEN 'ignition  IN' WHEN 4 THEN '0.6e1.0' WHEN 5 THEN n || '-' || q WHEN 6 THEN '2e5' ELSE 'bars' END AS first,
        CASE l_partkey % 4 WHEN 0 THEN 'shock_tube' WHEN 1 THEN 'rcm' WHEN 2 THEN 'flame' ELSE 'other' END AS reactor
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS q, CAST(l_linenumber AS VARCHAR(9)) AS n FROM {lineitem}) AS lines"""


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 9 = 0 THEN 'no_anchor' ELSE concat_ws(';',
        CASE WHEN CASE l_suppkey % 8 WHEN 0 THEN true WHEN 3 THEN true WHEN 5 THEN n::INT <= q::INT AND q::INT IN (q::INT, n::INT, l_linenumber + 40) ELSE false END THEN NULL ELSE first END,
        CASE reactor WHEN 'rcm' THEN 'rapid compression machine | rcm' WHEN 'flame' THEN 'flame' END) END AS missing
    FROM ({_CLAIMS.format(lineitem="lineitem")})""")
def unmet_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text of each line does not hold of what its claim requires, or that nothing is required."""
    claims = spark.sql(_CLAIMS, lineitem=table(spark, sf_dir, "lineitem"))
    terms = F.coalesce(anchors._alternatives(F.col("reactor"), anchors.REACTOR_TERMS), F.array().cast("array<string>"))
    asked = F.when(F.col("l_partkey") % 9 == 0, F.expr("cast(array() as array<array<string>>)")).otherwise(F.filter(F.array(F.array("first"), terms), lambda a: F.size(a) > 0))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = claims.select(F.struct(*keys).alias("claim_id"), F.col("text").alias("window"), asked.alias("required"))
    return anchors.unmet(rows).select(*[F.col(f"claim_id.{k}").alias(k) for k in keys], F.array_join("missing", ";").alias("missing"))


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(q::DOUBLE, n::DOUBLE, (l_linenumber + 40)::DOUBLE) AS lowest, greatest(q::DOUBLE, n::DOUBLE, (l_linenumber + 40)::DOUBLE) AS highest, 3 AS n_values
    FROM ({_CLAIMS.format(lineitem="lineitem")})""")
def window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers in the text of each line: ranges give both bounds, decayed percentages none."""
    claims = spark.sql(_CLAIMS, lineitem=table(spark, sf_dir, "lineitem")).withColumn("found", anchors.values_in(F.col("text")))
    return claims.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_min("found").alias("lowest"), F.array_max("found").alias("highest"), F.size("found").alias("n_values"))


@query("""
    SELECT l_orderkey, count(*) AS n_claims, CASE WHEN min(l_linenumber) > 2 THEN 0 ELSE 2 + 2 * count(*) + count(DISTINCT l_returnflag) + CASE WHEN max(l_tax) > 0.04 THEN 1 ELSE 0 END END AS n_required
    FROM lineitem GROUP BY l_orderkey""")
def required_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each order's experiment must prove: its observable, reactor, measurements (lines), species (flags), residence time."""
    null = lambda kind: F.lit(None).cast(kind)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_claims"), F.collect_list(F.struct(F.col("l_quantity").alias("value"), F.lit("K").alias("unit"))).alias("measured"),
        F.collect_set("l_returnflag").alias("species"), F.min("l_linenumber").alias("first"), F.max("l_tax").alias("tax"),
    )
    other = {"array<double>": ("temperature_range_K", "pressure_range_bar", "equivalence_ratio_range"), "string": ("apparatus", "level_of_theory", "reaction_label", "property", "software", "model_name", "mechanism_url"), "int": ("n_data_points", "n_species", "n_reactions"), "array<string>": ("fuel_species", "validation_targets"), "struct<value: double, unit: string>": ("result",)}
    payload = F.struct(
        F.lit("experimental_benchmark").alias("category"), F.lit("delay").alias("observable_raw"), F.lit("rcm").alias("reactor_type"), F.when(F.col("first") <= 2, F.col("measured")).alias("measured"), "species",
        F.when(F.col("tax") > 0.04, F.col("tax")).alias("residence_time_s"), *[null(kind).alias(name) for kind, names in other.items() for name in names],
    )
    return lines.select("l_orderkey", "n_claims", F.size(anchors.required(payload)).cast("long").alias("n_required"))
