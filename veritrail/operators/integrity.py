"""Integrity constraints as queries: each returns violations, and an empty result means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.operators.dedupe import closure, on_rings

#: Fixed value: how far mole fractions may be from one in sum.
SUM_TOLERANCE = 0.001
#: Quantity kinds that a composition's basis admits.
BASIS_KINDS = {"mole_fraction": ("mole_fraction",), "volume_percent": ("mole_fraction",), "mass_fraction": ("mass_fraction",), "ppm": ("mole_fraction", "mass_fraction")}


def duplicates(collections: list[DataFrame], key: str) -> DataFrame:
    """(key, n): ids that occur more than once across collections, which share one namespace."""
    ids = reduce(DataFrame.unionByName, [c.select(key) for c in collections])
    return ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, target: DataFrame, key: str, to: str) -> DataFrame:
    """Rows whose reference names no row of the target; a null reference names nothing and is fine."""
    ids = target.select(F.col(to).alias("_to")).distinct()
    return rows.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_to"), "left_anti")


def undecorated(nodes: DataFrame, refs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes (node) that no reference (node) targets and that are above no target. ancestors: node, ancestor."""
    used = refs.select("node").distinct()
    above = ancestors.join(used, "node", "left_semi").select(F.col("ancestor").alias("node"))
    return nodes.join(used.unionByName(above).distinct(), "node", "left_anti")


def unsorted_rows(rows: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Rows whose key is not above the one before, in the order that they were written."""
    before = F.lag(key).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") >= F.col(key)))


def ancestors(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a graph (node, parent), however deep; nodes on a cycle are their own ancestors."""
    edges = nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("next"))
    return closure(edges).select("node", F.col("reached").alias("ancestor"), "depth")


def on_cycles(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node): nodes of edges (node, parent) that reach themselves. Where each node has one parent at most, pointers jump and no
    pairs are made; else the pairs of the closure tell."""
    ways = edges.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("next")).distinct()
    if ways.groupBy("node").count().where("count > 1").isEmpty():
        return on_rings(ways)
    return closure(ways).where("node = reached").select("node")


def several_roots(members: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """(group, n_roots): groups whose members (group, node) have more than one root. roots: node, root."""
    return members.join(roots, "node").groupBy(group).agg(F.count_distinct("root").alias("n_roots")).where("n_roots > 1")


def wrong_sums(parts: DataFrame, group: str, fraction: str, tolerance: float = SUM_TOLERANCE) -> DataFrame:
    """(group, total): groups whose fractions do not sum to one."""
    total = parts.groupBy(group).agg(F.sum(F.col(fraction).cast("decimal(18,6)")).alias("total"))
    return total.where(F.abs(F.col("total") - 1) > tolerance)


def wrong_basis(components: DataFrame) -> DataFrame:
    """Components (basis, quantity, unit) whose quantity or unit their composition's basis does not admit."""
    fits = reduce(lambda a, b: a | b, [(F.col("basis") == b) & F.col("quantity").isin(*kinds) for b, kinds in BASIS_KINDS.items()])
    unit = F.when(F.col("basis") == "ppm", F.col("unit") == "ppm").when(F.col("basis") == "volume_percent", F.col("unit") == "%").otherwise(True)
    return components.where(~F.coalesce(fits & unit, F.lit(False)))


def blocks_statistics(kind, basis, scale, lower, upper):
    """Whether an uncertainty tells too little for statistics."""
    return kind.isNull() | kind.isin("unknown", "unspecified_percentage") | basis.isNull() | scale.isNull() | (lower.isNull() & upper.isNull())
