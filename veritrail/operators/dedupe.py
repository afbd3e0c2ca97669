"""Keyed dedupe, upserts, anti-joins, exact covers and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.sources import tables


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order; one shuffle, pre-limited on the map side."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def upgraded(rows: DataFrame, key: list[str], order: str, better: Column) -> DataFrame:
    """One row of each key: the first for which better holds, else the first; ``position`` is the key's first place.

    The result takes the place of the key's first row, as a list does whose entry is replaced.
    """
    ranked = rows.withColumn("_b", F.when(better, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_b", order))
    first = F.min(order).over(Window.partitionBy(*key))
    return ranked.withColumns({"_n": place, "position": first}).where("_n = 1").drop("_n", "_b")


def latest_wins(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row of each key: values of its latest row, ``position`` of its first. One aggregation, combined on the map side."""
    value = F.max_by(F.struct(*columns), F.col(order))
    return rows.groupBy(*key).agg(value.alias("_v"), F.min(order).alias("position")).select(*key, "_v.*", "position")


def uncovered(rows: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not covered yet."""
    return rows.join(covered.select(*key).distinct(), key, "left_anti")


def merged(held: DataFrame, fresh: DataFrame, key: str, fill: list[str], keep: list[str]) -> DataFrame:
    """An idempotent upsert: fresh values fill columns unless null or empty; kept columns stay as held."""
    f = fresh.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fill + keep])
    joined = held.join(f, held[key] == F.col("_key"), "full")
    return joined.select(
        F.coalesce(held[key], F.col("_key")).alias(key),
        *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), held[c]).alias(c) for c in fill],
        *[F.when(held[key].isNotNull(), held[c]).otherwise(F.col(f"_{c}")).alias(c) for c in keep],
    )


def cover_violations(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(key, problem): declared but unused, or used but undeclared. Empty if the cover is exact."""
    a = declared.select(key).distinct().withColumn("_a", F.lit(True))
    b = used.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full")
    return both.where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "declared_not_used").otherwise("used_not_declared").alias("problem"))


def closure(edges: DataFrame) -> DataFrame:
    """(node, reached, depth) of edges (node, next): all that each node reaches, with the length of a shortest way.

    Once all pairs up to a length L are known, those up to 2 L are the pairs of length L itself, joined with all known ones: a
    shortest way of L + j has a first part of L and a rest of j. So after log2 of the longest way all are known, and no
    pair is made again from shorter halves. Each round's new pairs are one written table. Cycles end by themselves.
    """
    known = new = tables.stored(edges.select("node", F.col("next").alias("reached")).where("node IS NOT NULL AND reached IS NOT NULL").distinct().withColumn("depth", F.lit(1)), "ways")
    length = 1
    while True:
        longest = new.where(F.col("depth") == length)
        if longest.isEmpty():
            return known
        rest = known.select(F.col("node").alias("reached"), F.col("reached").alias("_next"), F.col("depth").alias("_more"))
        ways = longest.join(rest, "reached").select("node", F.col("_next").alias("reached"), (F.col("_more") + length).alias("depth"))
        # what is known and what is new meet in one aggregate, which holds each pair once and sorts none
        met = ways.unionByName(known.select("node", "reached", F.lit(None).cast("int").alias("depth"))).groupBy("node", "reached")
        new = tables.stored(met.agg(F.min("depth").alias("depth"), F.bool_or(F.col("depth").isNull()).alias("_known")).where("NOT _known").drop("_known"), "ways")
        known, length = known.unionByName(new), 2 * length


def on_rings(edges: DataFrame) -> DataFrame:
    """(node): nodes on a cycle of edges (node, next) of which each node has one at most.

    Each round a node's pointer jumps as far again, and what is pointed at can only lose nodes. Once a round loses none, pointers
    lead from what is left onto all of it, so that it is the cycles and nothing else: after log2 of the longest way into a
    cycle. Rows that lead out of the graph drop out. Pointers meet by a merge join, since a round's whole table passes
    for small by its compressed size and would go through the driver.
    """
    jumps = tables.stored(edges.select("node", "next").where("node IS NOT NULL AND next IS NOT NULL"), "jumps")
    left = jumps.select("next").distinct().count()
    while left:
        hop = jumps.select(F.col("node").alias("next"), F.col("next").alias("_far"))
        before, jumps = jumps, tables.stored(jumps.join(hop.hint("merge"), "next").select("node", F.col("_far").alias("next")), "jumps")
        tables.removed(before)
        held, left = left, jumps.select("next").distinct().count()
        if left == held:
            break
    return jumps.select(F.col("next").alias("node")).distinct()
