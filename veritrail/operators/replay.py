"""Re-verification with three outcomes: verified, failed, unverifiable. Not refuted is never verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_spans(spans: DataFrame, texts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """spans (doc, start, end, recorded) with ``check``: matches, differs, out_of_range or no_text."""
    joined = spans.join(texts.select(doc, F.col("text").alias("_text")), doc, "left")
    cut = F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.withColumn(
        "check",
        F.when(F.col("_text").isNull(), "no_text")
        .when((F.col("start") < 0) | (F.col("end") > F.length("_text")) | (F.col("start") >= F.col("end")), "out_of_range")
        .when(cut == F.col("recorded"), "matches")
        .otherwise("differs"),
    ).drop("_text")


def outcome(failed: Column, unverifiable: Column, checks: Column) -> Column:
    """Any failure fails; anything unverifiable, or no check at all, leaves it open; else it is verified."""
    return F.when(failed > 0, "failed").when((unverifiable > 0) | (checks == 0), "unverifiable").otherwise("verified")


def outcomes(checked: DataFrame, group: str) -> DataFrame:
    """(group, n_checks, n_failed, n_unverifiable, outcome) of checked spans."""
    counted = checked.groupBy(group).agg(
        F.count("*").alias("n_checks"),
        F.count_if(F.col("check").isin("differs", "out_of_range")).alias("n_failed"),
        F.count_if(F.col("check") == "no_text").alias("n_unverifiable"),
    )
    return counted.withColumn("outcome", outcome(F.col("n_failed"), F.col("n_unverifiable"), F.col("n_checks")))


def first_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two frames of equal columns has and the other lacks, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
