"""Old shapes of stored reports and manifests as projections to the current ones; a chain is applied in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def report_to_passes(reports: DataFrame, run_columns: list[str]) -> DataFrame:
    """Version 1 to 2: the fields of the only run become the first of an array of passes."""
    rest = [c for c in reports.columns if c not in run_columns]
    return reports.select(*rest, F.array(F.struct(*run_columns)).alias("passes"))


def covered_pairs(reports: DataFrame, column: str = "covered") -> DataFrame:
    """Versions 3 and 4 to 5: covered addresses become (sha, extraction) with the root extraction."""
    pairs = F.transform(column, lambda sha: F.struct(sha.alias("sha"), F.lit("root").alias("extraction")))
    return reports.withColumn(column, F.coalesce(pairs, F.array().cast("array<struct<sha: string, extraction: string>>")))


def manifest(requests: DataFrame) -> DataFrame:
    """Any version of a request to the current one: notes, attempts and status have defaults."""
    for name, value in (("status", F.lit("requested")), ("detail", F.lit("")), ("attempts", F.lit(0)), ("note", F.lit(""))):
        requests = _with(requests, name, value)
    return requests


def appended(report: DataFrame, fresh: DataFrame, key: str = "sha") -> DataFrame:
    """Artifacts of a report and of a new pass, each address once, the older entry first; findings are never deduped."""
    return report.unionByName(fresh.join(report.select(key).distinct(), key, "left_anti").select(*report.columns))
