"""Append-only decision logs as JSON lines: typed envelopes, tolerant reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Envelope fields of an event; a payload never overwrites them. Fixed values of the log format.
ENVELOPE = ("schema_version", "event", "timestamp", "campaign_id", "action_id", "run_id")


def events_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose line is a JSON object, as a variant ``event``; malformed lines and other values are left out."""
    parsed = lines.withColumn("event", F.try_parse_json(F.col(column)))
    return parsed.where(F.col("event").isNotNull() & F.startswith(F.schema_of_variant("event"), F.lit("OBJECT")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return events_of(spark.read.text(path))


def skipped(lines: DataFrame, column: str = "value") -> DataFrame:
    """(n_lines, n_events, n_skipped): how many lines a read leaves out; blank lines do not count."""
    parsed = F.try_parse_json(F.col(column))
    good = parsed.isNotNull() & F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    some = F.trim(F.col(column)) != ""
    return lines.agg(F.count_if(some).alias("n_lines"), F.count_if(some & good).alias("n_events"), F.count_if(some & ~F.coalesce(good, F.lit(False))).alias("n_skipped"))


def typed_event(payload: list[str], envelope: dict[str, Column]) -> Column:
    """One JSON line: payload columns but for reserved names, then the envelope, which wins."""
    own = [F.col(c).alias(c) for c in payload if c not in ENVELOPE]
    return F.to_json(F.struct(*own, *[v.alias(k) for k, v in envelope.items()]))


def append_events(df: DataFrame, path: str, column: str = "line") -> None:
    """Appends a column of JSON lines to a log."""
    df.select(column).write.mode("append").text(path)
