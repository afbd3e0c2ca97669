"""Extraction versions: exactly one current record or a named outcome; "latest" never breaks a tie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_selection(artifacts: DataFrame, records: DataFrame, identity: DataFrame, key: str = "sha") -> DataFrame:
    """Every artifact once with (kind, extraction). records: key, extraction, extractor, code_sha, usable; identity: extractor, code_sha.

    Precedence: an unusable record, none stored, none current, several current, selected.
    """
    now = identity.select(F.col("extractor").alias("_x"), F.col("code_sha").alias("_c")).distinct()
    judged = records.join(now, (records.extractor == F.col("_x")) & (records.code_sha == F.col("_c")), "left")
    current = F.col("_x").isNotNull() & F.col("usable")
    grouped = judged.groupBy(key).agg(
        F.count("*").alias("n_records"),
        F.count_if(~F.col("usable")).alias("n_unusable"),
        F.count_if(current).alias("n_current"),
        F.max(F.when(current, F.col("extraction"))).alias("_extraction"),
    )
    kind = (
        F.when(F.col("n_records").isNull(), "no_records_stored")
        .when(F.col("n_unusable") > 0, "unusable_record_present")
        .when(F.col("n_current") == 0, "no_current_record")
        .when(F.col("n_current") > 1, "multiple_current_records")
        .otherwise("selected")
    )
    return artifacts.select(key).join(grouped, key, "left").select(key, kind.alias("kind"), F.when(kind == "selected", F.col("_extraction")).alias("extraction"))


def verified(artifacts: DataFrame, raw: str = "raw", sha: str = "sha") -> DataFrame:
    """artifacts with ``intact``: the bytes hash to their address."""
    return artifacts.withColumn("intact", F.coalesce(F.sha2(raw, 256) == F.col(sha), F.lit(False)))


def stored_outcomes(artifacts: DataFrame, selection: DataFrame, key: str = "sha") -> DataFrame:
    """One typed outcome for every artifact: its record if one is selected, else its intact text, else why not."""
    joined = artifacts.join(selection, key, "left")
    return joined.withColumn(
        "outcome",
        F.when(F.col("kind") == "selected", "extraction_record_digest_authenticated")
        .when(F.col("kind") == "multiple_current_records", "multiple_current_extraction_records")
        .when(~F.col("intact"), "artifact_digest_mismatch")
        .otherwise("self_consistent_metadata"),
    )
