"""Tokens of measurements in text: one exact place, whole numerals, clean edges, or a named reason against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import numerals
from veritrail.functions.affixes import clean_edges


def places(text: Column, token: Column) -> Column:
    """array<int>: where a token stands in a text, counted in characters, places that do not overlap."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    step = lambda acc, gap: F.struct((acc["at"] + F.length(gap) + F.length(token)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(gap)).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.when(F.contains(text, token) & (token != ""), F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), start, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))


def _numeral_edges(text: Column, start: Column, end: Column) -> Column:
    """Whether a numeral at [start, end) is all of the numeral there: its extent in a neighbourhood is itself."""
    low = F.greatest(F.lit(0), start - 40)
    around = F.substr(text, low + 1, end - low + 40)
    found = numerals.extents(around)
    whole = F.substr(text, start + 1, end - start)
    before, after = F.substr(text, start, F.when(start > 0, 1).otherwise(0)), F.substr(text, end + 1, F.lit(1))
    return F.array_contains(found, whole) & ~before.rlike("[0-9.,A-Za-z]$") & ~after.rlike("^[0-9,]")


def grounded(claims: DataFrame, texts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """claims (doc, token, role, occurrence) with (start, end, status).

    role is value, unit or label; occurrence is null or a place's number from 0. Status: no_text, not_found, ambiguous,
    no_such_occurrence, fragment_of_a_numeral, unclean_edge or grounded. Texts meet claims in an equi-join on doc.
    """
    joined = claims.join(texts.select(doc, F.col("text").alias("_text")), doc, "left")
    found = joined.withColumn("_at", places(F.col("_text"), F.col("token")))
    several = F.size("_at") > 1
    start = F.when(F.col("occurrence").isNotNull(), F.get("_at", F.col("occurrence"))).when(F.size("_at") == 1, F.get("_at", F.lit(0)))
    placed = found.withColumn("_start", start).withColumn("_end", F.col("_start") + F.length("token"))
    numeral = F.col("token").rlike(f"^(?:{numerals.CANDIDATE})$") & (F.col("role") == "value")
    status = (
        F.when(F.col("_text").isNull(), "no_text")
        .when(F.size("_at") == 0, "not_found")
        .when(F.col("_start").isNull() & F.col("occurrence").isNotNull(), "no_such_occurrence")
        .when(F.col("_start").isNull() & several, "ambiguous")
        .when(numeral & ~_numeral_edges(F.col("_text"), F.col("_start"), F.col("_end")), "fragment_of_a_numeral")
        .when(~numeral & ~clean_edges(F.col("_text"), F.col("_start"), F.col("_end")), "unclean_edge")
        .otherwise("grounded")
    )
    done = placed.withColumn("status", status)
    good = F.col("status") == "grounded"
    return done.select(*claims.columns, F.when(good, F.col("_start")).alias("start"), F.when(good, F.col("_end")).alias("end"), "status")
