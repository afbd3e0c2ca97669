"""Number and unit constructs in text, and whether a claim's label, value and unit can belong together.

A construct is a clean numeral with a known unit right behind it, on the same line. A claim is refuted unless the
window over its three spans holds exactly one construct, at the claimed places, whose unit can denote the
claimed quantity. Not refuted is not verified.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import numerals, units

_BLANK = r"[^\S\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*"


def _pattern() -> str:
    """A numeral, blanks within the line, and the longest known unit that ends there, as three groups."""
    spellings = {u for q, u in units.BASE_UNITS.items()} | {x for _, a, b, *_ in units.RULES for x in (a, b)} | {x for _, a, b in units.ALIASES for x in (a, b)}
    listed = "|".join(f"\\Q{s}\\E" + ("(?![A-Za-z])" if re.search("[A-Za-z]$", s) else "(?![0-9])" if re.search("[0-9]$", s) else "") for s in sorted(spellings, key=lambda s: (-len(s), s)))
    return f"(?U)({numerals.CANDIDATE.replace('(?![0-9a-zA-Z,])', '(?![0-9,])')})({_BLANK})({listed})"


PATTERN = _pattern()


def constructs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value_start, value_end, unit_start, unit_end, value_text, unit_text) of each construct, in order; places count characters.

    A slash before a numeral, after a digit, makes it the end of a composite, which is no construct. Places come
    from the lengths of what stands between matches, since regexp positions count other units than characters.
    """
    whole = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    parts = F.arrays_zip(
        whole.alias("w"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(1)).alias("v"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(2)).alias("b"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(3)).alias("u")
    )
    gaps = F.split(F.col(text), PATTERN, -1)
    pieces = texts.where(F.col(text).isNotNull()).select(key, gaps.alias("gaps"), parts.alias("parts")).where(F.size("parts") > 0)
    rows = pieces.select(key, "gaps", "parts", F.posexplode(F.col("parts")).alias("k", "m"))
    before = lambda name, upto: F.aggregate(F.slice(name, F.lit(1), upto), F.lit(0), lambda a, x: a + (F.length(x) if name == "gaps" else F.length(x["w"])))
    start = before("gaps", F.col("k") + 1) + before("parts", F.col("k"))
    gap = F.get("gaps", F.col("k"))
    made = rows.select(
        key,
        start.alias("value_start"),
        (start + F.length("m.v")).alias("value_end"),
        (start + F.length("m.v") + F.length("m.b")).alias("unit_start"),
        (start + F.length("m.w")).alias("unit_end"),
        F.col("m.v").alias("value_text"),
        F.col("m.u").alias("unit_text"),
        gap.rlike(r"(?U)\d[^\S\n\r]*/[^\S\n\r]*$").alias("composite"),
    )
    return made.where("NOT composite").drop("composite")


def refuted(claims: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """claims (claim_id, doc, label_start, …, unit_end, quantity) with ``refutation``, null if this check refutes nothing.

    Refutations: no_construct, several_constructs, other_place, other_quantity.
    """
    spans = ("label", "value", "unit")
    low, high = F.least(*[F.col(f"{s}_start") for s in spans]), F.greatest(*[F.col(f"{s}_end") for s in spans])
    windows = claims.select("*", low.alias("_low"), high.alias("_high"))
    c = found.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in ("value_start", "value_end", "unit_start", "unit_end", "unit_text")])
    inside = (windows[key] == F.col("_key")) & (F.col("_value_start") >= F.col("_low")) & (F.col("_unit_end") <= F.col("_high"))
    known = units.quantities_of(claims.sparkSession).select(F.col("spelling").alias("_unit_text"), F.col("quantities").alias("_quantities"))
    joined = windows.join(c, inside, "left").join(known, "_unit_text", "left")
    places = [F.col(f"_{x}") == F.col(x) for x in ("value_start", "value_end", "unit_start", "unit_end")]
    grouped = joined.groupBy(*claims.columns).agg(
        F.count("_key").alias("n"),
        F.bool_and(places[0] & places[1] & places[2] & places[3]).alias("same"),
        F.bool_and(F.array_contains("_quantities", F.col("quantity"))).alias("kind"),
    )
    reason = F.when(F.col("n") == 0, "no_construct").when(F.col("n") > 1, "several_constructs").when(~F.col("same"), "other_place").when(~F.col("kind"), "other_quantity")
    return grouped.select(*claims.columns, reason.alias("refutation"))
