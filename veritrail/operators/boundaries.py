"""Whether a quoted unit or number is all of what stands there, or a piece of something longer.

A unit is judged by its edges first, then by the vocabulary: a longer known spelling that begins or ends with it
refuses it. A number is judged by the constructs around it: ranges with blanks, uncertainties whose mark was lost,
powers of ten whose exponent was flattened. Names of refusals are fixed values; null means that nothing was refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import numerals, places, units

#: Characters that end a unit on both sides, those of units besides letters and digits, and operators that may trail one.
DELIMITERS = r"\[\]\"'“”=:,;."
TOKEN = r"\p{L}\p{N}%°_/^*\-·⁻−–"
OPERATORS = r"*/^\-·−–"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
#: The commonest clean neighbours of a unit on both sides, which need no pattern: nothing, blanks and plain delimiters.
PLAIN = ("", " ", "\t", "\n", *"[]\"':=,;.")
_SPACE = r"\p{IsWhite_Space}\x1C-\x1F"
#: Characters that are looked at behind a unit for trailing operators, and before or behind it for a longer spelling.
REACH = 256

_SIGNED, _TAIL = numerals._SIGNED, numerals._TAIL
#: Constructs of several tokens, in the order in which they are asked.
CONSTRUCTS = (
    ("ascii6_uncertainty", numerals.PLUS_MINUS_AS_SIX),
    ("spaced_range", _SIGNED + r"(?:\s+[-–]\s*|[-–]\s+)" + _TAIL),
    ("flattened_scientific", _SIGNED + r"\s*[x×*]\s*10\s+" + _TAIL),
)


def numeral_extents(text: Column) -> Column:
    """array<struct<start, end, hit>> of the whole numerals of a text; a unit's letter may follow one."""
    return places.found(text, f"(?U){numerals.EXTENT}")


def whole_numeral(text: Column, start: Column, end: Column) -> Column:
    """Whether text[start:end) is one of the whole numerals of a text."""
    return places.holds(text, f"(?U){numerals.EXTENT}", start, end)


def unit_edges(text: Column, start: Column, end: Column, value_start: Column, value_end: Column, whole: Column | None = None) -> Column:
    """Why text[start:end) is no clean unit by its edges, or null.

    A unit may touch a digit on its left only if [value_start, value_end) ends there and is a whole numeral. whole: whether it is
    one, where that is known (see ``whole_numeral``).
    """
    size = F.length(text)
    before = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    tail = F.substr(text, end + 1, F.lit(REACH))
    run = F.length(F.regexp_extract(tail, f"^[{OPERATORS}]*", 0))
    after_run = F.substr(tail, run + 1, F.lit(1))
    after = F.when((run > 0) & F.regexp_like(after_run, F.lit(r"^[\p{L}\p{N}]$")), F.substr(tail, run, F.lit(1))).otherwise(after_run)
    is_one = lambda c, kinds: F.regexp_like(c, F.lit(f"^[{kinds}]$"))
    well_formed = F.coalesce((value_start >= 0) & (value_start < value_end) & (value_end <= size), F.lit(False))
    whole = whole_numeral(text, value_start, value_end) if whole is None else whole
    glued = (
        F.when(value_start.isNull() & value_end.isNull(), "unit_digit_glue_no_value_span")
        .when(~well_formed, "unit_digit_glue_value_span_malformed")
        .when(value_end != start, "unit_digit_glue_value_span_mismatch")
        .when(~whole, "unit_digit_glue_value_span_not_clean_numeral")
    )
    digit = is_one(before, rf"\p{{Nd}}{RAISED}")
    leading = F.when(digit, glued).when(is_one(before, TOKEN), "unit_leading_not_maximal").when((before != "") & ~is_one(before, _SPACE + DELIMITERS + "("), "unit_leading_unclassified_char")
    trailing = (
        F.when(is_one(after, RAISED), "unit_trailing_exponent_or_footnote_ambiguous")
        .when(is_one(after, TOKEN), "unit_trailing_not_maximal")
        .when((after != "") & ~is_one(after, _SPACE + DELIMITERS + ")"), "unit_trailing_unclassified_char")
    )
    next_ = F.substr(text, end + 1, F.lit(1))
    return F.when(start < end, F.coalesce(F.when(~before.isin(*PLAIN, "("), leading), F.when(~next_.isin(*PLAIN, ")"), trailing)))


def longer_spellings(spark) -> DataFrame:
    """(quote, quantities, forward, backward): of each known spelling its quantities, and the known ones that begin with it, and that end with it.

    Made of the vocabulary's constants, so that Spark knows how small it is before it plans the join.
    """
    known = sorted({s for _, s, _ in units.spelled()})
    of = lambda fits: [sorted(t for t in known if len(t) > len(s) and fits(t, s)) for s in known]
    forward, backward = of(str.startswith), of(str.endswith)
    rows = [F.struct(F.lit(s).alias("quote"), *[F.lit(v).cast("array<string>").alias(c) for c, v in (("quantities", sorted({q for q, t, _ in units.spelled() if t == s})), ("forward", f), ("backward", b))]) for s, f, b in zip(known, forward, backward, strict=True)]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def unit_violations(spans: DataFrame, whole: str | None = None) -> DataFrame:
    """spans (text, start, end, quantity, value_start, value_end, …) with ``violation``, null for a clean unit.

    Edges come first. Then the quote must be a spelling of its quantity, exactly; and no longer spelling of any
    quantity may begin or end with it there, however wide the blanks within that one. Spans meet the vocabulary in an
    equi-join on the quote; only longer spellings of that quote are looked for in the text. Rows keep their number;
    those with a null text, place or quantity get null. whole: a column that tells of ``whole_numeral``, where there is one.
    """
    quote = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    spaced = lambda text: F.regexp_replace(text, rf"[{_SPACE}]+", " ")
    onward = spaced(F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start") + REACH))
    low = F.greatest(F.lit(0), F.col("start") - REACH)
    back = spaced(F.substr(F.col("text"), low + 1, F.col("end") - low))
    longer = longer_spellings(spans.sparkSession).select(F.col("quote").alias("_longer_of"), F.col("quantities").alias("_quantities"), "forward", "backward")
    edges = unit_edges(F.col("text"), F.col("start"), F.col("end"), F.col("value_start"), F.col("value_end"), None if whole is None else F.col(whole))
    judged = spans.withColumn("_quote", quote).withColumn("_edges", edges).join(longer, F.col("_quote") == F.col("_longer_of"), "left")
    table = (
        F.when(~F.coalesce(F.array_contains("_quantities", F.col("quantity")), F.lit(False)), "unit_not_in_vocabulary")
        .when((F.size("forward") > 0) & places.let(onward, lambda text: F.exists("forward", lambda s: F.startswith(text, s))), "unit_not_maximal_forward")
        .when((F.size("backward") > 0) & places.let(back, lambda text: F.exists("backward", lambda s: F.endswith(text, s))), "unit_not_maximal_backward")
    )
    given = F.col("text").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("quantity").isNotNull()
    return judged.select(*spans.columns, F.when(given, F.coalesce("_edges", table)).alias("violation"))


def _kinds(text: Column) -> Column:
    """array<struct<place, construct, at>>: for each kind of construct where it stands in a text."""
    return F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("construct"), places.found(text, f"(?U){p}").alias("at")) for i, (name, p) in enumerate(CONSTRUCTS)])


def constructs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, construct, c_start, c_end): numeric constructs of several tokens; place is their order of asking."""
    rows = texts.where(F.col(text).isNotNull()).select(key, F.inline(_kinds(F.col(text))))
    return rows.select(key, "place", "construct", F.inline("at")).select(key, "place", "construct", F.col("start").alias("c_start"), F.col("end").alias("c_end"))


def _held(key: str, place: str = "place") -> Column:
    """The first kind of construct that holds a span and more than it, or null.

    Of rows of spans (key, start, end), whose place is null, and of constructs beside them. Constructs that start before a span or with it
    are those before it in order, so that the greatest end among them tells of all: no span meets each construct.
    """
    # Spans without a key hold nothing and are held by nothing; their start deals them out.
    order = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col("start"))).orderBy("start")
    upto, before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.unboundedPreceding, -1)
    reach = lambda i, over: F.max(F.when(F.col(place) == i, F.col("end"))).over(over)
    holds = lambda i: F.col(key).isNotNull() & ((reach(i, upto) > F.col("end")) | (reach(i, before) >= F.col("end")))
    return F.coalesce(*[F.when(holds(i), name) for i, (name, _) in enumerate(CONSTRUCTS)])


def enclosed(spans: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, start, end, …) with ``construct``: the first kind of construct that holds the span and more than it, or null.

    found: constructs as ``constructs`` gives them. Both sides meet in one window by key (see ``_held``). Repeated spans each get their row.
    """
    place = "_place"
    beside = found.select(key, F.col("c_start").alias("start"), F.col("c_end").alias("end"), F.col("place").alias(place))
    rows = spans.unionByName(beside, allowMissingColumns=True)
    return rows.select(*spans.columns, place, _held(key, place).alias("construct")).where(F.col(place).isNull()).drop(place)


def enclosed_matches(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, construct): ``enclosed`` for the matches of a pattern, which come from their texts in the same pass as the constructs."""
    spans = F.transform(places.found(F.col(text), pattern), lambda m: F.struct(F.lit(None).cast("int").alias("place"), m["start"].alias("start"), m["end"].alias("end")))
    kinds = F.transform(_kinds(F.col(text)), lambda k: F.transform(k["at"], lambda m: F.struct(k["place"].alias("place"), m["start"].alias("start"), m["end"].alias("end"))))
    rows = texts.where(F.col(text).isNotNull()).select(key, F.inline(F.concat(spans, F.flatten(kinds))))
    return rows.select(key, "start", "end", "place", _held(key).alias("construct")).where("place IS NULL").drop("place")
