"""Numerals in text: candidates, glyph health, and parsing of one span to a scalar, a range or a named refusal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.places import let

#: The grammar of a numeral in prose, its sign repairs and what may not stand next to it.
_TAIL = r"\d+(?:\.\d+)?(?:[eE][-+]?\d+(?:\.\d+)?)?"
_SIGNED = r"(?:/[cC]0\s*|[-+−]|–(?=\d))?" + _TAIL
CANDIDATE = r"(?<![0-9a-zA-Z.,])" + _SIGNED + r"(?:[-–]" + _TAIL + r")?(?![0-9a-zA-Z,])"
EXTENT = r"(?<![0-9a-zA-Z.,])" + _SIGNED + r"(?:[-–]" + _TAIL + r")?(?![0-9,])"
#: One value (sign, mantissa, exponent mark, its sign, exponent), and shapes that are refused.
VALUE = r"^(/C0\s*|[-+−–])?(\d+(?:\.\d+)?)(?:([eE])(þ\s*|[-+])?(\d+(?:\.\d+)?))?$"
PLUS_MINUS_AS_SIX = r"\d+\s+6\s+\d+"
NOT_FINITE = ("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def candidates(text: Column) -> Column:
    """All clean numerals of a text, in order, as they stand there."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def extents(text: Column) -> Column:
    """All numerals with their extent; a unit's letter may follow."""
    return F.regexp_extract_all(text, F.lit(EXTENT), F.lit(0))


def glyph_health(text: Column) -> Column:
    """Marks of a damaged encoding of dashes, plus, equals, minus and plus-minus in a document."""
    return F.struct(
        (~F.contains(text, F.lit("–")) & text.rlike(r"\d+e\d+")).alias("suspects_dash_corruption"),
        F.contains(text, F.lit("þ")).alias("has_thorn_plus_marker"),
        F.contains(text, F.lit("¼")).alias("has_equals_ambiguity_marker"),
        F.contains(text, F.lit("/C0")).alias("has_slash_c0_minus_marker"),
        text.rlike(PLUS_MINUS_AS_SIX).alias("has_ascii6_uncertainty_marker"),
    )


def _single(text: Column, flat_pdf: Column, dash_damage: Column) -> Column:
    """struct(text, reason, repairs) of one value."""
    names = ("sign", "mantissa", "mark", "exponent_sign", "exponent")

    def of(p: Column) -> Column:
        sign, mantissa, mark, exponent_sign, exponent = (p[n] for n in names)
        negative = F.startswith(sign, F.lit("/C0")) | sign.isin("-", "−", "–")
        clean = F.concat(
            F.when(negative, "-").otherwise(""),
            mantissa,
            F.when(mark != "", F.concat(F.lit("e"), F.when(exponent_sign == "-", "-").otherwise("+"), exponent)).otherwise(""),
        )
        reason = (
            F.when(mantissa == "", "not_a_clean_numeral")
            .when(F.contains(exponent, F.lit(".")), "decimal_exponent")
            .when((mark == "e") & (exponent_sign == "") & ~F.contains(mantissa, F.lit(".")) & flat_pdf & dash_damage, "quarantined_bare_exponent")
        )
        repairs = F.array_compact(
            F.array(
                F.when(F.startswith(sign, F.lit("/C0")), "slash_c0_to_minus").when(sign == "−", "unicode_minus_to_ascii").when(sign == "–", "leading_en_dash_to_minus"),
                F.when(F.startswith(exponent_sign, F.lit("þ")), "thorn_to_plus"),
            )
        )
        kept = lambda why: F.struct(F.when(why.isNull(), clean).alias("text"), why.alias("reason"), F.when(why.isNull(), repairs).otherwise(F.array().cast("array<string>")).alias("repairs"))
        return let(reason, kept)

    return let(F.struct(*[F.regexp_extract(text, VALUE, k + 1).alias(n) for k, n in enumerate(names)]), of)


def parsed(span: Column, flat_pdf: Column | None = None, dash_damage: Column | None = None) -> Column:
    """struct(kind, text, value, low, high, reason, repairs) of a span that holds a value and nothing else.

    kind is scalar, range or unresolvable. ``text`` keeps every digit and is given for one value even if that
    is not finite as a double; ``value`` only if it is.
    """
    flat_pdf, dash_damage = (F.lit(False) if c is None else c for c in (flat_pdf, dash_damage))
    parts = r"(?s)^(.+?(?<![eE]))[-–](.*)$"
    number = lambda s: s["text"].try_cast("double")
    finite = lambda n: F.abs(n) < float("inf")

    def read(work: Column) -> Column:
        whole = (
            F.when(work == "", "empty")
            .when(F.lower(work).isin(*NOT_FINITE), "not_finite_literal")
            .when(F.contains(work, F.lit("_")), "digit_separator")
            .when(work.rlike(f"^{PLUS_MINUS_AS_SIX}$"), "possible_plus_minus")
        )
        bound = lambda k: _single(F.regexp_extract(work, parts, k), flat_pdf, dash_damage)
        values = lambda r: F.when(r, F.array(bound(1), bound(2))).otherwise(F.array(_single(work, flat_pdf, dash_damage)))
        return let(F.struct(whole.alias("whole"), work.rlike(parts).alias("is_range")), lambda w: let(values(w["is_range"]), lambda v: let(F.transform(v, number), lambda n: judged(w["whole"], w["is_range"], v, n))))

    def judged(whole: Column, is_range: Column, values: Column, numbers: Column) -> Column:
        one, low, high = F.get(values, F.lit(0)), F.get(values, F.lit(0)), F.get(values, F.lit(1))
        first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        reason = F.coalesce(
            whole,
            F.when(
                is_range,
                F.when(low["reason"].isNotNull(), F.concat(F.lit("low_bound_"), low["reason"]))
                .when(high["reason"].isNotNull(), F.concat(F.lit("high_bound_"), high["reason"]))
                .when(~finite(first) | ~finite(second), "bound_not_finite")
                .when(first > second, "bounds_reversed"),
            ).otherwise(F.coalesce(one["reason"], F.when(~finite(first), "value_not_finite"))),
        )
        return let(
            reason,
            lambda why: F.struct(
                F.when(why.isNotNull(), "unresolvable").when(is_range, "range").otherwise("scalar").alias("kind"),
                F.when(whole.isNull() & ~is_range, one["text"]).alias("text"),
                F.when(why.isNull() & ~is_range, first).alias("value"),
                F.when(why.isNull() & is_range, first).alias("low"),
                F.when(why.isNull() & is_range, second).alias("high"),
                why.alias("reason"),
                F.when(why.isNotNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(values, lambda v: v["repairs"]))).alias("repairs"),
            ),
        )

    return let(F.regexp_replace(span, r"(?U)^\s+|\s+$", ""), read)


def is_close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """Equal up to a relative difference of the larger; zero is close to zero only."""
    return F.when((a == 0) | (b == 0), a == b).otherwise(F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def has_clean_boundary(text: Column, start: Column, end: Column) -> Column:
    """Whether no letter or digit continues text[start:end) on either side, by the class of the span's own edge."""
    before = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    after = F.substr(text, end + 1, F.lit(1))
    first, last = F.substr(text, start + 1, F.lit(1)), F.substr(text, end, F.lit(1))
    same = lambda a, b: (a.rlike("[A-Za-z]") & b.rlike("[A-Za-z]")) | (a.rlike("[0-9]") & b.rlike("[0-9]"))
    return ~(same(before, first) | same(last, after))
