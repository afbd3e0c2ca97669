"""Required anchors of a claim: what its evidence must hold, numbers compared by value and terms by text.

A requirement is an array of alternatives. One that is a single anchor of numeric intent is met by value, whatever its
spelling; if it cannot be resolved to a number it is missing, and never looked for as text. Any other single anchor is
met where the normalized evidence holds it; several alternatives where one of them stands as a term of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import numerals, places
from veritrail.functions.text import normalized
from veritrail.operators.quotes import term_present

#: What is numeric in intent, and literals that a float parser takes besides digits.
NUMERIC_INTENT = r"^[-+]?\d[\d.eE+-]*$"
FLOAT_LITERAL = r"(?i)^\s*[-+]?(?:inf|infinity|nan|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[-+]?\d+(?:_\d+)*)?)\s*$"
#: Digits that are a finite value as they stand, also with an exponent where none is under suspicion, and two of them.
PLAIN = r"^[0-9]{1,300}(?:\.[0-9]+)?\z"
PLAIN_POWER = r"^[0-9]{1,200}(?:\.[0-9]+)?(?:[eE][-+]?[0-9]{1,2})?\z"
PLAIN_RANGE = r"^[0-9]{1,300}(?:\.[0-9]+)?[-–][0-9]{1,300}(?:\.[0-9]+)?\z"
#: Surface forms of reactor types and of computed properties; a property without forms asks for none.
REACTOR_TERMS = {
    "shock_tube": ("shock tube", "shock-tube", "st"), "jsr": ("jet-stirred reactor", "jet stirred reactor", "jsr"), "rcm": ("rapid compression machine", "rcm"),
    "pfr": ("plug flow", "plug-flow", "pfr"), "batch": ("batch reactor", "batch"), "flame": ("flame",),
}
PROPERTY_TERMS = {
    "enthalpy_of_formation": ("enthalpy of formation", "heat of formation"), "entropy": ("entropy",), "heat_capacity": ("heat capacity",), "rate_coefficient": ("rate coefficient", "rate constant"),
    "barrier_height": ("barrier height", "activation barrier", "activation energy"), "bond_dissociation_energy": ("bond dissociation energy", "bde"), "geometry": ("geometry",),
    "frequencies": ("frequencies", "vibrational frequencies"),
}


def numeric_intent(anchor: Column) -> Column:
    """Whether an anchor must be compared by value."""
    return F.regexp_like(anchor, F.lit(FLOAT_LITERAL)) | F.regexp_like(F.regexp_replace(anchor, r"(?U)^\s+|\s+$", ""), F.lit(NUMERIC_INTENT))


def _bounds(parsed: Column) -> Column:
    """The numbers of a parsed span: one of a scalar, two of a range, none of what cannot be resolved."""
    return F.when(parsed["kind"] == "scalar", F.array(parsed["value"])).when(parsed["kind"] == "range", F.array(parsed["low"], parsed["high"])).otherwise(F.array().cast("array<double>"))


def bounds(span: Column, flat_pdf: Column | None = None, dash_damage: Column | None = None) -> Column:
    """array<double>: the numbers of a span by ``numerals.parsed``, which plain digits and ranges of them need not be taken through."""
    none = F.array().cast("array<double>")
    ends = F.split(F.translate(span, "–", "-"), "-").try_cast("array<double>")
    ordered = places.let(ends, lambda e: F.when(F.get(e, F.lit(0)) <= F.get(e, F.lit(1)), e).otherwise(none))
    plain = PLAIN_POWER if flat_pdf is None or dash_damage is None else PLAIN
    read = F.when(span.rlike(plain), F.array(span.try_cast("double"))).when(span.rlike(PLAIN_RANGE), ordered).when(F.lower(span).isin(*numerals.NOT_FINITE), none)
    return read.otherwise(places.let(numerals.parsed(span, flat_pdf, dash_damage), _bounds))


def values_in(window: Column, flat_pdf: Column | None = None, dash_damage: Column | None = None) -> Column:
    """array<double>: every number that stands clean in a window, in order; a range gives both bounds.

    A number with an exponent beside a percent sign is no value, since ranges of percentages decay to that form.
    """
    # Each number comes with the percent signs beside it, doubled so that two numbers may share one.
    hits = F.regexp_extract_all(F.replace(window, F.lit("%"), F.lit("%%")), F.lit(f"(?U)%?{numerals.CANDIDATE}%?"), F.lit(0))
    kept = F.filter(hits, lambda h: ~(F.contains(h, F.lit("%")) & F.contains(F.lower(h), F.lit("e"))))
    return F.flatten(F.transform(kept, lambda h: places.let(F.replace(h, F.lit("%"), F.lit("")), lambda span: bounds(span, flat_pdf, dash_damage))))


def unmet(claims: DataFrame, claim_id: str = "claim_id") -> DataFrame:
    """(claim_id, missing): requirements of claims (claim_id, window, required) that the window does not meet, in order.

    required: array<array<string>>; its alternatives are joined by ` | ` in the result. Claims without a requirement come out
    with the reason that nothing was asked for, ``no_anchor``; those whose window is null miss all.
    """
    split = claims.select(claim_id, F.coalesce("window", F.lit("")).alias("window"), F.coalesce("required", F.array()).alias("required"))
    split = split.select("*", normalized(F.col("window")).alias("_text"))

    def met(alternatives: Column, values: Column) -> Column:
        one = F.get(alternatives, F.lit(0))
        near = lambda target: F.exists(values, lambda v: numerals.is_close(target, v))
        by_value = places.let(bounds(one), lambda targets: (F.size(targets) > 0) & F.forall(targets, near))
        single = F.when(numeric_intent(one), by_value).otherwise(F.contains("_text", normalized(one)))
        return F.when(F.size(alternatives) == 1, single).otherwise(F.exists(alternatives, lambda a: term_present(a, F.col("_text"))))

    lacking = lambda values: F.filter("required", lambda r: ~F.coalesce(met(r, values), F.lit(False)))
    missing = F.transform(places.let(values_in(F.col("window")), lacking), lambda r: F.array_join(r, " | "))
    return split.select(claim_id, F.when(F.size("required") == 0, F.array(F.lit("no_anchor"))).otherwise(missing).alias("missing"))


def _alternatives(key: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The terms of a key, or null."""
    return F.element_at(F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), key)


def required(payload: Column) -> Column:
    """array<array<string>>: what a payload's evidence must hold; empty if it states less than its category's least.

    payload: a struct of category (experimental_benchmark, qm_calculation or prior_model) and the fields of all three:
    observable_raw, reactor_type, measured (value, unit), species, temperature_range_K, pressure_range_bar,
    equivalence_ratio_range (each an array of two), residence_time_s, apparatus, n_data_points; level_of_theory, result (value,
    unit), reaction_label, property, software; model_name, n_species, n_reactions, mechanism_url, fuel_species,
    validation_targets. Numbers may be of any type. Fields that are null or empty ask for nothing beyond the least.
    """
    none = F.expr("cast(array() as array<array<string>>)")
    at = lambda name: payload[name]
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    if_any = lambda *cs: F.transform(F.array_compact(F.array(*[text(c) for c in cs])), lambda x: F.array(x))
    each = lambda c: F.coalesce(F.transform(c, lambda x: F.array(x.cast("string"))), none)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    pairs = lambda c: F.coalesce(F.flatten(F.transform(c, lambda q: F.array(F.array(q["value"].cast("string")), F.array(q["unit"])))), none)
    group = lambda c: F.when(F.size(c) > 0, F.array(c)).otherwise(none)
    experiment = F.when(
        some(at("measured")) & some(at("species")),
        F.concat(
            if_any(at("observable_raw")), group(_alternatives(at("reactor_type"), REACTOR_TERMS)), pairs(at("measured")), each(at("species")),
            *[each(at(f)) for f in ("temperature_range_K", "pressure_range_bar", "equivalence_ratio_range")], if_any(at("residence_time_s"), at("apparatus"), at("n_data_points")),
        ),
    )
    named = F.concat(F.coalesce(at("species"), F.array()), F.array_compact(F.array(text(at("reaction_label")))))
    computed = F.when(
        F.size(named) > 0,
        F.concat(if_any(at("level_of_theory"), at("result")["value"], at("result")["unit"]), F.array(named), group(_alternatives(at("property"), PROPERTY_TERMS)), if_any(at("software"))),
    )
    extent = if_any(at("n_species"), at("n_reactions"), at("mechanism_url"))
    model = F.when(F.size(extent) > 0, F.concat(if_any(at("model_name")), extent, each(at("fuel_species")), each(at("validation_targets"))))
    kind = at("category")
    return F.coalesce(F.when(kind == "experimental_benchmark", experiment).when(kind == "qm_calculation", computed).when(kind == "prior_model", model), none)


def _binned(values: DataFrame, value: str, tolerance: float, probes: tuple[int, ...]) -> DataFrame:
    """values with their sign and the bins of relative width 4 * tolerance that they are looked for in; zero has a bin of its own."""
    place = F.floor(F.log(F.abs(F.col(value))) / F.log1p(F.lit(4 * tolerance))).cast("long")
    bins = F.when(F.col(value) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(*[place + p for p in probes]))
    return values.where(F.abs(F.col(value)) < float("inf")).withColumn("_sign", F.signum(value).cast("int")).withColumn("_bin", F.explode(bins))


def close_pairs(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float = 1e-9) -> DataFrame:
    """All pairs of rows whose numbers are equal up to a relative difference of the larger; zero meets zero only.

    Columns of both sides must have different names. Numbers meet in an equi-join on sign and bin: the left ones look in
    their own bin and both beside it, which holds every number within the tolerance; the comparison itself is exact. Nulls and
    numbers that are not finite meet nothing.
    """
    a, b = _binned(left, left_value, tolerance, (-1, 0, 1)), _binned(right, right_value, tolerance, (0,))
    met = a.join(b, ["_sign", "_bin"]).where(numerals.is_close(F.col(left_value), F.col(right_value), tolerance))
    return met.select(*left.columns, *right.columns)
