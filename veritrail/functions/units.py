"""Units: a versioned conversion table, normalization of spellings, exact conversion and rounding by significance.

Values are decimal text; digits are measurement precision and are never lost. Arithmetic at a data-dependent
scale has no native form, so it is a vectorised function over the table's few rules.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal, Inexact, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base units, rules (quantity, from, to, scale, offset) and aliases (quantity, spelling, unit).
BASE_UNITS = {
    "length": "m", "velocity": "m/s", "temperature": "K", "pressure": "Pa", "time": "s", "volume": "m3", "strain_rate": "1/s",
    "mole_fraction": "1", "mass_fraction": "1", "equivalence_ratio": "1", "relative_uncertainty": "1",
}
RULES = [
    ("length", "cm", "m", "0.01", "0"), ("length", "mm", "m", "0.001", "0"), ("velocity", "cm/s", "m/s", "0.01", "0"),
    ("temperature", "C", "K", "1", "273.15"), ("pressure", "atm", "Pa", "101325", "0"), ("pressure", "bar", "Pa", "100000", "0"),
    ("pressure", "kPa", "Pa", "1000", "0"), ("pressure", "MPa", "Pa", "1000000", "0"), ("time", "ms", "s", "0.001", "0"),
    ("time", "us", "s", "0.000001", "0"), ("volume", "cm3", "m3", "0.000001", "0"), ("volume", "L", "m3", "0.001", "0"),
    ("mole_fraction", "%", "1", "0.01", "0"), ("mass_fraction", "%", "1", "0.01", "0"), ("relative_uncertainty", "%", "1", "0.01", "0"),
    ("mole_fraction", "ppm", "1", "0.000001", "0"), ("mass_fraction", "ppm", "1", "0.000001", "0"),
]
ALIASES = [
    ("temperature", "°C", "C"), ("temperature", "degC", "C"), ("temperature", "deg C", "C"), ("velocity", "cm s^-1", "cm/s"),
    ("velocity", "cm s-1", "cm/s"), ("velocity", "cm/sec", "cm/s"), ("velocity", "m s^-1", "m/s"), ("volume", "cm^3", "cm3"),
    ("volume", "cc", "cm3"), ("volume", "l", "L"), ("volume", "liter", "L"), ("volume", "litre", "L"), ("time", "µs", "us"),
    ("time", "μs", "us"), ("mole_fraction", "percent", "%"), ("mole_fraction", "-", "1"), ("mole_fraction", "dimensionless", "1"),
    ("mole_fraction", "ppmv", "ppm"), ("mass_fraction", "percent", "%"), ("mass_fraction", "-", "1"), ("mass_fraction", "dimensionless", "1"),
    ("equivalence_ratio", "-", "1"), ("equivalence_ratio", "dimensionless", "1"), ("relative_uncertainty", "percent", "%"),
    ("relative_uncertainty", "-", "1"), ("relative_uncertainty", "dimensionless", "1"),
]


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    quoted = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({columns})")


def rules(spark: SparkSession) -> DataFrame:
    """(quantity, unit, base, scale, offset, kind) with an identity rule for each base unit."""
    rows = [(q, u, u, "1", "0", "identity") for q, u in BASE_UNITS.items()]
    rows += [(q, a, b, s, o, "scale" if o == "0" else "affine") for q, a, b, s, o in RULES]
    return _values(spark, rows, "quantity, unit, base, scale, offset, kind")


def spelled() -> list[tuple]:
    """(quantity, spelling, unit) of all known units and their aliases."""
    return [(q, u, u) for q, u in BASE_UNITS.items()] + [(q, a, a) for q, a, *_ in RULES] + ALIASES


def shared_spellings() -> list[str]:
    """Spellings that several quantities admit."""
    return sorted(s for s in {s for _, s, _ in spelled()} if len({q for q, t, _ in spelled() if t == s}) > 1)


def spellings(spark: SparkSession) -> DataFrame:
    """(quantity, spelling, unit): all known units and their aliases."""
    return _values(spark, spelled(), "quantity, spelling, unit")


def quantities_of(spark: SparkSession) -> DataFrame:
    """(spelling, quantities): which quantities a spelling could mean."""
    return spellings(spark).groupBy("spelling").agg(F.array_sort(F.collect_set("quantity")).alias("quantities"))


def normalized_units(values: DataFrame, quantity: str = "quantity", unit: str = "unit_raw") -> DataFrame:
    """values with ``unit`` and ``unit_status`` (known or unknown_unit); spellings are trimmed, never lower-cased."""
    known = spellings(values.sparkSession).select(F.col("quantity").alias("_q"), F.col("spelling").alias("_s"), F.col("unit").alias("unit"))
    joined = values.join(known, (F.col(quantity) == F.col("_q")) & (F.trim(F.col(unit)) == F.col("_s")), "left").drop("_q", "_s")
    return joined.withColumn("unit_status", F.when(F.col("unit").isNotNull(), "known").otherwise("unknown_unit"))


def _convert_one(value: str, scale: str, offset: str, kind: str) -> tuple[str | None, str | None, str]:
    try:
        source = Decimal(value)
        if not source.is_finite():
            return None, None, "not_canonical"
    except (InvalidOperation, TypeError):
        return None, None, "not_canonical"
    if kind == "identity":
        return value, value, "converted"
    with localcontext() as ctx:
        ctx.prec = 4096
        ctx.traps[Inexact] = True
        try:
            exact = source * Decimal(scale) + Decimal(offset) if kind == "affine" else source * Decimal(scale)
        except Inexact:
            return None, None, "not_exact"
        ctx.traps[Inexact] = False
        place = exact.adjusted() - (len(source.as_tuple().digits) - 1) if kind == "scale" else source.as_tuple().exponent
        rounded = exact.quantize(Decimal((0, (1,), place)), rounding=ROUND_HALF_EVEN)
    return str(exact), str(rounded), "converted"


@F.pandas_udf(T.StructType().add("exact", T.StringType()).add("rounded", T.StringType()).add("status", T.StringType()))
def _convert(value: pd.Series, scale: pd.Series, offset: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = [_convert_one(*x) if x[3] is not None else (None, None, "no_rule") for x in zip(value, scale, offset, kind, strict=True)]
    return pd.DataFrame(rows, columns=["exact", "rounded", "status"])


def converted(values: DataFrame, value: str = "value", quantity: str = "quantity", unit: str = "unit") -> DataFrame:
    """values with (base_unit, rule_kind, exact, rounded, status): into the base unit of the quantity.

    A scaled value keeps the number of its digits, a shifted one (degrees) its last decimal place; ties go to
    the even digit. No rule gives status ``no_rule``; text that is no decimal gives ``not_canonical``.
    """
    table = rules(values.sparkSession).select(F.col("quantity").alias("_q"), F.col("unit").alias("_u"), F.col("base").alias("base_unit"), "scale", "offset", F.col("kind").alias("rule_kind"))
    joined = values.join(table, (F.col(quantity) == F.col("_q")) & (F.col(unit) == F.col("_u")), "left")
    done = joined.withColumn("_c", _convert(F.col(value), F.col("scale"), F.col("offset"), F.col("rule_kind")))
    return done.select("*", "_c.exact", "_c.rounded", "_c.status").drop("_q", "_u", "_c", "scale", "offset")


def in_base(value: Column, unit: Column, quantity: str) -> Column:
    """A DECIMAL value in the quantity's base unit by native arithmetic, for fixed-scale columns."""
    out = F.when(unit == BASE_UNITS[quantity], value)
    for q, source, _, scale, offset in RULES:
        if q == quantity:
            digits = max(0, -Decimal(scale).as_tuple().exponent)
            out = out.when(unit == source, value * F.lit(scale).cast(f"decimal(18,{digits})") + F.lit(offset).cast("decimal(10,2)"))
    return out
