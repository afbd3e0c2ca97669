"""Conversion tables under content addresses: a value is converted by the table that it cites, never by today's.

A version of a table is its rules (quantity, unit, base, scale, offset; numbers as text) and aliases (quantity, spelling, unit). Its
identity is their canonical JSON, keys and rows in order, and its address the SHA-256 of that. A shipped version never changes, so an
address that no version has is unknown, and there is no fallback to another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE, ALIAS = ("base", "offset", "quantity", "scale", "unit"), ("quantity", "spelling", "unit")
_PAYLOAD = "aliases array<struct<quantity: string, spelling: string, unit: string>>, rules array<struct<base: string, offset: string, quantity: string, scale: string, unit: string>>"


def addressed(rules: DataFrame, aliases: DataFrame, version: str = "version") -> DataFrame:
    """(version, table_sha, payload) of each version that has a rule. Equal rows count once; order does not matter."""

    def listed(rows: DataFrame, fields: tuple[str, ...], name: str) -> DataFrame:
        order = F.struct(*[F.col(f) for f in ("quantity", *[f for f in ("unit", "spelling") if f in fields], *fields)])
        whole = F.transform(F.array_sort(F.collect_set(F.struct(order.alias("by"), F.struct(*fields).alias("row")))), lambda x: x["row"])
        return rows.groupBy(version).agg(whole.alias(name))

    none = F.expr("cast(array() as array<struct<quantity: string, spelling: string, unit: string>>)")
    both = listed(rules, RULE, "rules").join(listed(aliases, ALIAS, "aliases"), version, "left").withColumn("aliases", F.coalesce("aliases", none))
    payload = F.to_json(F.struct("aliases", "rules"))
    return both.select(version, F.sha2(payload, 256).alias("table_sha"), payload.alias("payload"))


def read(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, aliases, problems) of stored payloads (table_sha, payload), each rule and alias with its table_sha.

    problems: (table_sha, problem): wrong_address if the payload is not what the address says, not_a_table if it has no rules. Such
    tables convert nothing. Payloads that are stored twice count once.
    """
    distinct = payloads.select("table_sha", "payload").distinct()
    parsed = distinct.withColumn("t", F.from_json("payload", _PAYLOAD)).withColumn(
        "problem",
        F.when(~(F.sha2("payload", 256) == F.col("table_sha")) | F.col("payload").isNull(), "wrong_address").when(F.coalesce(F.size("t.rules"), F.lit(0)) <= 0, "not_a_table"),
    )
    sound = parsed.where("problem IS NULL")
    return sound.select("table_sha", F.inline("t.rules")), sound.select("table_sha", F.inline("t.aliases")), parsed.where("problem IS NOT NULL").select("table_sha", "problem")


def converted(values: DataFrame, rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """values (table_sha, quantity, unit_raw, value, …) with (unit, base, in_base, status), by the cited table's own rules.

    value is a decimal; in_base is exact, at its scale plus twelve places. Spellings lose white space at their ends and are never
    folded. status: converted, unknown_table, unknown_unit or no_value. Tables are small beside values, and are joined by address,
    quantity and spelling: no version is looked at for a row that does not cite it.
    """
    known = rules.select(F.col("table_sha").alias("_t")).distinct().withColumn("_known", F.lit(True))
    names = rules.select("table_sha", "quantity", F.col("unit").alias("spelling"), "unit").unionByName(aliases.select("table_sha", "quantity", "spelling", "unit")).distinct()
    spelled = names.groupBy(F.col("table_sha").alias("_s"), F.col("quantity").alias("_q"), F.col("spelling").alias("_spelling")).agg(F.min(F.struct((F.col("unit") != F.col("spelling")).alias("other"), "unit"))["unit"].alias("unit"))
    of = rules.select(F.col("table_sha").alias("_r"), F.col("quantity").alias("_rq"), F.col("unit").alias("_u"), "base", F.col("scale").cast("decimal(18,9)").alias("_scale"), F.col("offset").cast("decimal(18,9)").alias("_offset"))
    bare = F.regexp_replace("unit_raw", r"(?U)^\s+|\s+$", "")
    joined = values.join(known, F.col("table_sha") == F.col("_t"), "left")
    joined = joined.join(spelled, (F.col("table_sha") == F.col("_s")) & (F.col("quantity") == F.col("_q")) & (bare == F.col("_spelling")), "left")
    joined = joined.join(of, (F.col("table_sha") == F.col("_r")) & (F.col("quantity") == F.col("_rq")) & (F.col("unit") == F.col("_u")), "left")
    status = F.when(F.col("_known").isNull(), "unknown_table").when(F.col("base").isNull(), "unknown_unit").when(F.col("value").isNull(), "no_value").otherwise("converted")
    in_base = (F.col("value").cast("decimal(18,6)") * F.col("_scale") + F.col("_offset")).cast("decimal(38,12)")
    return joined.select(*values.columns, "unit", "base", in_base.alias("in_base"), status.alias("status"))
