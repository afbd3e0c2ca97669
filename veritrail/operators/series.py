"""Rules of measured series, their references, uncertainties and embedded tables, each as a relation of violations.

Relations: axes (series, axis_id, role, quantity), with role coordinate, observation or constant; values (series, point_id, axis_id,
role, quantity, value, ...), one row for each constant, coordinate and observation; refs (path, node_id, locator, ...); nodes
(node_id, kind, extraction, ...). A value or extraction that is absent is null. An empty result means that the rule holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the quantity of a bound that is relative to its value.
RELATIVE = "relative_uncertainty"


def lacking(owners: DataFrame, parts: DataFrame, key: str, condition: Column) -> DataFrame:
    """(key): owners without a part for which the condition holds: series without a coordinate axis, envelopes without a record.
    Where owners are listed by their parts alone, one aggregate tells."""
    fits = condition & F.col(key).isNotNull()
    if parts is owners:
        return owners.groupBy(key).agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("_part")).where("NOT _part").select(key)
    return owners.select(key).distinct().join(parts.where(fits).select(key), key, "left_anti")


def points_without_value(values: DataFrame) -> DataFrame:
    """(series, point_id): points all of whose observations are absent."""
    observed = values.where("role = 'observation'")
    return observed.groupBy("series", "point_id").agg(F.count("value").alias("_n")).where("_n = 0").drop("_n")


def wrong_quantities(values: DataFrame, axes: DataFrame) -> DataFrame:
    """(series, point_id, axis_id, quantity, declared): present values whose quantity is not their axis's."""
    declared = axes.select("series", "axis_id", F.col("quantity").alias("declared"))
    joined = values.where("value IS NOT NULL").join(declared, ["series", "axis_id"])
    return joined.where(~F.col("quantity").eqNullSafe(F.col("declared"))).select("series", "point_id", "axis_id", "quantity", "declared")


def uncertain_without_value(values: DataFrame) -> DataFrame:
    """Rows that state an uncertainty (uncertainty) of a value that is absent."""
    return values.where(F.col("uncertainty").isNotNull() & F.col("value").isNull())


def wrong_bounds(uncertainties: DataFrame) -> DataFrame:
    """(path, bound, problem) of uncertainties (path, quantity, value, basis, upper, upper_quantity, lower, lower_quantity).

    A bound is a magnitude above zero. Where value and basis are present, an absolute bound has the value's quantity and a
    relative one the relative quantity.
    """
    expected = F.when(F.col("basis") == "absolute", F.col("quantity")).otherwise(RELATIVE)

    def of(name: str) -> DataFrame:
        bound, kind = F.col(name), F.col(f"{name}_quantity")
        wrong = F.col("value").isNotNull() & F.col("basis").isNotNull() & ~kind.eqNullSafe(expected)
        problem = F.when(bound <= 0, "not_positive").when(wrong, "wrong_quantity")
        return uncertainties.where(bound.isNotNull()).select("path", F.lit(name).alias("bound"), problem.alias("problem")).where("problem IS NOT NULL")

    return of("upper").unionByName(of("lower"))


def incompatible_refs(refs: DataFrame, nodes: DataFrame, compatible: DataFrame) -> DataFrame:
    """(path, problem): references whose locator may not target its node, by compatible (locator, kind), or that cite characters
    of a node without an extraction."""
    joined = refs.join(nodes.select("node_id", "kind", "extraction"), "node_id").join(compatible.withColumn("_fits", F.lit(True)), ["locator", "kind"], "left")
    problem = F.when(F.col("_fits").isNull(), "incompatible").when((F.col("locator") == "char_span") & F.col("extraction").isNull(), "no_extraction")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def wrong_forms(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, form): values whose source form (tabular, digitized, textual) their locator or node contradicts."""
    cell, crop = F.col("locator") == "table_cell", F.col("kind") == "figure_crop"
    fits = F.when(F.col("form") == "tabular", cell).when(F.col("form") == "digitized", crop).when(F.col("form") == "textual", ~(cell | crop))
    return refs.join(nodes.select("node_id", "kind"), "node_id").where(~F.coalesce(fits, F.lit(False))).select("path", "form")


def spans_as_series_values(values: DataFrame) -> DataFrame:
    """Present values of a series that are grounded by characters of a text, where a table or figure is asked for."""
    return values.where((F.col("locator") == "char_span") & F.col("value").isNotNull())


def missing_cells(citations: DataFrame, cells: DataFrame) -> DataFrame:
    """Citations (inventory, row, column) of cells that the inventory's grid has not."""
    return citations.join(cells.select("inventory", "row", "column").distinct(), ["inventory", "row", "column"], "left_anti")


def wrong_embeddings(embedded: DataFrame) -> DataFrame:
    """Embedded texts (sha, content) whose bytes don't hash to the address under which they are cited."""
    return embedded.where(F.sha2(F.encode("content", "UTF-8"), 256) != F.col("sha"))


def unit_answers(values: DataFrame, units: DataFrame) -> DataFrame:
    """(path, problem): recorded units (path, table_sha, unit_raw, unit_normalized) against units (table_sha, spelling, unit).

    unknown_table if no such table is embedded, unknown_unit if it has no such spelling, differs if its answer is another.
    """
    known = units.select("table_sha").distinct().withColumn("_table", F.lit(True))
    answers = units.select("table_sha", F.col("spelling").alias("unit_raw"), F.col("unit").alias("_answer"))
    joined = values.join(known, "table_sha", "left").join(answers, ["table_sha", "unit_raw"], "left")
    problem = F.when(F.col("_table").isNull(), "unknown_table").when(F.col("_answer").isNull(), "unknown_unit").when(F.col("_answer") != F.col("unit_normalized"), "differs")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def unreconciled(listed: DataFrame, walked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): sites of one list that the other lacks, counted with repeats: a hand-made list against a walk of the whole."""
    a, b = listed.select(*keys), walked.select(*keys)
    return a.exceptAll(b).withColumn("problem", F.lit("not_walked")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("not_listed")))


def walked(rows: DataFrame, key: str, places: dict[str, Column]) -> DataFrame:
    """(key, path, item): the items at named places of nested rows, each an array column, with dotted paths."""
    found = [rows.select(key, F.posexplode(items).alias("_i", "item")).select(key, F.concat(F.lit(f"{name}["), F.col("_i"), F.lit("]")).alias("path"), "item") for name, items in places.items()]
    return reduce(DataFrame.unionByName, found)


def overall(reports: DataFrame, claims: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """(key, overall) of reports (key, evidence): a failure stays one; a claim left unchecked or an attempt at refutation,
    survived or not run, leaves it unverifiable; only then the evidence decides."""
    left = claims.select(key).unionByName(attempts.select(key)).distinct().withColumn("_left", F.lit(True))
    said = F.when(F.col("evidence") == "failed", "failed").when(F.col("_left"), "unverifiable").otherwise(F.col("evidence"))
    return reports.join(left, key, "left").select(key, said.alias("overall"))
