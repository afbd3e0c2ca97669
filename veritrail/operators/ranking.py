"""Open-access candidates by tier, top lists and version order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: provider look-ups for one paper at most.
MOST_CALLS = 10


def resolved(providers: list[DataFrame], key: str, url: str = "url") -> DataFrame:
    """Candidates of all providers (key, url, tier, position), each url of a key once, with ``place`` in stable tier order.

    Providers keep their order among equal tiers.
    """
    tagged = [p.select(key, url, "tier", F.lit(k).alias("provider"), "position") for k, p in enumerate(providers)]
    order = ["tier", "provider", "position"]
    union = reduce(DataFrame.unionByName, tagged)
    once = F.row_number().over(Window.partitionBy(key, url).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, url))
    return union.withColumn("_n", once).where("_n = 1").drop("_n").withColumn("place", place)


def coverage(attempts: DataFrame, key: str) -> DataFrame:
    """(key, coverage): complete if every look-up of attempts (key, outcome) answered, partial if any failed or was cut."""
    broken = F.bool_or(F.col("outcome").isin("failed", "capped"))
    return attempts.groupBy(key).agg(F.when(F.count("outcome") == 0, "not_attempted").when(broken, "partial").otherwise("complete").alias("coverage"))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups on the map side before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def best_location(locations: Column) -> Column:
    """The first location with a PDF, repositories before publishers before others; null if none has one."""
    rank = lambda x: F.when(x["host_type"] == "repository", 0).when(x["host_type"] == "publisher", 1).otherwise(2)
    some = F.filter(locations, lambda x: x["pdf_url"].isNotNull())
    ordered = F.array_sort(F.transform(some, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("i"), x["pdf_url"].alias("pdf_url"), x["name"].alias("name"))))
    return F.get(F.transform(ordered, lambda x: F.struct(x["pdf_url"].alias("pdf_url"), x["name"].alias("name"))), 0)


def hits(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(…, position, hit): items of a search answer that is a list or holds one under results, data, items or web; items
    without a text url are left out."""
    v = F.try_parse_json(F.col(column))
    names = ("$", "$.results", "$.data", "$.items", "$.web")
    found = F.coalesce(*[F.try_variant_get(v, n, "array<variant>") for n in names])
    exploded = payloads.select("*", F.posexplode(found).alias("position", "hit"))
    return exploded.where(F.try_variant_get("hit", "$.url", "string").isNotNull() & F.startswith(F.schema_of_variant(F.col("hit")), F.lit("OBJECT")))


def version_order(names: DataFrame, column: str, family: str) -> DataFrame:
    """Names of a family ``<family>-<major>.<minor>…``, the newest first by number, then by name."""
    number = lambda k: F.regexp_extract(column, rf"^{family}-(\d+)(?:\.(\d+))?", k).try_cast("int")
    versions = names.withColumns({"major": number(1), "minor": F.coalesce(number(2), F.lit(0))})
    return versions.where("major IS NOT NULL").orderBy(F.desc("major"), F.desc("minor"), F.desc(column))
