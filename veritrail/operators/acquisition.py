"""The queue of wanted papers: what is pending, which file answers which request, and whether to admit it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import is_full_article
from veritrail.operators.identity import secondary_marker
from veritrail.operators.quotes import title_share

#: Shares of title words with and without the DOI in front, and how much of a text is the front.
WITH_DOI, WITHOUT_DOI, FRONT = 0.4, 0.8, 6000
#: Words of titles that tell nothing.
COMMON = (
    "a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with", "using", "via", "study", "studies", "analysis", "effect", "effects",
    "new", "novel", "high", "low",
)


def pending(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status").isin("requested", "rejected"))


def identity(text, doi, title):
    """struct(ok, share, doi_found): whether a document is the paper asked for, and not one about it."""
    head = F.lower(F.substring(text, 1, FRONT))
    found = F.coalesce(F.contains(head, F.lower(doi)) | F.contains(F.regexp_replace(head, r"\s+", ""), F.lower(doi)), F.lit(False))
    share = title_share(F.substring(text, 1, FRONT), title, COMMON)
    about = secondary_marker(F.substring(text, 1, FRONT), title).isNotNull()
    return F.struct((~about & (share >= F.when(found, WITH_DOI).otherwise(WITHOUT_DOI))).alias("ok"), share.alias("share"), found.alias("doi_found"))


def inferred(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Every file (file_id, text) once with (slug, status): the one pending request that it answers.

    Candidates share a word of over two letters between a file's front and a title, found by an equi-join on words;
    a single match wins, among several one whose DOI is in front if it is the only such, else ``ambiguous``.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2))
    asked = pending(requests).select("slug", "doi", "title", F.explode(words(F.col("title"))).alias("word"))
    fronts = files.select("file_id", "text", F.explode(words(F.substring("text", 1, FRONT))).alias("word"))
    candidates = fronts.select("file_id", "word").join(asked.select("slug", "word"), "word").select("file_id", "slug").distinct()
    full = candidates.join(files, "file_id").join(pending(requests).select("slug", "doi", "title"), "slug")
    judged = full.withColumn("i", identity(F.col("text"), F.col("doi"), F.col("title"))).where("i.ok")
    counted = judged.groupBy("file_id").agg(
        F.count("*").alias("n"), F.count_if("i.doi_found").alias("n_doi"), F.max("slug").alias("one"), F.max(F.when(F.col("i.doi_found"), F.col("slug"))).alias("by_doi")
    )
    slug = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_doi") == 1, F.col("by_doi"))
    status = F.when(F.col("n").isNull(), "no_match").when(slug.isNull(), "ambiguous").otherwise("matched")
    return files.select("file_id").join(counted, "file_id", "left").select("file_id", slug.alias("slug"), status.alias("status"))


def admission(files: DataFrame, most_bytes: int) -> DataFrame:
    """files (size, mime, text) with ``status``: admitted, or the first reason against it."""
    return files.withColumn(
        "status",
        F.when(F.col("size") > most_bytes, "too_large")
        .when(F.col("mime") == "text/html", "html_is_no_paper")
        .when(F.col("mime").isin("application/zip", "application/gzip"), "archive")
        .when(~F.col("mime").isin("application/pdf", "text/plain", "application/xml"), "unknown_type")
        .when(F.col("text").isNull() | (F.length("text") == 0), "no_text")
        .when(~is_full_article(F.col("text")), "not_a_full_article")
        .otherwise("admitted"),
    )


def queue_reason(attempts: DataFrame, coverage: DataFrame, paper: str) -> DataFrame:
    """(paper, reason): paywalled if ever seen, else the first failure, else by how complete the look-up was."""
    first = attempts.groupBy(paper).agg(F.max(F.when(F.col("reason") == "paywalled", F.col("reason"))).alias("_p"), F.min_by("reason", "position").alias("_f"))
    by_coverage = F.when(F.col("coverage") == "complete", "no_open_access_copy").when(F.col("coverage") == "partial", "oa_lookup_incomplete").otherwise("oa_lookup_not_attempted")
    return coverage.join(first, paper, "left").select(paper, F.coalesce("_p", "_f", by_coverage).alias("reason"))
