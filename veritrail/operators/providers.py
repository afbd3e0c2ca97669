"""Open-access candidates out of the answers of paper indexes, which come as JSON of unknown shape.

Every answer is a variant; what is missing or of another type simply gives no candidate. A record counts only if
it names the wanted DOI itself, or for preprints the exact title: a similar paper is worse than none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import normalized_doi, normalized_title

#: Tiers of copies, uses that publishers allow machines, and states in which a publisher hosts a copy.
PUBLISHER, REPOSITORY, PREPRINT = 0, 1, 2
MACHINE_USES = ("text-mining", "similarity-checking")
PUBLISHER_STATES = ("gold", "hybrid", "bronze")


def _text(v: Column, path: str) -> Column:
    """A value that is text; a number or a list in its place gives nothing."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _one(url: Column, tier) -> Column:
    tier = tier if isinstance(tier, Column) else F.lit(tier)
    return F.array(F.struct(url.alias("url"), tier.alias("tier")))


def _each(items: Column, path: str, tier: int, keep=None) -> Column:
    items = items if keep is None else F.filter(items, keep)
    return F.transform(items, lambda x: F.struct(_text(x, path).alias("url"), F.lit(tier).alias("tier")))


def _flat(items: Column, inner) -> Column:
    return F.flatten(F.transform(items, inner))


def _names(x: Column, path: str, doi: Column) -> Column:
    return F.coalesce(normalized_doi(_text(x, path)) == doi, F.lit(False))


def openalex(v: Column, doi: Column, title: Column) -> Column:
    open_ones = _each(_list(v, "$.locations"), "$.pdf_url", REPOSITORY, lambda x: F.coalesce(F.try_variant_get(x, "$.is_oa", "boolean"), F.lit(False)))
    return F.concat(_one(_text(v, "$.best_oa_location.pdf_url"), PUBLISHER), open_ones)


def unpaywall(v: Column, doi: Column, title: Column) -> Column:
    return F.concat(_one(_text(v, "$.best_oa_location.url_for_pdf"), PUBLISHER), _each(_list(v, "$.oa_locations"), "$.url_for_pdf", REPOSITORY))


def crossref(v: Column, doi: Column, title: Column) -> Column:
    fits = lambda x: (_text(x, "$['content-type']") == "application/pdf") & _text(x, "$['intended-application']").isin(*MACHINE_USES)
    return _each(_list(v, "$.message.link"), "$.URL", PUBLISHER, lambda x: F.coalesce(fits(x), F.lit(False)))


def semantic_scholar(v: Column, doi: Column, title: Column) -> Column:
    state = F.lower(_text(v, "$.openAccessPdf.status"))
    return _one(_text(v, "$.openAccessPdf.url"), F.when(state.isin(*PUBLISHER_STATES), PUBLISHER).otherwise(REPOSITORY))


def core(v: Column, doi: Column, title: Column) -> Column:
    def copies(x: Column) -> Column:
        links = _each(_list(x, "$.links"), "$.url", REPOSITORY, lambda y: F.coalesce(_text(y, "$.type") == "download", F.lit(False)))
        return F.concat(_one(_text(x, "$.downloadUrl"), REPOSITORY), links, _each(_list(x, "$.sourceFulltextUrls"), "$", REPOSITORY))

    return _flat(F.filter(_list(v, "$.results"), lambda x: _names(x, "$.doi", doi)), copies)


def doaj(v: Column, doi: Column, title: Column) -> Column:
    named = lambda x: F.exists(_list(x, "$.bibjson.identifier"), lambda y: F.coalesce(_text(y, "$.type") == "doi", F.lit(False)) & _names(y, "$.id", doi))
    full = lambda y: F.coalesce(_text(y, "$.type") == "fulltext", F.lit(False))
    pdf = lambda y: F.coalesce(F.upper(_text(y, "$.content_type")) == "PDF", F.lit(False))
    links = _flat(F.filter(_list(v, "$.results"), named), lambda x: F.filter(_list(x, "$.bibjson.link"), full))
    return F.concat(_each(links, "$.url", PUBLISHER, pdf), _each(links, "$.url", PUBLISHER, lambda y: ~pdf(y)))


def europepmc(v: Column, doi: Column, title: Column) -> Column:
    pdf = lambda y: F.coalesce(_text(y, "$.documentStyle") == "pdf", F.lit(False))
    return _flat(F.filter(_list(v, "$.resultList.result"), lambda x: _names(x, "$.doi", doi)), lambda x: _each(_list(x, "$.fullTextUrlList.fullTextUrl"), "$.url", REPOSITORY, pdf))


def chemrxiv(v: Column, doi: Column, title: Column) -> Column:
    same_title = lambda x: F.coalesce((normalized_title(title) != "") & (normalized_title(_text(x, "$.item.title")) == normalized_title(title)), F.lit(False))
    fits = lambda x: _names(x, "$.item.doi", doi) | _names(x, "$.item.vor.vorDoi", doi) | same_title(x)
    return _each(_list(v, "$.itemHits"), "$.item.asset.original.url", PREPRINT, fits)


#: Providers in the order in which they are asked.
PROVIDERS = {
    "openalex": openalex, "unpaywall": unpaywall, "crossref": crossref, "semantic_scholar": semantic_scholar, "core": core, "doaj": doaj,
    "europepmc": europepmc, "chemrxiv": chemrxiv,
}


def candidates(answers: DataFrame) -> DataFrame:
    """(paper, provider, position, url, tier) of answers (paper, doi, title, provider, payload); a paper's url once a provider."""
    v, doi = F.try_parse_json("payload"), normalized_doi(F.col("doi"))
    none = F.array().cast("array<struct<url: string, tier: int>>")
    found = none
    for name, read in PROVIDERS.items():
        found = F.when(F.col("provider") == name, read(v, doi, F.col("title"))).otherwise(found)
    listed = answers.select("paper", "provider", F.posexplode(F.filter(found, lambda c: c["url"].isNotNull() & (c["url"] != ""))).alias("position", "c"))
    once = listed.groupBy("paper", "provider", F.col("c.url").alias("url")).agg(F.min(F.struct("position", F.col("c.tier").alias("tier"))).alias("m"))
    return once.select("paper", "provider", "m.position", "url", "m.tier")


#: Types and beginnings of titles of index entries that are no papers.
NO_PAPER_TYPES = ("editorial", "grant", "paratext", "peer-review")
NO_PAPER_TITLE = r"(?i)^\s*(author response|decision letter|reviewer response|response to review)\b"


def non_paper(record_type: Column, title: Column) -> Column:
    """Whether an index entry is no paper, by its type or title."""
    return F.coalesce(F.lower(record_type).isin(*NO_PAPER_TYPES), F.lit(False)) | F.coalesce(title.rlike(NO_PAPER_TITLE), F.lit(False))
