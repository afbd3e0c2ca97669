"""Whether a document is the cited work: a strict conjunction, so that a review that merely cites it never passes."""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions.text import normalized, surname
from veritrail.operators import quotes
from veritrail.operators.sections import section_of, special_regions

#: Phrases by which a document says that it is about another one, and how far they are looked for.
MARKERS = ("erratum", "corrigendum", "correction to", "comment on", "reply to", "retraction", "editorial expression of concern")
MARKER_CHARS = 4000
#: Short words without identity, least lengths of terms and of long tokens, losses of a damaged token, ratio of a title.
STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "vs", "via", "with")
SHORTEST_TERM, LONG_TOKEN, MOST_LOST, SHORTEST_DAMAGED, TITLE_RATIO = 4, 4, 2, 3, 0.85


def secondary_marker(head: Column, title: Column) -> Column:
    """The phrase that marks a document as one about another, unless the wanted title has it too; null if none."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    window = flat(F.substring(head, 1, MARKER_CHARS))
    return F.coalesce(*[F.when(F.contains(window, F.lit(m)) & ~F.contains(flat(title), F.lit(m)), F.lit(m)) for m in MARKERS])


def outside_references(text: Column, term: Column) -> Column:
    """Whether a term of four characters or more stands in the normalized text before the closing references."""
    regions = special_regions(text)
    references = F.filter(regions, lambda r: r["label"] == "references")
    body = F.when(F.size(references) > 0, F.substr(text, F.lit(1), F.get(references, 0)["start"])).otherwise(text)
    wanted = normalized(term)
    return F.coalesce((F.length(wanted) >= SHORTEST_TERM) & F.contains(normalized(body), wanted), F.lit(False))


def _tokens(text: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", text))


def _worn(token: str) -> set[str]:
    """What is left of a token that lost letters."""
    sizes = range(max(SHORTEST_DAMAGED, len(token) - MOST_LOST), len(token))
    return {"".join(left) for size in sizes for left in combinations(token, size)}


def missing_token(window: str, title: str) -> str | None:
    """A token of a title that a window lacks; a long one may be worn or stand within others, a short one must be there."""
    held, run = _tokens(window), "".join(re.findall("[a-z0-9]+", window))
    absent = _tokens(title) - held - set(STOPWORDS)
    excused = {t for t in absent if len(t) >= LONG_TOKEN and (t in run or not held.isdisjoint(_worn(t)))}
    return min(absent - excused, default=None)


def _resembles(body: str | None, title: str | None) -> bool:
    """Whether a window of a text's body is close to a title and, widened to whole words, holds all of its tokens."""
    if not body or not title or len(title) < SHORTEST_TERM:
        return False
    found = quotes.like_windows(body, title, quotes.gram_places(body, title), TITLE_RATIO)
    ends = [(s - len(re.search(r"[^\W_]*$", body[:s])[0]), re.compile(r"[^\W_]*").match(body, s + len(title)).end()) for s, _ in found]
    return any(missing_token(body[a:b], title) is None for a, b in ends)


@F.pandas_udf(T.BooleanType())
def resembles_title(body: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([_resembles(b, t) for b, t in zip(body, title, strict=True)])


def confirmed(pairs: DataFrame) -> DataFrame:
    """pairs (text, doi, title, authors, year) with ``marker``, ``identity``: whether the text is the cited work.

    With a DOI both it and the title must stand before the references; without, title, first author and year. Titles
    that stand there exactly are settled by expressions; only the rest with a DOI is looked at for near windows.
    """
    text, title = F.col("text"), F.col("title")
    author = F.when(F.size("authors") > 0, surname(F.get("authors", 0)))
    year = F.col("year").cast("string")
    flagged = pairs.withColumns({
        "marker": secondary_marker(text, title),
        "_title": outside_references(text, title),
        "_doi": outside_references(text, F.col("doi")),
        "_rest": F.coalesce(outside_references(text, author), F.lit(False)) & F.when(year.isNull(), True).otherwise(outside_references(text, year)),
    })
    open_question = F.col("doi").isNotNull() & F.col("_doi") & ~F.col("_title") & F.col("marker").isNull()
    references = F.filter(special_regions(text), lambda r: r["label"] == "references")
    body = normalized(F.when(F.size(references) > 0, F.substr(text, F.lit(1), F.get(references, 0)["start"])).otherwise(text))
    asked = flagged.where(open_question).withColumn("_near", resembles_title(body, normalized(title)))
    settled = flagged.where(~F.coalesce(open_question, F.lit(False))).withColumn("_near", F.lit(False))
    by_doi, without = F.col("_doi") & (F.col("_title") | F.col("_near")), F.col("_title") & F.col("_rest")
    identity = F.col("marker").isNull() & F.when(F.col("doi").isNotNull(), by_doi).otherwise(without)
    return asked.unionByName(settled).withColumn("identity", identity).drop("_title", "_doi", "_rest", "_near")


def quoted_in(text: Column, place: Column) -> Column:
    """The section of a place of a text."""
    return section_of(special_regions(text), place)
