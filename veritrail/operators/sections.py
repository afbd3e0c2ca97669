"""Lines, sections and bibliography-like regions of documents, with offsets into the raw text (0-based, half open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.text import is_citation_line

#: Lines of a density window, its share, and length and share of a region that is beyond doubt.
WINDOW_LINES, DENSE, CONFIDENT_LINES, CONFIDENT_SHARE = 5, 0.6, 8, 0.7
#: How far an abstract's heading is looked for, its longest paragraph, and how early references may begin.
ABSTRACT_WITHIN, ABSTRACT_LONGEST, REFERENCES_FROM = 8000, 2000, 0.3
_ABSTRACT = r"(?im)^[ \t]*abstract[ \t]*:?[ \t]*$"
_REFERENCES = r"(?im)^[ \t]*(?:(?:\d+|[ivxlcdm]+)[.\)]?[ \t]+)?(?:references|bibliography|works cited|literature cited)[ \t]*:?[ \t]*(?=$|[A-Z])"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line_start, line): lines end at line feeds; numbers and offsets count from 0."""
    parts = F.split(F.col(text_col), "\n")
    exploded = docs.select(F.col(id_col), F.posexplode(parts).alias("line_no", "line"))
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return exploded.select(id_col, "line_no", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("line_start"), "line")


def bibliography_regions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", citation: Column | None = None) -> DataFrame:
    """(id, region_start, region_end, n_lines, confident): runs of lines that look like a bibliography.

    Blank lines do not count. A line is dense if enough of the lines in the window that it ends look like
    citations; a window at the start has fewer lines. Runs of dense lines are gaps-and-islands over a row number.
    """
    cited = is_citation_line(F.trim("line")) if citation is None else citation
    used = lines(docs, id_col, text_col).where(F.trim(F.regexp_replace("line", "[\t\r]", " ")) != "")
    order = Window.partitionBy(id_col).orderBy("line_no")
    used = used.select("*", F.row_number().over(order).alias("n"), cited.cast("int").alias("hit"))
    dense = used.withColumn("density", F.avg("hit").over(order.rowsBetween(1 - WINDOW_LINES, 0))).where(F.col("density") >= DENSE)
    islands = dense.withColumn("island", F.col("n") - F.row_number().over(order))
    size = F.length(F.regexp_replace("line", r"\r$", ""))
    return islands.groupBy(id_col, "island").agg(
        F.min("line_start").alias("region_start"),
        F.max(F.col("line_start") + size).alias("region_end"),
        F.count("*").alias("n_lines"),
        ((F.count("*") >= CONFIDENT_LINES) & (F.avg("hit") >= CONFIDENT_SHARE)).alias("confident"),
    ).drop("island")


def _before(text: Column, pattern: str) -> Column:
    """Characters before the first match, or null. Regexp positions count UTF-16 units; lengths count characters."""
    head = F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)
    return F.when(text.rlike(pattern), F.length(head))


def special_regions(text: Column) -> Column:
    """array<struct(label, start, end)>: the abstract's paragraph and the closing references, where found."""
    head = F.substring(text, 1, ABSTRACT_WITHIN)
    lead = F.regexp_extract(head, rf"(?s)^(.*?{_ABSTRACT}[\n\r \t]*)", 1)
    begin = F.length(lead)
    paragraph = F.substr(text, begin + 1, F.lit(ABSTRACT_LONGEST))
    blank = _before(paragraph, r"\n\s*\n")
    abstract = F.when((begin > 0) & (F.length(paragraph) > 0), F.struct(F.lit("abstract").alias("label"), begin.alias("start"), (begin + F.coalesce(blank, F.length(paragraph))).alias("end")))
    upto = F.regexp_extract(text, rf"(?s)^(.*)(?:{_REFERENCES})", 1)
    start = F.length(upto)
    references = F.when(
        text.rlike(_REFERENCES) & (start >= F.length(text) * REFERENCES_FROM), F.struct(F.lit("references").alias("label"), start.alias("start"), F.length(text).alias("end"))
    )
    return F.array_compact(F.array(abstract, references))


def section_of(regions: Column, place: Column) -> Column:
    """The label of the region that holds an offset; references win over an abstract; else body."""
    inside = F.filter(regions, lambda r: (r["start"] <= place) & (place < r["end"]))
    return F.coalesce(F.get(F.transform(inside, lambda r: r["label"]), F.size(inside) - 1), F.lit("body"))
