"""Text functions: normalization with and without offset maps, lines, readability, names and addresses."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, written out so that every engine reads it alike.
SPACE = "[ \\t\\n\\r\\f\\x0B]+"

#: Ligatures of printed text and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

#: Shapes of a citation line (author initial, year, et al., volume and pages, DOI).
CITATION_SHAPES = (
    r"[A-Z][A-Za-z'-]+,\s*[A-Z]\.",
    r"\(\d{4}[a-z]?\)",
    r"(?i)\bet al\.?\b",
    r"\b\d{1,4}\s*[:,]\s*\d{1,5}(?:[-–]\d{1,5})?\b",
    r"(?i)\bdoi\s*:?\s*10\.\d{4,9}/",
)
#: Block length and mean token length of text whose word spacing was lost, and the share that condemns it.
SPACE_LOSS_BLOCK, SPACE_LOSS_TOKEN, SPACE_LOSS_SHARE, LEAST_CHARS_A_PAGE = 2000, 12.0, 0.25, 100
#: Fixed values of a full article: characters and a heading of references.
ARTICLE_CHARS = 9000
#: Fixed value: a heading that a full article has.
ARTICLE_HEADING = r"(?im)^\s*(?:[0-9]+[.\s]*)?(?:references|bibliography|works cited|literature cited)\s*$"
REFERENCES_HEADING = r"(?im)^[ \t]*(?:(?:\d+|[ivxlcdm]+)[.\)]?[ \t]+)?(?:references|bibliography|works cited|literature cited)\b"


def normalized(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends; for text that compatibility forms leave as it is."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


#: A hyphen at a line's end between letters or digits, or a run of white space.
_BREAKS = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)|\s+")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]")


@lru_cache(1 << 16)
def _compatible(c: str) -> str:
    """The compatibility form of a character, ligatures apart."""
    return "".join(LIGATURES.get(piece, piece) for piece in unicodedata.normalize("NFKC", c))


def fold(text: str) -> str:
    """Compatibility forms, ligatures, joined line-end hyphens, single spaces and case folding."""
    flat = text if text.isascii() else _BEYOND_ASCII.sub(lambda m: _compatible(m.group()), text)
    return _BREAKS.sub(lambda m: "" if m.group()[0] == "-" else " ", flat).casefold().strip(" ")


def fold_with_map(text: str) -> tuple[str, np.ndarray]:
    """The same with the source offset of each resulting character; goes by runs between breaks."""
    flat, places = text, np.arange(len(text))
    if not text.isascii():
        pieces = [_compatible(c) for c in text]
        flat, places = "".join(pieces), np.repeat(places, [len(p) for p in pieces])
    parts, at, done = [], [places[:0]], 0
    for m in _BREAKS.finditer(flat):
        parts.append(flat[done : m.start()])
        at.append(places[done : m.start()])
        if m.group()[0] != "-":
            parts.append(" ")
            at.append(places[m.start() : m.start() + 1])
        done = m.end()
    joined, at = "".join([*parts, flat[done:]]), np.concatenate([*at, places[done:]])
    out = joined.casefold()
    if len(out) != len(joined):
        at = np.repeat(at, [len(c.casefold()) for c in joined])
    first = int(out[:1] == " ")
    last = len(out) - 1 if len(out) > first and out[-1] == " " else len(out)
    return out[first:last], at[first:last]


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("offsets", T.ArrayType(T.IntegerType())))
def normalized_with_map(text: pa.Array) -> pa.Array:
    """Compatibility forms, ligatures, joined line-end hyphens, single spaces and case folding, with the source
    offset of each resulting character. Spark has no Unicode normalization, hence a vectorised function, which holds four bytes
    for each character of a batch and the map of one text at a time."""
    folded, offsets, ends = [], array("i"), array("i", [0])
    for t in text:
        made, places = fold_with_map(t.as_py()) if t.is_valid else (None, None)
        folded.append(made)
        if places is not None:
            offsets.frombytes(places.astype(np.int32).tobytes())
        ends.append(len(offsets))
    given = np.array([t is not None for t in folded], bool)
    maps = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(offsets, np.int32)), mask=pa.array(~given))
    return pa.StructArray.from_arrays([pa.array(folded, pa.string()), maps], ["text", "offsets"])


def raw_span(offsets: Column, start: Column, end: Column, raw_length: Column) -> Column:
    """A span of normalized text as struct(start, end) of the raw text; spans are 0-based and half open."""
    n = F.size(offsets)
    first = F.when(start >= n, raw_length).otherwise(F.get(offsets, F.greatest(start, F.lit(0))))
    last = F.when(end <= start, first).when(end >= n, raw_length).otherwise(F.get(offsets, end - 1) + 1)
    return F.struct(first.alias("start"), last.alias("end"))


def is_citation_line(line: Column) -> Column:
    out = F.lit(False)
    for shape in CITATION_SHAPES:
        out = out | line.rlike(shape)
    return out


def space_loss(text: Column) -> Column:
    """The share of blocks whose tokens are so long that word spacing must have been lost; blank blocks do not count."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SPACE_LOSS_BLOCK}}}"), F.lit(0))
    marks = lambda b: F.regexp_replace(b, SPACE.replace("[", "[^"), "\u0001")  # noqa: E731  one mark for each token
    tokens = lambda b: F.length(marks(b)) - F.length(F.replace(marks(b), F.lit("\u0001"), F.lit("")))
    counted = F.transform(blocks, lambda b: F.struct(tokens(b).alias("n"), F.length(F.regexp_replace(b, SPACE, "")).alias("chars")))
    step = lambda acc, x: F.struct((acc["used"] + F.when(x["n"] > 0, 1).otherwise(0)).alias("used"), (acc["lost"] + F.when((x["n"] > 0) & (x["chars"] >= x["n"] * SPACE_LOSS_TOKEN), 1).otherwise(0)).alias("lost"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("lost"))
    return F.when(text.isNotNull(), F.aggregate(counted, start, step, lambda a: F.when(a["used"] > 0, a["lost"] / a["used"]).otherwise(0.0))).otherwise(0.0)


def unreadable_reason(text: Column, extractor: Column, pages: Column) -> Column:
    """Why a text is too damaged to search in, or null."""
    chars = F.length(F.regexp_replace(text, SPACE, ""))
    return (
        F.when(extractor == "pdf:unavailable", "no_extractor")
        .when(F.coalesce(chars, F.lit(0)) == 0, "no_text")
        .when(F.startswith(extractor, F.lit("pdf:")) & (pages > 0) & (chars / pages < LEAST_CHARS_A_PAGE), "no_text_layer")
        .when(space_loss(text) >= SPACE_LOSS_SHARE, "spacing_lost")
    )


def is_full_article(text: Column) -> Column:
    """Long enough, and with a heading of references alone on its line."""
    return (F.length(text) >= ARTICLE_CHARS) & text.rlike(ARTICLE_HEADING)


def estimated_tokens(prompt: Column) -> Column:
    """A third of the characters and an allowance for the answer, 8000 at least."""
    return F.greatest(F.lit(8000), F.floor(F.length(prompt) / 3) + 4000).cast("long")


def normalized_doi(value: Column) -> Column:
    """A DOI without its prefix or resolver, lower case; null if it is none."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(value), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")))
    return F.when(F.startswith(bare, F.lit("10.")), bare)


def doi_prefix(doi: Column) -> Column:
    """The registrant's part of a DOI."""
    bare = normalized_doi(doi)
    return F.when(F.contains(bare, F.lit("/")), F.split_part(bare, F.lit("/"), F.lit(1)))


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def _stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def slug(doi: Column, title: Column) -> Column:
    """A safe name of at most 180 characters: of the DOI if there is one, else of the title with eight digits of its hash."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(F.lower(_stripped(c)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    stem = F.regexp_replace(F.substring(flat(title), 1, 80), "^-+|-+$", "")
    digest = F.substring(F.sha2(F.lower(_stripped(title)), 256), 1, 8)
    by_title = F.concat(F.when(stem == "", "paper").otherwise(stem), F.lit("-"), digest)
    made = F.regexp_replace(F.substring(F.when(F.coalesce(doi, F.lit("")) != "", flat(doi)).otherwise(by_title), 1, 180), "^[-.]+|[-.]+$", "")
    made = F.when(made == "", "paper").otherwise(made)
    return F.when(made.rlike("^[a-z0-9][a-z0-9._-]{0,180}$"), made).otherwise(F.concat(F.lit("paper-"), F.substring(F.sha2(made, 256), 1, 16)))


def surname(author: Column) -> Column:
    """Before a comma, or else the last word."""
    return F.trim(F.when(F.contains(author, F.lit(",")), F.split_part(author, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(author), " +"), -1)))


def abstract_from_index(index: Column, most: int = 600) -> Column:
    """Prose of an inverted index {word: [positions]}, cut at most characters."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.left(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(most))


def safe_markdown(text: Column) -> Column:
    """Characters that act in Markdown, escaped; control characters and runs of white space become one blank."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F]", " "), r"(?U)\s+", " "))
    return F.regexp_replace(flat, r"([\\`*_\[\]()<>|])", r"\\$1")


def safe_url(url: Column) -> Column:
    """An http or https URL that cannot end its Markdown link, or null."""
    inert = F.replace(F.replace(F.regexp_replace(url, r"[\s<>\"']", ""), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.when(F.lower(url).rlike("^https?://"), inert)


def supplement_parent(stem: Column) -> Column:
    """The paper's name in ``<name>.si`` or ``<name>.si.<n>``, or null."""
    return F.nullif(F.regexp_extract(stem, r"^(.+)\.si(?:\.\d+)?$", 1), F.lit(""))


def supplement_ordinal(stem: Column) -> Column:
    """The number in ``<name>.si.<n>``, or null."""
    return F.regexp_extract(stem, r"\.si\.(\d+)$", 1).try_cast("int")
