"""Tokens beside a numeral that change what it means, and edges of units and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens by what they do to a numeral, and shapes of glyphs that an extractor could not map.
AFFIXES = {
    "sign": ("-", "+", "−", "–", "±", "∓", "þ"),
    "decimal": (".", ","),
    "exponent": ("×", "·"),
    "relational": ("=", "<", ">", "≤", "≥", "~", "≈", "≃", "≅", "¼"),
}
UNMAPPED = r"^(?:\(cid:\d+\)|/[cC]\d+|\x{FFFD})$"


def affix_class(token: Column) -> Column:
    """sign, decimal, exponent or relational; null says only that the token is not listed, not that it is harmless."""
    bare = F.regexp_replace(token, r"(?U)^\s+|\s+$", "")
    out = F.when(bare == "", F.lit(None).cast("string")).when(bare.rlike(UNMAPPED), "sign")
    for kind, listed in AFFIXES.items():
        out = out.when(bare.isin(*listed), kind)
    return out


def clean_edges(text: Column, start: Column, end: Column) -> Column:
    """Whether text[start:end) is no fragment of a longer word or number; edges are judged by their own class.

    A letter at an edge may not continue in a letter; a digit not in a digit, nor in a comma, nor at the front in
    a point. A digit before a unit's letter is fine.
    """
    at = lambda place: F.when(place >= 0, F.substr(text, place + 1, F.lit(1))).otherwise("")
    first, before, last, after = at(start), at(start - 1), at(end - 1), at(end)
    letter, digit = (lambda c: c.rlike("(?U)^[A-Za-z]$|^\\p{L}$")), (lambda c: c.rlike("^[0-9]$"))
    front = (letter(first) & letter(before)) | (digit(first) & (digit(before) | before.isin(".", ",")))
    back = (letter(last) & letter(after)) | (digit(last) & (digit(after) | (after == ",")))
    return (start >= end) | ~(front | back)


#: Affixes that reach the value on their left even when they lead a token.
REACH_LEFT = ("decimal", "exponent", "relational")


def abutting_affix(token: Column, on_the_left: bool, raised: Column) -> Column:
    """The affix at the edge of a token that touches a value: of a left neighbour its end, of a right one its begin.

    A sign that leads a right neighbour is that one's own, unless it is raised, as an exponent is. A point or
    comma counts only beside a digit. Null says only that none is listed.
    """
    bare = F.regexp_replace(token, r"(?U)^\s+|\s+$", "")
    edge = F.right(bare, F.lit(1)) if on_the_left else F.left(bare, F.lit(1))
    inner = F.substr(bare, F.length(bare) - 1, F.lit(1)) if on_the_left else F.substr(bare, F.lit(2), F.lit(1))
    kind = affix_class(edge)
    reaches = F.lit(True) if on_the_left else raised | kind.isin(*REACH_LEFT)
    partial = F.when(reaches & ((kind != "decimal") | ((F.length(bare) > 1) & inner.rlike("^[0-9]$"))), kind)
    return F.coalesce(affix_class(bare), partial)
