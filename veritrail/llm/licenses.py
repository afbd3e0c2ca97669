"""License scan: ordered signature rules behind a keyword prefilter, with suppression of contained detections.

Every whole text is turned into words joined by one space. A rule's pattern is tried only where its keyword
stands in the text. Detections are word intervals [start, end); one that lies inside another of at least its
priority is suppressed (on equal intervals the higher priority stays, then the earlier rule). All work is
done within the row by DataFrame functions: no shuffle, no Python on the executors.

Defined cases: a null or empty text has no words, no detections, score 0 and empty label strings; repeated
rows and null ids come back as they are; other columns are ignored, whatever their names; overlapping places
of one phrase all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import ascii_lower
from veritrail.llm.licence_rules import BASE, Rule, rules

PRIORITIES = 5
_MARK = "\u0001"


def normalized(text: Column) -> Column:
    """The words of a text, each with one space before it, and one space at the end."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _word_count(norm: Column) -> Column:
    return F.when(norm == "  ", F.lit(0)).otherwise(_spaces(norm) - 1).cast("long")


def _starts(norm: Column, pattern: Column) -> Column:
    """Word indices at which non-overlapping matches of ``( pattern)(?= )`` start, in order."""
    marked = F.regexp_replace(norm, F.concat(F.lit(" ("), pattern, F.lit(")(?= )")), F.lit(f" {_MARK}$1"))
    at = F.transform(F.split(marked, " "), lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1).otherwise(-1))
    return F.filter(at, lambda i: i >= 0)


def _phrase_starts(norm: Column, phrase: str) -> Column:
    """All word indices at which a phrase stands: only its first word is consumed, so places may overlap."""
    head, _, tail = phrase.partition(" ")
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), _starts(norm, F.lit(f"{head}(?= {tail} )" if tail else head))).otherwise(F.expr("cast(array() as array<int>)"))


def _rule_groups(listed: list[Rule]) -> Column:
    """The rules as one constant: (keyword, rules of that keyword), each with its place in the order."""
    groups: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(listed):
        groups.setdefault(r.keyword, []).append((i, r))
    rule = lambda i, r: F.struct(
        F.lit(i).alias("place"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.pattern).alias("pattern")
    )
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[rule(i, r) for i, r in v]).alias("rules")) for k, v in groups.items()])


def _detections(norm: Column, listed: list[Rule]) -> Column:
    fired = F.flatten(F.transform(F.filter(_rule_groups(listed), lambda g: F.contains(norm, g["keyword"])), lambda g: g["rules"]))
    fired = F.filter(fired, lambda r: F.regexp_like(norm, F.concat(F.lit(" (?:"), r["pattern"], F.lit(")(?= )"))))

    def found(r: Column) -> Column:
        matches = F.regexp_extract_all(norm, F.concat(F.lit(" (?:"), r["pattern"], F.lit(")(?= )")), F.lit(0))
        return F.zip_with(
            _starts(norm, r["pattern"]),
            matches,
            lambda s, m: F.struct(
                s.alias("start"), (-(s + _spaces(m))).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["place"].alias("place"), r["label"].alias("label"), r["confidence"].alias("confidence")
            ),
        )

    return F.array_sort(F.flatten(F.transform(fired, found)))


def _kept(detections: Column) -> Column:
    """(labels, score) of what suppression leaves; one pass over detections in interval order.

    ``reach[p]`` is the largest end among earlier detections of priority p or more: as earlier ones start no
    later, a detection lies inside one of them if and only if its end is within reach.
    """
    start = F.struct(
        F.array_repeat(F.lit(-1), PRIORITIES).alias("reach"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score")
    )

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        inside = F.get(acc["reach"], priority) >= end
        return F.struct(
            F.transform(acc["reach"], lambda x, p: F.when((p <= priority) & (x < end), end).otherwise(x)).alias("reach"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["confidence"])).alias("score"),
        )

    return F.aggregate(detections, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: list[Rule] | None = None) -> DataFrame:
    """One row per document: counts and places of the base phrases, base labels, all labels, a score from 0 to 1."""
    listed = rules() if listed is None else listed
    norm = F.col("norm")
    base = F.array(*[F.struct(F.lit(label).alias("label"), _phrase_starts(norm, phrase).alias("starts")) for label, phrase in BASE])
    places = F.flatten(F.transform("base", lambda b: b["starts"]))
    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])))
    return (
        docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"))
        .select("doc_id", _word_count(norm).alias("n_words"), base.alias("base"), _kept(_detections(norm, listed)).alias("kept"))
        .select("doc_id", "n_words", "kept", places.alias("places"), base_labels.alias("found"))
        .select(
            "doc_id",
            "n_words",
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"),
            F.array_max("places").cast("long").alias("last_word"),
            F.array_join("found", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("found", "kept.labels")), ",").alias("labels"),
            F.when(F.size("found") > 0, F.greatest(F.lit(0.95), F.col("kept.score"))).otherwise(F.col("kept.score")).alias("score"),
        )
    )
