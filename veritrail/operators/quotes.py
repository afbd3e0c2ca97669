"""Quotes in documents: exact places, near matches, what a difference means, evidence, identity, and the verdict.

Quotes are the stated set: they reach the executors in blocks of about BLOCK characters as one automaton, and
every document is read once for each block. A near match is looked for only where enough of the quote's short
grams stand together: a window at THRESHOLD leaves so few characters unmatched that it shares them.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import fold, fold_with_map, normalized

BLOCK = 8_000_000
GRAM = 4
#: Shortest quote, ratio of a near match, characters of evidence around a match.
SHORTEST, THRESHOLD, EVIDENCE = 20, 0.92, 300
#: Words and prefixes that negate, and pairs that reverse a claim.
NEGATIONS = (
    "not", "no", "never", "none", "cannot", "cant", "doesnt", "dont", "didnt", "isnt", "wasnt", "arent", "werent", "without", "neither", "nor",
)
NEGATING_PREFIXES = ("un", "in", "im", "il", "ir", "non")
ANTONYMS = [
    ("increase", "decrease"), ("increases", "decreases"), ("increased", "decreased"), ("increasing", "decreasing"), ("higher", "lower"),
    ("more", "less"), ("above", "below"), ("positive", "negative"), ("before", "after"), ("faster", "slower"), ("maximum", "minimum"),
    ("consistent", "inconsistent"), ("stable", "unstable"), ("present", "absent"), ("agrees", "disagrees"), ("agreement", "disagreement"),
]


def _blocks(quotes: DataFrame, quote_id: str, text: str, raw: bool = False) -> Iterator[list[tuple[int, str]]]:
    wanted = quotes.select(F.col(quote_id).alias("id"), (F.col(text) if raw else normalized(F.col(text))).alias("quote"))
    wanted = wanted.where("quote IS NOT NULL") if raw else wanted.where(F.length("quote") >= SHORTEST)
    total = wanted.agg(F.sum(F.length("quote"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    for b in range(blocks):
        yield [(r.id, r.quote) for r in wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toLocalIterator()]


def _automaton(patterns: dict[str, list]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    out = ahocorasick.Automaton()
    for p, owners in patterns.items():
        out.add_word(p, (len(p), owners))
    out.make_automaton()
    return out


def occurrences(docs: DataFrame, quotes: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", quote_id: str = "item_id", quote_text: str = "text") -> DataFrame:
    """(item_id, doc_id, q_start): every place, overlapping ones too, at which a normalized quote stands in a normalized document."""
    haystacks = docs.select(F.col(doc_id).alias("doc_id"), normalized(F.col(doc_text)).alias("hay"))
    out = None
    for block in _blocks(quotes, quote_id, quote_text):
        patterns: dict[str, list] = {}
        for i, q in block:
            patterns.setdefault(q, []).append(i)

        def search(batches, patterns=patterns):
            automaton = _automaton(patterns)
            for pdf in batches:
                rows = []
                for d, hay in zip(pdf["doc_id"], pdf["hay"], strict=True):
                    if automaton is not None and hay is not None:
                        rows += [(i, d, end - size + 1) for end, (size, owners) in automaton.iter(hay) for i in owners]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "q_start"])

        made = haystacks.mapInPandas(search, "item_id long, doc_id long, q_start long")
        out = made if out is None else out.unionByName(made)
    return out


def raw_places(docs: DataFrame, quotes: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", quote_id: str = "item_id", quote_text: str = "text") -> DataFrame:
    """(item_id, doc_id, start, end): every place of a quote in a document, in characters of the raw text, by full normalization.

    Both sides lose ligatures, compatibility forms, case, hyphens at line ends and the width of white space. Offsets are
    worked out for documents that hold a quote, and for no others. Quotes shorter than SHORTEST when normalized, and null
    texts, have no places; ids that are null are kept.
    """
    haystacks = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("hay")).where("hay IS NOT NULL")
    out = None
    for block in _blocks(quotes, quote_id, quote_text, raw=True):
        patterns: dict[str, list] = {}
        for i, q in block:
            if len(fold(q)) >= SHORTEST:
                patterns.setdefault(fold(q), []).append(i)

        def search(batches, patterns=patterns):
            automaton = _automaton(patterns)
            for batch in batches:
                rows = []
                for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("hay"), strict=True):
                    text = raw.as_py()
                    hits = list(automaton.iter(fold(text))) if automaton is not None else []
                    if hits:
                        at = fold_with_map(text)[1]
                        rows += [(i, d, int(at[end - size + 1]), int(at[end]) + 1) for end, (size, owners) in hits for i in owners]
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("item_id", "doc_id", "start", "end"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True)})

        made = haystacks.mapInArrow(search, "item_id long, doc_id long, start long, end long")
        out = made if out is None else out.unionByName(made)
    return out


def first_places(places: DataFrame) -> DataFrame:
    """The first place of each quote in each document."""
    return places.groupBy("item_id", "doc_id").agg(F.min("q_start").alias("q_start"))


def differs_in_meaning(window: Column, quote: Column) -> Column:
    """Whether two similar texts differ in a numeral, or their words in a negation, a negating prefix or an antonym."""
    numerals = lambda t: F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    changed = F.array_union(F.array_except(words(window), words(quote)), F.array_except(words(quote), words(window)))
    affixed = [F.arrays_overlap(F.transform(changed, lambda w, p=p: F.concat(F.lit(p), w)), changed) for p in NEGATING_PREFIXES]
    reversed_ = F.exists(F.array(*[F.array(*map(F.lit, pair)) for pair in ANTONYMS]), lambda pair: F.size(F.array_except(pair, changed)) == 0)
    return reduce(Column.__or__, affixed, (numerals(window) != numerals(quote)) | F.arrays_overlap(changed, F.array(*map(F.lit, NEGATIONS))) | reversed_)


def _needed(size: int, threshold: float) -> int:
    """Grams of a quote that any window at the threshold shares with it.

    At most (1 - threshold) of the characters are unmatched on either side. One of the window spoils GRAM grams of it at
    most, and one that the window lacks those GRAM - 1 that span its place.
    """
    return max(0, size - GRAM + 1 - (2 * GRAM - 1) * int(size * (1 - threshold) + 1e-9))


def _grid(size: int, length: int) -> np.ndarray:
    """Starts of the windows of a text that a quote is measured at: eighths of it apart, and the last one."""
    last = length - size
    return np.append(np.arange(0, last, max(1, size // 8)), last) if last >= 0 else np.zeros(0, np.int64)


def _common(text: str, masks: dict[str, int], size: int) -> int:
    """The length of the longest common subsequence of a text and one of so many characters, given where each of them stands in bits.

    What difflib matches is such a subsequence, so that its ratio is never more than this tells.
    """
    full = rest = (1 << size) - 1
    for c in text:
        same = rest & masks.get(c, 0)
        rest = ((rest + same) | (rest - same)) & full
    return size - rest.bit_count()


def like_windows(hay: str, quote: str, places: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(start, ratio) of the windows of a text that are like a quote by the threshold or more.

    places: where the quote's grams begin in the text, in order. Only windows that hold enough of them are measured.
    """
    starts = _grid(len(quote), len(hay))
    held = np.searchsorted(places, starts + len(quote) - GRAM, "right") - np.searchsorted(places, starts, "left")
    starts = starts[held >= _needed(len(quote), threshold)].tolist()
    masks: dict[str, int] = {}
    for k, c in enumerate(quote if starts else ""):
        masks[c] = masks.get(c, 0) | 1 << k
    measure = None

    def ratio(start: int) -> float:
        nonlocal measure
        window = hay[start : start + len(quote)]
        at_most = _common(window, masks, len(quote)) / len(quote)
        if at_most < threshold:
            return at_most
        measure = measure or SequenceMatcher(None, b=quote)
        measure.set_seq1(window)
        return measure.ratio()

    return [(s, r) for s in starts if (r := ratio(s)) >= threshold]


def best_window(hay: str, quote: str, places: np.ndarray, threshold: float = THRESHOLD) -> tuple[int, float] | None:
    """The window most like the quote, the earliest of equals; null if there is none."""
    return max(like_windows(hay, quote, places, threshold), key=lambda w: (w[1], -w[0]), default=None)


def gram_places(hay: str, quote: str) -> np.ndarray:
    """Where any gram of a quote begins in one text, or what hashes alike."""
    return np.flatnonzero(np.isin(_gram_hashes(_points(hay)), _gram_hashes(_points(quote))))


class _Grams:
    """The grams of a block's quotes as sorted numbers, each with the quotes that hold it; finds where a window may be like a quote.

    Numbers are hashes: a collision adds places and so measured windows, and takes none away.
    """

    def __init__(self, block: list[tuple[int, str]]):
        self.quotes = sorted(set(block), key=lambda o: (o[1], o[0] is None, o[0] or 0))
        grams = [np.unique(_gram_hashes(_points(q))) for _, q in self.quotes]
        sizes = np.array([len(q) for _, q in self.quotes], np.int64)
        self.spans, self.needed = sizes - GRAM + 1, np.array([max(1, _needed(n, THRESHOLD)) for n in sizes.tolist()], np.int64)
        numbers, owners = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(numbers, kind="stable")
        self.owners = owners[order]
        self.numbers, self.first = np.unique(numbers[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(numbers)))
        self.bits = max(16, int(len(self.numbers)).bit_length() + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.numbers >> np.uint64(64 - self.bits)] = True

    def candidates(self, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(number, places of its grams) of the quotes that a window of the text may be like.

        The grams of a window stand in two bins of its width at most, so these hold all that it needs.
        """
        hashes = _gram_hashes(points)
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.bits)])
        number = np.searchsorted(self.numbers, hashes[at])
        number[number == len(self.numbers)] = 0
        held = self.numbers[number] == hashes[at]
        at, number = at[held], number[held]
        n = self.count[number]
        if not len(n):
            return []
        ends = np.cumsum(n)
        owner = self.owners[np.arange(ends[-1]) + np.repeat(self.first[number] - (ends - n), n)]
        bins = len(points) // int(self.spans.min()) + 2
        place = np.repeat(at, n)
        key = owner * bins + place // self.spans[owner]
        if len(self.quotes) * bins <= 8 * len(key) + 1_000_000:
            many = np.bincount(key, minlength=len(self.quotes) * bins)
            key = np.flatnonzero(many)
            many = many[key]
        else:
            key, many = np.unique(key, return_counts=True)
        after = np.where(np.append(key[1:], -1) == key + 1, np.append(many[1:], 0), 0)
        fits = np.zeros(len(self.quotes), bool)
        fits[key[many + after >= self.needed[key // bins]] // bins] = True
        kept = np.flatnonzero(fits[owner])
        kept = kept[np.argsort(owner[kept], kind="stable")]
        parts = np.split(place[kept], np.flatnonzero(np.diff(owner[kept])) + 1)
        return list(zip(np.flatnonzero(fits).tolist(), parts, strict=len(kept) > 0))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_hashes(points: np.ndarray) -> np.ndarray:
    """A number for each gram of a text; none for a text shorter than a gram."""
    n = max(0, len(points) - GRAM + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n] + np.uint64(1)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def near_matches(docs: DataFrame, quotes: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", quote_id: str = "item_id", quote_text: str = "text") -> DataFrame:
    """(item_id, doc_id, q_start, ratio, reason) where a quote does not stand exactly but a window resembles it.

    reason is null for an acceptable near match and ``semantic_discrepancy`` where the difference changes the claim. Which
    quotes a text may hold is counted over arrays of grams, by bins of a quote's width; only those are measured.
    """
    haystacks = docs.select(F.col(doc_id).alias("doc_id"), normalized(F.col(doc_text)).alias("hay"))
    out = None
    for block in _blocks(quotes, quote_id, quote_text):

        def search(batches, block=block):
            grams = _Grams(block) if block else None
            for pdf in batches:
                rows = []
                for d, hay in zip(pdf["doc_id"], pdf["hay"], strict=True):
                    if grams is None or hay is None:
                        continue
                    for k, places in grams.candidates(_points(hay)):
                        i, q = grams.quotes[k]
                        if (best := best_window(hay, q, places)) and q not in hay:
                            rows.append((i, d, *best, hay[best[0] : best[0] + len(q)], q))
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "q_start", "ratio", "window", "quote"])

        made = haystacks.mapInPandas(search, "item_id long, doc_id long, q_start long, ratio double, window string, quote string")
        out = made if out is None else out.unionByName(made)
    reason = F.when(differs_in_meaning(F.col("window"), F.col("quote")), "semantic_discrepancy")
    return out.select("item_id", "doc_id", "q_start", "ratio", reason.alias("reason"))


def evidence_window(hay: Column, start: Column, end: Column, around: int = EVIDENCE) -> Column:
    """The text of a match from the sentence boundary before it to the one after it.

    A boundary is looked for within twice ``around`` characters; on a side without one the window ends ``around`` characters off.
    """
    first, size = F.greatest(F.lit(0), start - 2 * around), F.length(hay)
    before = F.length(F.regexp_extract(F.substr(hay, (first + 1).cast("int"), (start - first).cast("int")), r"(?s)^.*[.!?\n]", 0))
    after = F.length(F.regexp_extract(F.substr(hay, (end + 1).cast("int"), F.lit(2 * around)), r"(?s)^[^.!?\n]*[.!?\n]", 0))
    left = F.when(before > 0, first + before).otherwise(F.greatest(F.lit(0), start - around))
    right = F.when(after > 0, end + after).otherwise(F.least(size, end + around))
    return F.substr(hay, (left + 1).cast("int"), (right - left).cast("int"))


def term_present(term: Column, window: Column) -> Column:
    """Whether a term stands in a window with no letter or digit on either side."""
    # The pattern is made anew for each row, so only for windows that hold the term at all.
    return F.contains(F.lower(window), F.lower(term)) & F.regexp_like(F.lower(window), F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(F.lower(term), r"([\\.\[\]{}()*+?^$|-])", r"\\$1"), F.lit("(?![a-z0-9])")))


def missing_anchors(claims: DataFrame, claim_id: str = "claim_id") -> DataFrame:
    """(claim_id, missing): required anchors of claims (claim_id, window, anchors) that their evidence lacks."""
    one = claims.select(claim_id, "window", F.explode("anchors").alias("anchor"))
    return one.where(~term_present(F.col("anchor"), F.col("window"))).groupBy(claim_id).agg(F.array_sort(F.collect_set("anchor")).alias("missing"))


def title_share(head: Column, title: Column, without: tuple[str, ...] = ()) -> Column:
    """The share of a title's distinct words of over two letters, but for some, that stand anywhere in a document's head."""
    words = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) > 2))
    words = F.array_except(words, F.array(*map(F.lit, without))) if without else words
    held = F.filter(words, lambda w: F.contains(F.lower(head), w))
    return F.when(F.size(words) > 0, F.size(held) / F.size(words)).otherwise(0.0)


def verdict(quote: Column, readable: Column, exact: Column, near: Column, discrepancy: Column, section: Column, identity: Column, missing: Column, degraded: Column | None = None) -> Column:
    """struct(status, reason) by an ordered ladder; the first that applies wins. Columns are flags, but for section and quote.

    The reason tells why a quote was not found: too_short or semantic_discrepancy; null where it simply is not there.
    degraded: the text was read again without its sections, so that a quote found in it may stand in the references.
    """
    short = F.length(quote) < SHORTEST
    absent = ~exact & ~near
    status = (
        F.when(readable.isNull(), "no_artifact")
        .when(~readable & absent, "artifact_unreadable")
        .when(short | absent, "quote_not_found")
        .when(F.lit(False) if degraded is None else F.coalesce(degraded, F.lit(False)), "artifact_degraded")
        .when(section == "references", "references_only")
        .when(~identity, "identity_mismatch")
        .when(missing, "spans_missing")
        .when(exact, "grounded_exact")
        .otherwise("grounded_fuzzy")
    )
    reason = F.when(status == "quote_not_found", F.when(short, "too_short").when(discrepancy, "semantic_discrepancy"))
    return F.struct(status.alias("status"), reason.alias("reason"))


def credence(value: Column, ratio: Column, canonical: Column) -> Column:
    """A near match weighs by its ratio, and a claim that is not canonical 0.7 at most."""
    weighed = value * F.coalesce(ratio, F.lit(1.0))
    return F.when(canonical, weighed).otherwise(F.least(weighed, F.lit(0.7)))
