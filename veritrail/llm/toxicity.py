"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around each hit.

The lexicon is learned from labelled documents: words, and stems that many words begin with, which stand in toxic
documents and hardly in others. All are in one trie. An unknown word walks the trie together with its
Levenshtein automaton, whose states are rows of edit distances cut off at EDITS; it reaches a term if it is at
most EDITS edits away. Only whole words of FUZZY_FROM letters and more are matched with edits; a stem must stand
as it is, since its words vary anyway.

Walking is spared words that can't match: with one edit the first or the second half of a term stays whole, at
the word's begin or its end, and both are looked up by hash. Each hit is read in a window of WINDOW words: one
between quotation marks or near a word of reporting counts as quotation, others as abuse. A word near a term that
stands in documents that are not toxic is no misspelling; a weak term tells only by its number. Counts of
hits of each kind, and hits a hundred words, give the score by logistic regression with a prior that also orders
kinds that no label shows.

The fit takes at most SAMPLE toxic and twice as many other labelled documents, those with the least hash of their
id, of them those of up to LONGEST characters; equal texts count once. Scoring reads every whole text. Labels,
language, source and id are no inputs.

Defined cases: a null or empty text gets the score of no hits; a null id is scored and is not held out; of several
labels for an id the largest counts; without toxic labels the lexicon is empty and all scores are equal;
repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import tokens
from veritrail.llm.common import remainder, written

EDITS, FUZZY_FROM, WINDOW = 1, 5, 6
STEM_LENGTHS, LEAST_DOCS, LEAST_RATIO, STRONG_RATIO, LEAST_G, ENOUGH = range(4, 11), 4, 6.0, 20.0, 24.0, 4
#: Labelled documents of each sort to learn from (twice as many that are not toxic), characters of the longest, and of all together.
SAMPLE, LONGEST, MOST_TEXT = 3000, 40_000, 60_000_000
FOLDS, THRESHOLD = 3, 0.7
KINDS = ("abuse", "stem", "misspelled", "quoted", "weak")
#: Kinds that count towards hits a hundred words.
PLAIN = [0, 1, 4]
#: Centre and strength of the prior of the weights: bias, KINDS, then hits a hundred words.
PRIOR, PRIOR_STRENGTH = np.array([-4.0, 4.0, 4.0, 2.5, 0.5, 0.5, 0.5]), 0.5
#: Quotation marks.
QUOTES = ('"', "“", "”", "„", "«", "»")
#: Words near a hit that mark a report of someone's words.
REPORTING = ("said", "says", "quote", "quoted", "quotes", "wrote", "called", "reported", "word", "term", "slur", "meaning")


class Trie:
    """Terms, each a whole word or a stem; ``match`` gives the kind of the best match of a word.

    weak terms also stand in other documents now and then, and tell only by their number.
    """

    def __init__(self, terms: list[tuple[str, bool]], weak: frozenset[tuple[str, bool]] = frozenset()):
        self.terms = terms
        self.root: dict = {}
        for term, stem in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault(None, []).append((len(term), stem, (term, stem) in weak))

    def match(self, word: str) -> str | None:
        node, best = self.root, None
        for i, c in enumerate(word):
            node = node.get(c)
            if node is None:
                break
            for _, stem, weak in node.get(None, ()):
                if stem or i == len(word) - 1:
                    if not weak:
                        return "stem" if stem else "abuse"
                    best = "weak"
        if best:
            return best
        return "misspelled" if self._walk(self.root, word, list(range(len(word) + 1))) else None

    def _walk(self, node: dict, word: str, row: list[int]) -> bool:
        """row: for each prefix of the word the edits to the trie's path so far, its automaton's state."""
        for c, below in node.items():
            if c is None:
                continue
            now = [row[0] + 1]
            for i, w in enumerate(word):
                now.append(min(now[i] + 1, row[i + 1] + 1, row[i] + (w != c)))
            if min(now) > EDITS:
                continue
            if now[-1] <= EDITS and any(size >= FUZZY_FROM and not stem and not weak for size, stem, weak in below.get(None, ())):
                return True
            if self._walk(below, word, now):
                return True
        return False


def _hash(text: bytes) -> int:
    raw = np.frombuffer(text, np.uint8)
    return int(tokens.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


class Lexicon:
    """A trie with the hashes that find the few words worth walking it."""

    def __init__(self, terms: list[tuple[str, bool]], weak: frozenset[tuple[str, bool]] = frozenset(), innocent: frozenset[bytes] = frozenset()):
        self.trie, self.innocent = Trie(terms, weak), innocent
        heads: dict[int, set[int]] = {}
        tails: dict[int, set[int]] = {}
        self.cache: dict[bytes, str | None] = {}
        for term, stem in terms:
            raw = term.encode()
            heads.setdefault(len(raw), set()).add(_hash(raw))
            if len(term) >= FUZZY_FROM and not stem and (term, stem) not in weak:
                half = len(term) // 2
                a, b = term[:half].encode(), term[half:].encode()
                heads.setdefault(len(a), set()).add(_hash(a))
                tails.setdefault(len(b), set()).add(_hash(b))
        order = lambda x: {k: np.array(sorted(v), np.uint64) for k, v in x.items()}
        self.heads, self.tails = order(heads), order(tails)
        sizes = [len(t.encode()) for t, _ in terms]
        self.shortest = min(sizes, default=1 << 30) - EDITS
        self.longest = 1 << 30 if any(s for _, s in terms) else max(sizes, default=0) + 4 * EDITS

    def hits(self, chunk: tokens.Chunk, w: tokens.Words) -> list[tuple[int, str]]:
        """(word's place, kind) of each match, in order."""
        sizes = w.ends - w.starts
        maybe = np.zeros(len(w), bool)
        for table, tail in ((self.heads, False), (self.tails, True)):
            for size, known in table.items():
                rows = np.flatnonzero((sizes >= size) & (sizes >= self.shortest) & (sizes <= self.longest))
                if not len(rows):
                    continue
                s = w.ends[rows] - size if tail else w.starts[rows]
                h = tokens.span_hashes(chunk.low, s, s + size)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                maybe[rows[known[at] == h]] = True
        out = []
        for i in np.flatnonzero(maybe).tolist():
            word = chunk.low[w.starts[i] : w.ends[i]].tobytes()
            if word not in self.cache:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                kind = self.trie.match(word.decode("utf-8", "replace"))
                self.cache[word] = None if kind == "misspelled" and word in self.innocent else kind
            if kind := self.cache[word]:
                out.append((i, kind))
        return out


def _quotation(chunk: tokens.Chunk, w: tokens.Words, doc: int, i: int) -> bool:
    """Whether the window around word i has a quotation mark on both sides of it or a word of reporting."""
    first, last = max(int(w.of[doc]), i - WINDOW), min(int(w.of[doc + 1]), i + WINDOW + 1)
    begin = int(chunk.offsets[doc]) if first == w.of[doc] else int(w.starts[first])
    end = int(chunk.offsets[doc + 1]) if last == w.of[doc + 1] else int(w.starts[last])
    before = chunk.low[begin : w.starts[i]].tobytes().decode("utf-8", "replace")
    after = chunk.low[w.ends[i] : end].tobytes().decode("utf-8", "replace")
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
        return True
    near = {chunk.low[w.starts[k] : w.ends[k]].tobytes() for k in range(first, last) if w.ends[k] - w.starts[k] <= 10}
    return any(r.encode() in near for r in REPORTING)


def features(chunk: tokens.Chunk, lexicon: Lexicon) -> np.ndarray:
    """For each document the counts of KINDS and hits a hundred words, dampened."""
    w = tokens.words(chunk)
    out = np.zeros((chunk.n, len(KINDS)))
    found = lexicon.hits(chunk, w)
    docs = np.searchsorted(w.of, np.array([i for i, _ in found], np.int64), "right") - 1
    for (i, kind), d in zip(found, docs.tolist(), strict=True):
        out[d, KINDS.index("quoted" if _quotation(chunk, w, d, i) else kind)] += 1
    share = 100 * out[:, PLAIN].sum(axis=1, keepdims=True) / np.maximum(w.counts(), 50)[:, None]
    return np.log1p(np.concatenate([out, share], axis=1))


def _stems(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, start, end) of all words and of all their stems that end between characters, each once a document."""
    w = tokens.words(chunk)
    owner = np.repeat(np.arange(chunk.n), w.counts())
    parts = [(owner, tokens.word_hashes(chunk, w) ^ np.uint64(1), w.starts, w.ends)]
    for size in STEM_LENGTHS:
        rows = np.flatnonzero(w.ends - w.starts > size)
        rows = rows[(chunk.low[w.starts[rows] + size] & 0xC0) != 0x80]
        parts.append((owner[rows], tokens.span_hashes(chunk.low, w.starts[rows], w.starts[rows] + size), w.starts[rows], w.starts[rows] + size))
    d, h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, d))
    d, h, s, e = d[order], h[order], s[order], e[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new], s[new], e[new]


def _chunked(texts: list[str]) -> Iterator[tokens.Chunk]:
    for at in range(0, len(texts), 256):
        yield from tokens.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts[at : at + 256], pa.string())], ["text"])]))


def learn_terms(toxic: list[str], other: list[str]) -> tuple[list[tuple[str, bool]], frozenset[tuple[str, bool]]]:
    """(term, whether it is a stem), those that explain most toxic documents first, and which of them are weak.

    Candidates stand in at least LEAST_DOCS toxic documents (or 0.3 % of them), LEAST_RATIO times as often as
    in others, and so often that the log-likelihood ratio statistic is at least LEAST_G; under STRONG_RATIO they
    are weak. At most MOST_TERMS candidates, the most frequent, are weighed against each other. A stem gives way to a longer one or a word with nearly all of its documents. Terms are taken
    by the documents that they add; one is explained by ENOUGH terms, so what a few copies share adds nothing.
    """
    docs, hashes, names = [], [], {}
    n = 0
    for chunk in _chunked(toxic):
        d, h, s, e = _stems(chunk)
        docs.append(d + n)
        hashes.append(h)
        n += chunk.n
    if not docs:
        return [], frozenset()
    d, h = np.concatenate(docs), np.concatenate(hashes)
    kinds, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    least = max(LEAST_DOCS, 0.003 * n)
    kinds_kept = kinds[counts >= least]
    seen, m = np.zeros(len(kinds_kept), np.int64), 0
    for chunk in _chunked(other):
        x = _stems(chunk)[1]
        at = np.minimum(np.searchsorted(kinds_kept, x), max(len(kinds_kept) - 1, 0))
        if len(kinds_kept):
            seen += np.bincount(at[kinds_kept[at] == x], minlength=len(kinds_kept))
        m += chunk.n
    ratio = ((counts[counts >= least] + 0.5) / (n + 1)) / ((seen + 0.5) / (m + 1))
    both = counts[counts >= least] + seen
    log = lambda x, share: x * np.log(np.maximum(x, 1) / (both * share))
    evidence = 2 * (log(counts[counts >= least], n / (n + m)) + log(seen, max(m, 1) / (n + m)))
    good = kinds_kept[(ratio >= LEAST_RATIO) & (evidence >= LEAST_G)]
    strong = set(kinds_kept[ratio >= STRONG_RATIO].tolist())
    wanted = set(good.tolist())
    for chunk in _chunked(toxic):
        _, x, s, e = _stems(chunk)
        for k in np.flatnonzero(np.isin(x, good)).tolist():
            if int(x[k]) in wanted:
                wanted.discard(int(x[k]))
                names[int(x[k])] = chunk.low[s[k] : e[k]].tobytes()
        if not wanted:
            break
    size = dict(zip(kinds.tolist(), counts.tolist(), strict=True))
    words = {_hash(name) ^ 1: name for name in set(names.values())}
    whole = {key for key in names if key in words and words[key] == names[key]}
    kept: dict[int, tuple[bytes, bool]] = {}
    by_name = sorted(((name, key in whole, size[key], key) for key, name in names.items()), key=lambda x: (x[0], not x[1]))
    for i, (name, is_word, count, key) in enumerate(by_name):
        covered = False
        if not is_word:
            for other_name, _, other_count, other_key in by_name[i + 1 :]:
                if not other_name.startswith(name):
                    break
                if other_key != key and other_count >= 0.9 * count:
                    covered = True
                    break
            covered = covered or any(o[0] == name and o[1] and o[2] >= 0.9 * count for o in by_name[max(0, i - 1) : i])
        if not covered:
            kept[key] = (name, not is_word)
    by_kind = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[by_kind], np.arange(len(kinds) + 1))
    place = np.searchsorted(kinds, np.array(sorted(kept), np.uint64))
    member = {int(kinds[p]): d[by_kind[bounds[p] : bounds[p + 1]]] for p in place.tolist()}
    explained, out, weak = np.zeros(n, np.int64), [], set()
    order = {key: i for i, key in enumerate(sorted(kept, key=lambda key: kept[key][0], reverse=True))}
    heap = [(-len(x), order[key], key) for key, x in member.items()]
    heapq.heapify(heap)
    while heap:  # gains only fall, so one that is still the best after a new count is the best of all
        _, rank, best = heapq.heappop(heap)
        gain = int((explained[member[best]] < ENOUGH).sum())
        if heap and (-gain, rank) > heap[0][:2]:
            heapq.heappush(heap, (-gain, rank, best))
            continue
        if gain < least:
            break
        explained[member[best]] += 1
        name, stem = kept[best]
        out.append((name.decode("utf-8", "replace"), stem))
        if best not in strong:
            weak.add(out[-1])
    return out, frozenset(weak)


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of logistic regression around the prior, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + PRIOR_STRENGTH * np.eye(len(w)), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray, weak: frozenset[tuple[str, bool]] = frozenset(), innocent: frozenset[bytes] = frozenset()):
        self.terms, self.weights, self.weak, self.innocent = terms, weights, weak, innocent
        self.lexicon: Lexicon | None = None

    def predict(self, chunk: tokens.Chunk) -> np.ndarray:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.terms, self.weak, self.innocent)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features(chunk, self.lexicon) @ self.weights[1:], -30, 30)))


def _innocent(other: list[str], lexicon: Lexicon) -> frozenset[bytes]:
    """Words of documents that are not toxic which are within edits of a term: words of their own and no misspellings."""
    out = set()
    for chunk in _chunked(other):
        w = tokens.words(chunk)
        out |= {chunk.low[w.starts[i] : w.ends[i]].tobytes() for i, kind in lexicon.hits(chunk, w) if kind == "misspelled"}
    return frozenset(out)


def fit(toxic: list[str], other: list[str]) -> Model:
    toxic, other = sorted(set(toxic)), sorted(set(other))
    terms, weak = learn_terms(toxic, other)
    innocent = _innocent(other, Lexicon(terms, weak))
    lexicon = Lexicon(terms, weak, innocent)
    x = [features(c, lexicon) for c in _chunked(toxic)] + [features(c, lexicon) for c in _chunked(other)]
    y = np.repeat([1.0, 0.0], [len(toxic), len(other)])
    return Model(terms, fit_weights(np.concatenate(x), y) if x else PRIOR, weak, innocent)


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (remainder(F.col("id"), FOLDS) != 1)).groupBy("id").agg(F.max("label").alias("label")).withColumn("key", F.xxhash64("id"))
    picked = None
    for label, most in ((1, SAMPLE), (0, 2 * SAMPLE)):
        some = known.where(F.col("label") == label).orderBy("key", "id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.where(F.length("text") <= LONGEST).join(F.broadcast(picked), "id")
    rows = rows.groupBy("key").agg(F.max("label").alias("label"), F.min("text").alias("text"))  # an id may have many rows
    rows = written(rows, "learning")
    held, last = 0, None
    for r in sorted(rows.select("key", F.length("text").alias("size")).collect()):  # 3 * SAMPLE numbers at most
        if held >= MOST_TEXT:
            break
        held, last = held + r.size, r.key
    rows = rows.where(F.col("key") <= last).collect() if last is not None else []
    return fit([r.text for r in rows if r.label], [r.text for r in rows if not r.label])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(model.predict(chunk))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_scored(model), "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
