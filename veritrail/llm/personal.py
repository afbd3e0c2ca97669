"""Personal data: generators propose overlapping spans, boosted trees judge them by format and context.

The base of each kind is one pattern and a check of what it matches. Further generators propose more than that: cards
and phones that a neighbouring number runs into, numbers without a country code, addresses with brackets in place
of marks. A candidate is described by small integers (digits, groups, separators, a checksum, the characters
and words around it) and never by the generator that found it. In training it counts as right if it lies in a base
span of its kind. Counts of equal descriptions over all documents are what the
trees are fitted on, all of them: their number is bounded by the values that FEATURES have, whatever the number of documents; those of a fourth of the matched texts are held out and calibrate, for each kind, the least score
from which at least PRECISION of the candidates are right. Candidates from there on are added where no base span
overlaps; of two that overlap one that holds the other stays, else the one with the higher score, then the longer, then the earlier.

Everything on rows is DataFrame functions within the row, without a shuffle; the trees become nested conditions. Patterns
are possessive and begin only where a run of their characters does, so that long runs cost one pass. Folds over a
document's spans go by blocks, so that thousands of them in one text stay cheap.

Defined cases: a null text is an empty one; one without candidates has zero counts, the digest of an empty string and an
empty list; repeated rows and null ids come back as they are; other columns are ignored; without base spans of a
kind, or with fewer than LEAST of them held out, nothing of that kind is added; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The base patterns; the first alternatives let a match begin where the last one ended or a run begins, and nowhere else.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: (kind, pattern, what a text holds if the pattern matches): proposals beyond the base.
GENERATORS = (
    (EMAIL, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++", r"(?i)[\[({]\x20?at\x20?[\])}]"),
    (IP, r"(?<![0-9.\])])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9]|\.[0-9])", r"[.\])][0-9]"),
    (CARD, r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"[0-9]{13}"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])", r"[0-9]{4}[\x20-][0-9]{4}"),
    (CARD, r"(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])", r"[0-9][\x20-][0-9]{6}"),
    (PHONE, r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", r"\+[0-9]"),
    (PHONE, r"\+[0-9]{1,3}(?:[\x20.-][0-9]{2,4}){2,5}(?![0-9])", r"\+[0-9]"),
    (PHONE, r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9][.-][0-9]{4}"),
    (PHONE, r"(?<![0-9])00[0-9]{1,3}(?:[\x20.-][0-9]{2,4}){2,5}(?![0-9])", r"00[0-9]"),
)
#: What a text must hold for a base pattern to match.
NEEDS = (r"@", r"[0-9]\.[0-9]", r"[0-9]", r"\+[0-9]")
#: Characters of the shortest candidate of each kind.
SHORTEST = (5, 7, 13, 9)
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Characters of context on each side; words in it that speak for a kind, and words of other numbers and secrets.
AROUND = 40
FOR = ("mail|contact|write|reach|address", r"\bip\b|host|server|address|ping|log", "card|visa|credit|debit|payment|account|master", "tel|phone|call|fax|mobile|dial|contact|reach")
AGAINST = r"token|key|password|secret|sha|hash|version|isbn|serial|order|id\b"
#: What a candidate is described by, each a small integer.
FEATURES = ("kind", "digits", "groups", "seps", "valid", "before", "after", "lead", "speaks")
HELD_OUT, LEAST, PRECISION = 4, 20, 0.9
TREES, DEPTH, RATE, SMOOTH = 40, 3, 0.3, 1.0
BLOCK = 256

_SPAN = "start: int, end: int, hit: string, before: string, after: string"
_CANDIDATE = "start: int, end: int, fold: int, " + ", ".join(f"{f}: int" for f in FEATURES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """Folds an array in order; step gives the next state and an array of what the item adds to the result.

    Blocks of BLOCK items are folded by themselves and joined, so that the result is not copied for each item.
    """
    none = F.expr(f"cast(array() as array<struct<{out}>>)")
    places = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    blocks = let(items, lambda x: F.transform(places(x), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

    def one(acc: Column, item: Column) -> Column:
        after, added = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], added).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    whole = F.aggregate(blocks, F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<struct<{out}>>>)").alias("out")), block)
    return F.flatten(whole["out"])


def _spans(gaps: Column, hits: Column) -> Column:
    """Places of the matches of a pattern, in code points, with what stands around them up to the next match."""
    items = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.length(F.get(gaps, i)).alias("gap"), F.right(F.get(gaps, i), F.lit(AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("after")))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + m["gap"]
        end = start + F.length(m["hit"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after")))

    return folded(items, F.lit(0), step, _SPAN)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def checked(kind: int, hit: Column, digits: Column) -> Column:
    """Whether what a base pattern matched, and its digits, is of its kind."""
    n = F.length(digits)
    if kind == IP:
        return F.regexp_like(hit, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == CARD:
        return F.when(n.between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == PHONE else F.lit(True)


def _beside(c: Column) -> Column:
    """A character beside a candidate: none or white space, letter, digit, quotation or assignment, other."""
    return F.when((c == "") | (c == " "), 0).when(c.between("0", "9"), 2).when(F.regexp_like(c, F.lit(r"^\s$")), 0).when(F.regexp_like(c, F.lit(r"""^["'=:/_#]$""")), 3).when(F.regexp_like(c, F.lit(r"^\p{L}$")), 1).otherwise(4)


def _plain(kind: int, hit: Column) -> Column:
    """What a pattern matched, without brackets in place of marks."""
    if kind == EMAIL:
        return F.regexp_replace(F.regexp_replace(hit, r"\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?", "@"), r"\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?", ".")
    return F.regexp_replace(hit, r"\[\.\]|\(\.\)", ".") if kind == IP else hit


def _described(kind: int, m: Column) -> Column:
    """A candidate of the spans of one pattern."""

    def of(x: Column) -> Column:
        plain, digits = x["plain"], x["digits"]
        has = lambda mark, bit: F.when(F.contains(plain, F.lit(mark)), bit).otherwise(0)
        valid = F.regexp_like(plain, F.lit(r"@.*\.[A-Za-z]{2,}$")) if kind == EMAIL else checked(kind, plain, digits)
        first = F.left(plain, F.lit(1))
        figure = first.try_cast("int") if kind == CARD else F.lit(0)
        near = F.lower(F.concat_ws(" ", m["before"], m["after"]))
        described = {
            "kind": F.lit(kind),
            "digits": F.least(F.length(digits), F.lit(31)),
            "groups": F.least(F.size(F.split(plain, "[^0-9]+")), F.lit(9)),
            "seps": has(" ", 1) + has("-", 2) + has(".", 4) + has("(", 8),
            "valid": F.when(valid, 1).otherwise(0),
            "before": _beside(F.right(m["before"], F.lit(1))),
            "after": _beside(F.left(m["after"], F.lit(1))),
            "lead": F.when(first == "+", 11).when(first == "(", 12).when(first.between("0", "9"), figure).otherwise(10),
            "speaks": F.when(F.regexp_like(F.lower(m["before"]), F.lit(AGAINST)), 2).when(F.regexp_like(near, F.lit(FOR[kind])), 1).otherwise(0),
        }
        fold = (F.crc32(plain.cast("binary")) % HELD_OUT).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), fold.alias("fold"), *[described[f].cast("int").alias(f) for f in FEATURES])

    return let(_plain(kind, m["hit"]), lambda plain: let(F.struct(plain.alias("plain"), _digits(plain).alias("digits")), of))


def _distinct(ordered: Column) -> Column:
    return F.filter(ordered, lambda x, i: (i == 0) | (x != F.get(ordered, i - 1)))


def proposed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, candidates): base spans by kind, and all candidates in order of their start.

    base: an array for each kind, of (start, end), in order. A candidate's ``right`` says whether it lies in a base span of its kind.
    """
    listed = [*[(k, p, NEEDS[k]) for k, p in enumerate(BASE)], *GENERATORS]
    text = F.col("text")
    at = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    holds = {need: f"holds{i}" for i, need in enumerate(dict.fromkeys(n for *_, n in listed))}
    at = at.select("*", *[F.regexp_like(text, F.lit(need)).alias(name) for need, name in holds.items()])
    at = at.select("doc_id", "text", *[c for i, (_, p, need) in enumerate(listed) for c in (
        F.when(F.col(holds[need]), F.split(text, p)).alias(f"gaps{i}"), F.when(F.col(holds[need]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")).alias(f"hits{i}"))])
    at = at.select("doc_id", "text", *[_spans(F.col(f"gaps{i}"), F.col(f"hits{i}")).alias(f"spans{i}") for i in range(len(listed))])
    good = lambda k: F.transform(F.filter(f"spans{k}", lambda m: checked(k, m["hit"], _digits(m["hit"]))), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    described = lambda i, k: F.transform(F.filter(f"spans{i}", lambda m: F.length(m["hit"]) >= SHORTEST[k]), lambda m: _described(k, m))
    found = F.flatten(F.array(*[described(i, k) for i, (k, *_) in enumerate(listed)]))
    return at.select("doc_id", "text", F.array(*[good(k) for k in range(len(KINDS))]).alias("base"), let(F.array_sort(found), _distinct).alias("candidates"))


def _in_order(base: Column, candidates: Column) -> Column:
    """Base spans (kind, start, end) and candidates in one array by start, base first."""
    blank = lambda f: F.lit(0).alias(f)
    spans = F.flatten(F.transform(base, lambda of, k: F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("asks"), s["end"].alias("end"), blank("fold"), k.alias("kind"), *[blank(f) for f in FEATURES[1:]]))))
    asks = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("asks"), c["end"].alias("end"), c["fold"].alias("fold"), *[c[f].alias(f) for f in FEATURES]))
    return F.array_sort(F.concat(spans, asks))


def _labelled(base: Column, candidates: Column) -> Column:
    """Candidates with ``right``: whether the last base span of their kind that begins no later holds them."""

    def step(ends: Column, x: Column) -> tuple[Column, Column]:
        asks = x["asks"] == 1
        after = F.when(asks, ends).otherwise(F.transform(ends, lambda e, k: F.when(k == x["kind"], x["end"]).otherwise(e)))
        right = F.when(F.get(ends, x["kind"]) >= x["end"], 1).otherwise(0).alias("right")
        named = F.struct(*[x[f].alias(f) for f in ("fold", *FEATURES)], right)
        return after, F.when(asks, F.array(named)).otherwise(F.array_repeat(named, 0))

    return folded(_in_order(base, candidates), F.array_repeat(F.lit(-1), len(KINDS)), step, ", ".join(f"{f}: int" for f in ("fold", *FEATURES, "right")))


@dataclass
class Model:
    """Trees (a feature, the largest value that goes left, two branches; or a leaf's number) and of each kind the least score."""

    trees: list
    least: list[float | None]

    def score(self, c: Column) -> Column:
        def grown(node: object) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, value, left, right = node
            return F.when(c[FEATURES[feature]] <= value, grown(left)).otherwise(grown(right))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + grown(tree)
        return 1 / (1 + F.exp(-total))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of described candidates, as ``score`` gives them."""
        return 1 / (1 + np.exp(-sum((_at(t, x) for t in self.trees), np.zeros(len(x)))))


def _at(node: object, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), float(node))
    feature, value, left, right = node
    return np.where(x[:, feature] <= value, _at(left, x), _at(right, x))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> object:
    """The tree whose splits lower the second-order loss most."""
    whole = g.sum() ** 2 / (h.sum() + SMOOTH)
    best, split = 1e-9, None
    for f in range(x.shape[1]) if depth else ():
        left_g, left_h = np.cumsum(np.bincount(x[:, f], g))[:-1], np.cumsum(np.bincount(x[:, f], h))[:-1]
        gain = left_g**2 / (left_h + SMOOTH) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + SMOOTH) - whole
        if len(gain) and gain.max() > best:
            best, split = float(gain.max()), (f, int(gain.argmax()))
    if split is None:
        return float(-RATE * g.sum() / (h.sum() + SMOOTH))
    goes = x[:, split[0]] <= split[1]
    return (*split, _tree(x[goes], g[goes], h[goes], depth - 1), _tree(x[~goes], g[~goes], h[~goes], depth - 1))


def boosted(x: np.ndarray, n: np.ndarray, right: np.ndarray) -> list:
    """Trees for n candidates of each description, of which ``right`` are right (logistic loss)."""
    trees, raw = [], np.zeros(len(x))
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-raw))
        trees.append(_tree(x, n * p - right, n * p * (1 - p), DEPTH))
        raw += _at(trees[-1], x)
    return trees


def calibrated(score: np.ndarray, n: np.ndarray, right: np.ndarray) -> float | None:
    """The least score from which PRECISION of the candidates are right: shares are pooled until they ascend with the score."""
    pools: list[list[float]] = []
    for s in np.unique(score):
        pools.append([s, n[score == s].sum(), right[score == s].sum()])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            _, a, b = pools.pop()
            pools[-1][1:] = pools[-1][1] + a, pools[-1][2] + b
    return min((s for s, a, b in pools if b / a >= PRECISION), default=None) if right.sum() >= LEAST else None


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all documents' candidates; the driver gets a count of each description, as columns of small integers."""
    rows = proposed(docs, id_col, text_col).select(F.inline(_labelled(F.col("base"), F.col("candidates"))))
    held = (F.col("fold") == 0).alias("held")
    counted = rows.groupBy(*[F.col(f).cast("byte").alias(f) for f in FEATURES], held).agg(F.count("*").alias("n"), F.sum("right").alias("right")).orderBy(F.desc("n"), *FEATURES, "held").toArrow()
    x = np.stack([counted.column(f).to_numpy() for f in FEATURES], axis=1).astype(np.int8).reshape(-1, len(FEATURES))
    n, right = (counted.column(c).to_numpy().astype(float) for c in ("n", "right"))
    out = counted.column("held").to_numpy().astype(bool)
    model = Model(boosted(x[~out], n[~out], right[~out]), [])
    score = model.of(x)
    model.least = [calibrated(score[of], n[of], right[of]) for of in (out & (x[:, 0] == k) for k in range(len(KINDS)))]
    return model


def _added(base: Column, scored: Column) -> Column:
    """Candidates (kind, start, end, score) that no base span overlaps; of those that overlap, the one that holds the other or the surer one."""
    kept = "kind: int, start: int, end: int, score: double"
    blank = F.expr("named_struct('kind', -1, 'start', -1, 'end', -1, 'score', -1.0D)")
    spans = F.flatten(F.transform(base, lambda of: F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("asks"), s["end"].alias("end"), F.lit(-1).alias("kind"), F.lit(2.0).alias("score")))))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("asks"), F.lit(2**31 - 1).alias("end"), F.lit(-1).alias("kind"), F.lit(2.0).alias("score")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        held, reach = state["held"], state["reach"]
        mine = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))
        is_base, meets = x["asks"] == 0, held["end"] > x["start"]
        covered, surer = ~is_base & (x["start"] < reach), (x["score"] > held["score"]) | ((x["score"] == held["score"]) & (x["end"] - x["start"] > held["end"] - held["start"]))
        begins = x["start"] == held["start"]
        better = F.when(begins & (x["end"] == held["end"]), surer).when(begins, x["end"] > held["end"]).when(held["end"] >= x["end"], F.lit(False)).otherwise(surer)
        now = F.when(is_base, blank).when(covered | (meets & ~better), held).otherwise(mine)
        leaves = ~covered & ~meets & (held["kind"] >= 0)
        return F.struct(now.alias("held"), F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach).alias("reach")), F.when(leaves, F.array(held)).otherwise(F.array_repeat(held, 0))

    items = F.array_sort(F.concat(spans, F.transform(scored, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("asks"), c["end"].alias("end"), c["kind"].alias("kind"), c["score"].alias("score"))), last))
    return folded(items, F.struct(blank.alias("held"), F.lit(-1).alias("reach")), step, kept)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, added) for each row: base spans by kind, and spans that the model adds, with their scores."""
    at = proposed(docs, id_col, text_col)
    least = F.array(*[F.lit(s if s is not None else 2.0) for s in model.least])
    scored = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), model.score(c).alias("score")))
    at = at.select("doc_id", "text", "base", F.filter(scored, lambda c: c["score"] >= F.get(least, c["kind"])).alias("scored"))
    return at.select("doc_id", "text", "base", _added(F.col("base"), F.col("scored")).alias("added"))


def _listed(found: Column) -> Column:
    """Spans of an array for each kind as `kind:start:end`, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.flatten(F.transform(found, lambda of, k: F.transform(of, lambda s: F.concat_ws(":", F.get(names, k), s["start"].cast("string"), s["end"].cast("string"))))), ",")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what ``spans`` found."""
    pair = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    every = F.transform("base", lambda of, k: F.array_sort(F.concat(of, F.transform(F.filter("added", lambda s: s["kind"] == k), pair))))
    numbers = [F.size(F.get("base", F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *numbers, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, text) with each span, or run of spans that overlap, replaced by its kind in brackets (that of the first)."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    span = lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"))
    items = F.array_sort(F.concat(F.flatten(F.transform("base", lambda of, k: F.transform(of, lambda s: span(s, k)))), F.transform("added", lambda s: span(s, s["kind"]))))
    last = F.array(F.struct(F.length("text").alias("start"), F.length("text").alias("end"), F.lit(-1).alias("kind")))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        before = F.substring(F.col("text"), at + 1, F.greatest(s["start"] - at, F.lit(0)))
        mark = F.when(s["kind"] >= 0, F.get(names, s["kind"])).otherwise("")
        return F.greatest(at, s["end"]), F.array(F.struct(F.concat(before, F.when(s["start"] >= at, mark).otherwise("")).alias("part")))

    return found.select("doc_id", F.array_join(F.transform(folded(F.concat(items, last), F.lit(0), step, "part: string"), lambda p: p["part"]), "").alias("text"))
