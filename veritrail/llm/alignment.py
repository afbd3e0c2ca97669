"""Cross-tokenizer alignment: where the tokens of two tokenizers meet, and which of their ids go together.

Both tokenizers cut the same bytes, a space and the text. A document's two lists of token ends are merged along a
merge path: a binary search on every PIECE-th diagonal finds how many ends of A and of B come before it (A first
where both end alike), which cuts the merge into pieces of equal work. Pieces are rows of their own, written once as
token ids; each knows the byte where its first tokens begin and one token beyond its last, so that it finds its
overlaps alone. Every end, less those that both share, closes the overlap of just one A and one B token: that is a
link. An end of B that A shares closes a group; what a piece leaves open is stitched to what the next one begins
with.

Links are counted by pair of ids over all documents: within a task first, then by Spark. A document needs the counts
of its pairs. The FREQUENT pairs with the most links go to all tasks (a few MB, whatever the corpus); documents ask
for all others by a join on the pair, which has no hot key since such pairs are few each. No pair is left out.

Defined cases: a text that is null or empty, or whose bytes one of the tokenizers does not give back, has no tokens:
all numbers 0, groups an empty string. Strings of special tokens are plain text. Repeated rows and null ids each get
their row and count their links; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm import packing, tokens
from veritrail.llm.common import written

#: Steps of the merge path a piece has, bytes of text and steps of pieces handled at once, pairs that go to all tasks.
PIECE, TEXTS, STEPS, FREQUENT = 1 << 18, 256 << 10, 1 << 19, 1 << 18
#: Distinct pairs that a task keeps before it sends their counts on.
HELD = 1 << 20

_TOKENS = "key long, doc_id {id}, piece int, n_pieces int, a binary, b binary, n_a long, n_b long, a_from long, b_from long"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
TEXT_PARTS = ("body", "head_a", "head_b", "tail_a", "tail_b")
_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """A tokenizer: ids of a text (as that of ``space + text``), and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: np.array(model.encode(text), np.int64)
            piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            self.bytes = [piece(i) for i in range(model.get_piece_size())]
        else:
            coding = packing.encoder(path)
            self.ids = lambda text: coding.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
            known = {coding.fast.encode_single_token(t): t for t in coding.fast.token_byte_values()}
            self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.kind = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")
        self._marked: dict[str, np.ndarray] = {}

    def gives_back(self, ids: np.ndarray, data: bytes) -> bool:
        return b"".join([self.bytes[i] for i in ids.tolist()]) == data

    def marked(self, mark: str) -> np.ndarray:
        """Every id as text with a comma behind it, then every id with the mark behind it."""
        if mark not in self._marked:
            self._marked[mark] = np.array([f"{i}{m}" for m in (",", mark) for i in range(len(self.bytes))], object)
        return self._marked[mark]


def vocabulary(path: str) -> Vocabulary:
    """The tokenizer of a file, loaded once for each Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b come before each step-th diagonal of their merge, and before its end; equal ends: a first."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        from_a = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        low, high = np.where(from_a, mid + 1, low), np.where(open_ & ~from_a, mid, high)
    return low, d - low


def _cut(path_a: str, path_b: str, step: int):
    """A map of (doc_id, text) to pieces of their tokens."""

    def rows(text: str, va: Vocabulary, vb: Vocabulary) -> Iterator[tuple]:
        a, b = (va.ids(text), vb.ids(text)) if text else (np.zeros(0, np.int64),) * 2
        data = b" " + text.encode()
        if not len(a) or not va.gives_back(a, data) or not vb.gives_back(b, data):
            yield 0, 1, b"", b"", 0, 0, 0, 0
            return
        ends_a, ends_b = np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b])
        at_a, at_b = diagonals(ends_a, ends_b, step)
        for p, ((i, i1), (j, j1)) in enumerate(zip(itertools.pairwise(at_a.tolist()), itertools.pairwise(at_b.tolist()), strict=True)):
            begin_a, begin_b = int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0
            yield p, len(at_a) - 1, a[i : i1 + 1].astype(va.kind).tobytes(), b[j : j1 + 1].astype(vb.kind).tobytes(), i1 - i, j1 - j, begin_a, begin_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb, key = vocabulary(path_a), vocabulary(path_b), itertools.count(TaskContext.get().partitionId() << 33)
        for chunk in tokens.chunks(batches, limit=TEXTS):
            found = [(row, next(key), r) for row, (s, e) in enumerate(itertools.pairwise(chunk.offsets.tolist())) for r in [list(rows(chunk.raw[s:e].tobytes().decode("utf-8", "replace"), va, vb))]]
            flat = [(key_, row, *piece) for row, key_, pieces in found for piece in pieces]
            keys, at, *rest = zip(*flat, strict=True)
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
            columns = [pa.array(keys, pa.int64()), chunk.column("doc_id").take(pa.array(at)), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "piece", "n_pieces", "a", "b", "n_a", "n_b", "a_from", "b_from"])

    return run


def pieces(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", step: int = PIECE) -> DataFrame:
    """The written table of all documents' pieces: ids of A and B (one beyond the last of each), and where they begin."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(named.mapInArrow(_cut(path_a, path_b, step), _TOKENS.format(id=named.schema["doc_id"].dataType.simpleString())), "tokens", compression="zstd")


class _Merge:
    """The merge of some pieces at once: of each link its pair code and piece, and the common ends."""

    def __init__(self, batch: pa.RecordBatch, va: Vocabulary, vb: Vocabulary):
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.n_a, self.n_b, from_a, from_b = (column(c) for c in ("n_a", "n_b", "a_from", "b_from"))
        rows = np.arange(batch.num_rows)
        ids_a, slots_a = self._ids(batch.column("a"), va.kind, self.n_a)
        ids_b, slots_b = self._ids(batch.column("b"), vb.kind, self.n_b)
        self.row_a, self.row_b = np.repeat(rows, self.n_a), np.repeat(rows, self.n_b)
        self.ids_a, self.ids_b = ids_a[slots_a], ids_b[slots_b]
        # ends of all pieces on one line, piece after piece
        begin_a, begin_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        sum_a, sum_b = np.append(0, np.cumsum(va.lengths[self.ids_a])), np.append(0, np.cumsum(vb.lengths[self.ids_b]))
        last_a, last_b = from_a + sum_a[begin_a + self.n_a] - sum_a[begin_a], from_b + sum_b[begin_b + self.n_b] - sum_b[begin_b]
        least = np.minimum(from_a, from_b)
        width = np.maximum(last_a, last_b) - least + 2
        base = np.cumsum(width) - width - least
        ends_a = (base + from_a - sum_a[begin_a])[self.row_a] + sum_a[1:]
        ends_b = (base + from_b - sum_b[begin_b])[self.row_b] + sum_b[1:]
        before = np.searchsorted(ends_a, ends_b, "right")  # ends of A up to each end of B
        earlier = np.append(-1, ends_a)[before]
        earlier = np.where(before == begin_a[self.row_b], (base + from_a)[self.row_b], earlier)
        #: Whether an end of B is one of A, and the ends of A before it on the merge path.
        self.common, self.before = earlier == ends_b, before
        alone = ~self.common
        beside = np.searchsorted(ends_b, ends_a, "left")
        # a slot beyond the last token of each piece: index + row
        link_a = np.concatenate([self.ids_a, ids_a[before[alone] + self.row_b[alone]]])
        link_b = np.concatenate([ids_b[beside + self.row_a], self.ids_b[alone]])
        self.pairs, self.row = link_a * len(vb.bytes) + link_b, np.concatenate([self.row_a, self.row_b[alone]])

    @staticmethod
    def _ids(column: pa.Array, kind: np.dtype, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with one slot beyond the last of each piece, and which slots are its own tokens."""
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).astype(np.int64) if data is not None else np.zeros(0, np.int64)
        has = np.diff(offsets) // kind.itemsize
        begin = np.cumsum(n + 1) - (n + 1)
        out = np.zeros(int((n + 1).sum()), np.int64)
        out[np.arange(len(raw)) + np.repeat(begin - (np.cumsum(has) - has), has)] = raw
        return out, np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def _merges(batches: Iterator[pa.RecordBatch], va: Vocabulary, vb: Vocabulary) -> Iterator[tuple[pa.RecordBatch, _Merge]]:
    for batch in batches:
        steps = np.cumsum(batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(steps, (steps[first - 1] if first else 0) + STEPS, "right")))
            part = batch.slice(first, last - first)
            yield part, _Merge(part, va, vb)
            first = last


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _counted(path_a: str, path_b: str):
    """A map of pieces to (pair, n): links of each pair, summed within the task as far as HELD allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary(path_a), vocabulary(path_b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["pair", "n"])
        for _, m in _merges(batches, va, vb):
            held.append(np.unique(m.pairs, return_counts=True))
            if sum(len(p) for p, _ in held) > 2 * HELD:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD:
                    yield out(held.pop())
        if held:
            yield out(_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def counts(cut: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The written table (pair, a, b, n, best): links of each pair of ids, and whether no other A id has more with that B id."""
    size = len(vocabulary(path_b).bytes)
    found = cut.mapInArrow(_counted(path_a, path_b), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = found.select("pair", F.expr(f"pair div {size}").alias("a"), (F.col("pair") % size).alias("b"), "n")
    most = F.max("n").over(Window.partitionBy("b"))  # at most as many rows as A has ids
    return written(found.withColumn("best", F.col("n") == most), "pairs")


def _texts(m: _Merge, whole: np.ndarray, va: Vocabulary, vb: Vocabulary) -> list[tuple[str | None, ...]]:
    """Of each piece (body, head_a, head_b, tail_a, tail_b): its groups, ids before its first common end, ids after its last.

    A piece that is a whole document has a body alone; one without a common end has a tail alone.
    """
    rows = len(m.n_a)
    closers = np.flatnonzero(m.common)
    group_a = np.searchsorted(m.before[closers], np.arange(len(m.ids_a)), "right") + m.row_a
    group_b = np.cumsum(m.common) - m.common + m.row_b
    begin_a, begin_b = np.append(0, np.cumsum(m.n_a)), np.append(0, np.cumsum(m.n_b))
    # tokens in order of groups, A before B, each with the mark behind it
    ends_a, ends_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    words = np.empty(len(group_a) + len(group_b), object)
    words[np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")] = va.marked("|")[m.ids_a + ends_a * len(va.bytes)]
    words[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = vb.marked(";")[m.ids_b + ends_b * len(vb.bytes)]
    out: list[tuple[str | None, ...]] = []
    first = group = 0
    for r in range(rows):
        last = begin_a[r + 1] + begin_b[r + 1]
        closed = int(m.common[begin_b[r] : begin_b[r + 1]].sum())
        if whole[r]:
            out.append(("".join(words[first:last].tolist())[:-1], None, None, None, None))
        else:
            a, b = slice(begin_a[r], begin_a[r + 1]), slice(begin_b[r], begin_b[r + 1])
            at = lambda groups: np.searchsorted(groups, np.arange(group + 1, group + closed + 1))
            parts = [[",".join(map(str, x.tolist())) for x in np.split(ids, at(groups))] for ids, groups in ((m.ids_a[a], group_a[a]), (m.ids_b[b], group_b[b]))]
            head = (parts[0][0], parts[1][0]) if closed else (None, None)
            out.append((";".join(f"{x}|{y}" for x, y in zip(parts[0][1:-1], parts[1][1:-1], strict=True)), *head, parts[0][-1], parts[1][-1]))
        first, group = last, group + closed + 1
    return out


def _scored(path_a: str, path_b: str, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """A map of pieces to their numbers and groups; ``rare`` holds the pairs that are not among the frequent ones."""
    known, known_n, known_best = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary(path_a), vocabulary(path_b)
        for batch, m in _merges(batches, va, vb):
            rows = batch.num_rows
            distinct, of = np.unique(m.pairs, return_inverse=True)
            at = np.searchsorted(known, distinct)
            found = np.append(known, -1)[at] == distinct
            n, best = np.where(found, np.append(known_n, 0)[at], 0)[of], (found & np.append(known_best, False)[at])[of]
            common = np.bincount(m.row_b[m.common], minlength=rows)
            unknown = np.flatnonzero(~found[of])
            asked, links = np.unique(m.row[unknown] * len(distinct) + of[unknown], return_counts=True)
            structs = pa.StructArray.from_arrays([pa.array(distinct[asked % max(len(distinct), 1)]), pa.array(links)], ["pair", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(asked, np.arange(rows + 1) * len(distinct)).astype(np.int32)), structs)
            whole = batch.column("n_pieces").to_numpy() == 1
            texts = [pa.array(c, pa.string()) for c in zip(*_texts(m, whole, va, vb), strict=True)]
            totals = [m.n_a, m.n_b, common, m.n_a + m.n_b - common, _by_row(best.astype(np.int64), m.row, rows), _by_row(n, m.row, rows)]
            columns = [batch.column(c) for c in ("key", "doc_id", "piece", "n_pieces")] + [pa.array(x.astype(np.int64)) for x in totals] + texts + [rare]
            yield pa.RecordBatch.from_arrays(columns, [*("key", "doc_id", "piece", "n_pieces"), *NUMBERS, *TEXT_PARTS, "rare"])

    return run


def _by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums of values by row."""
    out = np.zeros(rows, np.int64)
    np.add.at(out, row, values)
    return out


def _stitched(parts: Column) -> Column:
    """The groups of a document from its pieces in order: what one leaves open, the next one's head completes."""
    joined = lambda x, y: F.concat_ws(",", F.nullif(x, F.lit("")), F.nullif(y, F.lit("")))

    def step(acc: Column, p: Column) -> Column:
        a, b, closes = joined(acc["a"], F.coalesce(p["head_a"], p["tail_a"])), joined(acc["b"], F.coalesce(p["head_b"], p["tail_b"])), p["head_a"].isNotNull()
        text = F.concat_ws(";", F.nullif(acc["text"], F.lit("")), F.concat_ws("|", a, b), F.nullif(p["body"], F.lit("")))
        return F.struct(F.when(closes, text).otherwise(acc["text"]).alias("text"), F.when(closes, p["tail_a"]).otherwise(a).alias("a"), F.when(closes, p["tail_b"]).otherwise(b).alias("b"))

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit("").alias("a"), F.lit("").alias("b")), step)["text"]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", carried: Callable[[Column], Column] = lambda groups: groups, step: int = PIECE, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row.

    groups lists the ids of each group, `a1,a2|b1;a3|b2,b3`. ``carried`` turns it into what the rows carry on,
    such as a digest, before they are shuffled.
    """
    cut = pieces(docs, path_a, path_b, id_col, text_col, step)
    counted = counts(cut, path_a, path_b)
    top = counted.orderBy(F.desc("n"), "pair").limit(frequent).select("pair", "n", "best").toPandas().sort_values("pair")  # frequent rows at most
    known = top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)
    kind = cut.schema["doc_id"].dataType.simpleString()
    kinds = f"key long, doc_id {kind}, piece int, n_pieces int, {', '.join(f'{c} long' for c in NUMBERS)}, {', '.join(f'{c} string' for c in TEXT_PARTS)}, rare array<struct<pair: long, n: long>>"
    found = lambda which: cut.where(which).mapInArrow(_scored(path_a, path_b, known), kinds)
    one = found("n_pieces = 1").select("key", "doc_id", *NUMBERS, carried(F.col("body")).alias("groups"), "rare")
    ordered = F.array_sort(F.collect_list(F.struct("piece", *TEXT_PARTS)))
    many = (
        found("n_pieces > 1")
        .groupBy("key")
        .agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in NUMBERS], carried(_stitched(ordered)).alias("groups"), F.flatten(F.collect_list("rare")).alias("rare"))
    )
    rows = written(one.unionByName(many), "aligned")
    asked = rows.select("key", F.inline("rare")).select("key", "pair", F.col("n").alias("links"))
    rest = asked.join(counted, "pair").groupBy("key").agg(F.sum(F.col("links") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
    added = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    whole = rows.drop("rare").join(rest, "key", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more"), "groups")
