"""Best-fit packing of tokenized documents by bin completion.

Documents become pieces of at most CAPACITY tokens. Only the number of pieces of each length matters for the
packing, so the driver solves it on that histogram (at most CAPACITY numbers, whatever the corpus) and
gives back runs: a filling and how many sequences take it. Pieces are numbered within each length, in
parallel, and look up the run, sequence and place of their number; nothing gathers the pieces of a length.

Search: best-fit decreasing is the first incumbent. Then sequences are completed around the largest piece left:
undominated fillings are enumerated with the least waste first, each applied as often as the counts allow,
and branches whose waste can't beat the incumbent are pruned. The search ends at the lower bound or after
STEPS fillings; the best solution found is used, so the effort is bounded and no piece is left out.

Defined cases: a null or empty text is one piece, the end token alone; repeated rows and null ids are packed
like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritrail.llm import tokens
from veritrail.llm.common import written

CAPACITY, END, STEPS = 1024, 2, 6000
#: Bytes of text whose pieces leave a task together.
TEXTS = 256 << 10
#: How byte-level BPE vocabularies of this family split a text before merging; a fixed value of the public format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE file, computed by a faster merger.

    The vocabulary's ids order its merges, which is what tiktoken ranks by. A text that spells out an added
    token goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.path, self.exact = path, None

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            self.exact = self.exact or Tokenizer.from_file(self.path)  # few texts need it: most workers never load it
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = (n - 1) % capacity + 1
    starts = [0, *range(first, n, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def _pieces(path: str):
    """A map of (doc_id, text) to pieces; nth numbers those of one length within the task. Rows leave by TEXTS of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).ids, TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY + 1, np.int64)
        for chunk in tokens.chunks(batches, limit=TEXTS):
            pieces: list[np.ndarray] = []
            for row, (a, b) in enumerate(itertools.pairwise(chunk.offsets.tolist())):
                ids = np.append(encode(chunk.raw[a:b].tobytes().decode("utf-8", "replace")), np.uint32(END)).astype("<u4")
                starts = np.array([s for s, _ in cut(len(ids))], np.int64)
                lengths = np.diff(starts, append=len(ids))
                crc = [zlib.crc32(ids[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                nth = seen[lengths]
                nth[1:] += np.arange(len(nth) - 1) + (lengths[:1] == CAPACITY)  # all but the first are full ones
                seen[lengths[0]] += 1
                seen[CAPACITY] += len(nth) - 1
                pieces.append(np.stack([np.full(len(nth), row), np.arange(len(nth)), starts, lengths, np.array(crc, np.int64), nth]))
            at, piece, start, length, crc, nth = np.concatenate(pieces, axis=1)
            columns = [chunk.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(at), part)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (filling, sequences)."""
    open_bins: dict[int, list[list]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                group, room = [(), left], capacity
            else:
                group = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            each = room // length
            bins = min(group[1], -(-left // each))
            if group[1] > bins and room < capacity:
                open_bins.setdefault(room, []).append([group[0], group[1] - bins])
            full, rest = divmod(left, each) if bins * each > left else (bins, 0)
            if full:
                open_bins.setdefault(room - each * length, []).append([group[0] + (length,) * each, full])
            if rest:
                open_bins.setdefault(room - rest * length, []).append([group[0] + (length,) * rest, 1])
            left -= full * each + rest
    return [(f, m) for groups in open_bins.values() for f, m in groups]


def _reach(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """For each place i the sums, as bits, that pieces of lengths[i:] can make within room."""
    limit, out = (1 << (room + 1)) - 1, [1]
    for length, count in zip(reversed(lengths), reversed(counts), strict=True):
        bits, left, step = out[-1], min(count, room // length), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * length)) & limit
            left -= take
            step *= 2
        out.append(bits)
    return out[::-1]


def _fillings(lengths: list[int], counts: list[int], room: int, slack: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of room with at most slack waste: least waste first, then larger pieces first.

    A sum that leaves more waste than a reachable one is dominated by it; of each sum the fillings come in
    the order of their largest pieces, and one whose pieces another merely splits comes before that other.
    """
    reach = _reach(lengths, counts, room)

    def exact(i: int, need: int) -> Iterator[tuple[int, ...]]:
        if need == 0:
            yield ()
            return
        while i < len(lengths) and not (lengths[i] <= need and reach[i] >> need & 1):
            i += 1
        if i == len(lengths):
            return
        for take in range(min(counts[i], need // lengths[i]), -1, -1):
            rest = need - take * lengths[i]
            if reach[i + 1] >> rest & 1:
                for tail in exact(i + 1, rest):
                    yield (lengths[i],) * take + tail

    for waste in range(min(slack, room) + 1):
        if reach[0] >> (room - waste) & 1:
            yield from exact(0, room - waste)


def pack(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(filling, sequences) that use up the histogram of piece lengths in as few sequences as found."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    total = int((counts * np.arange(capacity + 1)).sum())
    if not total:
        return whole
    bound = max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))
    best = _best_fit(counts, capacity)
    best_bins, used = sum(m for _, m in best), 0

    def complete(bins: int, waste: int, made: list[tuple[tuple[int, ...], int]], width: int) -> None:
        """Completes sequences around the largest piece left, depth first."""
        nonlocal best, best_bins, used
        here = np.flatnonzero(counts)[::-1].tolist()
        if not here:
            if bins < best_bins:
                best, best_bins = list(made), bins
            return
        if used >= steps or best_bins <= bound:
            return
        largest = here[0]
        counts[largest] -= 1
        kinds = [x for x in np.flatnonzero(counts)[::-1].tolist() if x <= capacity - largest]
        slack = (best_bins - 1) * capacity - total - waste
        options = _fillings(kinds, [int(counts[x]) for x in kinds], capacity - largest, slack) if slack >= 0 else iter(())
        counts[largest] += 1
        for _, tail in zip(range(width), options, strict=False):
            filling = (largest, *tail)
            lengths, need = np.unique(filling, return_counts=True)
            spare = capacity - sum(filling)
            times = int((counts[lengths] // need).min())
            if spare:
                times = max(1, min(times, ((best_bins - 1) * capacity - total - waste) // spare))
            counts[lengths] -= need * times
            used += 1
            made.append((filling, times))
            complete(bins + times, waste + spare * times, made, width)
            made.pop()
            counts[lengths] += need * times
            if used >= steps or best_bins <= bound:
                return

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 20_000))
    try:
        complete(0, 0, [], 1)  # the plain dive, then with branches
        if best_bins > bound:
            complete(0, 0, [], 4)
    finally:
        sys.setrecursionlimit(depth)
    return whole + best


class Plan:
    """Looks up the sequence and place of the n-th piece of a length."""

    def __init__(self, runs: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        given: dict[int, int] = {}
        base = 0
        for filling, times in runs:
            offset = 0
            for length in filling:
                first = given.get(length, 0)
                slots.setdefault(length, []).append((first, base, offset, times))
                given[length] = first + times
                offset += length
            base += times
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}

    def place(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.slots[length]
        at = slots[np.searchsorted(slots[:, 0], numbers, "right") - 1]
        return at[:, 1] + numbers - at[:, 0], at[:, 2]


def _placed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = np.asarray(batch.column("length")), np.asarray(batch.column("number"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                rows = lengths == length
                sequence[rows], offset[rows] = plan.place(length, numbers[rows])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece; path: the vocabulary file."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = picked.mapInArrow(_pieces(path), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    plan = Plan(pack(histogram))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(firsts, ["length", "part"]).withColumn("number", F.col("nth") + F.col("before"))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
