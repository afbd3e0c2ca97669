"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Every word is a context with a Chinese restaurant of the words that follow it (a bigram restaurant); all of them
share one parent, the restaurant of single words, above a uniform base. Customers of a context are its
training counts. How many tables a word has there is sampled by Gibbs from its conditional given all others:
generalised Stirling numbers weigh the seatings of c customers at t tables. Tables are the customers of the
parent. After BURN sweeps SAMPLES states are kept and predictive probabilities are averaged over them.

Data flow, all over the whole corpus. Documents are read in blocks of about BLOCK bytes. A block sends its
distinct (context, word) pairs with training counts to shards by context; a shard adds up counts, samples
tables and answers each block. Contexts that hold over a quarter of a shard's share are dealt over the shards by
word as well; they are kept apart and swept in rounds of their own, after each of which the tables of a context
are added up over its shards. Sums of tables by word go to shards by word, which also get each block's words, seat
the parent and answer with counts. A block's texts then meet its answers and are scored. A common pair or word is
one entry of a block however often it stands there. Shards grow in number with the corpus and not in size; a
block sends a shard one message or none, so messages grow with blocks times shards until a message holds one
pair, and never beyond the pairs themselves. The driver keeps the contexts dealt out, fewer than four a shard, with their sums.

Approximations: tables of a context are drawn at once for all its words given the totals of the sweep before;
while seating, the parent is a smoothed count of the block's training words, averaged over the blocks; words of
over CLOSED customers are seated one step of a sequence of customers at a time instead of by Stirling numbers;
the parent's tables and vocabulary while a shard seats its words are those of the shard times the shards, as
words are dealt by hash; words are known by 48 bits of their hash, so two share one with a chance below 1e-6 at
ten thousand million words' pairs in one context. Discounts and strengths are fixed.

Defined cases: a null or empty text is its end token alone; a null id counts as training and is not held out;
repeated rows each count and get their row; without training documents every probability is uniform; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import tokens
from veritrail.llm.common import dropped, remainder, written

BLOCK, SHARD, SEED = 5 << 20, 8 << 20, 77
BURN, SAMPLES, CLOSED = 4, 3, 256
#: Discount and strength of the contexts and of the parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0, 0.5, 10.0
FOLDS, HELD = 5, 1
_KEY = np.uint64((1 << 48) - 1)
#: The end token and the context of a first word.
END, START = np.uint64(1), np.uint64(2)
_PAIRS, _WORDS, _TEXT, _TOTALS, _STATE, _PARTIAL, _PLACES, _SUMS = range(8)
_SCHEMA = "kind int, home long, shard long, block long, data binary"
_NAMES = ["kind", "home", "shard", "block", "data"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; numbers of several bytes are split into planes, whose high bytes vanish."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code, width = a.dtype.str.encode().ljust(8), a.dtype.itemsize
        parts += [code, np.array([a.size], "<i8").tobytes(), a.reshape(-1).view(np.uint8).reshape(-1, width).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for _ in range(count):
        kind = np.dtype(raw[at : at + 8].decode().strip())
        size = int(np.frombuffer(raw, "<i8", 1, at + 8)[0])
        at += 16
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def _low48(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)


def _join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them; hashing spares sorting what repeats."""
    codes, values = pd.factorize(x)
    order = np.argsort(values, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return values[order], place[codes]


class Block:
    """The tokens of a chunk: word keys with an end after each document, the key before each, the document of each."""

    def __init__(self, chunk: tokens.Chunk, train: np.ndarray):
        w = tokens.words(chunk, tokens.SPACED)
        counts = w.counts() + 1
        self.of = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(chunk.n), counts)
        self.word = np.full(int(self.of[-1]), END, np.uint64)
        place = np.ones(len(self.word), bool)
        place[self.of[1:] - 1] = False
        self.word[place] = np.maximum(tokens.word_hashes(chunk, w) & _KEY, np.uint64(3))
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.of[:-1]] = START
        self.train = train[self.doc]


def _number(index: int) -> int:
    """The block's number: the same whenever the same scan reads it."""
    return (TaskContext.get().partitionId() << 32) | index


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tokens.Chunk, Block]]:
    for i, chunk in enumerate(tokens.chunks(batches, limit=BLOCK)):
        yield _number(i), chunk, Block(chunk, np.asarray(chunk.column("train").to_numpy(zero_copy_only=False), bool))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _shares(shards: int):
    """Words that hold over 1/16 of a shard's share of a block's tokens, with counts, and all of the block's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, b in _blocks(batches):
            keys, code = distinct(b.before)
            counts = np.bincount(code, minlength=len(keys))
            large = counts * 16 * shards >= len(b.word)
            keys, counts = np.append(keys[large], 0).astype(np.int64), np.append(counts[large], len(b.word))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["word", "n"])

    return run


def _shard_of(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    spread = np.isin(context, heavy)
    return (tokens.mix(np.where(spread, context * np.uint64(31) + word, context) + np.uint64(9)) % np.uint64(shards)).astype(np.int64)


def _order(b: Block, heavy: np.ndarray, shards: int):
    """Distinct pairs of a block by shard, context and word: (shard, context, word, place of each token's pair)."""
    word, word_code = distinct(b.word)
    code = np.empty_like(word_code)  # a word before is a word of the block too, but for the start
    code[1:] = word_code[:-1]
    code[b.of[:-1]] = len(word)
    pair, inverse = distinct(code * len(word) + word_code)
    u, v = np.append(word, START)[pair // len(word)], word[pair % len(word)]
    shard = _shard_of(u, v, heavy, shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return shard[order], u[order], v[order], place[inverse], word, word_code


def _pair_requests(heavy: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, b in _blocks(batches):
            shard, u, v, pair_of, word, word_code = _order(b, heavy, shards)
            count = np.bincount(pair_of[b.train], minlength=len(u)).astype(np.uint32)
            seen = np.bincount(word_code[b.train], minlength=len(word))
            share = (seen[np.searchsorted(word, v)] + 0.5) / (b.train.sum() + 0.5 * len(word))
            parent = np.clip(np.round(-8 * np.log2(share)), 0, 255).astype(np.uint8)
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                x = slice(bounds[s], bounds[s + 1])
                new = np.flatnonzero(np.concatenate([[True], u[x][1:] != u[x][:-1]]))
                runs = np.diff(np.append(new, bounds[s + 1] - bounds[s])).astype(np.uint32)
                yield _batch([(_PAIRS, s, s, number, packed(*_low48(u[x][new]), runs, *_low48(v[x]), count[x], parent[x]))])

    return run


@lru_cache(maxsize=4)
def stirling(discount: float, top: int = CLOSED) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S[c, t]: the weights of seatings of c customers at t tables."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(top):
        stay = out[c, 1 : c + 1] + np.log(np.maximum(c - discount * np.arange(1, c + 1), 1e-300))
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.append(stay, -np.inf))
    return out


def seat(count: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word given its customers, its parent probability and the tables of the other words there."""
    tables = np.minimum(count, 1).astype(np.int64)
    weights = stirling(discount)
    few = np.flatnonzero((count >= 2) & (count <= CLOSED))
    few = few[np.argsort(count[few], kind="stable")]
    bounds = np.searchsorted(count[few], np.arange(2, CLOSED + 2))
    for c in np.flatnonzero(np.diff(bounds)).tolist():
        rows, c = few[bounds[c] : bounds[c + 1]], c + 2
        for part in np.array_split(rows, -(-len(rows) * c // 2_000_000)):
            grow = np.log(strength + discount * (others[part][:, None] + np.arange(c)))
            logit = np.cumsum(grow, axis=1) + weights[c, 1 : c + 1] + np.log(parent[part])[:, None] * np.arange(1, c + 1)
            p = np.cumsum(np.exp(logit - logit.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (p < rng.random(len(part))[:, None] * p[:, -1:]).sum(axis=1)
    many = np.flatnonzero(count > CLOSED)
    if len(many):
        n, t, last = np.ones(len(many)), np.ones(len(many)), count[many].astype(float)
        while np.any(n < last):
            step = np.minimum(np.maximum(1, np.floor(n / 32)), last - n)
            new = (strength + discount * (others[many] + t)) * parent[many]
            t = t + rng.binomial(step.astype(np.int64), np.where(step > 0, new / (new + n - discount * t), 0))
            n = n + step
        tables[many] = t.astype(np.int64)
    return tables


def _rng(shard: int) -> np.random.Generator:
    return np.random.default_rng([SEED, int(shard)])


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)]) if rows else pa.table(dict(zip(_NAMES, (pa.array([], t) for t in _TYPES), strict=True)))


def _to_words(shards: int, words: np.ndarray, kept: list[np.ndarray]) -> Iterator[tuple]:
    """Sums of tables by word, for the shards of the words."""
    word, code = np.unique(words, return_inverse=True)
    sums = [np.bincount(code, weights=t, minlength=len(word)).astype(np.int64) for t in kept]
    target = (tokens.mix(word + np.uint64(5)) % np.uint64(shards)).astype(np.int64)
    by_target = np.argsort(target, kind="stable")
    bounds = np.searchsorted(target[by_target], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        x = by_target[bounds[s] : bounds[s + 1]]
        x = x[sums[0][x] > 0]
        if len(x):
            yield (_PARTIAL, s, s, -1, packed(*_low48(word[x]), *(_narrow(t[x]) for t in sums)))


def _pair_shard(heavy: np.ndarray, shards: int):
    """Adds up pairs, samples their tables and answers each block; sums of tables by word go on to the words' shards.

    Pairs of contexts that are dealt out leave as the shard's state, and for each block the places of its pairs there.
    """

    def run(group: pa.Table) -> pa.Table:
        shard, blocks = int(group.column("shard")[0].as_py()), group.column("block").to_pylist()
        parts = [unpacked(x.as_py()) for x in group.column("data")]
        heads = [_join48(p[0], p[1]) for p in parts]
        u = np.concatenate([np.repeat(h, p[2]) for h, p in zip(heads, parts, strict=True)])
        v = np.concatenate([_join48(p[3], p[4]) for p in parts])
        count, level = np.concatenate([p[5] for p in parts]).astype(np.int64), np.concatenate([p[6] for p in parts])
        sizes = [len(p[5]) for p in parts]
        order = np.lexsort((v, u))
        new = np.ones(len(u), bool)
        new[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
        pair = np.empty(len(u), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        pu, pv = u[first], v[first]
        c = np.bincount(pair, weights=count).astype(np.int64)
        parent = np.bincount(pair, weights=np.exp2(-level / 8.0)) / np.bincount(pair)
        dealt = np.isin(pu, heavy)
        place = np.cumsum(dealt) - 1
        contexts, at = np.unique(pu, return_inverse=True)
        seated = np.where(dealt, 0, c)
        tables, rng, kept = np.minimum(seated, 1), _rng(shard), []
        for sweep in range(BURN + SAMPLES):
            total = np.bincount(at, weights=tables, minlength=len(contexts))
            tables = seat(seated, parent, np.maximum(0, total[at] - tables), DISCOUNT, STRENGTH, rng)
            if sweep >= BURN:
                kept.append(tables)
        customers = np.bincount(at, weights=c, minlength=len(contexts)).astype(np.int64)
        served = [np.bincount(at, weights=t, minlength=len(contexts)).astype(np.int64) for t in kept]
        rows, begin = [], 0
        for number, head, size in zip(blocks, heads, sizes, strict=True):
            mine = pair[begin : begin + size]
            begin += size
            if len(heavy):
                out = mine[dealt[mine]]
                if len(out):
                    rows.append((_PLACES, number, shard, number, packed(_narrow(place[out]))))
                mine, head = mine[~dealt[mine]], head[~np.isin(head, heavy)]
            here = np.searchsorted(contexts, head)
            extra = [_narrow(t[mine] - np.minimum(c[mine], 1)) for t in kept]
            rows.append((_PAIRS, number, shard, number, packed(_narrow(c[mine]), *extra, _narrow(customers[here]), *(_narrow(s[here]) for s in served))))
        if dealt.any():
            some = np.minimum(c[dealt], 1)
            rows.append((_STATE, -1, shard, -1, packed(*_low48(pu[dealt]), *_low48(pv[dealt]), _narrow(c[dealt]), parent[dealt].astype(np.float32), _narrow(some))))
        return _table([*rows, *_to_words(shards, pv[~dealt], [t[~dealt] for t in kept])])

    return run


def _swept(totals: dict[int, int], sweep: int, keep: bool):
    """A map of states: draws the tables of contexts that are dealt out, given all tables of each; keep: beside those kept before."""
    key = np.array(sorted(totals), np.uint64)
    total = np.array([totals[int(k)] for k in key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, shard, data in zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                if kind != _STATE:
                    continue
                u0, u1, v0, v1, c, parent, *kept = unpacked(data.as_py())
                u, c = _join48(u0, u1), c.astype(np.int64)
                others = np.maximum(0, total[np.searchsorted(key, u)] - kept[-1].astype(np.int64))
                tables = seat(c, parent.astype(float), others, DISCOUNT, STRENGTH, np.random.default_rng([SEED, shard, sweep]))
                names, code = np.unique(u, return_inverse=True)
                sums = np.bincount(code, weights=tables).astype(np.int64)
                yield _batch([
                    (_STATE, -1, shard, -1, packed(u0, u1, v0, v1, _narrow(c), parent, *(kept if keep else []), _narrow(tables))),
                    (_SUMS, -1, shard, -1, packed(names, sums, np.bincount(code, weights=c).astype(np.int64))),
                ])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard's sums: context, tables, customers. Of a state not swept yet, each pair with a customer has one table."""
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            got = unpacked(data.as_py())
            if kind == _STATE:
                names, code = np.unique(_join48(got[0], got[1]), return_inverse=True)
                got = [names] + [np.bincount(code, weights=got[k]).astype(np.int64) for k in (6, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1]), pa.array(got[2])], ["context", "tables", "customers"])


def _dealt_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                got = unpacked(data.as_py())
                rows = list(_to_words(shards, _join48(got[2], got[3]), [t.astype(np.int64) for t in got[-SAMPLES:]]))
                if rows:
                    yield _batch(rows)

    return run


def _dealt_answers(state: pa.Table, places: pa.Table) -> pa.Table:
    """The counts and tables of each block's pairs in contexts that are dealt out."""
    if not state.num_rows:
        return _table([])
    got = unpacked(state.column("data")[0].as_py())
    rows = []
    for number, shard, data in zip(places.column("block").to_pylist(), places.column("shard").to_pylist(), places.column("data"), strict=True):
        at = unpacked(data.as_py())[0].astype(np.int64)
        rows.append((_PLACES, number, shard, number, packed(got[4][at], *(t[at] for t in got[-SAMPLES:]))))
    return _table(rows)


def _dealt_out(pairs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, dict[int, list[int]]]:
    """Sweeps of the contexts that are dealt out: answers to blocks, sums by word, and each context's customers and tables a sample."""

    def summed(rows: DataFrame) -> dict[int, tuple[int, int]]:
        sums = rows.mapInArrow(_sums, "context long, tables long, customers long").groupBy("context").agg(F.sum("tables").alias("t"), F.sum("customers").alias("c"))
        return {r.context: (r.t, r.c) for r in sums.toLocalIterator()}

    state = pairs.where(F.col("kind") == _STATE)
    now, spread = summed(state), {}
    for sweep in range(BURN + SAMPLES):
        swept = written(state.mapInArrow(_swept({k: t for k, (t, _) in now.items()}, sweep, sweep > BURN), _SCHEMA), "swept")
        if sweep:
            dropped(state)
        state = swept
        now = summed(swept.where(F.col("kind") == _SUMS))
        if sweep >= BURN:
            for k, (t, c) in now.items():
                spread.setdefault(k, [c]).append(t)
    state = state.where(F.col("kind") == _STATE)
    places = pairs.where(F.col("kind") == _PLACES)
    answers = state.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(_dealt_answers, _SCHEMA)
    return answers, state.mapInArrow(_dealt_words(shards), _SCHEMA), spread


def _word_requests(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, b in _blocks(batches):
            word, code = distinct(b.word)
            count = np.bincount(code[b.train], minlength=len(word)).astype(np.uint32)
            target = (tokens.mix(word + np.uint64(5)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            bounds = np.searchsorted(target[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                x = order[bounds[s] : bounds[s + 1]]
                yield _batch([(_WORDS, s, s, number, packed(*_low48(word[x]), count[x]))])

    return run


def _word_shard(shards: int):
    """Adds up words, seats the parent restaurant's part of them and answers each block; totals go to the driver."""

    def run(group: pa.Table) -> pa.Table:
        shard, kinds = int(group.column("shard")[0].as_py()), group.column("kind").to_pylist()
        numbers, parts = group.column("block").to_pylist(), [unpacked(x.as_py()) for x in group.column("data")]
        keys = [_join48(p[0], p[1]) for p in parts]
        word, code = np.unique(np.concatenate(keys), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        count = np.zeros(len(word), np.int64)
        guests = [np.zeros(len(word), np.int64) for _ in range(SAMPLES)]
        for k, p, a, b in zip(kinds, parts, bounds[:-1], bounds[1:], strict=True):
            if k == _WORDS:
                count += np.bincount(code[a:b], weights=p[2], minlength=len(word)).astype(np.int64)
            else:
                for g, more in zip(guests, p[2:], strict=True):
                    g += np.bincount(code[a:b], weights=more, minlength=len(word)).astype(np.int64)
        rng, tables = _rng(shard + (1 << 40)), []
        base = np.full(len(word), 1.0 / (int((count > 0).sum()) * shards + 1))
        for g in guests:
            t = np.minimum(g, 1)
            for _ in range(BURN):
                t = seat(g, base, np.maximum(0, int(t.sum()) * shards - t), ROOT_DISCOUNT, ROOT_STRENGTH, rng)
            tables.append(t)
        rows = [(_TOTALS, -1, shard, -1, packed(np.array([count.sum(), (count > 0).sum(), *(g.sum() for g in guests), *(t.sum() for t in tables)], np.int64)))]
        for k, number, a, b in zip(kinds, numbers, bounds[:-1], bounds[1:], strict=True):
            if k == _WORDS:
                x = code[a:b]
                rows.append((_WORDS, number, shard, number, packed(_narrow(count[x]), *(_narrow(g[x]) for g in guests), *(_narrow(t[x]) for t in tables))))
        return pa.table(dict(zip(_NAMES, (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)), strict=True)))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's ids and texts as one compressed row."""
    for i, chunk in enumerate(tokens.chunks(batches, limit=BLOCK)):
        number, ids = _number(i), chunk.column("doc_id")
        train = np.asarray(chunk.column("train").to_numpy(zero_copy_only=False), bool)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        yield _batch([(_TEXT, number, -1, number, packed(chunk.raw, chunk.offsets, ids.fill_null(0).to_numpy(), known, train))])


def parent(guests, tables, all_guests, all_tables, vocabulary: int):
    """Probability of words in the parent restaurant: guests and tables of the words and of all; one place for unknown words."""
    return (guests - ROOT_DISCOUNT * tables + (ROOT_STRENGTH + ROOT_DISCOUNT * all_tables) / (vocabulary + 1)) / (ROOT_STRENGTH + all_guests)


def predictive(count, tables, customers, served, above):
    """Probability of words in a context: counts and tables of the words there, all customers and tables there, the parent's."""
    inside = (count - DISCOUNT * tables + (STRENGTH + DISCOUNT * served) * above) / (STRENGTH + customers)
    return np.where(customers > 0, inside, above)


def _score_block(shards: int, heavy: dict[int, tuple[int, ...]], totals: list[int]):
    """Scores a block's documents from its texts and the answers to it."""
    spread = np.array(sorted(heavy), np.uint64)

    def run(group: pa.Table) -> pa.Table:
        kinds, shard_of, data = group.column("kind").to_pylist(), group.column("shard").to_pylist(), group.column("data")
        raw, offsets, ids, known, train = unpacked(data[kinds.index(_TEXT)].as_py())
        b = Block(tokens.Chunk(None, 0, tokens.LOWER[raw], raw, offsets), train)
        shard, u, v, pair_of, word, word_code = _order(b, spread, shards)
        dealt = np.isin(u, spread)
        count = np.zeros(len(word), np.int64)
        guests, tables = np.zeros((SAMPLES, len(word))), np.zeros((SAMPLES, len(word)))
        c, t = np.zeros(len(u)), np.zeros((SAMPLES, len(u)))
        customers, served = np.zeros(len(u)), np.zeros((SAMPLES, len(u)))
        target = (tokens.mix(word + np.uint64(5)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        w_bounds, p_bounds = np.searchsorted(target[order], np.arange(shards + 1)), np.searchsorted(shard, np.arange(shards + 1))
        for kind, s, blob in zip(kinds, shard_of, data, strict=True):
            if kind == _WORDS:
                got, x = unpacked(blob.as_py()), order[w_bounds[s] : w_bounds[s + 1]]
                count[x] = got[0]
                guests[:, x], tables[:, x] = got[1 : 1 + SAMPLES], got[1 + SAMPLES :]
            elif kind == _PAIRS:
                got, x = unpacked(blob.as_py()), np.arange(p_bounds[s], p_bounds[s + 1])
                x = x[~dealt[x]]
                c[x] = got[0]
                t[:, x] = np.array(got[1 : 1 + SAMPLES]) + np.minimum(got[0], 1)
                at = np.cumsum(np.append(True, u[x][1:] != u[x][:-1])[: len(x)]) - 1
                customers[x] = got[1 + SAMPLES][at]
                served[:, x] = np.array([g[at] for g in got[2 + SAMPLES :]])
            elif kind == _PLACES:
                got, x = unpacked(blob.as_py()), np.arange(p_bounds[s], p_bounds[s + 1])
                x = x[dealt[x]]
                c[x] = got[0]
                t[:, x] = got[1:]
        for key, (n, *tabs) in heavy.items():
            x = u == np.uint64(key)
            customers[x] = n
            served[:, x] = np.array(tabs)[:, None]
        n_all, kinds_all = totals[0], totals[1]
        all_guests, all_tables = np.array(totals[2 : 2 + SAMPLES], float)[:, None], np.array(totals[2 + SAMPLES :], float)[:, None]
        above = parent(guests, tables, all_guests, all_tables, kinds_all)[:, np.searchsorted(word, v)]
        p = predictive(c, t, customers, served, above).mean(axis=0)
        log_p = np.log10(p)[pair_of]
        log_base = np.log10((count + 0.5) / (n_all + 0.5 * (kinds_all + 1)))[word_code]
        first = b.of[:-1]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known),
            "n_tokens": pa.array(np.diff(b.of)),
            "n_known": pa.array(np.add.reduceat((count[word_code] > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(ids), n_all)),
            "base_score": pa.array(np.add.reduceat(log_base, first)),
            "score": pa.array(np.add.reduceat(log_p, first)),
        })

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document.

    score is the model's log10 probability of the text with its end; perplexity is 10 ** (-score / n_tokens).
    """
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("train", ~held)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    shares = written(texts.mapInArrow(_shares(shards), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "shares")
    limit = (shares.where("word = 0").agg(F.sum("n")).first()[0] or 0) / (4 * shards)
    large = [r.word for r in shares.where((F.col("word") != 0) & (F.col("n") > limit)).toLocalIterator()] if shards > 1 else []
    heavy = np.array(sorted(large), np.uint64)
    asked = texts.mapInArrow(_pair_requests(heavy, shards), _SCHEMA)
    pairs = written(asked.groupBy("shard").applyInArrow(_pair_shard(heavy, shards), _SCHEMA), "pairs")
    partial, spread, dealt = pairs.where(F.col("kind") == _PARTIAL), {}, None
    if len(heavy):
        dealt, more, spread = _dealt_out(pairs, shards)
        partial = partial.unionByName(more)
    asked = texts.mapInArrow(_word_requests(shards), _SCHEMA).unionByName(partial)
    words = written(asked.groupBy("shard").applyInArrow(_word_shard(shards), _SCHEMA), "words")
    totals = [0] * (2 + 2 * SAMPLES)
    for r in words.where(F.col("kind") == _TOTALS).toLocalIterator():
        totals = [a + int(x) for a, x in zip(totals, unpacked(r.data)[0].tolist(), strict=True)]
    answers = pairs.where(F.col("kind") == _PAIRS).unionByName(words.where(F.col("kind") == _WORDS))
    answers = answers.unionByName(dealt) if dealt is not None else answers
    gathered = texts.mapInArrow(_texts, _SCHEMA).unionByName(answers)
    out = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = gathered.groupBy("home").applyInArrow(_score_block(shards, {k: tuple(v) for k, v in spread.items()}, totals), out)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
