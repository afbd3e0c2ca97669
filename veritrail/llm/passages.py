"""Substring dedup by compact windows: near-duplicate passages across documents, found, verified and cut.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; tokens are the hashes of
shingles of WIDTH words, and a passage is SPAN tokens (50 words). Two passages whose tokens agree by place at
similarity 0.8 differ in at most 5 of 46 of them. A changed word spoils 5 tokens unless it is at an end, so at
most one lies inside, and the larger part beside it is 21 equal tokens, 25 equal words. So do passages in
which one word was put in or left out. Windows are therefore made to meet by exact repeats of 25 words, none
of which is missed: a compact window (l, c, r) of one min-hash over grams of GRAM words stands for all
passages within [l, r] whose least gram is at c, and 25 equal words, PICK grams, have the same c. The gram
there is the key of the run at c. (For windows of one length their c alone is needed, not the tree.)

A run has, beside its key, four bits of each of the 35 words on either side, eight of each piece of 7 words and a hash of all of them. Runs that
are the same around the gram repeat 50 words: each is aligned with the first of them only, in its chunk of
documents and then in the shard of the key, so that a passage that a third of all documents hold sends one
run for each chunk. Of runs that differ, each is aligned with the key's first if five pieces of 7 words in a
row are equal, which makes 50 words too; else with every earlier one back to such a repeat, as no single hub
can stand for a key whose documents drift. In groups of over SMALL different runs it is compared with all of
these as well, but aligned only with those whose words around the gram allow 50 words with one word changed,
put in or left out, and at first with MEET of them only. Where what these alignments give does not hold all words
around a run that stopped at MEET or at a sure repeat, a second pass takes all runs of its key with exact hashes of all words around the gram
and verifies it there against the earlier ones, from the nearest back, until all its words are held. A
passage is given only if it holds words that none before it has, so that their number grows with the runs and not with the
pairs of a group; only comparisons grow with these. A document's runs that surely repeat its run before are aligned with that one, and go to the second pass where they differ around it.

An alignment is one of two documents. It, or a pair of runs of the second pass, is verified on the shingles of both: a window of SPAN tokens counts
if its Jaccard similarity is at least SIMILARITY, by aligned equal shingles or else by the sets. The result
names for each passage the document and the earlier document or place that holds it.

Defined cases: texts that are null, empty or shorter than 50 words and rows with a null id take no part; a passage
that repeats within a document matches its earlier place there; rows of one id are one document; passages of
repeated rows are reported for each different text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm import tokens
from veritrail.llm.common import unused, written
from veritrail.llm.pitman_yor import _join48 as join48
from veritrail.llm.pitman_yor import _low48 as low48
from veritrail.llm.pitman_yor import packed, unpacked

WIDTH, SPAN, SIMILARITY = 5, 46, 0.8
#: Ends of the slices of a document that alignments ask for are multiples of this, so that partners share slices.
GRID = 256
#: Tokens on either side of an alignment that verification may extend into.
MARGIN = 128
#: Aligned equal shingles that a window needs: m / (2 SPAN - m) >= SIMILARITY.
NEED = int(np.ceil(2 * SPAN * SIMILARITY / (1 + SIMILARITY) - 1e-9))
#: Words of a gram, and grams of the equal words that any two near passages hold: those of half of NEED shingles.
GRAM = 3 * WIDTH
PICK = -(-NEED // 2) + WIDTH - GRAM
#: Words of a piece, and pieces on either side of a gram; with the gram they are 50 words.
PIECE, SIDE = 7, 5
WORDS = 2 * SIDE * PIECE
#: Runs of a key that are aligned without a look at their words; of more, all are compared first.
SMALL = 32
#: Runs of such a key that one is aligned with before it is known whether they hold all around it.
MEET = 2
#: Values of a key that the second pass tells apart before its shuffle, a bit each.
BUCKETS = 1 << 24
#: Earlier runs that the second pass compares with one at once, and alignments that are verified at once.
BACK, AT_ONCE = 256, 1024
#: Bytes of text of a chunk and for each shard.
BLOCK, SHARD = 4 << 20, 16 << 20
_RUNS, _FOUND, _TWINS = range(3)
_ODD, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64((1 << 24) - 1)


def _minima(values: np.ndarray, of: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of span tokens within a document, and the position of the least value in each."""
    n = np.maximum(np.diff(of) - span + 1, 0)
    starts = np.arange(n.sum()) + np.repeat(of[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    if not len(starts):
        return starts, starts
    best = (values & ~_LOW) | (np.arange(len(values), dtype=np.uint64) & _LOW)  # the position breaks ties
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    least = np.minimum(best[starts], best[starts + span - width])
    return starts, starts + (((least & _LOW).astype(np.int64) - starts) & int(_LOW))


def compact_windows(values: np.ndarray, of: np.ndarray, span: int = SPAN) -> np.ndarray:
    """(l, c, r) of the nodes of each document's Cartesian tree that span at least span tokens, by c. r is inclusive.

    ``_minima`` tells the nodes; a stack over them, by position, gives the tree: on leaving the stack a node
    meets the smaller one at its right, and below it lies the smaller one at its left.
    """
    nodes = np.unique(_minima(values, of, span)[1])
    doc = np.searchsorted(of, nodes, "right") - 1
    left, right = of[doc], of[doc + 1] - 1
    rank = ((values[nodes] & ~_LOW) | (nodes.astype(np.uint64) & _LOW)).tolist()
    owner, place = doc.tolist(), nodes.tolist()
    l, r = left.tolist(), right.tolist()
    stack: list[int] = []
    for i in range(len(place)):
        while stack and (owner[stack[-1]] != owner[i] or rank[stack[-1]] > rank[i]):
            k = stack.pop()
            if owner[k] == owner[i]:
                r[k] = place[i] - 1
        if stack:
            l[i] = place[stack[-1]] + 1
        stack.append(i)
    return np.column_stack([np.array(l, np.int64), nodes, np.array(r, np.int64)]) if len(nodes) else np.zeros((0, 3), np.int64)


def _picks(chunk: tokens.Chunk) -> tuple[np.ndarray, ...]:
    """(key, row, word) of a chunk's grams that are least in some PICK in a row; then its word hashes with the first of each row, and its shingles likewise."""
    w = tokens.words(chunk)
    hashes = tokens.word_hashes(chunk, w)
    made, of = tokens.shingles(hashes, w.of, WIDTH)
    size = np.diff(w.of)
    many = np.maximum(size - GRAM + 1, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) + np.repeat(of[:-1] - first[:-1], many)
    grams = made[at]
    for k in range(WIDTH, GRAM, WIDTH):
        grams = tokens.mix(grams * _ODD + made[at + k])
    least = np.zeros(len(grams), bool)
    least[_minima(tokens.mix(grams ^ _SEED), first, PICK)[1]] = True
    spot = np.flatnonzero(least)
    doc = np.searchsorted(first, spot, "right") - 1
    long = size[doc] >= SPAN + WIDTH - 1
    spot, doc = spot[long], doc[long]
    return grams[spot] >> np.uint64(16), doc, spot - first[doc], hashes, w.of, made, of


def _around(values: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    """Rows of width values of each run's document from SIDE pieces before its word on; 0 beyond values[begin:end] of the document."""
    docs, place = np.unique(doc, return_inverse=True)
    n = end[docs] - begin[docs]
    to = np.cumsum(n + width) - n
    flat = np.zeros(int((n + width).sum()) + width, values.dtype)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat[np.repeat(to, n) + inner] = values[np.repeat(begin[docs], n) + inner]
    return np.lib.stride_tricks.sliding_window_view(flat, width)[to[place] + word - SIDE * PIECE]


def picked(chunk: tokens.Chunk) -> tuple[np.ndarray, ...]:
    """(key, doc id, word, around, same) of a chunk's picked grams, by key, id and word.

    around: 1 to 15 for each of the SIDE * PIECE words before the gram and after it, by place; 0 where the
    document ends before; then a byte for each piece of them. same: equal, for equal keys, if all words within SIDE pieces on both sides are.
    """
    key, doc, word, hashes, words_of, made, of = _picks(chunk)
    side, n = SIDE * PIECE, np.diff(words_of)[doc]
    piece = np.maximum(tokens.mix(made[: WIDTH - PIECE] * _ODD + made[PIECE - WIDTH :]) >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    starts = np.array([PIECE * k if k < SIDE else GRAM + PIECE * k for k in range(2 * SIDE)])
    pieces = _around(piece, of[:-1], np.maximum(of[:-1], of[1:] - (PIECE - WIDTH)), doc, word, GRAM + WORDS)[:, starts]
    mixed = tokens.mix(hashes)
    short = ((mixed >> np.uint64(32)) % np.uint64(15) + np.uint64(1)).astype(np.uint8)
    near = _around(short, words_of[:-1], words_of[1:], doc, word, GRAM + WORDS)
    around = np.concatenate([near[:, :side], near[:, side + GRAM :], (pieces & np.uint16(255)).astype(np.uint8)], axis=1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    same = total[words_of[doc] + np.minimum(n, word + GRAM + side)] - total[words_of[doc] + np.maximum(0, word - side)]
    for k in range(2 * SIDE):
        same = tokens.mix(same * _ODD + pieces[:, k].astype(np.uint64))
    ids = np.asarray(chunk.column("doc_id"))[doc] if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((word, ids, key))
    return key[order], ids[order], word[order], around[order], (same >> np.uint64(32)).astype(np.uint32)[order]


def _clean(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether pieces around equal grams are equal in SIDE of a row, which is a repeat of 50 words."""
    equal = (one == two) & (one != 0)
    total = np.zeros((len(equal), 2 * SIDE + 1), np.int8)
    np.cumsum(equal, axis=1, out=total[:, 1:])
    return (total[:, SIDE:] - total[:, : SIDE + 1] == SIDE).any(axis=1)


def _folded(around: np.ndarray) -> np.ndarray:
    """Two words a byte."""
    return np.concatenate([around[:, :WORDS:2] | around[:, 1:WORDS:2] << 4, around[:, WORDS:]], axis=1)


def _unfolded(folded: np.ndarray) -> np.ndarray:
    halves = folded[:, : WORDS // 2]
    return np.concatenate([np.stack([halves & 15, halves >> 4], axis=2).reshape(len(halves), WORDS), folded[:, WORDS // 2 :]], axis=1)


def _pieces(around: np.ndarray) -> np.ndarray:
    """Each of the pieces around grams as one number, of its words' bits and its own; 0 where the document ends before."""
    words = around[:, :WORDS].reshape(len(around), 2 * SIDE, PIECE)
    out = around[:, WORDS:].astype(np.uint64) << np.uint64(4 * PIECE)
    for j in range(PIECE):
        out |= words[:, :, j].astype(np.uint64) << np.uint64(4 * j)
    out[(words == 0).any(axis=2)] = 0
    return out


def _reach(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading words that are equal, and those up to the second place where they differ if a word is changed, put in or left out."""
    size = one.shape[1]

    def first(differ: np.ndarray) -> np.ndarray:
        return np.where(differ.any(axis=1), differ.argmax(axis=1), size)

    known = (one != 0) & (two != 0)
    differ = (one != two) | ~known
    plain = first(differ)
    place = np.arange(size)
    far = first(differ & (place > plain[:, None]))
    late = place[:-1] >= plain[:, None]
    for x, y in ((one, two), (two, one)):
        far = np.maximum(far, first(((x[:, 1:] != y[:, :-1]) | (x[:, 1:] == 0) | (y[:, :-1] == 0)) & late))
    return plain, far


def _near(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether words around equal grams allow a near passage: one word changed, put in or left out, or only its ends differ."""
    side = SIDE * PIECE
    left, far_left = _reach(one[:, side - 1 :: -1], two[:, side - 1 :: -1])
    right, far_right = _reach(one[:, side:WORDS], two[:, side:WORDS])
    edited = np.maximum(far_left + right, left + far_right)
    return (GRAM + left + right >= SPAN - 1) | (GRAM + edited >= SPAN + WIDTH - 2)


def _pairs(group: np.ndarray, around: np.ndarray, sift: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of places in equal groups, which stand together: each one with all before it, back to
    the nearest that it surely repeats; if sift, only those that can be near, the group's first and then the nearest,
    until MEET of them are found. Third: the places that stopped at either with more before them."""
    place, pieces = np.arange(len(group)), _pieces(around)
    lead = np.ones(len(group), bool)
    lead[1:] = group[1:] != group[:-1]
    rank = place - np.maximum.accumulate(np.where(lead, place, 0)) if len(group) else place
    todo, out, back, stopped = place[rank > 0], [], 0, []
    met = np.zeros(len(group), np.int64)
    while len(todo):
        # The group's first at once, so that copies of one text have the same partner under all keys.
        other = todo - rank[todo] if back == 0 else todo - back
        sure = _clean(pieces[todo], pieces[other])
        meet = sure | _near(around[todo], around[other]) if sift else sure if back == 0 else np.ones(len(todo), bool)
        out.append(np.stack([todo, other])[:, meet])
        met[todo] += meet
        done = sure | (met[todo] >= MEET) if sift else sure
        stopped.append(todo[done & (rank[todo] > back + 1)])
        todo, back = todo[~done], back + 1
        todo = todo[rank[todo] >= back]
    pairs = tuple(np.concatenate(out, axis=1)) if out else (place[:0], place[:0])
    return *pairs, np.concatenate(stopped) if stopped else place[:0]


def linked(key: np.ndarray, ids: np.ndarray, word: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier) runs to align, and of runs that are the same around equal grams the first of each.

    The others are linked to that first one: they repeat its 50 words.
    """
    order = np.lexsort((word, ids, same, key))
    lead = np.ones(len(order), bool)
    lead[1:] = (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1])
    head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
    return order[~lead], head[~lead], order[lead]


def partners(key: np.ndarray, ids: np.ndarray, word: np.ndarray, around: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier) runs to align, of runs that all differ around equal grams, and those that stopped with more before them.

    In groups of up to small runs each meets all before it, in larger ones those that can be near.
    """
    order = np.lexsort((word, ids, key))
    k = key[order]
    count = np.searchsorted(k, k, "right") - np.searchsorted(k, k, "left")
    few, many = order[(count > 1) & (count <= small)], order[count > small]
    out = [[x[y] for y in _pairs(key[x], around[x], x is many)] for x in (few, many)]
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _links(ids: np.ndarray, word: np.ndarray, later: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, other, shift, first word, end word) of alignments, each once."""
    swap = (ids[later] < ids[earlier]) | ((ids[later] == ids[earlier]) & (word[later] < word[earlier]))
    at, to = np.where(swap, earlier, later), np.where(swap, later, earlier)
    doc, other, shift = ids[at], ids[to], word[at] - word[to]
    order = np.lexsort((word[at], shift, other, doc))
    order = order[(doc[order] != other[order]) | (shift[order] > 0)]
    doc, other, shift, place = doc[order], other[order], shift[order], word[at][order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])
    last = np.append(new[1:], True) if len(new) else new
    return doc[new], other[new], shift[new], np.maximum(0, place[new] - SIDE * PIECE), place[last] + GRAM + SIDE * PIECE


def _dealt(shards: int, key: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Runs as one blob for each shard of their keys."""
    shard = (tokens.mix(key) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
    return [(s, packed(*low48(key[x]), *(c[x].reshape(-1) for c in columns))) for s in np.flatnonzero(np.diff(bounds)).tolist() for x in [order[bounds[s] : bounds[s + 1]]]]


def _sides(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are known before and after the gram of each run."""
    there, half = around[:, :WORDS] != 0, WORDS // 2
    return there[:, :half].sum(axis=1).astype(np.uint8), there[:, half:].sum(axis=1).astype(np.uint8)


def _requests(shards: int):
    """A chunk's distinct runs by shard of their keys, its alignments of runs that repeat one within the chunk, and of these the runs that differ around the repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches, limit=BLOCK):
            key, ids, word, around, same = picked(chunk)
            again = np.zeros(len(key), bool)  # sure repeats of the run before in the document: periodic text is one alignment
            twin = 1 + np.flatnonzero((key[1:] == key[:-1]) & (ids[1:] == ids[:-1]))
            equal = same[twin] == same[twin - 1]
            again[twin] = equal | _clean(_pieces(around[twin]), _pieces(around[twin - 1]))
            beside = twin[again[twin] & ~equal]  # what lies around them is left to the second pass
            once, later = np.flatnonzero(~again), np.flatnonzero(again)
            one, two, first = (once[x] for x in linked(key[once], ids[once], word[once], same[once]))
            found = _links(ids, word, np.concatenate([later, one]), np.concatenate([later - 1, two]))
            blobs = _dealt(shards, key[first], ids[first], word[first].astype(np.uint32), _folded(around[first]), same[first])
            kinds = [_RUNS] * len(blobs)
            twins = _dealt(shards, key[beside], ids[beside], word[beside].astype(np.uint32), *_sides(around[beside]))
            blobs, kinds = blobs + twins, kinds + [_TWINS] * len(twins)
            if len(found[0]):
                blobs.append((int(found[0][0]) % shards, packed(*found)))
                kinds.append(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array(kinds, pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], ["shard", "kind", "data"])

    return run


def _hashed(words: np.ndarray) -> np.ndarray:
    """One hash of the words along the last axis."""
    out = np.zeros(words.shape[:-1], np.uint64)
    for k in range(words.shape[-1]):
        out = tokens.mix(out * _ODD + words[..., k].astype(np.uint64))
    return out


def _different(key: np.ndarray, ids: np.ndarray, mark: np.ndarray, word: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of runs with the same words around equal grams the first, by key, id and word; and that of each other text of its id at its place."""
    same = _hashed(words)
    order = np.lexsort((mark, word, ids, same, key))
    k, s, i, w, m = (x[order] for x in (key, same, ids, word, mark))
    lead, twin = np.ones(len(order), bool), np.zeros(len(order), bool)
    lead[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0)) if len(order) else order
    twin[1:] = m[1:] != m[:-1]
    kept = order[lead | twin & (i == i[head]) & (w == w[head])]
    return kept[np.lexsort((word[kept], ids[kept], key[kept]))]


def _asked(shards: int, wanted: bytes):
    """A chunk's different runs of keys that are asked for again, with hashes of all words around them, by shard. wanted: a bit for each bucket of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for chunk in tokens.chunks(batches, limit=BLOCK):
            key, doc, word, hashes, of, _, _ = _picks(chunk)
            bucket = key % np.uint64(BUCKETS)
            x = np.flatnonzero(bits[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            ids, mark = (np.asarray(chunk.column(n))[doc[x]] for n in ("doc_id", "mark"))
            order = np.lexsort((word[x], mark, ids, key[x]))
            x, ids, mark = x[order], ids[order], mark[order]
            short = np.maximum(tokens.mix(hashes) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
            key, word, words = key[x], word[x], _around(short, of[:-1], of[1:], doc[x], word[x], GRAM + WORDS)
            again = np.zeros(len(x), bool)
            again[1:] = (key[1:] == key[:-1]) & (ids[1:] == ids[:-1]) & (mark[1:] == mark[:-1]) & (words[1:] == words[:-1]).all(axis=1)
            once = np.flatnonzero(~again)
            once = once[_different(key[once], ids[once], mark[once], word[once], words[once])]
            blobs = _dealt(shards, key[once], ids[once], mark[once], word[once].astype(np.uint32), words[once])
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[1] for b in blobs], pa.binary())], ["shard", "data"])

    return run


def _runs(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """(key, id, word, around, same) of runs whose key another one has."""
    key = np.concatenate([join48(p[0], p[1]) for p in parts])
    ids, word = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64)
    folded, same = np.concatenate([p[4] for p in parts]).reshape(-1, WORDS // 2 + 2 * SIDE), np.concatenate([p[5] for p in parts])
    order = np.argsort(key, kind="stable")
    order = order[np.append(key[order][1:] == key[order][:-1], False) | np.append(False, key[order][1:] == key[order][:-1])]
    return key[order], ids[order], word[order], _unfolded(folded[order]), same[order]


_ALIGNED = ["doc", "other", "shift", "first", "last", "key"]
_REQUESTS = "shard long, kind int, data binary"
_ALIGNED_SCHEMA = ", ".join(f"{n} long" for n in _ALIGNED)
_PASSAGE = ["doc_id", "mark", "start_word", "end_word", "match_doc_id", "match_start_word", "similarity"]
_PASSAGES = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n in _PASSAGE)


def _met(small: int, shards: int):
    """The alignments of a shard's runs and those that chunks have found; and, with their keys, the runs that stopped with more before them.

    Such a run has its shard as other, its word as shift, and the words that are known around it from first to last.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py()) for x in group.column("data")]
        kinds = group.column("kind").to_pylist()
        out = [(*p, None) for p, k in zip(parts, kinds, strict=True) if k == _FOUND]
        runs, twins = ([p for p, k in zip(parts, kinds, strict=True) if k == kind] for kind in (_RUNS, _TWINS))

        def rest(key: np.ndarray, ids: np.ndarray, word: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
            shard, at = (tokens.mix(key) % np.uint64(shards)).astype(np.int64), word.astype(np.int64)
            out.append((ids, shard, at, at - before, at + GRAM + after, key.astype(np.int64)))

        for p in twins:
            rest(join48(p[0], p[1]), *p[2:])
        if runs:
            key, ids, word, around, same = _runs(runs)
            one, two, first = linked(key, ids, word, same)
            more, those, stopped = (first[x] for x in partners(key[first], ids[first], word[first], around[first], small))
            out.append((*_links(ids, word, np.concatenate([one, more]), np.concatenate([two, those])), None))
            if twins:  # which no run has met yet
                stopped = np.union1d(stopped, first[np.isin(key[first], np.concatenate([join48(p[0], p[1]) for p in twins]))])
            rest(key[stopped], ids[stopped], word[stopped], *_sides(around[stopped]))
        columns = [pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64), pa.int64()) for k in range(5)]
        keys = pa.chunked_array([pa.nulls(len(x[0]), pa.int64()) if x[5] is None else pa.array(x[5], pa.int64()) for x in out], pa.int64())
        return pa.table([*columns, keys], _ALIGNED)

    return run


def further(key: np.ndarray, ids: np.ndarray, word: np.ndarray, words: np.ndarray, asked: np.ndarray, held: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(run, earlier run, first word, end word, similarity): verified passages that hold all words around asked runs that any earlier run's would.

    Runs come by key, id and word. held: the first and the end word around each run that passages hold already. Those of earlier
    runs are verified, from the nearest back, until all words around the run are held; of each block
    that is verified, those that add most come first and those that add nothing are left out. So a run gives at
    most one passage for each word that was not held, however large its group is.
    """
    side = SIDE * PIECE
    known = words != 0
    bits = np.where(known, words % np.uint32(255) + np.uint32(1), 0).astype(np.uint8)
    bits = np.concatenate([bits[:, :side], bits[:, side + GRAM :]], axis=1)
    made = _hashed(np.lib.stride_tricks.sliding_window_view(words, WIDTH, axis=1)) >> np.uint64(32)
    low, high = side - known[:, :side].sum(axis=1), side + GRAM + known[:, side + GRAM :].sum(axis=1)
    origin, least = word - side, np.searchsorted(key, key, "left")
    start, stop, end = held[:, 0] - origin, held[:, 1] - origin, np.arange(len(key))
    out: list[tuple[int, int, int, int, float]] = []
    todo, back, turn = np.flatnonzero(asked), 4, 0
    while len(todo := todo[(end[todo] > least[todo]) & ((start[todo] > low[todo]) | (stop[todo] < high[todo]))]):
        if back <= BACK // 4 or not turn % 16:
            todo = todo[_open(least.astype(np.uint64), made, todo, low[todo], start[todo], stop[todo], high[todo])]
        begin, turn = np.maximum(least[todo], end[todo] - back), turn + 1
        for one, two in _in_batches(todo, begin, end[todo]):
            adds = _adds(made[one], made[two], low[one], start[one], stop[one], high[one]) & ((ids[one] != ids[two]) | (word[two] < word[one]))
            one, two = one[adds], two[adds]
            near = _near(bits[one], bits[two])
            one, two = one[near], two[near]
            from_ = np.maximum(low[one], low[two])
            n = np.maximum(np.minimum(high[one], high[two]) - (WIDTH - 1) - from_, 0)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - from_, n)
            which, s, e, share = matched(made[np.repeat(one, n), at], made[np.repeat(two, n), at], n)
            s, e, u, v = s + from_[which], e + from_[which] + WIDTH - 1, one[which], two[which]
            gains = np.flatnonzero((s < start[u]) | (e > stop[u]))
            gains = gains[np.argsort(u[gains], kind="stable")]
            for of in np.split(gains, np.flatnonzero(np.diff(u[gains])) + 1) if len(gains) else ():
                w = int(u[of[0]])
                while (gain := np.maximum(start[w] - s[of], 0) + np.maximum(e[of] - stop[w], 0)).max() > 0:
                    best = of[int(gain.argmax())]
                    out.append((w, int(v[best]), int(origin[w] + s[best]), int(origin[w] + e[best]), float(share[best])))
                    start[w], stop[w] = min(start[w], s[best]), max(stop[w], e[best])
        end[todo], back = begin, min(BACK, 4 * back)
    return out


def _in_batches(of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each place and those in its range [begin, end), about AT_ONCE at a time, with all of a place together."""
    n = end - begin
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE)) + 1
    for x in np.split(np.arange(len(of)), cuts):
        inner = np.arange(n[x].sum()) - np.repeat(np.cumsum(n[x]) - n[x], n[x])
        yield np.repeat(of[x], n[x]), np.repeat(begin[x], n[x]) + inner


def _beyond(size: int, low: np.ndarray, start: np.ndarray, stop: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of shingles of runs [low, high) that are not all within the words held, [start, stop)."""
    place = np.arange(size)
    return (place >= low[:, None]) & (place + WIDTH <= high[:, None]) & ((place < start[:, None]) | (place + WIDTH > stop[:, None]))


def _open(group: np.ndarray, made: np.ndarray, todo: np.ndarray, *bounds: np.ndarray) -> np.ndarray:
    """Which of the runs todo have a shingle not held that an earlier run of their group has too, at its place or one beside it; no run is compared with each."""
    beyond, out, size = _beyond(made.shape[1], *bounds), np.zeros(len(todo), bool), made.shape[1]
    for place in range(size if len(todo) else 0):
        value, first = np.unique(tokens.mix(made[:, place] * _ODD + group), return_index=True)
        for at in range(max(0, place - 1), min(size, place + 2)):
            x = np.flatnonzero(beyond[:, at] & ~out)
            mine = tokens.mix(made[todo[x], at] * _ODD + group[todo[x]])
            spot = np.minimum(np.searchsorted(value, mine), len(value) - 1)
            out[x] = (value[spot] == mine) & (first[spot] < todo[x])
    return out


def _adds(mine: np.ndarray, other: np.ndarray, *bounds: np.ndarray) -> np.ndarray:
    """Whether shingles of runs that are not held stand in other runs too, at their place or one beside it."""
    same = mine == other
    same[:, 1:] |= mine[:, 1:] == other[:, :-1]
    same[:, :-1] |= mine[:, :-1] == other[:, 1:]
    return (same & _beyond(mine.shape[1], *bounds)).any(axis=1)


def _rest(group: pa.Table, asked: pa.Table) -> pa.Table:
    """The verified passages that asked runs of a shard share with earlier ones, beyond the words that are held."""
    rows: list[tuple] = []
    if group.num_rows and asked.num_rows:
        parts = [unpacked(x.as_py()) for x in group.column("data")]
        key = np.concatenate([join48(p[0], p[1]) for p in parts])
        ids, mark, word = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (2, 3, 4))
        words = np.concatenate([p[5] for p in parts]).reshape(len(key), GRAM + WORDS)
        x = np.flatnonzero(np.isin(key, asked.column("key").to_numpy().astype(np.uint64)))
        x = x[_different(key[x], ids[x], mark[x], word[x], words[x])]
        key, ids, mark, word, words = key[x], ids[x], mark[x], word[x], words[x]
        names = {n[:3]: n[3:] for n in zip(*(asked.column(n).to_pylist() for n in ("key", "doc", "shift", "held_from", "held_to")), strict=True)}
        spans = [names.get(n) for n in zip(key.tolist(), ids.tolist(), word.tolist(), strict=True)]
        held = np.array([n or (0, 0) for n in spans], np.int64).reshape(-1, 2)
        for u, v, start, end, share in further(key, ids, word, words, np.array([n is not None for n in spans], bool), held):
            rows.append((int(ids[u]), int(mark[u]), start, end, int(ids[v]), start - int(word[u] - word[v]), share))
    kinds = [pa.int64()] * 6 + [pa.float64()]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _PASSAGE)


def _spans(met: DataFrame) -> DataFrame:
    """Alignments, each once, with the tokens [lo, hi) of doc and those of other that they need."""
    down = F.greatest(F.lit(0), F.floor((F.col("lo") - F.col("shift") - MARGIN) / GRID) * GRID).cast("long")
    up = (F.ceil((F.col("hi") - F.col("shift") + MARGIN) / GRID) * GRID).cast("long")
    once = met.groupBy("key", "doc", "other", "shift").agg(F.min("first").alias("lo"), (F.max("last") - (WIDTH - 1)).alias("hi"))
    return once.withColumns({"o_from": down, "o_to": up})


def _shards(texts: DataFrame) -> int:
    return max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD))


def _found(texts: DataFrame, shards: int) -> DataFrame:
    return texts.mapInArrow(_requests(shards), _REQUESTS).groupBy("shard").applyInArrow(_met(SMALL, shards), _ALIGNED_SCHEMA)


def alignments(texts: DataFrame) -> DataFrame:
    """(doc, other, shift, lo, hi): tokens [lo, hi) of doc may repeat those of other, earlier or the same, at lo - shift; of the first pass. texts: doc_id, text."""
    return _spans(_found(texts, _shards(texts))).where("key IS NULL").select("doc", "other", "shift", "lo", "hi")


def _parts(found: DataFrame, *by: str) -> DataFrame:
    """Passages with the number of their part: those that overlap or touch are one part."""
    order = Window.partitionBy(*by).orderBy("start_word")
    reached = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    edge = found.withColumn("new", F.coalesce(F.col("start_word") > reached, F.lit(True)).cast("int"))
    return edge.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _unheld(stopped: DataFrame, found: DataFrame) -> DataFrame:
    """Runs that stopped with more before them of which passages found in their document do not hold all words around, with what these hold there."""
    here = found.join(stopped.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    parts = _parts(here, "doc_id", "mark")
    whole = parts.groupBy("doc_id", "mark", "part").agg(F.min("start_word").alias("start"), F.max("end_word").alias("end"))
    single = here.groupBy("doc_id").agg(F.countDistinct("mark").alias("n")).where("n = 1").select("doc_id")
    whole = whole.join(single, "doc_id")
    word, until = F.col("shift"), F.col("hi") + (WIDTH - 1)
    there = stopped.join(whole, (F.col("doc_id") == F.col("doc")) & (F.col("start") <= word) & (F.col("end") >= word + GRAM), "left")
    there = there.withColumns({"held_from": F.coalesce("start", word + GRAM), "held_to": F.coalesce("end", word)})
    return there.where((F.col("held_from") > F.col("lo")) | (F.col("held_to") < until)).select(*stopped.columns, "held_from", "held_to")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of each document's tokens (32 bits of each): for its own alignments, and for those of later documents to it."""
    names = ["own", "other", "o_from", "o_to", "doc", "mark", "shift", "lo", "hi", "base", "tokens"]
    for chunk in tokens.chunks(batches):
        w = tokens.words(chunk)
        made, of = tokens.shingles(tokens.word_hashes(chunk, w), w.of, WIDTH)
        made = (made >> np.uint64(32)).astype(np.uint32).view(np.int32)
        rows: list[tuple] = []
        parts: list[np.ndarray] = []
        ids, marks = chunk.column("doc_id").to_pylist(), chunk.column("mark").to_pylist()
        for d, (own, theirs) in enumerate(zip(chunk.column("own").to_pylist(), chunk.column("theirs").to_pylist(), strict=True)):
            mine = made[of[d] : of[d + 1]]
            for p in own or ():
                base = max(0, p["lo"] - MARGIN)
                rows.append((True, p["other"], p["o_from"], p["o_to"], ids[d], marks[d], p["shift"], p["lo"], p["hi"], base))
                parts.append(mine[base : p["hi"] + MARGIN])
            for p in theirs or ():
                rows.append((False, ids[d], p["o_from"], p["o_to"], 0, 0, 0, 0, 0, p["o_from"]))
                parts.append(mine[p["o_from"] : p["o_to"]])
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        kinds = [pa.bool_()] + [pa.int64()] * 9
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names)


def _since(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by token, and for each place the first window of SPAN tokens, by its start, whose first such token stands there: from there to the place itself it does."""
    order, place = np.argsort(token, kind="stable"), np.arange(len(token))
    before = np.full(len(token), -1)
    twin = 1 + np.flatnonzero(token[order[1:]] == token[order[:-1]])
    before[order[twin]] = order[twin - 1]
    return order, np.maximum(np.maximum(before + 1, place - SPAN + 1), first)


def _counted(start: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges [start, last] hold each of n places."""
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n]


def _by_sets(own: np.ndarray, theirs: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (their first tokens, similarities) of pairs of token arrays own[begin:begin + size] of which the sets are near.

    The places of a token give ranges of windows that do not overlap, on both sides; where two of them meet, both sets have it.
    """
    pair, of = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)])
    place, first = np.arange(len(pair)), of[pair]
    at = begin[pair] + place - first
    mine, others = ((pair.astype(np.uint64) << np.uint64(32)) | x[at].astype(np.uint32).astype(np.uint64) for x in (own, theirs))
    (_, since), (order, theirs_since) = _since(mine, first), _since(others, first)
    ranked = others[order]
    a, b = np.searchsorted(ranked, mine, "left"), np.searchsorted(ranked, mine, "right")
    ordered = np.searchsorted(ranked, ranked, "left") << 32 | order  # by token and place
    low = np.searchsorted(ordered, a << 32 | since)
    hits = np.where(a < b, np.minimum(np.searchsorted(ordered, a << 32 | place) + 1, b) - low, 0)
    i = np.repeat(place, hits)
    j = order[np.arange(len(i)) + np.repeat(low - (np.cumsum(hits) - hits), hits)]
    start, last = np.maximum(since[i], theirs_since[j]), np.minimum(i, j)
    meet = start <= last
    both = _counted(start[meet], last[meet], len(pair))
    share = both / np.maximum(_counted(since, place, len(pair)) + _counted(theirs_since, place, len(pair)) - both, 1)
    good = np.flatnonzero((share >= SIMILARITY) & (place + SPAN <= of[1:][pair]))
    return at[good], share[good]


def matched(own: np.ndarray, theirs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, first token, end token, similarity) of verified passages of pairs of aligned token arrays, which stand one after another with the given sizes.

    Windows anywhere in the arrays are verified by aligned equal tokens; where none is good enough, windows at
    the same place are compared as sets, for words that were put in or left out. The similarity is that of the best window.
    """
    of = np.concatenate([[0], np.cumsum(size)])
    pair, place = np.repeat(np.arange(len(size)), size), np.arange(len(own))
    equal = own == theirs
    total = np.concatenate([[0], np.cumsum(equal), np.zeros(SPAN, np.int64)])
    held = np.where(place + SPAN <= of[1:][pair], total[place + SPAN] - total[place], 0)
    good = np.flatnonzero(held >= NEED)
    new = np.ones(len(good), bool)
    new[1:] = (pair[good[1:]] != pair[good[:-1]]) | (np.diff(good) > SPAN)
    lead = np.flatnonzero(new)
    start, last = good[lead], good[np.append(lead[1:], len(good)) - 1] if len(lead) else good
    most = np.maximum.reduceat(held[good], lead) if len(lead) else good
    spots = np.flatnonzero(equal)
    first, end = spots[np.searchsorted(spots, start)], spots[np.searchsorted(spots, last + SPAN) - 1] + 1
    out = [(pair[start], first - of[:-1][pair[start]], end - of[:-1][pair[start]], most / (2 * SPAN - most))]
    left = np.ones(len(size), bool)
    left[pair[start]] = False
    left = np.flatnonzero(left & (size >= SPAN))
    if len(left):
        start, share = _by_sets(own, theirs, of[left], size[left])
        new = np.ones(len(start), bool)
        new[1:] = (pair[start[1:]] != pair[start[:-1]]) | (np.diff(start) > SPAN)
        lead = np.flatnonzero(new)
        if len(lead):
            one, last = start[lead], start[np.append(lead[1:], len(start)) - 1]
            out.append((pair[one], one - of[:-1][pair[one]], last + SPAN - of[:-1][pair[one]], np.maximum.reduceat(share, lead)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(k, AT_ONCE) for k in range(0, whole.num_rows, AT_ONCE)):
            doc, mark, other, shift, base, there = (np.asarray(batch.column(k)) for k in ("doc", "mark", "other", "shift", "base", "o_from"))
            own, theirs = batch.column("tokens"), batch.column("o_tokens")
            a, b = np.asarray(own.offsets), np.asarray(theirs.offsets)
            lo = np.maximum(base, there + shift)
            n = np.maximum(np.minimum(base + np.diff(a), there + shift + np.diff(b)) - lo, 0)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = np.asarray(own.values)[np.repeat(a[:-1] + lo - base, n) + inner]
            pair, s, e, share = matched(mine, np.asarray(theirs.values)[np.repeat(b[:-1] + lo - shift - there, n) + inner], n)
            start = lo[pair] + s
            columns = [doc[pair], mark[pair], start, lo[pair] + e + WIDTH - 1, other[pair], start - shift[pair]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(share, pa.float64())], _PASSAGE)


def _passages(texts: DataFrame, aligned: DataFrame) -> DataFrame:
    """The verified passages of alignments."""
    own = aligned.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("other", "shift", "lo", "hi", "o_from", "o_to")).alias("own"))
    theirs = aligned.select(F.col("other").alias("id"), "o_from", "o_to").distinct().groupBy("id").agg(F.collect_list(F.struct("o_from", "o_to")).alias("theirs"))
    asked = own.join(theirs, "id", "full").hint("merge")  # the lists grow with the corpus: never a broadcast
    held = texts.join(asked, texts.doc_id == asked.id).select("doc_id", "text", F.xxhash64("text").alias("mark"), "own", "theirs")
    slices = held.mapInArrow(
        _slices, "own boolean, other long, o_from long, o_to long, doc long, mark long, shift long, lo long, hi long, base long, tokens array<int>"
    )
    later = slices.where("own").drop("own")
    earlier = slices.where("NOT own").select("other", "o_from", "o_to", F.col("tokens").alias("o_tokens"))
    pairs = later.join(earlier, ["other", "o_from", "o_to"])
    return pairs.mapInArrow(_verified, _PASSAGES)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified passages: (doc_id, mark, start_word, end_word, match_doc_id, match_start_word, similarity).

    mark is a hash of the text that the passage stands in; words count from 0, the end is exclusive.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    shards = _shards(texts)
    aligned = written(_spans(_found(texts, shards)), "alignments")
    first = written(_passages(texts, aligned.where("key IS NULL")), "passages")
    unheld = written(_unheld(aligned.where("key IS NOT NULL"), first), "unheld")
    buckets = unheld.select(F.pmod("key", F.lit(BUCKETS)).alias("bucket")).distinct().toArrow()  # BUCKETS numbers at most
    if not buckets.num_rows:
        return first
    wanted = np.zeros(BUCKETS, bool)
    wanted[buckets.column("bucket").to_numpy()] = True
    runs = texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_asked(shards, np.packbits(wanted, bitorder="little").tobytes()), "shard long, data binary")
    rest = runs.groupBy("shard").cogroup(unheld.groupBy("other")).applyInArrow(_rest, _PASSAGES)
    by = ["doc_id", "mark", "match_doc_id", "shift"]
    parts = _parts(rest.withColumn("shift", F.col("start_word") - F.col("match_start_word")), *by)  # of the runs of one alignment
    whole = parts.groupBy(*by, "part").agg(*(f(n).alias(n) for f, n in ((F.min, "start_word"), (F.max, "end_word"), (F.min, "match_start_word"), (F.max, "similarity"))))
    return first.unionByName(whole.select(*first.columns)).distinct()


def _without(schema_names: list[str], cuts_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches):
            cuts = chunk.column(cuts_name).to_pylist()
            texts: list[str | None] = chunk.column("text").to_pylist()
            keep = np.ones(chunk.n, bool)
            if any(cuts):
                w = tokens.words(chunk)
                for d in [d for d, c in enumerate(cuts) if c]:
                    first, n = int(w.of[d]), int(w.of[d + 1] - w.of[d])
                    gone = np.zeros(n + 1, np.int64)
                    for c in cuts[d]:
                        gone[c["start_word"]] += 1
                        gone[min(c["end_word"], n)] -= 1
                    gone = np.cumsum(gone)[:n] > 0
                    keep[d] = not gone.all()
                    begin, end = int(chunk.offsets[d]), int(chunk.offsets[d + 1])
                    bounds = np.append(w.starts[first : first + n], end)
                    parts = [chunk.raw[begin : bounds[0]]] + [chunk.raw[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~gone).tolist()]
                    texts[d] = np.concatenate(parts).tobytes().decode("utf-8", "replace").rstrip()
            out = {name: chunk.column(name) for name in schema_names}
            out["text"] = pa.array(texts, out["text"].type)
            if "n_chars" in out:
                sizes = out["n_chars"].to_pylist()
                out["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(texts, cuts, sizes, strict=True)], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[n] for n in schema_names], schema_names).filter(pa.array(keep))

    return run


def cut(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others, maybe n_chars) without passages that an earlier document or place holds.

    A document of which no word is left goes. Whatever has no such passage stays as it is.
    """
    cuts = unused("_cuts", docs.columns)
    found = repeats(docs).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start_word", "end_word")).alias(cuts))
    joined = docs.join(found, (docs["doc_id"] == found["doc_id"]) & (F.xxhash64(docs["text"]) == found["mark"]), "left")
    joined = joined.select(*[docs[c] for c in docs.columns], found[cuts])
    return joined.mapInArrow(_without(docs.columns, cuts), docs.schema)
