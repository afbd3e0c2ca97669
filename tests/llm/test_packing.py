import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import empty_docs, hard_docs, prose
from veritrail.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_tokenizers_library(text):
    assert packing.encoder(PATH).ids(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids


def test_ids_of_spelled_out_tokens_and_odd_spaces():
    for text in ("a <|endoftext|> b", "   \t\n\r\x0b x", "don't DON'T it's", "漢字 ﬁ 🙂‍🙂", "1234 ١٢٣ ²", "\u0085  x"):
        assert packing.encoder(PATH).ids(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids, text


def test_cutting_leaves_full_pieces_after_the_first():
    for n in (1, 2, 1023, 1024, 1025, 2048, 5000):
        pieces = packing.cut(n)
        assert sum(k for _, k in pieces) == n and all(k == 1024 for _, k in pieces[1:]) and 1 <= pieces[0][1] <= 1024
        assert [s for s, _ in pieces] == list(itertools.accumulate([0] + [k for _, k in pieces[:-1]]))


def used(runs):
    out = {}
    for filling, times in runs:
        for x in filling:
            out[x] = out.get(x, 0) + times
    return out


def optimum(lengths, capacity):
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= lengths[k] and bins[i] not in bins[:i]:
                bins[i] -= lengths[k]
                go(k + 1, bins)
                bins[i] += lengths[k]
        go(k + 1, [*bins, capacity - lengths[k]])

    lengths.sort(reverse=True)
    go(0, [])
    return best


def test_packing_reaches_the_optimum_of_small_cases():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice((10, 20, 37))
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 11))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        runs = packing.pack(histogram, capacity)
        assert used(runs) == histogram and all(sum(f) <= capacity for f, _ in runs)
        assert sum(m for _, m in runs) == optimum(lengths, capacity)


def test_packing_of_large_histograms_is_near_the_bound():
    rng = random.Random(2)
    for kind in (lambda: rng.randrange(1, 1024), lambda: rng.choice((342, 343, 600)), lambda: rng.randrange(300, 700)):
        histogram = {}
        for _ in range(20_000):
            x = kind()
            histogram[x] = histogram.get(x, 0) + 1
        runs = packing.pack(histogram)
        assert used(runs) == histogram and all(sum(f) <= 1024 for f, _ in runs)
        bound = max(-(-sum(k * n for k, n in histogram.items()) // 1024), sum(n for k, n in histogram.items() if k > 512))
        fit = packing._best_fit(np.array([histogram.get(k, 0) for k in range(1025)]), 1024)
        assert used(fit) == histogram and bound <= sum(m for _, m in runs) <= sum(m for _, m in fit)


def test_every_document_comes_back_from_its_pieces(spark):
    extra = [(100 + i, prose(i, 3 + 40 * i), "en", "s", 1) for i in range(60)]
    df = hard_docs(spark, extra)
    rows = packing.packed(df, PATH).collect()
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(itertools.accumulate([0] + [n for _, n in p[:-1]])) and sum(n for _, n in p) <= 1024
    expected = {}
    for r in df.collect():
        ids = np.array([*EXACT.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.setdefault(r.doc_id, []).extend((k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids))))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    total = sum(n for v in expected.values() for _, _, n, _ in v)
    assert len(places) <= -(-total // 1024) + 2
    assert packing.packed(empty_docs(spark), PATH).count() == 0
