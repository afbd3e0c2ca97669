"""Alignment of two tokenizers against a plain walk over all pairs of tokens."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import empty_docs, hard_docs
from veritrail.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_spans(text):
    """((id, start, end), ...) of A and of B, or two empty lists."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    raw = [base64.b64decode(line.split()[0]) for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")]
    pieces = [(i, raw[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if not text or any(b"".join(p for _, p in side) != (" " + text).encode() for side in pieces):
        return [], []
    out = []
    for side in pieces:
        at, spans = 0, []
        for i, p in side:
            spans.append((i, at, at + len(p)))
            at += len(p)
        out.append(spans)
    return out


def brute(texts):
    spans = [token_spans(t or "") for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in spans]
    count = Counter(p for one in links for p in one)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for (a, b), one in zip(spans, links, strict=True):
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for high in shared:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= high) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= high))
            low = high
        out.append((len(a), len(b), len(shared), len(one), sum(count[p] == most[p[1]] for p in one), sum(count[p] for p in one), ";".join(groups)))
    return out


TEXTS = [
    "The quick brown fox, naïve café; 漢字 and 😀 emoji's.", "a", " leading", "two  spaces and\ttabs\n\nlines", "<|endoftext|> and <s> are plain </s>", None, "", "▁ is no space", "ﬁnal ﬂow",
    "supercalifragilistic " * 9, "The quick brown fox, naïve café; 漢字 and 😀 emoji's.", "\u0000nul", "12345678901234567890", " ", "\n",
]


@pytest.mark.parametrize(("step", "frequent"), [(1 << 18, 1 << 18), (5, 7), (1, 0), (16, 50)])
def test_alignment_is_that_of_all_pairs(spark, step, frequent):
    """Whole documents and pieces of a few steps, frequent pairs and pairs joined, give the same."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = sorted(tuple(r) for r in alignment.aligned(docs, A, B, step=step, frequent=frequent).collect())
    assert [r[1:] for r in rows] == brute(TEXTS)


def test_diagonals_cut_the_merge_evenly():
    import numpy as np

    a, b = np.array([1, 4, 4 + 3, 9, 12]), np.array([4, 5, 9, 12])
    i, j = alignment.diagonals(a, b, 2)
    merged = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
    for d, x, y in zip([0, 2, 4, 6, 8, 9], i, j, strict=True):
        assert (x, y) == (sum(s == 0 for _, s in merged[:d]), sum(s == 1 for _, s in merged[:d]))


def test_pairs_count_links_of_all_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    cut = alignment.pieces(docs, A, B)
    count = Counter((x[0], y[0]) for t in TEXTS for a, b in [token_spans(t or "")] for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    assert {(r["a"], r["b"]): r["n"] for r in alignment.counts(cut, A, B).collect()} == dict(count)


def test_hard_documents(spark):
    rows = alignment.aligned(hard_docs(spark), A, B, carried=lambda g: F.sha2(g, 256)).collect()
    assert len(rows) == 10
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_a"] == 0 and r["groups"] == hashlib.sha256(b"").hexdigest() for i in (2, 3) for r in by_id[i])
    assert by_id[5][0]["n_links"] == by_id[5][0]["n_a"] + by_id[5][0]["n_b"] - by_id[5][0]["n_groups"] > 60_000
    assert len(by_id[6]) == 2 and by_id[6][0] == by_id[6][1]
    assert len(by_id[None]) == 2
    assert alignment.aligned(empty_docs(spark), A, B).collect() == []
