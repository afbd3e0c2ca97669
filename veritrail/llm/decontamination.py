"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by size: class s holds items of up to 2**s shingles. For a class a document is seen as
windows of 2**(s + 1) shingles, one every 2**s, so that any passage of an item's size lies whole in a window
and their Jaccard similarity is at least 0.19 at containment 0.8. An item and a window are a candidate pair
if any of HASHES min-hashes agrees (a miss has a chance below 2e-6), and a candidate counts only if the
document holds at least THRESHOLD of the item's distinct shingles, exactly counted over the whole document.

A min-hash that agrees is one shingle that stands in both, so only windows with a shingle that is some item's
minimum are hashed at all; the others could not collide. Items are the stated query set: they go to
the executors in blocks of about BLOCK shingles, each block against all documents.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a shingle is WIDTH words, and
an item of fewer words is one shingle of all its words. Defined cases: null or empty texts and items without
words match nothing; repeated documents each get their rows, repeated items (equal id and text) are one; null
ids come back as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import tokens

WIDTH, THRESHOLD, HASHES, BLOCK = 5, 0.8, 64, 1_000_000
_SEEDS = tokens.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tokens.chunks(batches):
        w = tokens.words(chunk)
        hashes = tokens.word_hashes(chunk, w)
        widths, sets = [], []
        for a, b in zip(w.of[:-1], w.of[1:], strict=True):
            k = min(WIDTH, int(b - a))
            made = tokens.shingles(hashes[a:b], np.array([0, b - a]), k)[0] if k else np.zeros(0, np.uint64)
            widths.append(k)
            sets.append(np.unique(made).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([chunk.column("item_id"), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "width", "shingles"])


class Items:
    """A block of items of one shingle width, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = [i for i, _ in rows]
        self.sets = [np.array(s, np.int64).view(np.uint64) for _, s in rows]
        self.classes = [max(0, (len(s) - 1).bit_length()) for s in self.sets]
        hashed = [tokens.mix(s[None, :] ^ _SEEDS[:, None]) for s in self.sets]
        self.signatures = [h.min(axis=1) for h in hashed]
        owners: dict[int, list[int]] = {}
        for k, (s, h) in enumerate(zip(self.sets, hashed, strict=True)):
            for v in np.unique(s[h.argmin(axis=1)]).tolist():
                owners.setdefault(v, []).append(k)
        self.owners = owners
        self.minima = np.array(sorted(owners), np.uint64)
        bits = max(16, int(32 * len(self.minima)).bit_length())
        self.low = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.minima & self.low).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that are some item's minimum."""
        maybe = np.flatnonzero(self.seen[(shingles & self.low).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.minima, shingles[maybe]), len(self.minima) - 1)
        return maybe[self.minima[at] == shingles[maybe]]

    def found(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the document holds) of each item in a document."""
        windows: dict[tuple[int, int], set[int]] = {}
        for p in hits.tolist():
            for k in self.owners[int(shingles[p])]:
                s = self.classes[k]
                for w in {p >> s, max(0, (p >> s) - 1)}:
                    windows.setdefault((s, w), set()).add(k)
        candidates: set[int] = set()
        for (s, w), items in windows.items():
            items = items - candidates
            if items:
                part = shingles[w << s : (w << s) + (2 << s)]
                signature = tokens.mix(part[None, :] ^ _SEEDS[:, None]).min(axis=1)
                candidates |= {k for k in items if np.any(self.signatures[k] == signature)}
        if not candidates:
            return []
        held = np.unique(shingles)
        counts = [(k, len(self.sets[k]), int(np.isin(self.sets[k], held, assume_unique=True).sum())) for k in sorted(candidates)]
        return [(k, n, c) for k, n, c in counts if c >= THRESHOLD * n]


def _matches(chunk: tokens.Chunk, blocks: dict[int, Items]) -> Iterator[tuple[int, int, int, int]]:
    """(document's place in the chunk, item id, its shingles, those found)."""
    w = tokens.words(chunk)
    hashes = tokens.word_hashes(chunk, w)
    for width, block in blocks.items():
        made, of = tokens.shingles(hashes, w.of, width)
        hits = block.hits(made)
        if not len(hits):
            continue
        bounds = np.searchsorted(hits, of)
        for d in np.flatnonzero(np.diff(bounds)).tolist():
            for k, n, c in block.found(made[of[d] : of[d + 1]], hits[bounds[d] : bounds[d + 1]] - of[d]):
                yield d, block.ids[k], n, c


def _searched(blocks: dict[int, Items]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches):
            found = list(_matches(chunk, blocks))
            columns = [pa.array([row[k] for row in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").take(columns[0]), *columns[1:]], ["doc_id", "item_id", "n_shingles", "n_found"])

    return run


def _kept(blocks: dict[int, Items], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tokens.chunks(batches, text):
            keep = np.ones(chunk.n, bool)
            for d, *_ in _matches(chunk, blocks):
                keep[d] = False
            yield chunk.batch.slice(chunk.first, chunk.n).filter(pa.array(keep))

    return run


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[dict[int, Items]]:
    """The stated items in blocks of about BLOCK shingles, by shingle width; at least one block, maybe empty."""
    stated = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    stated = stated.mapInArrow(_item_batches, "item_id long, width int, shingles array<long>").where("width > 0").distinct()
    total = stated.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    for b in range(blocks):
        by_width: dict[int, list] = {}
        for r in stated.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).toLocalIterator():
            by_width.setdefault(r.width, []).append((r.item_id, r.shingles))
        yield {k: Items(v) for k, v in by_width.items()}


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each document that holds a benchmark item."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text):
        made = picked.mapInArrow(_searched(block), "doc_id long, item_id long, n_shingles long, n_found long")
        out = made if out is None else out.unionByName(made)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, as they are and without a shuffle: one pass for each block."""
    for block in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(_kept(block, text), docs.schema)
    return docs
