"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is 64 bits over all 3-word shingles. Fingerprints within RADIUS bits are found by structured
masks: bit i gets a vector m(i) of RADIUS + 1 bits, not zero, and for each of the 2**(RADIUS + 1) - 1 vectors
v the table v keeps the bits with odd m(i)·v. RADIUS differing bits span too little to meet every v, so
some table drops them all and the pair collides there: no pair within the radius is missed.

Equal fingerprints are one class from the start. A bucket of up to SMALL classes is compared in place and
gives its true links only. In a larger bucket each class emits itself and its one-bit neighbours among the
bits that the table drops: two classes share such a centre if and only if they differ in at most two bits,
and a centre has at most 65 members, so the work stays in proportion to the classes, whatever the bucket.

Defined cases: texts that are null, empty or without words have fingerprint zero and link like any other; fewer
words than a shingle are one shingle; repeated rows stay; a null id gets a row and never becomes a component's
id (the component of only null ids is null); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import tokens
from veritrail.llm.common import components, written

BITS, RADIUS, SHINGLE, SEED, SMALL = 64, 2, 3, 42, 24
_LANES = np.uint64(0x0101010101010101)


def masks() -> list[int]:
    """For each vector v the signed 64-bit mask of the bits that its table keeps."""
    vectors = [i % (2 ** (RADIUS + 1) - 1) + 1 for i in range(BITS)]
    out = []
    for v in range(1, 2 ** (RADIUS + 1)):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _joined(chunk: tokens.Chunk, w: tokens.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and each word's span there."""
    sizes = w.ends - w.starts
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(w) else 0, 0x20, np.uint8)
    inside = np.zeros(len(chunk.low) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = chunk.low[mask]
    return out.tobytes(), ends - sizes, ends


def fingerprints(chunk: tokens.Chunk) -> np.ndarray:
    """The 64-bit fingerprint of each document of a chunk."""
    w = tokens.words(chunk, tokens.SPACED)
    text, starts, ends = _joined(chunk, w)
    counts = w.counts()
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(bounds[-1]) + np.repeat(w.of[:-1] - bounds[:-1], made)
    last = at + np.repeat(np.minimum(counts, SHINGLE) - 1, made)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(at))
    out = np.zeros(chunk.n, np.uint64)
    some = np.flatnonzero(made)
    if not len(some):
        return out
    half = made[some]
    for j in range(8):
        lanes = ((h >> np.uint64(j)) & _LANES).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes, bounds[:-1][some], axis=0, dtype=np.int64)
        set_bits = (2 * sums > half[:, None]).astype(np.uint64)
        for byte in range(8):
            out[some] |= set_bits[:, byte] << np.uint64(8 * byte + j)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tokens.chunks(batches):
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(fingerprints(chunk).view(np.int64))], ["doc_id", "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct fingerprints within RADIUS bits. classes: fp, each once.

    Not every such pair is a row, but the rows connect just the fingerprints that those pairs connect.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept"), F.lit(~m).alias("free")) for k, m in enumerate(masks())])
    keyed = classes.select("fp", F.inline(tables))
    sizes = keyed.groupBy("k", "kept").count().where("count > 1")
    keyed = keyed.join(sizes, ["k", "kept"])
    bucket = keyed.where(F.col("count") <= SMALL).groupBy("k", "kept").agg(F.collect_list("fp").alias("fps"))
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= RADIUS
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda a, i: F.transform(F.filter("fps", lambda b, j: (j > i) & near(a, b)), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))),
        )
    )
    small = bucket.select(F.inline(pairs))
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("free", i) == 1),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    centres = (
        keyed.where(F.col("count") > SMALL)
        .select("k", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("centre"))
        .groupBy("k", "centre")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    large = centres.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return small.unionByName(large).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = written(fingerprint_table(docs, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(classes.select("fp")))
    placed = classes.join(rooted, classes.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = written(placed.select("fp", "root").join(ids, "root").select(F.col("fp").alias("class_fp"), "component_id"), "components")
    return prints.join(labelled, prints.fp == labelled.class_fp).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least id.

    Rows of one id are one document, of which one row stays. Documents with a null id all stay.
    """
    found = groups(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
