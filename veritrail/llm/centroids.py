"""Centroid clustering on bit planes: distances are exact integers made of weighted popcounts.

Each component becomes the integer floor(SCALE * x) less the least of all. Plane i of a vector is one
unsigned 64-bit word of the i-th bits of its 64 components, so that a dot product of two vectors is the sum of
2^(i + j) * popcount(plane i of one AND plane j of the other), and a squared distance is two squares less twice the
dot product. Taking the same number off all components leaves distances as they are. The planes are packed once
and written; each round reads that table, a third of the vectors' size or less, and sends on one sum for each
centroid and task. The driver holds the centroids alone: k vectors of 64 integers.

Defined cases: vectors that are null, have another number of components, or hold a null, a non-finite one or one of
2^23 or more in size take no part and have no row. A null id is assigned like any other, but starts no centroid.
Repeated rows each get their row and their weight. With fewer than k vectors there are as many centroids as
vectors; of an empty table nothing. A distance beyond a long counts as the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import dropped, written

WIDTH, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Sizes of components from which a vector takes no part; vectors handled at once in a task.
LARGEST, STEP = 1 << 23, 4096
#: Planes up to which every distance fits a long.
SAFE = 28
MOST = np.iinfo(np.int64).max


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    named = named.where((F.size("x") == WIDTH) & F.forall("x", fits))
    return named.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))


def planes_of(u: np.ndarray, bits: int) -> np.ndarray:
    """The bit planes, (n, bits) words, of (n, WIDTH) integers from 0 to 2^bits - 1."""
    out = np.empty((len(u), bits), np.uint64)
    for i in range(bits):
        out[:, i] = np.packbits((u >> i & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def integers_of(planes: np.ndarray) -> np.ndarray:
    """The (n, WIDTH) integers of bit planes."""
    out = np.zeros((len(planes), WIDTH), np.int64)
    for i in range(planes.shape[1]):
        words = np.ascontiguousarray(planes[:, i], "<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(words, axis=1, bitorder="little").astype(np.int64) << i
    return out


def _popcounts(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each weight 2^s the popcounts that it multiplies, of a's rows with b's rows (aligned by broadcasting)."""
    bits = a.shape[-1]
    for s in range(2 * bits - 1):
        yield s, sum(np.bitwise_count(a[..., i] & b[..., s - i]).astype(np.uint16) for i in range(max(0, s - bits + 1), min(s, bits - 1) + 1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products, modulo 2^64, of planes a with planes b."""
    return sum(c.astype(np.uint64) << np.uint64(s) for s, c in _popcounts(a, b))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) squared distances between the integers of two sets of planes."""
    a, b = vectors[:, None, :], centroids[None, :, :]
    square = lambda p: dots(p, p)
    out = (square(vectors)[:, None] + square(centroids)[None, :] - np.uint64(2) * dots(a, b)).view(np.int64)
    if vectors.shape[1] > SAFE:  # far vectors: the largest long stands for what does not fit
        about = lambda p, q: sum(c * 2.0**s for s, c in _popcounts(p, q))
        far = about(vectors, vectors)[:, None] + about(centroids, centroids)[None, :] - 2 * about(a, b) >= 2.0**63
        out[far] = MOST
    return out


def _steps(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and planes, STEP vectors at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            part = batch.slice(first, STEP)
            column = part.column("planes").cast(pa.large_binary())
            _, offsets, data = column.buffers()
            begin = np.frombuffer(offsets, np.int64)[column.offset]
            yield part.column("vec_id"), np.frombuffer(data, "<u8", len(part) * bits, begin).reshape(-1, bits)


def packed(integers: DataFrame, lowest: int, bits: int) -> DataFrame:
    """(vec_id, planes): the planes of each vector, words of 8 bytes with the lowest plane first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                u = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) - lowest
                words = planes_of(u, bits).astype("<u8")
                ends = pa.py_buffer(np.arange(0, (len(words) + 1) * bits * 8, bits * 8, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.Array.from_buffers(pa.binary(), len(words), [None, ends, pa.py_buffer(words.tobytes())])], ["vec_id", "planes"])

    return integers.mapInArrow(run, f"vec_id {integers.schema['vec_id'].dataType.simpleString()}, planes binary")


def _assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid, the smaller number among equals."""
    bits = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, planes in _steps(batches, bits):
            d = distances(planes, centroids)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def _sums(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, n, total): of each cluster and component the vectors assigned and the sum of their integers.

    A task sends one row for each cluster.
    """
    bits, k = centroids.shape[1], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for _, planes in _steps(batches, bits):
            nearest = distances(planes, centroids).argmin(axis=1)
            n += np.bincount(nearest, minlength=k)
            order = np.argsort(nearest, kind="stable")
            first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
            total[nearest[order][first]] += np.add.reduceat(integers_of(planes[order]), first, axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return parts.select("cluster", "n", F.posexplode("total").alias("place", "total")).groupBy("cluster", "place").agg(exact("n"), exact("total"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) for each vector that takes part."""
    spark, integers = vectors.sparkSession, kept(vectors, id_col, vector_col)
    ends = integers.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    lowest = ends["low"] or 0
    bits = max(((ends["high"] or 0) - lowest).bit_length(), 1)
    starts = integers.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)).orderBy("h", "v").limit(k).collect()
    centroids = [list(r["v"]) for r in starts] or [[lowest] * WIDTH]
    table = written(packed(integers, lowest, bits), "planes")
    as_planes = lambda: planes_of(np.array(centroids, np.int64) - lowest, bits)
    for _ in range(rounds):
        for r in _sums(table, as_planes()).collect():  # k * WIDTH rows
            centroids[r["cluster"]][r["place"]] = int(r["total"]) // int(r["n"]) + lowest
    found = written(_assigned(table, as_planes()), "clusters")
    dropped(table)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most, whole = int(MOST), sum(inertia.values())
    rows = [(c, min(inertia.get(c, 0), most), min(whole, most), digest(v), v) for c, v in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
