"""Nearest neighbours by cross-polytope hashing with fast Hadamard rotations and multiprobe tables.

Each of TABLES hash tables turns a unit vector by rounds of random signs and fast Hadamard transforms and takes
the nearest of the signed axes. One code has too few values for a large table, so codes of several rotations
are put together, the last one over fewer axes, until a table has FINE * sqrt(n) buckets for n vectors. A query
looks into the PROBES buckets of least summed loss. So it meets about TABLES * PROBES * sqrt(n) / FINE
vectors: a share of the table that falls as the table grows.

Vectors of one dimension are indexed by bands of their norm (half octaves), as near directions mean near
vectors only at like norms; a query probes the bands that can hold one of its nearest.

Data flow: equal vectors are one class that carries its TOP + 1 smallest ids (no list of TOP needs more). Buckets
receive vectors rounded to 16 bits a component and compare them with the queries that probe them. Rounding leaves each
distance between two bounds; a vector is passed on unless TOP + 1 others are surely nearer, so that neither rounding
nor ties lose one. The first FIRST tables give each query a distance within which TOP + 1 vectors surely lie; what the
others pass on may be nearer, so the candidates of a query don't grow with the table but for ties. They
are ranked exactly, in double precision on the original vectors. A bucket of more than BLOCK vectors is dealt out in pieces, each with the bucket's queries, so what a
task holds is bounded. Queries for which fewer than TOP are found are compared with all vectors, BLOCK queries
at a time. Every row is indexed; nothing is fitted or sampled. What reaches the driver is one row for each pair
of dimension and band, large buckets never, and the vectors of one block of short queries at a time.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
id, take no part; vectors are only compared within one dimension; repeated rows count once; a query with fewer
than TOP other rows in its dimension returns those; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import written

TABLES, FIRST, PROBES, FINE, TOP, BLOCK, SEED = 30, 3, 24, 34, 10, 8192, 20240607
#: Numbers handled at once while hashing and while comparing.
CELLS = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; columns are a power of two.

    Each step transforms up to 64 columns at once by a small matrix product, which is far quicker than steps of two.
    """
    n, d = x.shape
    h = 1
    while h < d:
        r = min(64, d // h)
        small = np.ones((1, 1), x.dtype)
        while len(small) < r:
            small = np.block([[small, small], [small, -small]])
        x = (x.reshape(-1, r) @ small if h == 1 else small @ x.reshape(-1, r, h)).reshape(n, d)
        h *= r
    return x / x.dtype.type(np.sqrt(d))


def width(d: int) -> int:
    """Columns of a rotation of d: a power of two, at least 16, below which signs and transforms make few rotations."""
    return max(16, 1 << max(0, d - 1).bit_length())


def rotated(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """A pseudo-rotation: three rounds of signs and Hadamard transform, rows filled up with zeros."""
    n, d = x.shape
    out = np.zeros((n, width(d)), x.dtype)
    out[:, :d] = x
    for s in np.random.default_rng([seed, number, d]).integers(0, 2, (3, width(d))) * 2 - 1:
        out = hadamard(out * s.astype(x.dtype))
    return out


@dataclass(frozen=True)
class Slot:
    """The vectors of one dimension and band of norms: how many distinct ones and rows there are, and the axes of each code."""

    number: int
    dim: int
    band: int
    vectors: int
    rows: int

    @property
    def levels(self) -> list[int]:
        """Axes of each code of the concatenation: all of a rotation, and the last one as many as the buckets need."""
        buckets, out = FINE * self.vectors**0.5, []
        while buckets > 1:
            wide = width(self.dim)
            axes = wide if buckets >= 2 * wide else 1 << max(0, int(np.ceil(np.log2(buckets / 2))))
            out.append(axes)
            buckets /= 2 * axes
        return out


def codes(x: np.ndarray, levels: list[int], tab: int, probes: int) -> np.ndarray:
    """For each unit vector its ``probes`` buckets of a table, least summed squared loss first."""
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k, axes in enumerate(levels):
        r = rotated(x, tab * 64 + k)[:, :axes]
        both = np.concatenate([r, -r], axis=1)
        if probes == 1:
            code = code * (2 * axes) + np.argmax(both, axis=1)[:, None]
            continue
        off = (both.max(axis=1, keepdims=True) - both) ** 2
        near = np.argsort(off, axis=1, kind="stable")[:, :probes]
        more = np.take_along_axis(off, near, axis=1)
        loss = (loss[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * axes) + near[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, code = np.take_along_axis(loss, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def _hashed(slots: dict[tuple[int, int], Slot], probes: int, tables: range, short: bool = False):
    """A map of rows (cls, vec, band, most) to one row for each table and bucket; short: without the vectors."""
    schema = ["slot", "code", "cls", "most", "scale", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, bands = batch.column("vec"), np.asarray(batch.column("band"))
            sizes = np.asarray(vectors.value_lengths())
            flat = np.asarray(vectors.flatten(), dtype=np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for d, band in {*zip(sizes.tolist(), bands.tolist(), strict=True)}:
                slot, every = slots[d, band], np.flatnonzero((sizes == d) & (bands == band))
                for rows in np.array_split(every, -(-len(every) * width(d) * probes // CELLS)):
                    x = flat[(starts[rows][:, None] + np.arange(d)).reshape(-1)].reshape(-1, d)
                    top = np.abs(x).max(axis=1, keepdims=True)
                    q = np.round(x / top * 32767).astype("<i2")
                    x = (x / top).astype(np.float32)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    cls, most, scale = batch.column("cls").take(pa.array(rows)), batch.column("most").take(pa.array(rows)), pa.array((top[:, 0] / 32767).astype(np.float64))
                    blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * 2 * d).astype("<i4")), pa.py_buffer(q.tobytes())])
                    for tab in tables:
                        code = codes(x, slot.levels, tab, probes)
                        for j in range(code.shape[1]):
                            head = [pa.array(np.full(len(rows), slot.number * TABLES + tab)), pa.array(code[:, j])]
                            yield pa.RecordBatch.from_arrays(head if short else [*head, cls, most, scale, blobs], schema[:2] if short else schema)

    return run


def _bounds(of: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row the TOP + 1 least ``high`` among the rows of its query, infinite if there are fewer."""
    order = np.lexsort((high, of))
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    last = np.full(len(starts), np.inf)
    last[sizes > TOP] = high[order][starts[sizes > TOP] + TOP]
    out = np.empty(len(order))
    out[order] = np.repeat(last, sizes)
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and piece, vectors before queries: of each query those that may be among its TOP + 1 nearest, and between what their distance lies."""
    kept: pa.Table | None = None  # the vectors of the bucket that the batch before ended in
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]).combine_chunks() if kept is not None else table
        key = np.stack([np.asarray(table.column(c)) for c in ("slot", "code", "piece")])
        asks = np.asarray(table.column("asks"))
        new = np.ones(table.num_rows, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        bounds, group = np.append(np.flatnonzero(new), table.num_rows), np.cumsum(new) - 1
        members = np.add.reduceat(asks == 0, bounds[:-1])  # they come first in their group
        queries = np.flatnonzero(asks == 1)
        pairs = np.cumsum(members[group[queries]])
        cls, most, scale, blob = np.asarray(table.column("cls")), np.asarray(table.column("most")), np.asarray(table.column("scale")), table.column("q").chunk(0)
        offsets = np.frombuffer(blob.buffers()[1], "<i4")[blob.offset : blob.offset + len(blob) + 1]
        data = np.frombuffer(blob.buffers()[2], "<i2")
        done = 0
        while done < len(queries):
            d = (offsets[queries[done] + 1] - offsets[queries[done]]) // 2
            before = pairs[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(pairs, before + CELLS // max(1, d), "right")))
            mine = queries[done:end]
            mine = mine[offsets[mine + 1] - offsets[mine] == 2 * d]  # a table is sorted by dimension
            done += len(mine)
            count = members[group[mine]]
            a = np.repeat(mine, count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[group[mine]], count)
            at = np.arange(d)
            x = data[(offsets[a] // 2)[:, None] + at] * scale[a][:, None]
            x -= data[(offsets[b] // 2)[:, None] + at] * scale[b][:, None]
            apart = np.einsum("ij,ij->i", x, x)
            apart, error = np.sqrt(apart), (scale[a] + scale[b]) * (np.sqrt(d) * 0.5 * (1 + 1e-6))
            low, high = np.maximum(apart - error, 0), apart + error
            near = low <= most[a]
            qcls, found, low, high = cls[a][near], cls[b][near], low[near], high[near]
            near = low <= _bounds(qcls, high)
            yield pa.RecordBatch.from_arrays([pa.array(qcls[near]), pa.array(found[near]), pa.array(low[near]), pa.array(high[near])], ["qcls", "cls", "low", "high"])
        kept = table.slice(bounds[-2], int(members[-1]))


def _against(block: list[tuple[int, list[float]]]):
    """For each query of a block the vectors of a batch that may be among its TOP + 1 nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cls = np.asarray(batch.column("vec").value_lengths()), np.asarray(batch.column("cls"))
            flat, starts = np.asarray(batch.column("vec").flatten(), dtype=np.float64), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = flat[(starts[rows][:, None] + np.arange(d)).reshape(-1)].reshape(-1, d)
                for q, vec in block:
                    if len(vec) == d:
                        apart = np.sqrt(((x - np.array(vec)) ** 2).sum(axis=1))
                        low, high = apart * (1 - 1e-9), apart * (1 + 1e-9)
                        near = np.flatnonzero(low <= _bounds(np.zeros(len(x), np.int64), high))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(cls[rows][near]), pa.array(low[near]), pa.array(high[near])], ["qcls", "cls", "low", "high"])

    return run


def _first(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The n first rows of each value; ``rank`` counts them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _nearest(candidates: DataFrame) -> DataFrame:
    """(qcls, cls, low, high, most): candidates that may be among the TOP + 1 nearest of their query, and the distance (most) within which so many surely lie."""
    near = candidates.repartition("qcls").groupBy("qcls", "cls").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    whole = Window.partitionBy("qcls").orderBy("high").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumn("most", F.coalesce(F.nth_value("high", TOP + 1).over(whole), F.lit(float("inf"))))
    return near.where("low <= most")


def _ranked(asked: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) of candidates (qcls, cls, low, high), ranked exactly."""
    near = _nearest(candidates).select("qcls", "cls").join(classes.select("cls", "least", "ids", "vec"), "cls")
    near = near.join(classes.select(F.col("cls").alias("qcls"), F.col("vec").alias("own")), "qcls")
    near = near.select("qcls", "least", "ids", distance(F.col("own").cast("array<double>"), F.col("vec").cast("array<double>")).alias("score"))
    near = _first(near, "qcls", ["score", "least"], TOP + 1).drop("rank", "least")
    each = asked.join(near, "qcls").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    return _first(each, "query_id", ["score", "vec_id"], TOP).select("query_id", "rank", "vec_id", "score")


def _band(vec: Column) -> Column:
    """Half octaves of the norm; very large and very small vectors are scaled first, that no square overflows."""

    def of(exponent: int) -> Column:
        return F.log2(F.aggregate(vec, F.lit(0.0), lambda s, x: s + (x.cast("double") * 2.0**exponent) * (x.cast("double") * 2.0**exponent))) - 2 * exponent

    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    return F.rint(F.when(top > 1e100, of(-600)).when(top < 1e-100, of(600)).otherwise(of(0))).cast("int")


def _reached(slots: list[Slot]) -> dict[tuple[int, int], list[int]]:
    """For each dimension and band of a query the bands that can hold one of its TOP nearest.

    Rows of norm at most r are within q + r of a query of norm q, so once more than TOP rows are that small no
    vector of a norm over 2 q + r is among the nearest: three times the larger is 3.2 half octaves more.
    """
    out = {}
    for s in slots:
        mine = sorted((x for x in slots if x.dim == s.dim), key=lambda x: x.band)
        below = np.cumsum([x.rows for x in mine])
        edge = next((x.band for x, n in zip(mine, below, strict=True) if n > TOP), mine[-1].band)
        out[s.dim, s.band] = [x.band for x in mine if x.band <= max(s.band, edge) + 5]
    return out


def search(vectors: DataFrame, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its nearest others found."""
    x = F.col("vec")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    rows = rows.where("vec_id IS NOT NULL").where(usable)
    firsts = _first(rows.distinct(), "vec", ["vec_id"], TOP + 1)
    classes = firsts.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), F.col("ids")[0].alias("least"), "ids", "vec", _band(x).alias("band")), "classes")
    asked = rows.where(F.col("vec_id") % every == 0).distinct().join(classes.select("cls", "vec"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("qcls"))
    asked = written(asked, "asked")
    sizes = classes.groupBy(F.size("vec").alias("dim"), "band").agg(F.count("*").alias("vectors"), F.sum(F.size("ids")).alias("rows")).collect()
    slots = [Slot(i, r.dim, r.band, r.vectors, r.rows) for i, r in enumerate(sorted(sizes))]
    if not slots:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_key = {(s.dim, s.band): s for s in slots}

    picked = classes.select("cls", "least", "vec", "band", F.lit(0.0).alias("most"))
    size = picked.mapInArrow(_hashed(by_key, 1, range(TABLES), short=True), "slot long, code long").groupBy("slot", "code").count()
    large = written(size.where(F.col("count") > BLOCK).select("slot", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("pieces")), "large")
    probing = picked.drop("most").join(asked.select(F.col("qcls").alias("cls")).distinct(), "cls")
    reach = F.coalesce(*(F.when((F.size("vec") == d) & (F.col("band") == own), F.array(*map(F.lit, found))) for (d, own), found in _reached(slots).items()))
    probing = written(probing.withColumn("reach", reach), "probing")

    def met(asking: DataFrame, tables: range) -> DataFrame:
        """(qcls, cls, low, high) of the queries' candidates in these tables that may be within ``most``."""
        schema = "slot long, code long, cls long, most double, scale double, q binary"
        index = picked.mapInArrow(_hashed(by_key, 1, tables), schema).join(large, ["slot", "code"], "left")
        index = index.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("cls"), "pieces").cast("int"), F.lit(0))).withColumn("asks", F.lit(0))
        asking = asking.select("cls", "vec", F.explode("reach").alias("band"), "most").mapInArrow(_hashed(by_key, PROBES, tables), schema).join(large, ["slot", "code"], "left")
        asking = asking.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).withColumn("asks", F.lit(1))
        columns = ["slot", "code", "piece", "asks", "cls", "most", "scale", "q"]
        both = index.select(*columns).unionByName(asking.select(*columns)).repartition("slot", "code", "piece").sortWithinPartitions("slot", "code", "piece", "asks")
        return both.mapInArrow(_compared, "qcls long, cls long, low double, high double")

    some = met(probing.withColumn("most", F.lit(float("inf"))), range(min(FIRST, TABLES)))
    some = written(_nearest(some), "some")
    bound = some.groupBy(F.col("qcls").alias("cls")).agg(F.min("most").alias("most"))
    rest = met(probing.join(bound, "cls", "left").fillna({"most": float("inf")}), range(FIRST, TABLES))
    found = written(_ranked(asked, some.drop("most").unionByName(rest), classes), "found")

    # what hashing found too little for is compared with everything, a block of queries at a time
    held = {d: sum(s.rows for s in slots if s.dim == d) for d in {s.dim for s in slots}}
    most = F.coalesce(*(F.when(F.size("vec") == d, F.lit(min(TOP, n - 1))) for d, n in held.items()))
    wanted = asked.join(picked.select(F.col("cls").alias("qcls"), most.alias("most")), "qcls")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = written(wanted.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < F.col("most")).select("query_id", "qcls"), "short")
    if short.isEmpty():
        return found
    block, exact = [], []
    for r in short.select(F.col("qcls").alias("cls")).distinct().join(picked, "cls").toLocalIterator():
        block.append((r.cls, [float(v) for v in r.vec]))
        if len(block) == BLOCK:
            exact, block = [*exact, written(picked.mapInArrow(_against(block), "qcls long, cls long, low double, high double"), "exact")], []
    exact.append(picked.mapInArrow(_against(block), "qcls long, cls long, low double, high double"))
    again = _ranked(short, reduce(DataFrame.unionByName, exact), classes)
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
