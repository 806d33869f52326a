"""Embedding near-duplicates by a subspace pigeonhole join.

A cosine of at least t is a squared distance of at most 2 - 2t between unit vectors. A rotation keeps distances; it
spreads them over blocks of `block_dims` coordinates. If a pair's distance is within the budget, then at least one
block's distance is within that block's share of it, so joining every block by range and taking the union loses no
pair. A block's range join is nested over all its coordinates: for each coordinate the members are cut into bins by
rank, a bitmap tells the members of all lower bins, and two of them give those within the range of a query's
coordinate; what is left after all coordinates of the block is compared under the block's budget, once for all blocks,
and then verified by the exact cosine in double precision.

Equal vectors of a label are one class first. A label's classes are dealt into chunks and each pair of chunks is a unit
of its own, in which a pair is met once and counts for both ends: units hand on sums of links and spanning stars, never
pairs. A row travels to as many units as its label has chunks: one up to `chunk_rows` classes, at most 16 up to a
million, and a sixteenth of a label's millions beyond, since every link of a dense label has to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.shared import components, local_stars, prepare, workspace, written

_SLACK = 1e-9
#: Bins of a coordinate, queries compared at a time, and chunks of a label before chunks grow.
_BINS, _QUERIES, _CHUNKS = 256, 256, 16


def _rotation(dims: int) -> np.ndarray:
    """A fixed rotation."""
    return np.linalg.qr(np.random.default_rng(42).normal(size=(dims, dims)))[0]


class Blocks:
    """The blocks of vectors of a dimension, and each block's share of the squared distance."""

    def __init__(self, dims: int, threshold: float, block_dims: int):
        n = max(1, dims // block_dims)
        self.cuts = [dims * i // n for i in range(n + 1)]
        self.rotation = _rotation(dims)
        total = max(0.0, 2 - 2 * threshold) * (1 + _SLACK) + 1e-12
        self.budget = np.array([total * (b - a) / dims for a, b in zip(self.cuts, self.cuts[1:])])

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        # einsum, not BLAS: a vector's coordinates are the same in whichever batch it is
        return np.einsum("ij,kj->ik", unit, self.rotation)

    def shares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each block's squared distance."""
        return np.add.reduceat((a - b) ** 2, self.cuts[:-1], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Ranges:
    """The members of one block: who lies within a range in every coordinate."""

    def __init__(self, part: np.ndarray):
        """part: a row of coordinates for each member."""
        self.n = len(part)
        self.words = -(-self.n // 64)
        bins = min(self.n, _BINS)
        start = np.arange(bins) * self.n // bins
        self.cuts, self.below = [], []
        for x in part.T:
            order = np.argsort(x, kind="stable")
            self.cuts.append((x[order[start]], x[order[np.append(start[1:], self.n) - 1]]))
            bits = np.zeros((bins + 1, self.words * 64), np.uint8)
            bits[np.searchsorted(start, np.arange(self.n), side="right"), order] = 1
            self.below.append(np.bitwise_or.accumulate(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), axis=0))

    def within(self, part: np.ndarray, radius: float, among: np.ndarray) -> np.ndarray:
        """The bitmaps of `among`, a row for each query, without members outside the box around the query."""
        out = among.copy()
        for x, (low, high), below in zip(part.T, self.cuts, self.below):
            out &= below[np.searchsorted(low, x + radius, side="right")]
            out &= ~below[np.searchsorted(high, x - radius)]
        return out


def bit_pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the bits that are set."""
    row, word = np.nonzero(bits)
    some = np.unpackbits(bits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, place = np.nonzero(some)
    return row[k], word[k] * 64 + place


class Unit:
    """The links between two chunks of a label, or within one."""

    def __init__(self, threshold: float, block_dims: int):
        self.threshold, self.block_dims = threshold, block_dims
        #: Pairs that were compared under a block's budget, and those verified.
        self.compared = self.verified = 0

    def links(self, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of a and of b (of a itself, the second behind the first, if b is None) that link."""
        plan = Blocks(a.shape[1], self.threshold, self.block_dims)
        ua = unit(a)
        ub = ua if b is None else unit(b)
        ta, tb = plan.rotated(ua), plan.rotated(ub)
        ranges = [Ranges(tb[:, lo:hi]) for lo, hi in zip(plan.cuts, plan.cuts[1:])]
        n = len(ub)
        places = np.arange(ranges[0].words * 64)
        for at in range(0, len(ua), _QUERIES):
            q = np.arange(at, min(at + _QUERIES, len(ua)))
            open_ = (places < n) & (places > (q[:, None] if b is None else np.full((len(q), 1), -1)))
            left = np.packbits(open_, axis=1, bitorder="little").view(np.uint64)
            found = []
            for block, (lo, hi) in enumerate(zip(plan.cuts, plan.cuts[1:])):
                radius = float(np.sqrt(plan.budget[block])) * (1 + 1e-6) + 1e-12
                x, y = bit_pairs(ranges[block].within(ta[q, lo:hi], radius, left))
                near = np.zeros(len(x), bool)
                for i in range(0, len(x), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    near[j] = ((ta[q[x[j]], lo:hi] - tb[y[j], lo:hi]) ** 2).sum(1) <= plan.budget[block] * (1 + 1e-6) + 1e-12
                self.compared += len(x)
                x, y = x[near], y[near]
                found.append((x, y))
                if len(x):  # a pair is compared no more once a block has it
                    taken = np.zeros((len(q), len(places)), bool)
                    taken[x, y] = True
                    left &= ~np.packbits(taken, axis=1, bitorder="little").view(np.uint64)
            x, y = (np.concatenate(z) for z in zip(*found))
            self.verified += len(x)
            for i in range(0, len(x), 1 << 16):
                k, m = q[x[i : i + (1 << 16)]], y[i : i + (1 << 16)]
                ok = np.einsum("ij,ij->i", ua[k], ub[m]) >= self.threshold
                if ok.any():
                    yield k[ok], m[ok]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _units(threshold: float, block_dims: int):
    """mapInArrow over rows (label, dims, i, j, chunk, rep, n, embedding) sorted by the first four."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        dims, i, j = (rows.column(c)[0].as_py() for c in ("dims", "i", "j"))
        chunk, rep, n = (rows.column(c).to_numpy() for c in ("chunk", "rep", "n"))
        x = rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(np.float64)
        a = np.flatnonzero(chunk == i)
        b = a if i == j else np.flatnonzero(chunk == j)
        if not len(a) or not len(b):
            return None
        total = np.zeros(len(rep), np.int64)
        stars = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, m in Unit(threshold, block_dims).links(x[a], None if i == j else x[b]):
            k, m = a[k], b[m]
            np.add.at(total, k, n[m])
            np.add.at(total, m, n[k])
            stars.append(local_stars(rep[k], rep[m]))
        p, q = local_stars(*(np.concatenate(z) for z in zip(*stars)))
        has = np.flatnonzero(total)
        ends = pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(q, pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[has], p])), ends, pa.array(np.concatenate([total[has], np.zeros(len(p), np.int64)]))], schema=_FOUND)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in it:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dims", "i", "j"))))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != key and held:
                    if (out := solve(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                key = keys[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block_dims: int = 16, chunk_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine in double precision is at least the threshold.
    n_links: rows linked to directly; component_id: the smallest vec_id reachable; kept: it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components, and those without a label or a vec_id, link with
    nothing and are kept; vectors of different dimensions don't link; rows that repeat link with each other; other
    columns are not looked at; an empty table gives an empty result. The embedding is an array of floats or doubles.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ws = workspace(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    classes = written(rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), ws, "classes")
    dealt = classes.withColumn("dims", F.size("embedding"))
    n = F.col("count") / chunk_rows
    large = dealt.groupBy("label", "dims").count().where(F.col("count") > chunk_rows).select("label", "dims", F.ceil(F.greatest(F.least(n, F.lit(float(_CHUNKS))), n / _CHUNKS)).cast("long").alias("chunks"))
    large = written(large, ws, "large_labels")
    if large.isEmpty():
        dealt = dealt.withColumn("chunks", F.lit(1).cast("long"))
    else:
        dealt = dealt.join(large, ["label", "dims"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("label", "dims", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "n", "embedding")
    unit_of = ["label", "dims", "i", "j"]
    found = written(dealt.repartition(*unit_of).sortWithinPartitions(*unit_of).mapInArrow(_units(threshold, block_dims), "a long, b long, n long"), ws, "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    labels = components(found.where("b is not null").select("a", "b"), ws)
    known = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    whole = rows.withColumn("usable", usable)
    of = known.withColumn("usable", F.lit(True))
    out = whole.join(of, ["usable", "label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
