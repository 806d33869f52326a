"""SimHash near-duplicates: fingerprints of word shingles, linked through Burkhard-Keller trees.

Documents with equal fingerprints form one class first, so that exact copies cost one row. Distinct fingerprints
within `radius` bits agree on at least one of the tables' keys (the bits are cut into blocks, a table's key leaves
`radius` of them out), so each key's fingerprints are a shard and every link lies within some shard. A shard's tree
keeps children by their integer distance to the parent; a query follows only the edges within the radius of its own
distance. A shard of more than `tree_nodes` fingerprints is dealt into slices with a tree each, which all its members
visit; one so large that this would cost more than keys of finer blocks is cut up by those first, and only what still
agrees on them, a ball of a few bits, is dealt into slices. Trees stay bounded, no link is lost, and a task emits a
spanning star for each batch, never all pairs.
The trees travel to the tasks that hold their shard's queries rather than to every executor: a broadcast goes through
the driver, and the trees of a corpus hold all its fingerprints, for which there is no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.shared import components, local_stars, prepare, spans, workspace, written

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """The hashes of a text's shingles in their order; a text of at most `words` words is one shingle."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and white space is ASCII
    joined = b" ".join(data)
    if len(data) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if data else [], np.uint64)
    length = np.fromiter(map(len, data), np.int64, len(data))
    start = np.cumsum(length + 1) - length - 1
    n = len(data) - words + 1
    ends = (start + length)[words - 1 :].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(start[:n].tolist(), ends)], repeat(42)), "<u8", n)


def folded(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: each bit as most of them have it."""
    n = len(h)
    table = np.zeros((8, 256), np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        table += np.bincount((part + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    ones = (table @ _BITS).ravel()
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def simhash64(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long. A null or empty text has 0."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((simhash64(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema=_FP)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """The trees of several shards, built and searched level by level in arrays."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """shard: the shard of each node, equal ones side by side; fp: their fingerprints, unsigned."""
        self.fp = fp
        n = len(fp)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.shards, self.roots = shard[first], first
        parent = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        node = np.setdiff1d(np.arange(n), first, assume_unique=True)
        keys, children = [], []
        while len(node):
            edge = parent[node] * 128 + np.bitwise_count(fp[node] ^ fp[parent[node]])
            order = np.argsort(edge, kind="stable")
            node, edge = node[order], edge[order]
            head = np.concatenate([[True], edge[1:] != edge[:-1]])
            child = node[head]
            keys.append(edge[head])
            children.append(child)
            parent[node] = child[np.cumsum(head) - 1]
            node = node[~head]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], (np.concatenate(children)[order] if keys else key)

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) at `radius` bits or fewer."""
        if not len(self.roots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        query = np.flatnonzero(self.shards[at] == shard)
        node = self.roots[at[query]]
        hits = []
        while len(query):
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            hits.append((query[near], node[near]))
            low = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.key, node * 128 + d + radius, side="right") - low
            total = np.cumsum(many)
            node = self.child[np.repeat(low - total + many, many) + np.arange(total[-1])]
            query = np.repeat(query, many)
        return tuple(np.concatenate(x) for x in zip(*hits))


def _links(radius: int):
    """mapInArrow over rows (shard, slice, node, fp, rep) sorted by shard, slice and nodes first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for b in it:
            shard, part, node, fp, rep = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            fp = fp.view(np.uint64)
            if not len(shard):
                continue
            node = node.astype(bool)
            # the open shard's nodes stay from batch to batch; others have ended
            same = (kept[0] == shard[0]) & (kept[1] == part[0])
            nodes = [np.concatenate([k[same], x[node]]) for k, x in zip(kept, (shard, part, fp, rep))]
            rows_s, rows_p = np.concatenate([nodes[0], shard]), np.concatenate([nodes[1], part])
            _, ids = np.unique(np.stack([rows_s, rows_p]), axis=1, return_inverse=True)
            ids = ids.ravel()
            own, asked = ids[: len(nodes[0])], ids[len(nodes[0]) :]
            order = np.argsort(own, kind="stable")
            forest = Forest(own[order], nodes[2][order])
            reps = nodes[3][order]
            load = np.bincount(own, minlength=ids.max() + 1)[asked]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, j in spans(load, 1 << 21):
                q, n = forest.search(asked[i:j], fp[i:j], radius)
                found.append(local_stars(rep[i:j][q], reps[n]))
            a, c = local_stars(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], schema=_EDGE)
            last = (nodes[0] == shard[-1]) & (nodes[1] == part[-1])
            kept = [x[last] for x in nodes]

    return run


def _blocks(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table the (shift, width) of its key's blocks: `radius` of the blocks are left out, in every way."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in c] for c in combinations(range(blocks), blocks - radius)]


def _tables(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """More blocks give longer keys and more tables; enough are taken for shards of about 64 of n random fingerprints.
    Any choice finds every link."""
    for blocks in range(radius + 1, radius + 4):
        tables = _blocks(blocks, radius)
        if n >> min(sum(w for _, w in t) for t in tables) <= 64:
            break
    return tables


def _keys(tables: list[list[tuple[int, int]]], *within: Column) -> Column:
    """The shard of a fingerprint in each table."""
    parts = [[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in t] for t in tables]
    return F.array(*[F.xxhash64(*within, F.lit(t), *p) for t, p in enumerate(parts)])


def link_fingerprints(reps: DataFrame, ws: str, radius: int = 3, tree_nodes: int = 4096, finer: int = 6) -> DataFrame:
    """Edges (a, b) that join the representatives of all fingerprints within `radius` bits; reps: (fp, rep).

    finer: blocks beyond the radius that cut up a shard larger than `tree_nodes` times their number of tables. Equal
    fingerprints are one row of reps; null ones have no links; an empty table has none.
    """
    rows = reps.where("fp is not null").select("fp", "rep", F.explode(_keys(_tables(reps.count(), radius))).alias("shard"))

    def large(rows: DataFrame) -> DataFrame | None:
        found = rows.groupBy("shard").count().where(F.col("count") > tree_nodes).select("shard", F.ceil(F.col("count") / tree_nodes).cast("int").alias("n"))
        found = written(found, ws, "large_shards")
        return None if found.isEmpty() else found

    def sliced(rows: DataFrame, sizes: DataFrame | None) -> DataFrame:
        if sizes is None:
            return rows.select("shard", F.lit(0).alias("slice"), F.lit(1).alias("node"), "fp", "rep")
        n_of = F.coalesce("n", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), n_of).cast("int")
        each = rows.join(sizes, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), n_of - 1)).alias("slice"), "fp", "rep", own.alias("own"))
        return each.select("shard", "slice", (F.col("slice") == F.col("own")).cast("int").alias("node"), "fp", "rep")

    sizes, tables = large(rows), _blocks(radius + finer, radius)
    deep = None if sizes is None else sizes.where(F.col("n") > len(tables))
    if deep is None or deep.isEmpty():
        rows = sliced(rows, sizes)
    else:
        below = rows.join(deep.select("shard"), "shard", "left_semi").select("fp", "rep", F.explode(_keys(tables, F.col("shard"))).alias("shard"))
        rows = sliced(rows.join(deep.select("shard"), "shard", "left_anti"), sizes).unionByName(sliced(below, large(below)))
    rows = rows.select("shard", F.col("slice").cast("long"), F.col("node").cast("long"), "fp", "rep")
    rows = rows.repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.desc("node"))
    return rows.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, tree_nodes: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id that links of at most `radius` bits reach. Texts without words have
    fingerprint zero and link like any other; rows with a null doc_id keep a row but are nobody's link; repeated rows
    each keep theirs; an empty table gives an empty result; other columns of docs are not looked at; a very long text
    is hashed whole, its shingle hashes in memory once.
    """
    spark = docs.sparkSession
    ws = workspace(spark)
    fps = written(fingerprints(docs, words, id_col, text_col), ws, "fingerprints")
    reps = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), ws, "classes")
    labels = components(written(link_fingerprints(reps, ws, radius, tree_nodes), ws, "links"), ws)
    of = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, one row each; rows without a doc_id stay."""
    found = near_duplicates(docs, words, radius).where("doc_id = component_id").select(F.col("doc_id").alias("__sw_id")).distinct()
    return rows_of(docs, found)


def rows_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is a __sw_id of found, one row each, and those without a doc_id."""
    kept = docs.join(found, docs["doc_id"] == found["__sw_id"], "left_semi")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    kept = kept.withColumn("__sw_n", F.row_number().over(one)).where("__sw_n = 1").drop("__sw_n")
    return kept.unionByName(docs.where("doc_id is null"))
