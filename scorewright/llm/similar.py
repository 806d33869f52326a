"""Near-duplicates whose word shingles have a similarity (Jaccard) of 0.8 or more, as the corpus pipeline removes them.

Texts with the same set of shingles form one node first, so that exact copies cost one row. Two sources propose pairs
of nodes: SimHash fingerprints within `radius` bits, and bands of MinHash values, because copies of similarity 0.8 lie
too many bits apart to be found by blocks of a 64-bit fingerprint. Every proposed pair is checked exactly; nothing is
linked on a fingerprint or a band alone. A pair of similarity s shares a band with probability 1 - (1 - s**5)**24, which
is 0.99993 at 0.8 and more above. A band's members are checked against its hub, the member that most other members of
all its bands meet. Members that this leaves in different components meet again only at rare shingles, by a prefix
filter that misses no similar pair, whether it shares a band or not, and places and bitmaps rule most of those out. So a
large group of near copies costs a star and the pairs that are nearly similar, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm import simhash
from scorewright.llm.shared import components, lean, prepare, workspace, written

BANDS, ROWS = 24, 5
#: Words of 64 bits in a bitmap of shingles.
_WORDS = 8
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SET = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def node_of(shingles: np.ndarray) -> int:
    """The hash of a sorted set of shingle hashes."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its least values under as many permutations. No shingles have no keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 12):
        np.minimum(least, ((shingles[i : i + (1 << 12)] ^ _XOR) * _ODD).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))] if len(shingles) else []
    return np.array(keys, np.uint64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, fp, n, bands) of every row with a doc_id; n is the number of different shingles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(it):
            node, fp, n, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                h = simhash.shingle_hashes(text, words)
                own = np.unique(h)
                node.append(node_of(own))
                fp.append(simhash.folded(h))
                n.append(len(own))
                keys.append(bands(own).view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), *signed, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCH)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, node long, fp long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of every row of docs (text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(it):
            own = [np.unique(simhash.shingle_hashes(t, words)) for t in b.column(0).to_pylist()]
            node = np.array([node_of(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], schema=_SET)

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def sharing_rare(rows: DataFrame, similarity: float, ws: str) -> DataFrame:
    """(a, b): pairs of rows (node, n, component, shingles) of different components, all of those with `similarity` among
    them; n is the number of shingles.

    What two components share are shingles that more than one component has. A similar pair shares at least
    ceil(similarity * n) of a node's, so that in any order of them all it also shares one of the node's first
    `most` - ceil(similarity * n) + 1, `most` being how many the node has; nodes with fewer have no pair. Rare ones come
    first. Of the pairs that meet at one, those go that the places of it or the bitmaps rule out: a bit of one node that
    the other lacks stands for a shingle at least that they don't share.
    """
    parts = rows.select("node", "n", "component", F.explode("shingles").alias("shingle"))
    common = parts.groupBy("shingle").agg(F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", "k")
    shared = written(parts.join(common, "shingle"), ws, "common")
    word, bit = F.shiftright("shingle", 6).bitwiseAND(_WORDS - 1), F.expr("shiftleft(1L, cast(shingle & 63 AS int))")
    maps = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(_WORDS)]
    need = F.ceil(similarity * F.col("n") - 1e-9)
    able = shared.groupBy("node").agg(F.count("*").alias("most"), F.first("n").alias("m"), *maps).where(F.col("most") >= F.ceil(similarity * F.col("m") - 1e-9)).drop("m")
    ranked = shared.select("node", "n", "component", "shingle", F.row_number().over(Window.partitionBy("node").orderBy("k", "shingle")).alias("at"))
    first = written(ranked.join(able, "node").where(F.col("at") <= F.col("most") - need + 1), ws, "rare")
    x, y = first.alias("x"), first.alias("y")
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    overlap = F.ceil(similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    sizes = F.least(*of("n")) >= similarity * F.greatest(*of("n")) - 1e-9
    places = F.least(*of("at")) + F.least(F.col("x.most") - F.col("x.at"), F.col("y.most") - F.col("y.at")) >= overlap
    lacks = lambda p, q: sum(F.bit_count(F.col(f"{p}.w{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.w{k}")))) for k in range(_WORDS))
    maps = F.least(F.col("x.most") - lacks("x", "y"), F.col("y.most") - lacks("y", "x")) >= overlap
    return x.join(y, met & sizes & places & maps).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def similar_pairs(docs: DataFrame, words: int, radius: int, similarity: float, ws: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes (node, doc_id: the smallest with these shingles), links (a, b) of at least `similarity`."""
    found = written(sketches(docs, words), ws, "sketches")
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes, ws, "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = written(rows.join(shared, "band"), ws, "members")
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = members.join(met, "node").groupBy("band").agg(F.max_by(F.struct("node", "n"), F.struct(F.col("met"), -F.col("node"))).alias("hub"))

    same = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), ws, "classes")
    near = nodes.join(same, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = near.unionByName(simhash.link_fingerprints(same, ws, radius))

    def fits(n, m):
        """Sets of these sizes can be similar enough."""
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    first = members.join(hubs, "band").where(F.col("node") != F.col("hub.node")).where(fits(F.col("n"), F.col("hub.n"))).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tried = written(near.unionByName(first).where("a <> b").select(*ordered).distinct(), ws, "pairs")

    ends = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("doc_id")
    sets = shingle_sets(docs.join(wanted, "doc_id", "left_semi"), words).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = written(sets, ws, "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("n"))
        return both.where(F.col("both") >= similarity * (F.col("n") - F.col("both")) - 1e-9).select("a", "b")

    links = written(checked(tried), ws, "links")
    labels = components(links, ws)
    at = members.join(labels, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = at.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    at = written(at.join(mixed, "band", "left_semi").select("node", "n", "component").distinct(), ws, "mixed")
    rest = sharing_rare(at.join(sets, "node"), similarity, ws)
    more = written(checked(rest.join(tried, ["a", "b"], "left_anti")), ws, "links")
    return nodes.select("node", "doc_id"), links.unionByName(more)


def keep_one(docs: DataFrame, words: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, one row each; rows without a doc_id stay.

    A group is a component of links between texts whose sets of `words`-word shingles have at least `similarity`.
    Texts without words have the same empty set. Null texts are empty, of rows that repeat a doc_id one stays, other
    columns are handed on, an empty table gives none, and a very long text's shingle hashes are in memory once.
    """
    prepare(docs.sparkSession)
    ws = workspace(docs.sparkSession)
    nodes, links = similar_pairs(docs, words, radius, similarity, ws)
    labels = components(links, ws)
    groups = nodes.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("doc_id").alias("__sw_id"))
    return simhash.rows_of(docs, groups.select("__sw_id").distinct())
