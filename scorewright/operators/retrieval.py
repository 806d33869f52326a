"""Retrieval of similar examples, and positional blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators.lineage import cut
from scorewright.shipping import ship

#: Rows of a block of queries or of the index, on average; a unit compares one block of each.
BLOCK = 4096
#: Clusters of the index at most: their centres are all that the driver holds of it.
CLUSTERS = 256
#: Components of a part of the index, which one task compares with a block of queries; parts of
#: an index at least, unless they would be smaller than SCORE_ROWS.
PART, PARTS = 1 << 23, 8
#: Queries whose scores against a block or cluster of the index are in memory at a time.
SCORE_ROWS = 256
#: Documents of a word from which on BM25 adds it as part of a matrix product.
OFTEN = 65_536
#: Characters and words of queries that a unit of documents has at most, on average.
UNIT_CHARS, UNIT_WORDS = 1 << 24, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(queries: DataFrame, index: DataFrame, id_col: str, vector: str, k: int, block: int = BLOCK, clusters: int = CLUSTERS) -> DataFrame:
    """(query_id, rank, neighbour_id, score): the k largest inner products of each query, itself left out, ties by id.

    The index falls into at most `clusters` clusters around vectors drawn by a hash of their ids. A query meets its own
    cluster first; its k-th score there rules out every cluster whose inner products cannot reach it (that with the
    centre, plus the query's length times the cluster's radius). Queries in blocks of about four times `block` rows meet the
    index in parts (`PARTS` of them, more where one would exceed `PART` components), packed and written once, and a block
    keeps k rows a query of each part: what goes to disk grows as queries and index, and as k rows a query and part.

    Rows without an id, and vectors that are null or hold a null or non-finite component, are left out on both sides.
    """
    ship(index.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return x.where(F.col("id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    asked, held = rows(queries), rows(index)
    m, n = asked.count(), held.count()
    blocks = max(1, -(-m // (4 * block)), min(index.sparkSession.sparkContext.defaultParallelism, -(-m // SCORE_ROWS)))
    centres = held.orderBy(F.xxhash64("id"), "id").limit(max(1, min(clusters, -(-n // block)))).collect()
    centres = np.unique(np.array([r.v for r in centres], np.float64), axis=0)
    if not len(centres):
        return index.sparkSession.createDataFrame([], "query_id long, rank int, neighbour_id long, score double")
    asked, held = _clustered(asked, centres), _clustered(held, centres)
    held = _packed(held, max(-(-n // max(block, PART // max(1, centres.shape[1]))), min(PARTS, -(-n // SCORE_ROWS))))
    near = cut(_nearest(asked.withColumn("least", F.lit(None).cast("double")), held, centres, k, blocks, False))
    if len(centres) > 1:
        least = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        far = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "v", "cluster", "least")
        near = _ranked(near.drop("rank").unionByName(_nearest(far, held, centres, k, blocks, True).drop("rank")), k)
    return near.select("query_id", "rank", "neighbour_id", "score")


def _clustered(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (id, v) with their nearest centre."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                # einsum, not BLAS: a vector's cluster is the same in whichever batch it is
                at = ((centres**2).sum(1) - 2 * np.einsum("ij,kj->ik", x, centres)).argmin(1)
                yield pdf.assign(cluster=at.astype(np.int32))

    return rows.mapInPandas(run, "id long, v array<double>, cluster int")


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each of the parts that rows (id, v, cluster, and least of queries) are dealt to in turn, written once: ids,
    clusters, vectors and least scores as bytes, by cluster. Vectors are of single precision where that changes none."""
    asked = "least" in rows.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # batches become arrays as they come: lists of a whole part's vectors would be many times as large
        held = [(np.stack(pdf["v"].to_numpy()), pdf.drop(columns="v")) for pdf in it if len(pdf)]
        if held:
            x, rest = np.concatenate([v for v, _ in held]), pd.concat([r for _, r in held])
            order = np.lexsort((rest["id"], rest["cluster"]))
            single = x.astype(np.float32)
            x, rest = (single if (single == x).all() else x)[order], rest.iloc[order]
            out = {"ids": rest["id"].to_numpy(np.int64), "clusters": rest["cluster"].to_numpy(np.int32), "vectors": x}
            yield pd.DataFrame({c: [v.tobytes()] for c, v in (out | ({"least": rest["least"].to_numpy(float)} if asked else {})).items()})

    return cut(rows.repartition(parts).mapInPandas(run, "ids binary, clusters binary, vectors binary" + ", least binary" * asked))


def _reachable(it: Iterator[pd.DataFrame], centres: np.ndarray, radius: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row of each query for each cluster, its own left out, that may hold a score of its `least` or more."""
    for pdf in it:
        if len(pdf):
            q = np.stack(pdf["v"].to_numpy())
            length = np.sqrt((q**2).sum(1))[:, None]
            slack = 1e-9 * (1 + length * (np.sqrt((centres**2).sum(1)) + radius)) + 1e-9
            bound = q @ centres.T + length * radius + slack
            open_ = (radius >= 0) & ~(bound < pdf["least"].to_numpy(float)[:, None])  # without a least score, any
            open_[np.arange(len(q)), pdf["cluster"]] = False
            queries, clusters = np.nonzero(open_)
            for at in range(0, len(queries), BLOCK):  # a batch of queries has up to CLUSTERS rows for each
                i, c = queries[at : at + BLOCK], clusters[at : at + BLOCK]
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "cluster": c.astype(np.int32)})


def _nearest(asked: DataFrame, held: DataFrame, centres: np.ndarray, k: int, blocks: int, others: bool) -> DataFrame:
    """The k best rows of held (packed) for each row of asked in its own cluster or, of those of its `least` score or
    more, in all others. Every block of queries meets every part of the index; both are read where they were written, so
    that no vector is shuffled for it."""
    units = _packed(asked, blocks).hint("shuffle_replicate_nl").crossJoin(held.toDF("held_ids", "held_clusters", "held_vectors"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples(index=False):
                q_ids, ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.held_ids, np.int64)
                q, x = (np.frombuffer(v, f"f{len(v) // (n * centres.shape[1])}").reshape(n, -1).astype(float) for v, n in ((r.vectors, len(q_ids)), (r.held_vectors, len(ids))))
                own, cluster, least = np.frombuffer(r.clusters, np.int32), np.frombuffer(r.held_clusters, np.int32), np.frombuffer(r.least)
                ends = np.searchsorted(cluster, np.arange(len(centres) + 1))
                radius = np.array([np.sqrt(((x[i:j] - c) ** 2).sum(1).max()) if i < j else -1.0 for c, i, j in zip(centres, ends, ends[1:])])
                for at in range(0, len(q), SCORE_ROWS):
                    some = slice(at, at + SCORE_ROWS)
                    pairs = pd.DataFrame({"id": np.arange(len(q[some])), "v": list(q[some]), "cluster": own[some], "least": least[some]})
                    pairs = [p[["id", "cluster"]].to_numpy() for p in (_reachable(iter([pairs]), centres, radius) if others else [pairs])]
                    if pairs:
                        i, neighbour, score = _met(np.concatenate(pairs), q_ids[some], q[some], least[some], ids, x, ends, k)
                        yield pd.DataFrame({"query_id": q_ids[some][i], "neighbour_id": neighbour, "score": score})

    return _ranked(units.mapInPandas(run, "query_id long, neighbour_id long, score double"), k)


def _met(pairs: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, neighbour, score): the k best of each query among the clusters that it is paired with. A query's bar is
    its least score, then the k-th of those found; what is under it is left out before it is sorted."""
    bar = np.where(np.isnan(least), -np.inf, least)
    found, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
    for rows in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 1])) + 1):
        i, own = rows[:, 0], slice(*ends[rows[0, 1] : rows[0, 1] + 2]) if len(rows) else slice(0, 0)
        if own.start == own.stop:
            continue
        scores = q[i] @ x[own].T
        scores[q_ids[i, None] == ids[own]] = -np.inf
        over = bar[i]
        if k < scores.shape[1] and np.isinf(over).any():
            over = np.maximum(over, np.partition(scores, -k, axis=1)[:, -k])
        a, b = np.nonzero((scores >= over[:, None] - 1e-9) & (scores > -np.inf))  # scores count by their ninth place
        found.append((i[a], ids[own][b], np.round(scores[a, b], 9)))
        waiting += len(a)
        if waiting > 4 * k * len(q):
            who, _, score = best = _top(*(np.concatenate(c) for c in zip(*found)), k)
            found, waiting = [best], 0
            last = np.searchsorted(who, np.arange(len(q)), "right") - 1
            full = np.bincount(who, minlength=len(q)) >= k
            bar[full] = np.maximum(bar[full], score[last[full]])
    return _top(*(np.concatenate(c) for c in zip(*found)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _top(query: np.ndarray, neighbour: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each query, ties by neighbour."""
    order = np.lexsort((neighbour, -score, query))
    query, neighbour, score = query[order], neighbour[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    keep = rank < k
    return query[keep], neighbour[keep], score[keep]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \\t\\n]+"), lambda w: F.length(w) > 0)


def bm25(queries: DataFrame, index: DataFrame, query_id: str, doc_id: str, text: str, k: int, k1: float = 1.5, b: float = 0.75, rare: int = OFTEN, salt_docs: int = BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by Okapi BM25, ties by id.

    Document frequencies and lengths cover all documents. A query word counts as often as it occurs. A null text has no
    words. Rows that share an id are one document, whose contributions are added.

    Documents are dealt once into units of about `salt_docs` (fewer where texts are long), in which their words meet those
    of the queries; a unit's postings are one row of flat arrays, written once. Frequencies are sums over units. Each
    block of queries then meets each unit, which scores every document that shares a word and hands on its k best a query,
    so that no row of a word and a document, or of a query and a document, is ever shuffled. Words of more than `rare`
    documents are added as one matrix product, others posting by posting.
    """
    spark = index.sparkSession
    ship(spark)
    docs = index.select(F.col(doc_id).alias("d"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    asked = queries.select(F.col(query_id).alias("q"), F.explode(tokens(F.col(text))).alias("word")).groupBy("q", "word").agg(F.count("*").alias("qf"))
    asked = cut(asked)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    units = max(1, -(-size.n // salt_docs), -(-(size.chars or 0) // UNIT_CHARS))
    words = asked.select("word").distinct()
    slots = max(1, -(-words.count() // UNIT_WORDS))
    blocks = max(1, -(-asked.select("q").distinct().count() // BLOCK))

    def everywhere(rows: DataFrame, slot: str, n: int) -> DataFrame:
        return rows.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def dealt(rows: DataFrame, slot: str, key: str, n: int) -> DataFrame:
        return rows.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))

    texts, parts = everywhere(dealt(docs, "xs", "d", units), "vs", slots), everywhere(dealt(words, "vs", "word", slots), "xs", units)
    kind, asker = (df.schema[c].dataType.simpleString() for df, c in ((docs, "d"), (asked, "q")))
    post = texts.groupBy("xs", "vs").cogroup(parts.groupBy("xs", "vs")).applyInArrow(_inverted, f"xs int, vs int, n long, total long, ids array<{kind}>, words array<string>, df array<long>, at array<int>, tf array<int>, len array<int>")
    post = cut(post)
    stats = post.where("vs = 0").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean")).first()  # two numbers
    found = post.select(F.explode(F.arrays_zip("words", "df")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.df").alias("df"))
    idf = F.log((F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = asked.join(found, "word").select("q", "word", (F.col("qf") * idf).alias("u"), (F.col("df") > rare).alias("often"))
    near = _scored(everywhere(dealt(asked, "qs", "q", blocks), "xs", units), everywhere(post.drop("n", "total"), "qs", blocks), k, k1, b, stats.mean, f"q {asker}, d {kind}, part double")
    scored = near.withColumn("score", F.round("part", 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), "rank", F.col("d").alias(doc_id), "score")


def _inverted(texts: pa.Table, words: pa.Table) -> pa.Table:
    """One row: a unit's ids in their order and, for those of the words that occur, the documents (places of ids), counts
    and lengths of the documents, of which rows of one id and length are one."""
    vocabulary = words["word"].to_pylist()
    code = {w: i for i, w in enumerate(vocabulary)}
    entries: dict[tuple, int] = {}
    codes, at, total = [np.zeros(0, np.int64)], [], 0
    for d, text in zip(texts["d"].to_pylist(), texts["text"].to_pylist()):
        split = text.replace("\t", " ").replace("\n", " ").split(" ")
        length = len(split) - split.count("")
        total += length
        at.append(entries.setdefault((d, length), len(entries)))
        found = np.fromiter(map(code.get, split, repeat(-1)), np.int64, len(split))
        codes.append(found[found >= 0])
    kept = sorted(entries, key=lambda e: (e[0] is not None, *(e[:1] if e[0] is not None else ()), e[1]))
    ids = list(dict.fromkeys(d for d, _ in kept))
    place = {d: i for i, d in enumerate(ids)}
    order = np.zeros(len(kept), np.int64)
    order[[entries[e] for e in kept]] = np.arange(len(kept))
    who = np.repeat(order[at], [len(c) for c in codes[1:]]) if at else np.zeros(0, np.int64)
    pairs, tf = np.unique(np.concatenate(codes) * max(len(kept), 1) + who, return_counts=True)
    word, entry = np.divmod(pairs, max(len(kept), 1))
    used, df = np.unique(word, return_counts=True)
    values = {
        "xs": words["xs"][0] if len(words) else texts["xs"][0], "vs": words["vs"][0] if len(words) else texts["vs"][0], "n": len(at), "total": total, "ids": ids, "words": [vocabulary[i] for i in used],
        "df": df, "at": np.array([place[d] for d, _ in kept], np.int64)[entry], "tf": tf, "len": np.array([n for _, n in kept], np.int64)[entry],
    }
    kinds = {"xs": pa.int32(), "vs": pa.int32(), "n": pa.int64(), "total": pa.int64(), "ids": pa.list_(texts.schema.field("d").type), "words": pa.list_(pa.string()), "df": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "tf": pa.list_(pa.int32()), "len": pa.list_(pa.int32())}
    out = pa.table({c: pa.array([values[c].as_py() if isinstance(values[c], pa.Scalar) else values[c]], kind) for c, kind in kinds.items()})
    return out if len(at) else out.slice(0, 0)


def _scored(asked: DataFrame, post: DataFrame, k: int, k1: float, b: float, mean: float, schema: str) -> DataFrame:
    """(q, d, part): the k best scores of each query in each unit, by the words asked (q, word, u, often) and the postings."""

    def weights(rows: list[dict]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for r in rows:
            df, at, tf, length = (np.asarray(r[c]) for c in ("df", "at", "tf", "len"))
            g = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            ends = np.cumsum(df)
            for w, i, j in zip(r["words"], ends - df, ends):
                first = np.flatnonzero(np.diff(at[i:j], prepend=-1))  # documents of one id lie side by side
                yield w, at[i:j][first], np.add.reduceat(g[i:j], first)

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        kinds = [asking.schema.field("q").type, held.schema.field("ids").type.value_type, pa.float64()]
        found: list[tuple] = [([], [], np.zeros(0))]
        if len(held) and len(asking):
            rows = [{c: held[c][i].values.to_numpy(False) if c in ("df", "at", "tf", "len") else held[c][i].as_py() for c in held.column_names} for i in range(len(held))]
            ids, postings = rows[0]["ids"], {w: (at, g) for w, at, g in weights(rows)}
            by_query: dict = {}
            for q, word, u, often in zip(*(asking[c].to_pylist() for c in ("q", "word", "u", "often"))):
                if word in postings:
                    by_query.setdefault(q, []).append((word, u, often))
            names = list(by_query)
            for start in range(0, len(names), SCORE_ROWS):
                part = names[start : start + SCORE_ROWS]
                scores, many, few = np.zeros((len(part), len(ids))), {}, {}
                for i, q in enumerate(part):
                    for word, u, often in by_query[q]:
                        (many if often else few).setdefault(word, []).append((i, u))
                for word, pairs in few.items():
                    (at, g), (i, u) = postings[word], zip(*pairs)
                    scores[np.ix_(i, at)] += np.outer(u, g)
                if many:
                    left, right = np.zeros((len(part), len(many))), np.zeros((len(many), len(ids)))
                    for j, (word, pairs) in enumerate(many.items()):
                        (at, g), (i, u) = postings[word], zip(*pairs)
                        left[list(i), j], right[j, at] = u, g
                    scores += left @ right
                shares = scores > 0
                scores = np.round(scores, 6)
                least = np.partition(scores, -k, axis=1)[:, -k] if k < len(ids) else np.zeros(len(part))
                i, j = np.nonzero(shares & (scores >= least[:, None]))
                i, j, best = _top(i, j, scores[i, j], k)
                found.append(([part[x] for x in i], [ids[x] for x in j], best))
        columns = [[x for f in found for x in f[0]], [x for f in found for x in f[1]], np.concatenate([f[2] for f in found])]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["q", "d", "part"])

    unit = ["xs", "qs"]
    return post.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(run, schema)


def previous_k(rows: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """rows with the k values before each, oldest first; the first ones are padded from the end of their key."""
    w = Window.partitionBy(key).orderBy(order)
    n, at = F.count("*").over(Window.partitionBy(key)), F.row_number().over(w)
    before = F.collect_list(value).over(w.rowsBetween(-k, -1))
    tail = F.slice(F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), -F.least(n, F.lit(k)), k)
    short = F.greatest(F.least(n, F.lit(k)) - F.size("__before"), F.lit(0))
    out = rows.withColumn("__before", before).withColumn("__tail", tail).withColumn("__at", at)
    pad = F.when(short > 0, F.slice("__tail", -F.greatest(short, F.lit(1)), F.greatest(short, F.lit(1)))).otherwise(F.slice("__tail", F.lit(1), F.lit(0)))
    return out.withColumn("previous", F.concat(pad, F.col("__before"))).drop("__before", "__tail", "__at")


def sliding_blocks(rows: DataFrame, key: str, length: str, block: int = 1900, stride: int = 512) -> DataFrame:
    """(key, block, start, end, n_new): floor((n - block) / stride) + 1 blocks, of which only new places count."""
    n = F.col(length)
    count = F.when(n >= block, F.floor((n - block) / stride) + 1).otherwise(F.when(n > 0, 1).otherwise(0)).cast("int")
    out = rows.withColumn("__count", count).where("__count > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    start = F.col("block") * stride
    end = F.least(start + block, n)
    return out.select(key, "block", start.alias("start"), end.alias("end"), F.when(F.col("block") == 0, end).otherwise(F.lit(stride)).alias("n_new"))


def dpp(candidates: DataFrame, query: str, item: str, relevance: str, vector: str, k: int, scale: float = 0.1) -> DataFrame:
    """(query, rank, item): a diverse choice of k by greedy maximum a posteriori inference, then by relevance.

    One task for each query's candidates, whose number the caller bounds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item).reset_index(drop=True)
        v = np.stack(pdf[vector].to_numpy()).astype(float)
        near = (v @ v.T + 1) / 2
        r = np.exp(pdf[relevance].to_numpy() / (2 * scale))
        kernel = r[:, None] * near * r[None, :]
        gain, basis, chosen = np.diag(kernel).copy(), np.zeros((0, len(v))), []
        while len(chosen) < min(k, len(v)):
            j = int(gain.argmax())
            if gain[j] < 1e-10:
                break
            chosen.append(j)
            e = (kernel[j] - basis[:, j] @ basis) / np.sqrt(gain[j])
            basis = np.vstack([basis, e])
            gain = gain - e**2
            gain[j] = -np.inf
        chosen.sort(key=lambda j: (-pdf[relevance][j], pdf[item][j]))
        return pd.DataFrame({query: [pdf[query][0]] * len(chosen), "rank": range(1, len(chosen) + 1), item: pdf[item][chosen].to_numpy()})

    return candidates.groupBy(query).applyInPandas(run, f"{query} long, rank int, {item} long")


def vote_k(neighbours: DataFrame, items: DataFrame, item: str, select: int, threshold: float = 1.0, seed: int = 0) -> DataFrame:
    """(rank, item): items by falling number of voters, ties by id, without those of whose voters a share of at least
    `threshold` voted for any one earlier item, taken or not; filled up to `select` from the rest by a hash of seed and id.

    neighbours: (query_id, neighbour_id), a vote each; rows that repeat are one vote. items: all that can be chosen. Since
    every earlier item counts, an item is judged by itself: it meets others only through the few votes of each voter it has.
    """
    votes = cut(neighbours.select("query_id", "neighbour_id").distinct())  # retrieval runs once, however often votes are read
    many = votes.groupBy("neighbour_id").agg(F.count("*").alias("voters"))
    own = votes.join(many, "neighbour_id")
    # a voter's votes, each with the items voted for more often; their number is what retrieval gave a query
    ballots = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("voters")).alias("order"), "neighbour_id"))).alias("votes"))
    placed = ballots.select("votes", F.posexplode("votes").alias("at", "v"))
    shared = placed.select("v.neighbour_id", F.explode(F.slice("votes", F.lit(1), F.col("at"))).alias("before"))
    shared = shared.groupBy("neighbour_id", "before.neighbour_id").count().toDF("item", "before", "shared")
    most = shared.groupBy("item").agg(F.max("shared").alias("shared"))
    voted = many.withColumnRenamed("neighbour_id", "item").join(most, "item", "left")
    taken = cut(voted.where(F.coalesce("shared", F.lit(0)) < threshold * F.col("voters")).orderBy(F.desc("voters"), "item").limit(select))
    # at most `select` rows of either kind: the drawn ones take the ranks after the last
    rest = items.select(F.col(item).cast("long").alias("item")).distinct().join(taken.select("item"), "item", "left_anti")
    rest = rest.orderBy(F.xxhash64(F.lit(seed), "item"), "item").limit(select)
    both = taken.select("voters", "item", F.lit(0).alias("drawn")).unionByName(rest.select(F.lit(0).alias("voters"), "item", F.lit(1).alias("drawn")))
    order = Window.orderBy("drawn", F.desc("voters"), F.when(F.col("drawn") == 1, F.xxhash64(F.lit(seed), "item")), "item")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= select).select("rank", "item")


def fixed_k(queries: DataFrame, query: str, items: list[int]) -> DataFrame:
    """(query, rank, item): the same items for every query; none of them for an empty list."""
    each = F.array(*[F.struct(F.lit(k + 1).alias("rank"), F.lit(i).cast("long").alias("item")) for k, i in enumerate(items)])
    if not items:
        return queries.select(query, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("item")).limit(0)
    return queries.select(query, F.explode(each).alias("x")).select(query, "x.rank", "x.item")


def least_description(candidates: DataFrame, query: str, subset: str, loss: str) -> DataFrame:
    """(query, subset, loss): of a query's candidate subsets of examples the one under which a language model's loss, given
    as a column, is least; ties by subset."""
    best = candidates.groupBy(query).agg(F.min_by(F.struct(subset, loss), F.struct(F.col(loss), F.col(subset))).alias("b"))
    return best.select(query, f"b.{subset}", f"b.{loss}")
