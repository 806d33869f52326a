"""Questions asked several times: rotations of their options, replicas, and orders of a pair."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.aggregates import mean_weighted


def patterns(options: str = "ABCD", kind: str = "circular") -> list[str]:
    """Orders of the options: the origin, all rotations, or all permutations."""
    if kind == "origin":
        return [options]
    if kind == "circular":
        return [options[i:] + options[:i] for i in range(len(options))]
    if kind == "all":
        return ["".join(p) for p in permutations(options)]
    raise ValueError(f"unknown kind of patterns {kind!r}")


def rotate_options(rows: DataFrame, qid: str, answer: str, options: str = "ABCD", kind: str = "circular") -> DataFrame:
    """Each row once for each pattern, with columns pattern and qid: what option i said stands under the pattern's i-th
    letter, and the answer follows; an answer that is no option stays."""
    kinds = F.array(*map(F.lit, patterns(options, kind)))
    out = rows.withColumn("qid", F.col(qid)).withColumn("pattern", F.explode(kinds))
    place = lambda letter: F.locate(letter, F.col("pattern"))
    texts = F.array(*[F.col(o) for o in options])
    moved = {o: F.element_at(texts, place(o)) for o in options}
    at = F.instr(F.lit(options), F.col(answer))
    follows = F.when((F.length(answer) == 1) & (at > 0), F.substring(F.col("pattern"), at, F.lit(1))).otherwise(F.col(answer))
    return out.select(*[moved.get(c, follows.alias(c) if c == answer else F.col(c)).alias(c) for c in out.columns])


def circular_metrics(rows: DataFrame, qid: str, prediction: str, answer: str, pattern: str, options: str = "ABCD") -> DataFrame:
    """(metric, value) in percent: acc_1 and acc_n over patterns, more_i_j (questions with at least j of i right), perf_i
    (all right), vote_i (the option most voted for, first seen on ties by letter, is right) and prior_X (how often a
    letter is predicted).

    i is 1 for the original order and n for all rotations. Rows are aggregated to one a question, then to one.
    """
    n, origin = len(options), options
    cycle = patterns(options)
    right = (F.coalesce(F.col(prediction), F.lit("")) == F.col(answer)).cast("int")
    said = F.instr(F.lit(options), F.col(prediction))
    known = F.coalesce((F.length(prediction) == 1) & (said > 0), F.lit(False))
    # back to the question's own letters: the pattern's letter at the predicted option's place
    back = F.when(known, F.substring(F.col(pattern), said, F.lit(1))).otherwise("-")
    truth = F.substring(F.col(pattern), F.instr(F.lit(options), F.col(answer)), F.lit(1))
    sets = {1: F.col(pattern) == origin, n: F.col(pattern).isin(*cycle)}
    votes = [F.sum((sets[i] & (back == o)).cast("int")).alias(f"v{i}{o}") for i in sets for o in (*options, "-")]
    hits = [F.sum(F.when(sets[i], right).otherwise(0)).alias(f"h{i}") for i in sets]
    priors = [F.sum((F.when(known, F.col(prediction)).otherwise("-") == o).cast("int")).alias(f"p{o}") for o in (*options, "-")]
    each = rows.groupBy(qid).agg(*hits, *votes, *priors, F.count("*").alias("rows"), F.min(truth).alias("truth"))
    best = {i: F.array_max(F.array(*[F.struct(F.col(f"v{i}{o}").alias("n"), F.lit(-k).alias("k"), F.lit(o).alias("o")) for k, o in enumerate((*options, "-"))]))["o"] for i in sets}
    total = F.sum("rows")
    out = [(F.sum(f"h{i}") / total * n / i * 100).alias(f"acc_{i}") for i in sets]
    out += [(F.avg((F.col(f"h{i}") >= j).cast("double")) * 100).alias(f"more_{i}_{j}") for i in sets for j in range(i + 1)]
    out += [(F.avg((F.col(f"h{i}") >= i).cast("double")) * 100).alias(f"perf_{i}") for i in sets]
    out += [(F.avg((best[i] == F.col("truth")).cast("double")) * 100).alias(f"vote_{i}") for i in sets]
    out += [(F.sum(f"p{o}") / total * 100).alias(f"prior_{o}") for o in (*options, "-")]
    wide = each.agg(*out)
    return wide.unpivot([], wide.columns, "metric", "value")


def replica_scores(rows: DataFrame, subdivision: str, item: str, score: str, n: int) -> DataFrame:
    """(subdivision, score, n_items) in percent over items that must have n replicas each, and over all (null); an item with
    another number raises when its row is read."""
    items = rows.groupBy(subdivision, item).agg(F.avg(score).alias("s"), F.count("*").alias("r"))
    checked = F.when(F.col("r") == n, F.col("s")).otherwise(F.raise_error(F.concat(F.lit(f"not {n} replicas: "), F.col(item).cast("string"))).cast("double"))
    items = items.select(subdivision, checked.alias("s"))
    kind = rows.schema[subdivision].dataType
    agg = [(100 * F.avg("s")).alias("score"), F.count("*").alias("n_items")]
    return items.groupBy(subdivision).agg(*agg).unionByName(items.agg(*agg).select(F.lit(None).cast(kind).alias(subdivision), "score", "n_items"))


def weighted_pass(rows: DataFrame, item: str, passed: str, weight: str, k: int) -> DataFrame:
    """One row: the weighted mean over items of pass@k of their samples; items with fewer than k samples are an error."""
    from scorewright.operators.aggregates import pass_at_k

    items = rows.groupBy(item).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("c"), F.max(weight).alias("w"))
    value = F.coalesce(pass_at_k(F.col("n"), F.col("c"), k), F.raise_error(F.concat(F.lit(f"fewer than {k} samples: "), F.col(item).cast("string"))).cast("double"))
    return items.select(value.alias("p"), "w").agg(mean_weighted("p", "w").alias("pass"), F.count("*").alias("n_items"))


def mean_g_pass(n: Column, c: Column, k: int) -> Column:
    """Twice the mean over i from ceil(k/2)+1 to k of the chance that at least i of k draws are right, by k."""
    from scorewright.operators.aggregates import g_pass_at_k

    low = -(-k // 2)
    terms = [g_pass_at_k(n, c, k, (i - 0.5) / k) for i in range(low + 1, k + 1)]
    return 2.0 * sum(terms[1:], terms[0]) / k if terms else F.lit(0.0)


def both_orders(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Each pair in both orders with columns shown_first, shown_second and swapped, as a judge sees it twice."""
    out = pairs.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    return out.withColumn("shown_first", F.when(F.col("swapped"), F.col(second)).otherwise(F.col(first))).withColumn("shown_second", F.when(F.col("swapped"), F.col(first)).otherwise(F.col(second)))


def random_order(pairs: DataFrame, key: str, first: str, second: str, seed: int = 0) -> DataFrame:
    """Each pair in an order drawn by a hash of seed and key."""
    from scorewright.operators.sampling import uniform

    out = pairs.withColumn("swapped", uniform(seed, key) < 0.5)
    return out.withColumn("shown_first", F.when(F.col("swapped"), F.col(second)).otherwise(F.col(first))).withColumn("shown_second", F.when(F.col("swapped"), F.col(first)).otherwise(F.col(second)))
