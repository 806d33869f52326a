"""Readers of result records: ragged JSON, JSONL, delimited tables and agent harness results, as long score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.text import correctness

#: Keys of a record map that are not items, and where a record's id and verdict are looked for, in order. Fixed values.
META_KEYS = ("type", "meta", "metadata")
ID_KEYS = ("example_abbr", "instance_id", "id", "index", "task_id", "example_id", "reference")
VERDICT_KEYS = ("voted_correctness", "any_correct", "is_correct", "hit", "if_right")


def _first(json, keys) -> F.Column:
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def _id(json) -> F.Column:
    """A record's id; of a list its first element."""
    value = _first(json, ID_KEYS)
    return F.coalesce(F.get_json_object(value, "$[0]"), value)


def _verdict(json) -> F.Column:
    """A verdict may be a list, of which the first element counts, or a map's bare value."""
    value = _first(json, VERDICT_KEYS)
    head = F.coalesce(F.get_json_object(value, "$[0]"), value)
    return F.when(F.ltrim(head).startswith('"'), correctness(F.regexp_replace(head, '^"|"$', ""))).otherwise(correctness(head, numbers=True))


def read_models(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """(model, item, score) of <root>/<model>/<dataset>.json files, whose details are a map, a list or the top level.

    score is null where the record has no verdict.
    """
    files = spark.read.text(f"{root}/*/{dataset}.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("model"), F.col("value").alias("json"))
    body = F.coalesce(F.get_json_object("json", "$.details"), F.col("json"))
    rows = files.select("model", body.alias("body")).withColumn("is_list", F.ltrim("body").startswith("["))
    of_map = rows.where("not is_list").select("model", F.explode(F.from_json("body", "map<string,string>")).alias("item", "record"))
    of_map = of_map.where(~F.lower("item").isin(*META_KEYS))
    verdict = F.when(F.ltrim("record").startswith("{"), _verdict(F.col("record"))).otherwise(correctness(F.col("record"), numbers=True))
    of_map = of_map.select("model", "item", verdict.cast("double").alias("score"))
    of_list = rows.where("is_list").select("model", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "record"))
    of_list = of_list.select("model", F.coalesce(_id(F.col("record")), F.col("pos").cast("string")).alias("item"), _verdict(F.col("record")).cast("double").alias("score"))
    return of_map.unionByName(of_list)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """(item, weight) of a JSONL subset; its id is question_id, id or index."""
    rows = spark.read.schema("question_id string, id string, index string, weight double").json(path)
    return rows.select(F.coalesce("question_id", "id", "index").alias("item"), "weight")


def subset_faults(subset: DataFrame, universe: DataFrame) -> DataFrame:
    """(fault, item): ids that repeat, ids the universe lacks, and weights that are missing or negative."""
    twice = subset.groupBy("item").count().where("count > 1").select(F.lit("duplicate").alias("fault"), "item")
    lost = subset.select("item").distinct().join(universe.select("item"), "item", "left_anti").select(F.lit("unknown").alias("fault"), "item")
    bad = subset.where("weight is null or weight < 0").select(F.lit("weight").alias("fault"), "item")
    return twice.unionByName(lost).unionByName(bad)


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A table by its suffix: csv and tsv (cells stay strings, quotes may span lines), json, jsonl, parquet or xlsx
    (the active sheet)."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True, multiLine=True, escape='"')
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        from scorewright.sources.workbooks import read_xlsx

        return read_xlsx(spark, path)
    raise ValueError(f"no reader for {path}")


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists") -> None:
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    w = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        w.csv(path, sep="\t" if kind == "tsv" else ",", header=True, escape='"')
    elif kind in ("json", "jsonl"):
        w.json(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"no writer for {path}")


def merge_shards(shards: DataFrame, shard: str, place: str) -> DataFrame:
    """shards with idx: the place within the whole, by the sizes of the shards before."""
    from pyspark.sql import Window

    sizes = shards.groupBy(shard).agg(F.count("*").alias("__n"))
    before = sizes.select(shard, F.coalesce(F.sum("__n").over(Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return shards.join(F.broadcast(before), shard).withColumn("idx", F.col("__before") + F.col(place)).drop("__before")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))


def tau2_results(spark: SparkSession, path: str, eps: float = 1e-6) -> DataFrame:
    """(task_id, score, errored): success is a reward of at least 1 - eps, averaged over trials; a task of which no
    trial has a reward is errored."""
    sims = _text(spark, path).select(F.explode(F.from_json(F.get_json_object("json", "$.simulations"), "array<struct<task_id:string,reward_info:struct<reward:double>>>")).alias("s"))
    hit = F.when(F.col("s.reward_info.reward").isNotNull(), (F.col("s.reward_info.reward") >= 1 - eps).cast("double"))
    return sims.groupBy(F.col("s.task_id").alias("task_id")).agg(F.avg(hit).alias("score")).withColumn("errored", F.col("score").isNull())


def swe_bench_results(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, score, errored) of summary reports: resolved 1, all others 0; error ids are 0 and flagged. The first
    of resolved, unresolved, error and empty patch that names an id decides."""
    kinds = (("resolved_ids", 1.0), ("unresolved_ids", 0.0), ("error_ids", 0.0), ("empty_patch_ids", 0.0))
    rows = _text(spark, path)
    each = [rows.select(F.explode(F.from_json(F.get_json_object("json", f"$.{k}"), "array<string>")).alias("task_id"), F.lit(i).alias("o"), F.lit(s).alias("s"), F.lit(k == "error_ids").alias("e")) for i, (k, s) in enumerate(kinds)]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.groupBy("task_id").agg(F.min_by("s", "o").alias("score"), F.max("e").alias("errored"))


def swe_bench_pro_results(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, score, errored) of a map from ids to booleans; another value raises when the rows are read."""
    rows = _text(spark, path).select(F.explode(F.from_json("json", "map<string,string>")).alias("task_id", "v"))
    score = F.when(F.col("v") == "true", 1.0).when(F.col("v") == "false", 0.0)
    score = F.coalesce(score, F.raise_error(F.concat(F.lit("not a boolean: "), F.col("task_id"), F.lit(" = "), F.coalesce("v", F.lit("null")))).cast("double"))
    return rows.select("task_id", score.alias("score"), F.lit(False).alias("errored"))


def terminal_bench_results(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    """(task_id, score, errored) of trial files: share of trials with a reward of at least the threshold."""
    rows = _text(spark, path).select(F.get_json_object("json", "$.task_name").alias("task_id"), F.get_json_object("json", "$.verifier_result.rewards.reward").cast("double").alias("r"))
    hit = F.when(F.col("r").isNotNull(), (F.col("r") >= threshold).cast("double"))
    return rows.where("task_id is not null").groupBy("task_id").agg(F.avg(hit).alias("score")).withColumn("errored", F.col("score").isNull())


def osworld_results(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, score, errored) of a map domain -> id -> score: clamped to [0, 1]; what is no finite number is errored."""
    rows = _text(spark, path).select(F.explode(F.from_json("json", "map<string,map<string,string>>")).alias("domain", "m")).select(F.explode("m").alias("task_id", "v"))
    x = F.when(F.lower("v").isin("true", "false"), (F.lower("v") == "true").cast("double")).otherwise(F.col("v").try_cast("double"))
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return rows.select("task_id", x.alias("score")).groupBy("task_id").agg(F.avg("score").alias("score")).withColumn("errored", F.col("score").isNull())


def toolathlon_results(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, score, errored) of <task>/eval_res.json files with a boolean pass."""
    rows = _text(spark, path)
    task = F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^SingleUserTurn-", "")
    v = F.get_json_object("json", "$.pass")
    score = F.when(v == "true", 1.0).when(v == "false", 0.0)
    return rows.select(task.alias("task_id"), score.alias("score")).groupBy("task_id").agg(F.avg("score").alias("score")).withColumn("errored", F.col("score").isNull())
