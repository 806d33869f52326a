"""Results of agent harnesses, from their files and folders, as (task_id, score, errored).

A score is the mean over a task's trials; a task of which no trial has a score is errored, with a null score. Files that
aren't what the harness writes raise when the rows are read, but for files of no bytes, which Spark's readers pass over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.text import whole_number

#: Rewards from which on a trial counts as a success, how close to 1 is, and the prefix of task folders. Fixed values.
SUCCESS_REWARD, NEARLY, USER_TURN = 0.5, 1e-6, "SingleUserTurn-"
#: Arguments that restrict a harness to tasks: before each of them, or before all. Fixed values.
EACH_TASK = {"terminal_bench": "-i"}
ALL_TASKS = {"swe_bench": "--instance_ids", "tau2": "--task-ids"}
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def task_args(harness: str, tasks: Sequence[str]) -> list[str]:
    """Command line arguments for some tasks; a harness without such a filter raises."""
    if harness in EACH_TASK:
        return [x for t in tasks for x in (EACH_TASK[harness], t)]
    if harness in ALL_TASKS:
        return [ALL_TASKS[harness], *tasks]
    raise ValueError(f"{harness} has no task filter")


def task_domains(tasks: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, tasks): sorted tasks by domain, as a harness without a filter reads them; a task without one raises."""
    both = tasks.select("task_id").join(domains.select("task_id", "domain"), "task_id", "left")
    known = F.coalesce("domain", F.raise_error(F.concat(F.lit("no domain for "), F.col("task_id"))))
    return both.select(known.alias("domain"), "task_id").groupBy("domain").agg(F.array_sort(F.collect_list("task_id")).alias("tasks"))


def files(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file, body) of a file, or of a folder's files of these names at any depth."""
    reader = spark.read.option("wholetext", True)
    if not path.endswith((".json", ".txt")):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return reader.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def checked_json(rows: DataFrame) -> DataFrame:
    """rows; one whose body is no JSON raises."""
    fine = F.get_json_object("body", "$").isNotNull()
    return rows.withColumn("body", F.when(fine, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("cannot read "), F.col("file"))).cast("string")))


def _refuse(rows: DataFrame, known: Column, what: str) -> DataFrame:
    return rows.withColumn("body", F.when(known, F.col("body")).otherwise(F.raise_error(F.concat(F.lit(f"not {what}: "), F.col("file"))).cast("string")))


def averaged(trials: DataFrame) -> DataFrame:
    """trials (task_id, score or null) as one row a task."""
    return trials.groupBy("task_id").agg(F.avg("score").alias("score")).withColumn("errored", F.col("score").isNull())


def swe_bench(spark: SparkSession, path: str) -> DataFrame:
    """A summary report, a list of instances, a merged report, or a folder of <instance>/report.json. Ids in error count 0
    and are flagged."""
    rows = checked_json(files(spark, path, "report.json"))
    summary, listed = F.get_json_object("body", "$.resolved_ids").isNotNull(), F.get_json_object("body", "$.results").startswith("[")
    merged = F.from_json("body", "map<string,struct<resolved:boolean>>")
    reports = F.coalesce(~summary & ~F.coalesce(listed, F.lit(False)) & (F.size(merged) > 0) & F.forall(F.map_values(merged), lambda v: v.isNotNull() & v["resolved"].isNotNull()), F.lit(False))
    rows = _refuse(rows, summary | F.coalesce(listed, F.lit(False)) | reports, "a result of this harness").withColumns({"s": summary, "l": F.coalesce(listed, F.lit(False))})
    kinds = [(k, s, F.lit(k == "error_ids")) for k, s in (("resolved_ids", 1.0), ("unresolved_ids", 0.0), ("error_ids", 0.0), ("empty_patch_ids", 0.0))]
    parts = [rows.where("s").select(F.explode(F.from_json(F.get_json_object("body", f"$.{k}"), "array<string>")).alias("task_id"), F.lit(i).alias("o"), F.lit(s).alias("score"), e.alias("errored")) for i, (k, s, e) in enumerate(kinds)]
    each = rows.where("l").select(F.explode(F.from_json(F.get_json_object("body", "$.results"), "array<struct<instance_id:string,correct:string>>")).alias("r"))
    value = F.when(F.lower("r.correct").isin("true", "false"), (F.lower("r.correct") == "true").cast("double")).otherwise(whole_number(F.col("r.correct")))
    value = F.coalesce(F.when(F.col("r.instance_id").isNotNull(), value), F.raise_error(F.concat(F.lit("bad results row: "), F.to_json("r"))).cast("double"))
    parts.append(each.select(F.col("r.instance_id").alias("task_id"), F.lit(9).alias("o"), value.alias("score"), F.lit(False).alias("errored")))
    one = rows.where("not s and not l").select(F.explode(F.from_json("body", "map<string,struct<resolved:boolean>>")).alias("task_id", "v"))
    parts.append(one.select("task_id", F.lit(9).alias("o"), F.col("v.resolved").cast("double").alias("score"), F.lit(False).alias("errored")))
    return reduce(DataFrame.unionByName, parts).groupBy("task_id").agg(F.min_by("score", "o").alias("score"), F.max("errored").alias("errored"))


def terminal_bench(spark: SparkSession, path: str, threshold: float = SUCCESS_REWARD) -> DataFrame:
    """A job's result.json, a trial's, or a folder of both. A job lists the trials with a reward by that reward; where there
    is one, trials of their own only tell which crashed, so that none counts twice."""
    rows = checked_json(files(spark, path, "result.json")).withColumn("evals", F.get_json_object("body", "$.stats.evals"))
    jobs = rows.where("evals is not null").select(F.explode(F.from_json("evals", "map<string,struct<reward_stats:struct<reward:map<string,array<string>>>>>")).alias("e", "v"))
    jobs = jobs.select(F.explode("v.reward_stats.reward").alias("reward", "trials")).select(F.col("reward").cast("double").alias("reward"), F.explode("trials").alias("trial"))
    scored = jobs.select(F.regexp_replace("trial", "__(?!.*__).*$", "").alias("task_id"), "reward")
    own = rows.where("evals is null").select(F.get_json_object("body", "$.task_name").alias("task_id"), F.get_json_object("body", "$.verifier_result.rewards.reward").cast("double").alias("reward")).where("task_id is not null")
    job = F.broadcast(rows.agg(F.max(F.col("evals").isNotNull()).alias("job")))
    crashed = own.crossJoin(job).where("not job or reward is null").drop("job")
    hit = F.when(F.col("reward").isNotNull(), (F.col("reward") >= threshold).cast("double"))
    return averaged(scored.unionByName(crashed).select("task_id", hit.alias("score")))


def osworld(spark: SparkSession, path: str) -> DataFrame:
    """all_result.json, a map of maps in JSON or as a Python literal, or a folder of <uuid>/result.txt. Scores are cut to
    [0, 1]; what is no finite number is errored."""
    rows = files(spark, path, "{all_result.json,result.txt}").withColumn("all", F.col("file").endswith(".json"))
    has_all = F.broadcast(rows.agg(F.max("all").alias("has_all")))
    plain = reduce(lambda c, p: F.regexp_replace(c, f"(?<=[:,\\[{{\\s]){p[0]}(?=[,\\]}}\\s])", p[1]), (("None", "null"), ("True", "true"), ("False", "false"), ("nan", "\"nan\""), ("inf", "\"inf\"")), F.col("body"))
    maps = F.from_json(plain, "map<string,map<string,string>>", {"allowSingleQuotes": "true"})
    whole = _refuse(rows.where("all"), F.coalesce(F.size(maps) > 0, F.lit(False)), "a map of results")
    whole = whole.select(F.explode(maps).alias("domain", "m")).select(F.explode("m").alias("task_id", "v"))
    task = F.element_at(F.split("file", "/"), -2)
    single = rows.where("not all").crossJoin(has_all).where("not has_all").select(task.alias("task_id"), F.btrim("body", F.lit(" \t\r\n")).alias("v")).where(F.regexp_like("task_id", F.lit(f"^{UUID}$")))
    low = F.lower("v")
    x = F.when(low.isin("true", "false"), (low == "true").cast("double")).otherwise(whole_number(F.col("v")))
    x = F.when(F.abs(x) < float("inf"), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return averaged(whole.unionByName(single).select("task_id", x.alias("score")))


def tau2(spark: SparkSession, path: str) -> DataFrame:
    """results.json with simulations, or a folder that holds one; success is a reward of 1, nearly."""
    rows = checked_json(files(spark, path, "results.json"))
    body = F.get_json_object("body", "$.simulations")
    rows = _refuse(rows, F.coalesce(body.startswith("["), F.lit(False)), "a list of simulations")
    sims = rows.select(F.explode(F.from_json(F.get_json_object("body", "$.simulations"), "array<struct<task_id:string,reward_info:struct<reward:double>>>")).alias("s")).where("s.task_id is not null")
    hit = F.when(F.col("s.reward_info.reward").isNotNull(), (F.col("s.reward_info.reward") >= 1 - NEARLY).cast("double"))
    return averaged(sims.select(F.col("s.task_id").alias("task_id"), hit.alias("score")))


def toolathlon(spark: SparkSession, path: str) -> DataFrame:
    """A folder of <task>/eval_res.json with a boolean pass."""
    rows = checked_json(files(spark, path, "eval_res.json"))
    value = F.get_json_object("body", "$.pass")
    task = F.regexp_replace(F.element_at(F.split("file", "/"), -2), f"^{USER_TURN}", "")
    return averaged(rows.select(task.alias("task_id"), F.when(value == "true", 1.0).when(value == "false", 0.0).alias("score")))
