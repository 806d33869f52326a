"""Record readers over small synthetic trees, and the streaming aggregate."""

import json

import pytest
from pyspark.sql import functions as F

from scorewright.sources import records
from scorewright.streaming import windows


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def scores(df):
    return {r.task_id: (r.score, r.errored) for r in df.collect()}


def test_model_records(spark, tmp_path):
    put(tmp_path / "m1/d.json", {"details": {"1": {"is_correct": "yes"}, "2": {"hit": [False, True]}, "type": "x", "3": {}}})
    put(tmp_path / "m2/d.json", {"details": [{"id": "a", "is_correct": True}, {"if_right": 0}]})
    put(tmp_path / "m3/d.json", {"7": 1, "8": 0})
    got = {(r.model, r["item"]): r.score for r in records.read_models(spark, str(tmp_path), "d").collect()}
    assert got == {("m1", "1"): 1.0, ("m1", "2"): 0.0, ("m1", "3"): None, ("m2", "a"): 1.0, ("m2", "1"): 0.0, ("m3", "7"): 1.0, ("m3", "8"): 0.0}


def test_subset_and_its_faults(spark, tmp_path):
    put(tmp_path / "s.jsonl", "\n".join(map(json.dumps, [{"question_id": "a", "weight": 0.5}, {"id": "b", "weight": 0.5}, {"index": 3}, {"id": "b", "weight": 0.1}])))
    subset = records.read_subset(spark, str(tmp_path / "s.jsonl"))
    universe = spark.createDataFrame([("a",), ("b",)], "item string")
    assert {(r.fault, r["item"]) for r in records.subset_faults(subset, universe).collect()} == {("duplicate", "b"), ("unknown", "3"), ("weight", "3")}


def test_harnesses(spark, tmp_path):
    put(tmp_path / "tau.json", {"simulations": [{"task_id": "1", "reward_info": {"reward": 1}}, {"task_id": "1", "reward_info": {"reward": 0}}, {"task_id": "2", "reward_info": {"reward": None}}]})
    assert scores(records.tau2_results(spark, str(tmp_path / "tau.json"))) == {"1": (0.5, False), "2": (None, True)}
    put(tmp_path / "swe.json", {"resolved_ids": ["a"], "unresolved_ids": ["b", "a"], "error_ids": ["c"], "empty_patch_ids": ["d"]})
    assert scores(records.swe_bench_results(spark, str(tmp_path / "swe.json"))) == {"a": (1.0, False), "b": (0.0, False), "c": (0.0, True), "d": (0.0, False)}
    put(tmp_path / "pro.json", {"a": True, "b": False})
    assert scores(records.swe_bench_pro_results(spark, str(tmp_path / "pro.json"))) == {"a": (1.0, False), "b": (0.0, False)}
    put(tmp_path / "bad.json", {"a": True, "c": 3})
    with pytest.raises(Exception, match="not a boolean: c = 3"):
        records.swe_bench_pro_results(spark, str(tmp_path / "bad.json")).collect()
    put(tmp_path / "tb/x/result.json", {"task_name": "t", "verifier_result": {"rewards": {"reward": 1.0}}})
    put(tmp_path / "tb/y/result.json", {"task_name": "t", "verifier_result": {"rewards": {"reward": None}}})
    put(tmp_path / "tb/z/result.json", {"task_name": "u", "verifier_result": None})
    assert scores(records.terminal_bench_results(spark, str(tmp_path / "tb/*/result.json"))) == {"t": (1.0, False), "u": (None, True)}
    put(tmp_path / "os.json", {"dom": {"a": "1.7", "b": "nan", "c": 0.25, "d": "True"}})
    assert scores(records.osworld_results(spark, str(tmp_path / "os.json"))) == {"a": (1.0, False), "b": (None, True), "c": (0.25, False), "d": (1.0, False)}
    put(tmp_path / "tool/SingleUserTurn-a/eval_res.json", {"pass": True})
    put(tmp_path / "tool/b/eval_res.json", {"pass": None})
    assert scores(records.toolathlon_results(spark, str(tmp_path / "tool/*/eval_res.json"))) == {"a": (1.0, False), "b": (None, True)}


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "parquet"])
def test_tables_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([("a", 'quote " and, comma'), ("b", "two\nlines")], "k string, v string")
    records.write_table(rows, f"{tmp_path}/t.{kind}")
    assert sorted(map(tuple, records.read_table(spark, f"{tmp_path}/t.{kind}").select("k", "v").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        records.read_table(spark, "x.pkl")


def test_shards(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 0)], "shard int, place int")
    assert sorted(tuple(r) for r in records.merge_shards(rows, "shard", "place").select("shard", "place", "idx").collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (2, 0, 3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 10:00:00", f"t{i % 2}", float(i)) for i in range(30)], "ts string, task string, score double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windows.windowed_scores(stream, "ts", "task", "score").writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    same = lambda df: sorted(map(tuple, df.select(F.col("start").cast("string"), "task", "n", "total", "mean").collect()))
    assert same(spark.table("windowed")) == same(windows.windowed_scores(rows, "ts", "task", "score"))


def test_resume(spark):
    rows, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert [r.k for r in windows.resume(rows, done, ["k"]).collect()] == [1]
