import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorewright.streaming import upserts


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).glob("version=*/__bucket=*"))


def test_batches_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    folder = str(tmp_path / "t")
    write = upserts.upsert_sink(folder, ["k"], "at", buckets=8)
    batch = lambda ids, at: spark.createDataFrame([(i, at, i * at) for i in ids], "k long, at long, v long")
    want = {}
    for at, ids in enumerate([range(40), [3], [3, 41], [], [3], range(20, 60)]):
        write(batch(ids, at), at)
        want |= {i: (i, at, i * at) for i in ids}
        assert rows(upserts.latest(spark, folder)) == sorted(want.values())
        if len(ids) == 1:
            assert len([f for f in files(folder) if f.startswith(f"version={at:012d}")]) == 1
    by_bucket = [f.split("/")[1] for f in files(folder)]
    assert len(set(by_bucket)) == 8 and max(map(by_bucket.count, by_bucket)) <= 2


def test_a_batch_that_runs_again_and_one_that_dies(spark, tmp_path):
    folder = str(tmp_path / "t")
    write = upserts.upsert_sink(folder, ["k"], buckets=4)
    first = spark.createDataFrame([(i, 0) for i in range(20)], "k long, v long")
    second = spark.createDataFrame([(i, 1) for i in range(5, 25)], "k long, v long")
    write(first, 0)
    write(second, 1)
    once = rows(upserts.latest(spark, folder))
    write(second, 1)
    assert rows(upserts.latest(spark, folder)) == once == sorted([(i, 0) for i in range(5)] + [(i, 1) for i in range(5, 25)])
    with pytest.raises(PySparkException):
        write(second.withColumn("v", F.when(F.col("k") == 24, F.raise_error(F.lit("lost"))).otherwise(F.col("v") + 1).cast("long")), 2)
    assert rows(upserts.latest(spark, folder)) == once
    os.makedirs(f"{folder}/version={3:012d}/__bucket=0")  # a version without its mark of success
    assert rows(upserts.latest(spark, folder)) == once
