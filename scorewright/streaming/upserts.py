"""Tables of results that grow by batches: the newest result of a key holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those of the same key; of several new rows of a key the one last by `order`, or
    else the largest as text, holds."""
    rank = F.col(order) if order else F.to_json(F.struct(*new.columns))
    newest = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(rank)))).where("__n = 1").drop("__n")
    return old.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def upsert_sink(folder: str, keys: list[str], order: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table in a folder, dealt into buckets by a hash of its keys. Each batch writes version <id>, in
    one job that commits all of it: the buckets that its keys fall into, from their newest rows before it. So a batch that
    runs again replaces its own version, no reader sees a half-written one, and other buckets stay as they are. Of each
    bucket the newest two versions are kept, so the last batch can run again. A batch without rows writes nothing. All
    writers of a folder use the same number of buckets."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
            touched = {r.b for r in kept.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` numbers
            if not touched:
                return
            old = latest(spark, folder, batch_id - 1, touched)
            out = upsert(kept.limit(0) if old is None else old, kept, keys, order)
            out.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/version={batch_id:012d}")
        finally:
            kept.unpersist()
        fs, path = _files(spark, folder)
        for at in _buckets(spark, folder, None).values():
            for version in sorted(at)[:-2]:
                fs.delete(path(at[version]), True)

    return write


#: The column that names a bucket's folder.
_BUCKET = "__bucket"


def _files(spark, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _buckets(spark, folder: str, most: int | None) -> dict[int, dict[int, str]]:
    """The folders of each bucket by version, of finished versions up to `most`."""
    fs, path = _files(spark, folder)
    names = lambda at: [s.getPath().getName() for s in fs.listStatus(path(at))] if fs.exists(path(at)) else []
    out: dict[int, dict[int, str]] = {}
    for name in names(folder):
        if name.startswith("version=") and (most is None or int(name[8:]) <= most) and fs.exists(path(f"{folder}/{name}/_SUCCESS")):
            for part in names(f"{folder}/{name}"):
                if part.startswith(f"{_BUCKET}="):
                    out.setdefault(int(part[len(_BUCKET) + 1 :]), {})[int(name[8:])] = f"{folder}/{name}/{part}"
    return out


def latest(spark, folder: str, most: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """An upsert table from the newest finished version of each bucket, or the newest up to `most`, which only tells of the
    last batch but one and later; of some buckets only, if asked. None if there is nothing."""
    found = _buckets(spark, folder, most)
    paths = [at[max(at)] for b, at in sorted(found.items()) if only is None or b in only]
    if not paths:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*paths)
