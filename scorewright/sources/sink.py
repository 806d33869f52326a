"""Records as one JSON file for each model and dataset, written by tasks and put in place by a commit."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scorewright.shipping import ship


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def there(path: str) -> bool:
    system, where = located(path)
    return system.get_file_info(where).type != fs.FileType.NotFound


@dataclass
class Staged(WriterCommitMessage):
    #: (staged file, place below the root) of each record.
    files: list[tuple[str, str]]


class RecordSink(DataSource):
    """Options: path: the root; overwrite: true to replace records that are there."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options["path"].rstrip("/"), self.options.get("overwrite", "false") == "true")


class RecordWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.stage = f"{root}/.staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """A file for each run of rows of a model and dataset, written row by row under a name of this attempt's own."""
        system, stage = located(self.stage)
        system.create_dir(stage, recursive=True)
        files: list[tuple[str, str]] = []
        key, out, n, missing, total, last = None, None, 0, 0, 0.0, None

        def ended() -> None:
            mean = total / n if n else None
            tail = {"is_correct": mean, "accuracy": mean, "meta": {"n_items": n, "n_missing": missing}}
            out.write(("}, " + json.dumps(tail)[1:] + "\n").encode())
            out.close()

        for r in rows:
            if (r.model, r.dataset) != key:
                if out:
                    ended()
                key, n, missing, total, last = (r.model, r.dataset), 0, 0, 0.0, None
                files.append((f"{stage}/{uuid.uuid4().hex}", f"{r.model}/{r.dataset}.json"))
                out = system.open_output_stream(files[-1][0])
                out.write((json.dumps({"dataset": r.dataset, "model": r.model}, ensure_ascii=False)[:-1] + ', "details": {').encode())
            if r.item == last:
                raise ValueError(f"{r.model}/{r.dataset} has the item {r.item!r} twice")
            if r.score is None or not math.isfinite(r.score):
                raise ValueError(f"{r.model}/{r.dataset}: the score of {r.item!r} isn't a number")
            detail = {"is_correct": r.score} | ({"missing": True} if r.missing else {})
            out.write((("," if n else "") + f"\n{json.dumps(r.item, ensure_ascii=False)}: {json.dumps(detail)}").encode())
            n, missing, total, last = n + 1, missing + bool(r.missing), total + r.score, r.item
        if out:
            ended()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        """Records in place by renaming; nothing is moved if one would replace another without leave to."""
        files = [f for m in messages if m for f in m.files]
        if not self.overwrite and (taken := [p for _, p in files if there(f"{self.root}/{p}")]):
            self.abort(messages)
            raise FileExistsError(f"{self.root}/{taken[0]} is there; overwrite replaces it")
        system, root = located(self.root)
        for staged, place in files:
            system.create_dir(f"{root}/{place.rpartition('/')[0]}", recursive=True)
            system.move(staged, f"{root}/{place}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, stage = located(self.stage)
        if there(self.stage):
            system.delete_dir(stage)


def write_records(scores: DataFrame, root: str, overwrite: bool = False) -> None:
    """<root>/<model>/<dataset>.json of scores (model, dataset, item, score; missing: optional).

    Each record has details by item, their mean, how many there are and how many are missing. A task writes the records
    that it gets one row at a time, in staged files that only the commit moves in place: a task that is lost or runs
    twice leaves nothing behind. An item that repeats and a score that isn't a number raise, as do a record that is there
    already, unless `overwrite`, and names that would leave the root. No scores write nothing.
    """
    spark = scores.sparkSession
    ship(spark)
    spark.dataSource.register(RecordSink)
    name = lambda c: F.when(F.col(c).isNull() | F.col(c).isin("", ".", "..") | F.col(c).contains("/"), F.raise_error(F.concat(F.lit(f"not a {c}: "), F.coalesce(F.col(c), F.lit("null")))).cast("string")).otherwise(F.col(c)).alias(c)
    missing = F.col("missing") if "missing" in scores.columns else F.lit(False)
    rows = scores.select(name("model"), name("dataset"), F.col("item").cast("string").alias("item"), F.col("score").cast("double").alias("score"), missing.alias("missing"))
    rows = rows.repartition("model", "dataset").sortWithinPartitions("model", "dataset", "item")
    rows.write.format("records").option("path", root).option("overwrite", str(overwrite).lower()).mode("append").save()


def read_manifest(folder: str) -> dict:
    """A dataset's manifest, one small file: manifest.yaml where there is one and a YAML reader, else manifest.json."""
    for name in ("manifest.yaml", "manifest.yml", "manifest.json"):
        if not there(f"{folder}/{name}"):
            continue
        system, where = located(f"{folder}/{name}")
        with system.open_input_stream(where) as f:
            text = f.read().decode()
        if name.endswith("json"):
            found = json.loads(text)
        else:
            import yaml  # optional

            found = yaml.safe_load(text)
        if not isinstance(found, dict) or "subsets" not in found:
            raise ValueError(f"{folder}/{name}: no section subsets")
        return found
    raise FileNotFoundError(f"no manifest in {folder}")


def read_manifest_subset(spark: SparkSession, folder: str, subset: str) -> DataFrame:
    """(index, weight, id) of a subset that the manifest names; a line that isn't JSON, or lacks index or weight, raises
    when it is read, and blank lines are skipped."""
    known = read_manifest(folder)["subsets"]
    if subset not in known:
        raise ValueError(f"no subset {subset!r}; there are {['full', *known]}")
    lines = spark.read.text(f"{folder}/{known[subset]['file']}").where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", "index string, weight double, id string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    fault = F.when(F.col("r.broken").isNotNull(), "isn't JSON").when(F.col("r.index").isNull() | F.col("r.weight").isNull(), "lacks index or weight")
    index = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"{subset}: a line "), fault, F.lit(": "), F.col("value"))).cast("string")).otherwise(F.col("r.index"))
    return parsed.select(index.alias("index"), F.col("r.weight").alias("weight"), F.coalesce("r.id", "r.index").alias("id"))
