"""Files that Python tasks write to the workspace, and how Spark reads them back."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path within it; a path without a scheme is local."""
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def put(folder: str, name: str, data: bytes) -> None:
    """Write a whole file under its name in one step, so that a task that runs again replaces it and none is partial."""
    system, path = store(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{path}/{name}")


def binary(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(file, content) of the folder's files."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
