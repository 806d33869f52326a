"""Cutting the lineage of iterative fits."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that the session names: a lost executor repeats no earlier round. Only in local
    mode, as in tests, is a folder of this machine set where there is none."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = os.path.join(tempfile.gettempdir(), "scorewright-checkpoints")
        sc.setCheckpointDir(folder)
    kept = df.persist()  # else the plan would run once for the rows and once for the checkpoint
    out = kept.checkpoint()
    kept.unpersist()
    return out
