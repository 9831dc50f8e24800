"""Lineage cuts for iterative operators, on the shared folder the cluster names."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may fall back to /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="driftgrid-ckpt-")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table or a stream's checkpoint."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder so the plan stops growing and lost executors cost little."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def ship(obj) -> None:
    """Send the module of a class or function along with it, so workers need no installed package."""
    module = sys.modules.get(obj.__module__)
    if module is not None and obj.__module__.split(".")[0] == __name__.split(".")[0]:
        cloudpickle.register_pickle_by_value(module)
