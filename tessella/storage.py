"""Where intermediate results go: the folder that spark.checkpoint.dir names, which driver and executors share; a temporary one only where that is unset and everything runs in one process, as in tests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    had = sc._jsc.sc().getCheckpointDir()
    if not (sc.getConf().get("spark.checkpoint.dir") or had.isDefined() or re.match(r"local(\[|$)", sc.master)):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = sc.getConf().get("spark.checkpoint.dir") or (had.get() if had.isDefined() else tempfile.mkdtemp(prefix="tessella-"))
    if not had.isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df computed once."""
    shared(df.sparkSession)
    return df.checkpoint()
