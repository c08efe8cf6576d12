"""Results kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..model import Activities


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder; lost executors do not lose it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(a: Activities) -> Activities:
    """Cuts the lineage of recordings whose tables several later steps read."""
    return a.having(**{t: checkpointed(df) for t, df in a.tables().items()})
