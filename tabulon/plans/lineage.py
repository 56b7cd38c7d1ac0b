"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    ``spark.checkpoint.dir`` wins; a folder of our own is set only where
    neither that setting nor an earlier ``setCheckpointDir`` names one, and
    only under a local master: a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the checkpoint folder."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
