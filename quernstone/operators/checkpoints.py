"""Rows saved in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir`` where that is set.

    Only a local session may go without the setting and gets a temporary folder. On a cluster a folder of one machine
    would be lost to the others, so a session without a shared one is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quernstone-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, saved in the shared folder so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
