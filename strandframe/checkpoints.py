"""Checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and cut its lineage there.

    The folder is the session's ``spark.checkpoint.dir``. A local session without that setting gets a
    temporary folder; a cluster without it is refused, as executors don't share local disks.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
