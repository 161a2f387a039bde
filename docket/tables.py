"""Tables that are written on the way."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session has none and runs on one machine (tests) a folder of our own is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docket-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df from the shared folder: its lineage ends there, so a lost executor repeats nothing before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
