"""Session factory with the settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fareflow", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skewed-join handling, dynamic partition overwrite. Sizes are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return builder.config(map=defaults | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can write to, where checkpoints go: ``spark.checkpoint.dir``.

    Only in a session on one machine, as in tests, is a folder made where none is named; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fareflow-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs a read, not a recomputation. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
