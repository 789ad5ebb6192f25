"""Session settings that the engine's plans assume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC for all time arithmetic; adaptive execution for runtime partition sizes and skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Plans of many columns are built several times faster without a note of each call's place in the code.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "tallyforge", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Without that setting only a local session gets one of our own: on a cluster every machine would
    write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file:///tmp/checkpoints/tallyforge"
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/tallyforge-{tag}-{uuid.uuid4().hex}"
