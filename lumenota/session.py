"""Session helpers shared by tests, the bench and the library."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenota")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LUMENOTA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one ``spark.checkpoint.dir`` names.

    Only a local session, where driver and executors are one process, may leave it unset; it then
    gets a temporary folder. Anywhere else a missing setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
        folder = f"file://{tempfile.mkdtemp(prefix='lumenota-shared-')}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there, and
    later reads take only the columns they need."""
    folder = f"{shared_folder(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
