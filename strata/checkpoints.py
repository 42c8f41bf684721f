"""Where lineage cuts and scratch tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from strata.files import make_folder_of_session

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only where it is unset in local mode."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="strata-")
    make_folder_of_session(spark, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that one query writes and reads back; it goes when the session's JVM ends."""
    own = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    make_folder_of_session(spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"
