"""Session helpers: tables of a directory, a place for checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; set an own one only where none is set (tests, local runs)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lintmill-checkpoint-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(where)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one for checkpoints, which all executors share."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: survives the loss of executors and ends the lineage."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
