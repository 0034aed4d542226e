"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on: UTC timestamps and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is made only for an unset local session."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get(CHECKPOINT_CONF, None)
        if found is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder all executors can reach")
            found = tempfile.mkdtemp(prefix="zephyrgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it from there.

    For roll-ups that several branches of a plan use: the raw data is scanned once, the table keeps
    column pruning and size statistics, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
