"""Session defaults and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "crestline") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter configures it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CRESTLINE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str | None:
    """The cluster's shared folder, None if there is none and the session is local; an error on a cluster without one."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written files: in the cluster's shared folder, in a local one only in a local session where none is set."""
    return f"{shared_folder(spark) or tempfile.mkdtemp(prefix='crestline-')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder (an own folder only in a local session where none is set)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession) or tempfile.mkdtemp(prefix="crestline-checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`, read by Spark so that any store works."""
    return spark.read.parquet(f"{root}/{name}.parquet")
