"""Session settings that operators need, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's spark.checkpoint.dir; where none is set, to a folder of our own if the master is local (as in
    tests), else it is an error: executors elsewhere don't see the driver's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoints, which goes when the driver ends."""
    shared_checkpoints(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """df as a table of the shared folder, and where.  Unlike a checkpoint it has its own size in the plan: over many rounds of
    joins the estimates that checkpoints pass on grow until planning takes longer than running."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def unsent(side: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, never sent whole through the driver: the planner takes its size from the files
    that it is derived from, which may be a hundredth of it."""
    return side.hint("merge")
