"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where a local session names none."""
    ctx = spark.sparkContext
    current = ctx._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = ctx.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomwork-")
    ctx.setCheckpointDir(named)
    return ctx._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost nothing twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> bool:
    """Delete what staged kept of df, once nothing reads it any more; whether there was something. Loops call it for the turn before."""
    jvm, plan = df.sparkSession._jvm, df._jdf.queryExecution().logical()
    if not plan.getClass().getSimpleName().startswith("LogicalRDD"):
        return False
    kept = plan.rdd().getCheckpointFile()
    if not kept.isDefined():
        return False
    path = jvm.org.apache.hadoop.fs.Path(kept.get())
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
