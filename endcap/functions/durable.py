"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names; a scratch folder only on local runs that name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A path beneath the checkpoints that nothing else uses."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the session's folder; its size is that of its files.

    Spark keeps the estimate of the plan behind a checkpoint, and takes a join for the product of its
    sides. From step to step such a number has more digits, until planning takes longer than the work.
    """
    checkpoint_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    spark, plan = done.sparkSession, done._jdf.queryExecution().logical()
    jvm = spark.sparkContext._jvm
    files = spark.read.text(plan.rdd().getCheckpointFile().get())     # listed, not read
    stats = files._jdf.queryExecution().analyzed().stats()
    sized = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(),
                      plan.isStreaming(), plan.stream(), spark._jsparkSession,
                      jvm.scala.Option.apply(stats), jvm.scala.Option.apply(plan.constraints()))
    return type(done)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet beside the checkpoints and read again: for many rows of few values, which
    a checkpoint would hold uncompressed."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
