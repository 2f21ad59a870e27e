"""Cutting lineage in a folder that every executor can read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Plan nodes that are not worth doing twice.
_COSTLY = re.compile(r"\b(Join|Aggregate|Window|Distinct|Sort|Repartition\w*|RebalancePartitions|Intersect|Except|Deduplicate|LogicalRDD|\w*Python\w*|ArrowEval\w*|MapIn\w*|FlatMap\w*)\b")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Without one a local folder serves a local master only; on a cluster it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "skyaccord-checkpoints")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint: later stages restart from files, not from the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, read again; removed when the application ends.

    For loops: a checkpoint hands the constraints of its plan on, which grow with every round until planning
    takes longer than the work; a table starts afresh, and its known size lets Spark broadcast small ones.
    """
    path = scratch(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what stands there is removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)  # only what exists can be marked for removal
    system.deleteOnExit(hadoop)
    return path


def once(df: DataFrame) -> DataFrame:
    """df for several readings: as it is where its plan only reads, selects and filters, otherwise stored."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return stored(df) if _COSTLY.search(plan) else df
