"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where none is named (tests)."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        folder = "file://" + (local := tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, local, True)
        spark.conf.set(_KEY, folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Unlike a cached or locally checkpointed frame, the copy outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


LARGE = ("chunks", "documents", "docs", "vectors", "serp_results")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. One that its few files would leave to fewer tasks than there are cores is spread first."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LARGE and df.rdd.getNumPartitions() < cores // 2 else df
