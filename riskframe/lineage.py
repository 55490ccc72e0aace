"""Cut long lineages in the shared checkpoint folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a scratch folder only where driver and executors are one process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskframe-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, keep it in the checkpoint folder, and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of one loop, in a folder of its own beside the checkpoints.

    A checkpoint keeps the size estimate of the plan it came from, and joins multiply the estimates of their sides;
    in a loop that joins its own results they grow without bound. A table read back has the size of its files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once and read back."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, last: int | None = None) -> None:
        """Delete all tables, or those made before the last ones; nothing may read them any more."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [self.folder] if last is None else [f"{self.folder}/{i}" for i in range(self.made - last)]
        for path in paths:
            where = hadoop(path)
            where.getFileSystem(conf).delete(where, True)


def store(df: DataFrame, *keys: str) -> DataFrame:
    """Compute df once into a Parquet table beside the checkpoints, for several passes over many rows.

    It is smaller than a checkpoint and a pass reads only its columns. With keys their rows lie together, so that sums
    by them are made before the shuffle; the rows of a frequent key may lie in several files.
    """
    return Tables(df.sparkSession, "table").keep(df.hint("rebalance", *keys) if keys else df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even partitions over all cores ahead of a step that multiplies rows.

    The number is stated, so small inputs are not merged back into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def spread_few(df: DataFrame, *keys: str) -> DataFrame:
    """spread() for a stored table of fewer files than there are cores; a larger one is read in parts as it lies."""
    few = len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism
    return spread(df, *keys) if few else df
