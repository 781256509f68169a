"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkloom.shared.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
        spark.conf.set("sparkloom.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors, computes Python work once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the session's cores if it comes in fewer parts: for work that costs far more than moving its rows.

    A file's row group is one task however many cores there are. Inputs of twice as many parts as cores stay as they are.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt over the session's cores: for costly work on rows that come from a shuffle, which Spark may have put in few parts."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cleanup(spark: SparkSession) -> int:
    """Deletes what this application has stored in the shared folder, and says how many tables; results that read them must be written before."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith(f"{spark.sparkContext.applicationId}-")] if files.exists(folder) else []
    for path in own:
        files.delete(path, True)
    return len(own)
