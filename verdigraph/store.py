"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a new local folder if all runs in this process, else an error, since executors of a cluster
    would each write to their own disk."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verdigraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _scratch(spark: SparkSession):
    """This application's folder, as text and as a path, and its file system."""
    name = f"{shared_dir(spark).rstrip('/')}/verdigraph-{spark.sparkContext.applicationId}"
    target = spark._jvm.org.apache.hadoop.fs.Path(name)
    return name, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_marked: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when the application ends."""
    folder, target, fs = _scratch(spark)
    if folder not in _marked:
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _marked.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written to a table in the shared folder and read from there: a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all that this application stored so far: results that were not read yet are lost."""
    _, target, fs = _scratch(spark)
    fs.delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small table has fewer splits than these; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
