"""Tables that jobs leave for later ones in folders all executors share: results written once, batches appended once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, one of this machine's. A cluster must name one that all its machines see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; Spark removes it at its end."""
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: what made them runs once, also if executors are lost later."""
    return written_once(df, fresh_dir(df.sparkSession, name))


def written_once(df: DataFrame, path: str) -> DataFrame:
    """The rows as they stand in a folder, written unless a job has done so; one that a job left unfinished is written anew."""
    spark = df.sparkSession
    files, done = file_system(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished batches, each a folder of its own below the path; none where there is no folder yet."""
    files, at = file_system(spark, path)
    batches = [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
    done = sorted(str(b) for b in batches if files.exists(spark._jvm.org.apache.hadoop.fs.Path(b, "_SUCCESS")))
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream of a table below a folder, be it a folder of files or one file."""
    files, at = file_system(spark, f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{folder}/{name}") if files.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
