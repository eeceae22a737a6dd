"""Intermediate tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (as in tests) one of this session's own. A cluster must name one that all its machines see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffle files of what it writes as soon as that is written, and not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors. Spark removes it at its end. options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path).alias(name)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As write(), in so many buckets of the key (at most as many as Spark allows a table), one sorted file each: grouping by the key leaves these rows where they are.

    The catalog's entry goes at once; the DataFrame keeps the files and their buckets.
    """
    spark = df.sparkSession
    table = f"quill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    with shuffles_end(spark):
        df.repartition(buckets, key).write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.table(table)
    spark.sql(f"drop table {table}")
    return out.alias(name)


def drop(*tables: DataFrame) -> None:
    """Remove tables that write() or write_bucketed() made, or all of whose rows lie in such ones, and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by the links, for each node that has one.

    Alternates large-star and small-star steps: each round is two shuffles, every row of which goes
    to a neighbour's smallest neighbour, so that a hub with many links is only an aggregated minimum.
    Ends when a round changes nothing; rounds grow as the logarithm of the longest chain.
    """
    edges = write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("x"), "u", "m")
        step = small.select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = write(step, "edges")
        # the sum of the links changes whenever the links do, but for a hash collision
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = after
        if mark == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").transform(lambda d: d.unionByName(d.select(F.col("component").alias("node"), "component").distinct()))
        before = mark
