"""Records upserted from a stream: each micro-batch is a batch of versions, written once under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import history as H
from quillspark.sources import tables as T


def version_writer(path: str, query: str = "upserts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's rows with its number as batch. A batch that comes again, after a failure or from a replayed source, changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        T.written_once(rows.withColumn("batch", F.lit(batch).cast("long")), f"{path}/{query}-{batch}")

    return write


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, query: str = "upserts"):
    """A writer (to be started) that keeps all versions of the changed records below the path."""
    return changes.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(version_writer(path, query))


def upserted(spark: SparkSession, path: str, schema: str, key: str, updated: str) -> DataFrame:
    """The newest version of each record by the time it was updated; of equal times the one of the later batch, then the greater row."""
    versions = T.appended(spark, path, f"{schema}, batch long")
    rest = [c for c in versions.columns if c not in (key, updated, "batch")]
    out = H.latest(versions.withColumn("quill_tie", F.struct("batch", F.struct(*rest))), key, updated, "quill_tie")
    return out.select(*[c for c in versions.columns if c != "batch"])
