"""Small tables kept as one JSON file (policies, codes, records), and results written as JSON.

Tables that grow belong in Parquet, as versions (operators.history); these readers are for dimension tables of a few thousand rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import file_system

POLICIES = (
    "id string, title string, source string, category string, effective_date string, content string, "
    "approval_criteria array<string>, icd10_codes array<string>, cpt_codes array<string>"
)
CODES = "code string, description string"


def json_table(spark: SparkSession, path: str, schema: str, position: str = "corpus_pos") -> DataFrame:
    """The records of a JSON array and their positions from 0; no rows where the file is missing or isn't JSON. Values of another type are null."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{position} int, {schema}")
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias(position, "record"))
    return rows.select(position, "record.*")


def policies(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, POLICIES)


def codes(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, CODES)


def write_results(cases: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluated cases and their tally, as lines of JSON in two folders; those of an earlier run are replaced."""
    cases.write.mode("overwrite").json(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")


def json_version(spark: SparkSession, folder: str) -> int:
    """The newest version in a folder of versions; 0 if it has none."""
    files, at = file_system(spark, folder)
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def versioned_table(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The records of a version (the newest one) of a JSON table that is changed by change_table(), with their positions."""
    n = json_version(spark, folder) if version is None else version
    return json_table(spark, f"{folder}/{n:010}.json", schema)


def change_table(spark: SparkSession, folder: str, schema: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5, keep: int = 3) -> int:
    """Publishes change(rows) as the next version and returns its number; change keeps or sets corpus_pos, by which the new version is ordered.

    The version is one file, written aside and renamed into place, so a reader sees the old or the new table and a write that fails leaves the old one. A rename never replaces a
    version: if another writer has published first, the change is made again on what it left, and no row is lost. The last versions stay for their readers.
    """
    for _ in range(attempts):
        read = json_version(spark, folder)
        rows = change(versioned_table(spark, folder, schema, read))
        columns = [c for c in rows.columns if c != "corpus_pos"]
        whole = rows.agg(F.array_sort(F.collect_list(F.struct("corpus_pos", F.struct(*columns).alias("record")))).alias("all"))
        aside = f"{folder}/.{uuid.uuid4().hex}"
        whole.select(F.to_json(F.transform("all", lambda x: x["record"]), {"ignoreNullFields": "false"})).coalesce(1).write.text(aside)
        files, at = file_system(spark, aside)
        part = next(x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("part-"))
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{read + 1:010}.json")
        published = not files.exists(target) and files.rename(part, target)
        files.delete(at, True)
        if published:
            for old in range(max(1, read + 1 - 2 * keep), read + 2 - keep):
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old:010}.json"), False)
            return read + 1
    raise RuntimeError(f"{folder}: other writers came first {attempts} times")


def at_head(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new records before the others, the last of them first, as if each was put at the head."""
    ordered = new.withColumn("corpus_pos", -1 - F.monotonically_increasing_id())
    return rows.withColumn("corpus_pos", F.col("corpus_pos").cast("long")).unionByName(ordered.withColumn("corpus_pos", F.col("corpus_pos").cast("long")))


def without(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The table without the records of these keys; records without a key stay."""
    return rows.where(~F.coalesce(F.col(key).isin(values), F.lit(False)))


def by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The first record of a key, if any."""
    return rows.where(F.col(key) == F.lit(value)).orderBy("corpus_pos").limit(1)
