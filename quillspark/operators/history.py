"""Stored records: lookups, ordered lists, versions, status counts, caches, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.search import any_of


def point_lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def newest(table: DataFrame, created: str, position: str, limit: int | None = None) -> DataFrame:
    """Rows from the newest on; equal times by position. With a limit, only so many."""
    out = table.orderBy(F.desc(created), position)
    return out if limit is None else out.limit(limit)


def matching(table: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which a column holds the query, ignoring case; an empty query keeps all."""
    return table.where(any_of([F.contains(F.lower(c), F.lit(query.lower())) for c in columns])) if query else table


def latest(versions: DataFrame, key: str, updated: str, tie: str) -> DataFrame:
    """The last version of each key: an aggregate of the largest (time, tie), combined before the shuffle."""
    rest = [c for c in versions.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(updated, tie))
    return versions.groupBy(key).agg(row.alias("quill_row")).select(key, "quill_row.*")


def updated(table: DataFrame, updates: DataFrame, key: str, stamp: str, at: Column) -> DataFrame:
    """The table after updates, one row a key: their columns replace the table's, nulls included, and the stamp is set; updates of unknown keys change nothing."""
    changed = [c for c in updates.columns if c != key]
    news = updates.select(F.col(key), F.struct(*changed).alias("quill_new"))
    hit = F.col("quill_new").isNotNull()
    new = {c: F.when(hit, F.col("quill_new")[c]).otherwise(F.col(c)) for c in changed} | {stamp: F.when(hit, at).otherwise(F.col(stamp))}
    return table.join(news, key, "left").withColumns(new).select(table.columns)


def status_counts(table: DataFrame, status: str) -> DataFrame:
    return table.groupBy(status).agg(F.count("*").alias("n"))


def status_pivot(table: DataFrame, status: str, kinds: dict[str, str]) -> DataFrame:
    """One row: the total over all statuses, and a column for each named one."""
    return table.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(c) for c, v in kinds.items()))


def cached_responses(requests: DataFrame, cache: DataFrame, parts: list[Column], key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(answered, missing): requests with the cached response of their parts' hash, and those that have none."""
    keyed = requests.withColumn(key, cache_key(parts))
    return keyed.join(cache, key), keyed.join(cache.select(key), key, "left_anti")


def cache_key(parts: list[Column]) -> Column:
    """SHA-256 of the parts as a list of JSON strings."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


def cache_is_valid(cache: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """One row: whether the cache has as many rows as the corpus, and only keys of it."""
    strange = cache.join(corpus.select(key), key, "left_anti")
    return cache.agg(F.count("*").alias("n")).crossJoin(corpus.agg(F.count("*").alias("m"))).crossJoin(strange.agg(F.count("*").alias("strange"))).select(((F.col("n") == F.col("m")) & (F.col("strange") == 0)).alias("valid"))


def merged(primary: Column, fallback: Column) -> Column:
    """The primary value unless it is missing or empty."""
    return F.coalesce(F.nullif(primary, F.lit("")), fallback)


def filled(current: Column, parsed: Column, overwrite: bool = False) -> Column:
    """The current value unless it is blank; with overwrite, the parsed value if there is one."""
    return F.coalesce(parsed, current) if overwrite else F.coalesce(X.blank_to_null(current), parsed)


def with_element(values: Column, new: Column) -> Column:
    """A comma-separated list with an element added unless it is there."""
    listed = X.code_list(values)
    return F.array_join(F.when(F.array_contains(listed, new), listed).otherwise(F.array_append(listed, new)), ", ")


def rejects(table: DataFrame, least: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows whose required texts are long enough, and the others with the failing columns as errors."""
    short = F.filter(F.array(*(F.when(F.coalesce(F.length(c), F.lit(0)) < n, F.lit(c)) for c, n in least.items())), lambda x: x.isNotNull())
    marked = table.withColumn("errors", short)
    return marked.where("size(errors) = 0").drop("errors"), marked.where("size(errors) > 0")


