"""Chunks of documents, numbered context, and the way back from context to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X


def folded(text: Column | str, separator: str = "\n\n", most: int = 600, overlap: int = 100) -> Column:
    """An array of chunks: paragraphs are added until the next would pass the limit; then a new chunk starts with the last characters.

    The limit is a threshold, not a cap: a long paragraph stays whole, and a chunk of up to overlap characters is never closed.
    """
    paragraphs = F.filter(F.split(X.col(text), separator), lambda p: F.trim(p) != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def add(state: Column, p: Column) -> Column:
        now, done = state["now"], state["done"]
        full = (F.length(now) + F.length(p) > most) & (F.length(now) > overlap)
        grown = F.when(now == "", p).otherwise(F.concat(now, F.lit(separator), p))
        return F.struct(F.when(full, F.concat(F.right(now, F.lit(overlap)), F.lit(separator), p)).otherwise(grown).alias("now"), F.when(full, F.concat(done, F.array(now))).otherwise(done).alias("done"))

    return F.aggregate(paragraphs, start, add, lambda s: F.when(F.trim(s["now"]) != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def chunks(docs: DataFrame, key: str, text: str, prefix: Column | None = None, separator: str = "\n\n", most: int = 600, overlap: int = 100) -> DataFrame:
    """key, chunk_id (<key>-chunk-<n>), chunk_pos and text, each with the document's prefix line."""
    rows = docs.select(key, *([prefix.alias("quill_prefix")] if prefix is not None else []), F.posexplode(folded(text, separator, most, overlap)).alias("chunk_pos", "chunk"))
    body = F.col("chunk") if prefix is None else F.concat("quill_prefix", "chunk")
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("-chunk-"), "chunk_pos").alias("chunk_id"), "chunk_pos", body.alias("text"))


def criteria_chunks(policies: DataFrame, key: str, title: str, criteria: str, code_lists: dict[str, str]) -> DataFrame:
    """One chunk of each policy (<key>-criteria) with its numbered criteria and code lists, after all its content chunks."""
    numbered = F.array_join(F.transform(criteria, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    codes = [F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")) for label, c in code_lists.items()]
    return policies.select(key, F.concat(F.col(key).cast("string"), F.lit("-criteria")).alias("chunk_id"), F.lit(2**31 - 1).alias("chunk_pos"), F.concat_ws("\n", title, numbered, *codes).alias("text"))


def context(rows: DataFrame, key: str, rank: str, text: Column, label: str = "Reference", separator: str = "\n\n---\n\n") -> DataFrame:
    """key, context: the texts in rank order, each after [label rank]."""
    part = F.concat(F.lit(f"[{label} "), F.col(rank).cast("string"), F.lit("] "), text)
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), separator).alias("context"))


def split_context(rows: DataFrame, key: str, text: str, label: str = "Reference") -> DataFrame:
    """key, source_at, label, text: the sources that context() joined. Without marks, the whole text is one source; blank text has none."""
    parts = F.filter(F.split(text, rf"(?i)(?=\[{label}\s+\d+\])"), lambda p: p.rlike(rf"(?i)^\[{label}\s+\d+\]"))
    parts = F.when(X.trimmed(text) == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(text)).otherwise(parts)
    out = rows.select(key, F.posexplode(parts).alias("source_at", "text"))
    number = F.regexp_extract("text", rf"(?i)^\[{label}\s+(\d+)\]", 1)
    return out.select(key, "source_at", F.when(number != "", F.concat(F.lit(f"{label} "), number)).otherwise("Context").alias("label"), "text")
