"""Table functions for SQL: chunks and segments of the texts of a table argument, each row by itself.

    register(spark)
    select * from chunks(table(select doc_id, text from documents) partition by (doc_id), 'doc_id', 'text')
    select * from segments(table(select id, note from notes), 'id', 'note', '[^.]+[.]')

The key keeps its type. A null text gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def keyed(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, *columns: T.StructField) -> AnalyzeResult:
    """The result's columns: the key as the table has it, then the given ones."""
    if not rows.isTable or not isinstance(key.value, str) or not isinstance(text.value, str):
        raise ValueError("arguments: a table, the name of its key and the name of its text, as constants")
    fields = {f.name: f.dataType for f in rows.dataType}
    if not {key.value, text.value} <= set(fields):
        raise ValueError(f"the table has no columns {key.value} and {text.value}")
    return AnalyzeResult(T.StructType([T.StructField(key.value, fields[key.value]), *columns]))


def folded(text: str, separator: str, most: int, overlap: int) -> list[str]:
    """Paragraphs put together until the next would pass the limit; a new chunk then starts with the last characters of the one before."""
    now, done = "", []
    for paragraph in text.split(separator):
        if not paragraph.strip(" "):
            continue
        if len(now) + len(paragraph) > most and len(now) > overlap:
            done.append(now)
            now = f"{now[len(now) - overlap :]}{separator}{paragraph}"
        else:
            now = f"{now}{separator}{paragraph}" if now else paragraph
    return [*done, now] if now.strip(" ") else done


@udtf
class Chunks:
    """operators.chunks.chunks() for SQL."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, separator: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return keyed(rows, key, text, T.StructField("chunk_id", T.StringType()), T.StructField("chunk_pos", T.IntegerType()), T.StructField("text", T.StringType()))

    def eval(self, row: Row, key: str, text: str, separator: str = "\n\n", most: int = 600, overlap: int = 100) -> Iterator[tuple]:
        for at, chunk in enumerate(folded(row[text] or "", separator, most, overlap)):
            yield row[key], None if row[key] is None else f"{row[key]}-chunk-{at}", at, chunk


@udtf
class Segments:
    """The matches of a pattern in order, with their places in code points."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        re.compile(pattern.value)
        return keyed(rows, key, text, *(T.StructField(c, T.IntegerType()) for c in ("segment", "start", "end")), T.StructField("text", T.StringType()))

    def eval(self, row: Row, key: str, text: str, pattern: str) -> Iterator[tuple]:
        for at, found in enumerate(re.finditer(pattern, row[text] or ""), 1):
            yield row[key], at, found.start(), found.end(), found[0]


def register(spark: SparkSession) -> None:
    """Makes chunks and segments known to a session's SQL."""
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("segments", Segments)
