"""Texts and vectors from services outside of Spark: a cache of answers by what was asked, an ordered chain of providers, vectors kept by content.

Services are callables given by the caller. They run in tasks, once for each distinct question without an answer: the answers are written as one
batch before anything reads them, so a later stage that is computed again reads the batch and calls nobody. Errors are values in
the batch, not failures of the job. Only a task that is itself lost before its batch is written calls again. No more calls run at a time than
there are tasks to make them, which is a parameter.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import history as H
from quillspark.sources import tables as T

# How services say that a caller must wait, and for how long.
LIMITED = r"429|(?i:rate limit|resource_exhausted|quota)"
RETRY_AFTER = (r"(?i)retryDelay['\"]?\s*[:=]\s*['\"]?(\d+)s", r"(?i)retry_delay\s*\{\s*seconds:\s*(\d+)", r"(?i)Retry-After['\"]?\s*[:=]\s*['\"]?(\d+)")
LONGEST_WAIT = 20
EMBEDDING_WAITS = (40, 80)

ANSWERS = "cache_key string, response string, provider string, error string, n_calls int"
VECTORS = "key string, text_hash string, vector array<double>, error string, gone boolean, version long"


@dataclass(frozen=True)
class Provider:
    """call(system, prompt, temperature) gives a text; nothing or an error hands the question to the next provider.

    attempts: how often it is called if it names a wait of at most longest_wait seconds; last: an error that is no rate limit ends the chain.
    """

    name: str
    call: Callable[[str, str, float], str | None]
    attempts: int = 1
    longest_wait: float = LONGEST_WAIT
    last: bool = False


class Answer(NamedTuple):
    response: str | None
    provider: str | None
    error: str | None
    n_calls: int


def is_limited(message: str) -> bool:
    return re.search(LIMITED, message) is not None


def retry_after(message: str) -> int | None:
    """The seconds that a message asks to wait."""
    found = (re.search(p, message) for p in RETRY_AFTER)
    return next((int(m[1]) for m in found if m), None)


def ask(chain: list[Provider], system: str, prompt: str, temperature: float, wait: Callable[[float], None] = time.sleep) -> Answer:
    """The first text that a provider of the chain gives; if none does, what each had to say."""
    calls, said = 0, []
    for p in chain:
        for attempt in range(1, p.attempts + 1):
            calls += 1
            try:
                text = p.call(system, prompt, temperature)
            except Exception as e:  # noqa: BLE001 (whatever a service throws is its answer)
                message = str(e)
                seconds = retry_after(message) if is_limited(message) else None
                if attempt < p.attempts and seconds is not None and seconds <= p.longest_wait:
                    wait(seconds)
                    continue
                said.append(f"{p.name}: {'rate limit' if is_limited(message) else message}")
                if p.last and not is_limited(message):
                    return Answer(None, None, "; ".join(said), calls)
            else:
                if text:
                    return Answer(text, p.name, None, calls)
                said.append(f"{p.name}: no text")
            break
    return Answer(None, None, "; ".join(said) or "no provider is configured", calls)


def ask_all(batches: Iterator[pa.RecordBatch], chain: list[Provider], temperature: float, wait: Callable[[float], None]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, systems, prompts = (batch.column(c).to_pylist() for c in ("cache_key", "system", "prompt"))
        for key, system, prompt in zip(keys, systems, prompts, strict=True):
            a = ask(chain, system or "", prompt or "", temperature, wait)
            yield pa.RecordBatch.from_pylist([{"cache_key": key, **a._asdict()}], pa.schema([("cache_key", pa.string()), *[(c, pa.string()) for c in ("response", "provider", "error")], ("n_calls", pa.int32())]))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """An answer for each question that got one; of several (two jobs may have asked at once) one of them."""
    kept = T.appended(spark, path, ANSWERS).where("response is not null")
    return kept.groupBy("cache_key").agg(F.min(F.struct("response", "provider")).alias("a")).select("cache_key", "a.*")


def answered(
    requests: DataFrame, cache: str, chain: list[Provider], system: Column, prompt: Column, batch: str, temperature: float = 0.3, tasks: int = 8, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """The requests with cached, response, provider, error and n_calls (0 where the cache had it, else the calls that its question took).

    cache: a folder of batches; batch: the name of the one that this job adds. A job that runs again under the same name reads what it has and calls nobody.
    Requests that ask the same are one call. A null system or prompt counts as empty.
    """
    spark = requests.sparkSession
    asked = requests.withColumn("quill_system", F.coalesce(system, F.lit(""))).withColumn("quill_prompt", F.coalesce(prompt, F.lit("")))
    asked = asked.withColumn("cache_key", H.cache_key([F.col("quill_system"), F.col("quill_prompt"), F.lit(temperature)]))
    path = f"{cache}/{batch}"
    files, done = T.file_system(spark, f"{path}/_SUCCESS")
    known = read_cache(spark, cache)
    if files.exists(done):  # what this batch has answered was not there when it was asked
        own = spark.read.schema(ANSWERS).parquet(path)
        known = known.join(own, "cache_key", "left_anti")
    else:
        missing = asked.select("cache_key", "quill_system", "quill_prompt").join(known.select("cache_key"), "cache_key", "left_anti")
        missing = missing.groupBy("cache_key").agg(F.any_value("quill_system").alias("system"), F.any_value("quill_prompt").alias("prompt"))
        own = T.written_once(missing.repartition(tasks, "cache_key").mapInArrow(lambda it: ask_all(it, chain, temperature, wait), ANSWERS), path)
    both = known.select("cache_key", F.lit(True).alias("cached"), "response", "provider", F.lit(None).cast("string").alias("error"), F.lit(0).alias("n_calls"))
    both = both.unionByName(own.withColumn("cached", F.lit(False)))
    return asked.drop("quill_system", "quill_prompt").join(both, "cache_key", "left")


Embed = Callable[[list[str]], list[list[float]]]


def embed_all(batches: Iterator[pa.RecordBatch], embed: Embed, size: int, waits: tuple[float, ...], wait: Callable[[float], None]) -> Iterator[pa.RecordBatch]:
    """text_hash, vector and error of distinct texts, asked for in lists of at most so many; a list that fails after all waits has the error in each row."""
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            texts, vectors, error = part.column("text").to_pylist(), None, None
            for attempt in range(len(waits) + 1):
                try:
                    vectors = embed(texts)
                    if len(vectors) != len(texts):
                        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                    break
                except Exception as e:  # noqa: BLE001 (an error is a value of the batch)
                    vectors, error = None, str(e)
                    if attempt == len(waits) or not is_limited(error):
                        break
                    wait(waits[attempt])
            vectors = vectors or [None] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("text_hash"), pa.array(vectors, pa.list_(pa.float64())), pa.array([None if v is not None else error for v in vectors], pa.string())], ["text_hash", "vector", "error"]
            )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """key, text_hash, vector and version of each key that the last batch about it didn't take out."""
    rows = T.appended(spark, path, VECTORS)
    last = rows.groupBy("key").agg(F.max_by(F.struct("text_hash", "vector", "gone", "version"), "version").alias("v"))
    return last.where("not v.gone").select("key", "v.text_hash", "v.vector", "v.version")


def corpus_changes(corpus: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, text_hash and change: added, changed (its text has another hash), gone (only the cache has it) or same. Keys as strings; a null text counts as empty."""
    now = corpus.select(F.col(key).cast("string").alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_hash"))
    had = cache.select("key", F.col("text_hash").alias("old_hash"))
    change = F.when(F.col("text_hash").isNull(), "gone").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("text_hash"), "changed").otherwise("same")
    return now.join(had, "key", "full").select("key", "text", "text_hash", change.alias("change"))


def refresh_vectors(
    corpus: DataFrame, path: str, key: str, text: str, embed: Embed, version: int, size: int = 64, tasks: int = 8, waits: tuple[float, ...] = EMBEDDING_WAITS, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Brings a folder of vectors up to the corpus (keys must be distinct) and returns its changes: key, change and error.

    Each version is a batch of the folder that holds only what changed: vectors of texts that are new to their key, each distinct text asked for once, and
    keys that are gone. A version that is there is not made again. A text whose call failed stays out, so that the next version asks again.
    """
    spark = corpus.sparkSession
    batch = f"{path}/{version}"
    files, done = T.file_system(spark, f"{batch}/_SUCCESS")
    if not files.exists(done):
        change = corpus_changes(corpus, read_vectors(spark, path), key, text).where("change <> 'same'")
        wanted = change.where("change <> 'gone'").groupBy("text_hash").agg(F.any_value("text").alias("text"))
        made = wanted.repartition(tasks, "text_hash").mapInArrow(lambda it: embed_all(it, embed, size, waits, wait), "text_hash string, vector array<double>, error string")
        made = T.written(made, "vectors")
        rows = change.drop("text").join(made, "text_hash", "left")
        rows = rows.select("key", "text_hash", "vector", "error", ((F.col("change") == "gone") | F.col("error").isNotNull()).alias("gone"), F.lit(version).cast("long").alias("version"))
        T.written_once(rows, batch)
    before = T.appended(spark, path, VECTORS).where(F.col("version") < version).groupBy("key").agg(F.max_by("gone", "version").alias("was_gone"))
    here = spark.read.schema(VECTORS).parquet(batch).join(before, "key", "left")
    change = F.when(F.col("gone") & F.col("error").isNull(), "gone").when(F.coalesce("was_gone", F.lit(True)), "added").otherwise("changed")
    return here.select("key", change.alias("change"), "error")
