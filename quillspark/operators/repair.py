"""The repair loop: drafts that fail their checks are rewritten once, sanitised and checked again.

The drafts are written before their checks read them, the checks' reports before their verdicts send rows two ways, and the rewritten and sanitised drafts
before anything reads them, so each draft is made and checked once and each failing one is sent out once. Only failing drafts take the second way; the others stay as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import generation as G
from quillspark.operators import safety as S
from quillspark.sources import tables as T

REPAIR_TEMPERATURE = 0.05
PARTS = ("ORIGINAL LETTER", "CLINICAL NOTES", "GUIDELINE CONTEXT", "PUBMED CONTEXT", "SAFETY REPORT")


def repair_prompt(task: str, parts: dict[str, Column], closing: str) -> Column:
    """A prompt of named parts; a null part is empty."""
    named = [F.concat(F.lit(f"== {name} ==\n"), F.coalesce(text, F.lit(""))) for name, text in parts.items()]
    return F.concat_ws("\n\n", F.lit(task), *named, F.lit(closing))


def contexts(sources: DataFrame, key: str, kind: str, source_text: str) -> DataFrame:
    """key, case, policy and article: each kind's texts in order, one after the other."""
    texts = F.array_join(F.array_sort(F.collect_list(F.struct(kind, source_text))).getField(source_text), "\n\n---\n\n")
    by_kind = sources.groupBy(key, F.col(kind).alias("quill_kind")).agg(texts.alias("quill_text"))
    return by_kind.groupBy(key).agg(*(F.max(F.when(F.col("quill_kind") == k, F.col("quill_text"))).alias(f"quill_{k}") for k in ("case", "policy", "article")))


def repaired_letters(
    letters: DataFrame, sources: DataFrame, key: str, text: str, chain: list[G.Provider], cache: str, batch: str, system: str, task: str, closing: str,
    kind: str = "kind", source_text: str = "source_text", tasks: int = 8, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """The letters (one row a key) with the final report, repair_attempted, pre_repair_verdict, repair_error and status.

    A draft whose verdict is FAIL goes to the chain with its sources and its report; the answer is sanitised and checked anew, and its verdict counts. Where no provider answers,
    the draft and its report stay and repair_error says why. status: failed if the last verdict is FAIL, else completed. Letters of null are empty.
    """
    drafts = T.written(letters.withColumn(text, F.coalesce(text, F.lit(""))), "drafts")  # the checks and the rows that they join both read them
    _, report = S.check_letters(drafts, sources, key, text, kind, source_text)
    checked = T.written(drafts.join(report, key), "checked")
    failing = checked.where("verdict = 'FAIL'").join(contexts(sources, key, kind, source_text), key, "left")
    safety = F.to_json(F.struct("verdict", "issues"))
    prompt = repair_prompt(task, dict(zip(PARTS, (F.col(text), F.col("quill_case"), F.col("quill_policy"), F.col("quill_article"), safety), strict=True)), closing)
    asked = G.answered(failing, cache, chain, F.lit(system), prompt, batch, REPAIR_TEMPERATURE, tasks, wait)
    answers = T.written(asked.select(*checked.columns, S.sanitized("response").alias("quill_response"), F.col("error").alias("repair_error")), "repaired")

    again = answers.where("quill_response is not null").select(*letters.columns, "quill_response").withColumn(text, F.col("quill_response")).drop("quill_response")
    mine = sources.join(again.select(key), key, "left_semi")
    _, report_again = S.check_letters(again, mine, key, text, kind, source_text)
    outcome = lambda rows, tried, before, error: rows.withColumns({"repair_attempted": F.lit(tried), "pre_repair_verdict": before.cast("string"), "repair_error": error.cast("string")})
    none = F.lit(None)
    out = outcome(checked.where("verdict <> 'FAIL'"), False, none, none)
    out = out.unionByName(outcome(again.join(report_again, key), True, F.lit("FAIL"), none))
    out = out.unionByName(outcome(answers.where("quill_response is null").drop("quill_response"), True, F.lit("FAIL"), F.col("repair_error")))
    return out.withColumn("status", F.when(F.col("verdict") == "FAIL", "failed").otherwise("completed"))


def progress(outcome: DataFrame, key: str) -> DataFrame:
    """key, at, event and data: what a caller is told of each letter, in order, as frames for streaming.stages."""
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    first = F.coalesce("pre_repair_verdict", "verdict")
    verdict = lambda v: F.to_json(F.struct(v.alias("verdict")))
    steps = F.array(event("safety_done", verdict(first)))
    repair = F.array(event("repair_started", F.lit("{}")), event("repair_done", verdict(F.col("verdict"))))
    end = F.array(event("save_started", F.lit("{}")), event("save_done", F.to_json(F.struct("status"))))
    all_steps = F.concat(steps, F.when(F.col("repair_attempted"), repair).otherwise(F.array().cast("array<struct<event: string, data: string>>")), end)
    return outcome.select(key, F.posexplode(all_steps).alias("at", "e")).select(key, "at", "e.event", "e.data")
