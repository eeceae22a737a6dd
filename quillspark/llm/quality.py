"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule says good (1), bad (-1) or nothing (0) of a document. How often a rule is right about good
and about bad documents is not given but estimated: the votes of all documents are counted by
pattern (a map-side combined count with at most 3 ** rules rows), and EM on those counts alternates
between the probability that a pattern is good and each rule's accuracies. A document is kept if its
pattern's posterior reaches the threshold, so no single rule has to pass.

Defined results: a null text has no words; equal rows get equal verdicts; extra columns pass through
filter_documents() untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .words import U, Words, byte_class, joined, mix, runs, slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_plain", "n_distinct"]
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """bad, good: SQL conditions on the counts; neither holds: the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("upper case", "10 * n_upper > 4 * n_letters", "10 * n_upper <= 1.5 * n_letters"),
    Rule("repeated words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("repeated lines", "10 * n_dup_lines > 6 * n_lines", "n_dup_lines = 0"),
    Rule("word length", "word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    Rule("bare marks", "10 * n_plain < 9 * n_words", "100 * n_plain >= 98 * n_words"),
    Rule("vocabulary", "n_words >= 50 and 20 * n_distinct < n_words", "4 * n_distinct >= n_words"),
)


def count_text(text: pa.Array) -> pa.Array:
    """The COUNTS of each text, as a struct column."""
    symbol, is_word = np.isin(np.arange(256), list(SYMBOLS)), byte_class("space")
    alnum = byte_class("letters")
    out: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for part in slices(text):
        w = Words(part)
        n = len(part)

        def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[at[1:]] - sums[at[:-1]]

        rows, hashes = w.rows, w.hashes()
        data = w.data
        upper = (data >= 65) & (data <= 90)
        letters = upper | ((data >= 97) & (data <= 122))
        plain = np.concatenate([[0], np.cumsum(alnum[data])])
        # words of three-word windows that occur twice or more
        three = runs(hashes, 3)
        at = np.flatnonzero(w.left()[: len(three)] >= 3)
        _, back, times = np.unique(three[at] ^ mix(rows[at].astype(U) + U(1)), return_inverse=True, return_counts=True)
        again = np.zeros(len(hashes) + 2, bool)
        hits = at[times[back] > 1]
        for k in range(3):
            again[hits + k] = True
        # lines that hold a word
        lines = Words(part, "line")
        solid = np.concatenate([[0], np.cumsum(is_word[data])])
        full = solid[lines.ends] > solid[lines.starts]
        line_rows = lines.rows[full]
        _, first = np.unique(lines.hashes()[full] ^ mix(line_rows.astype(U) + U(1)), return_index=True)
        n_lines = np.bincount(line_rows, minlength=n)
        _, kinds = np.unique(hashes ^ mix(rows.astype(U) + U(1)), return_index=True)
        for k, v in enumerate((
            w.counts, total(w.inside & ((data & 0xC0) != 0x80), w.offsets), total(symbol[data], w.offsets),
            n_lines - np.bincount(line_rows[first], minlength=n), total(again[: len(hashes)], w.first), n_lines,
            total(upper, w.offsets), total(letters, w.offsets),
            np.bincount(rows[plain[w.ends] > plain[w.starts]], minlength=n), np.bincount(rows[kinds], minlength=n),
        )):
            out[k].append(v)
    return pa.StructArray.from_arrays([joined([pa.array(v, pa.int64()) for v in x], pa.int64()) for x in out], COUNTS)


def counts(text: Column | str) -> Column:
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    # declared nondeterministic, so that a filter on the result is not evaluated a second time below it
    return F.arrow_udf(count_text, kind).asNondeterministic()(text)


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as a string of the characters g (good), b (bad) and - (abstains)."""
    return F.concat(*(F.expr(f"case when {r.bad} then 'b' when {r.good} then 'g' else '-' end") for r in rules))


#: Votes that every estimate starts with: right ones and all, about good and about bad documents. Their number is fixed, so data outweighs them.
GOOD_VOTES, BAD_VOTES = (19.9, 20.0), (6.0, 20.0)


def fit(patterns: dict[str, int], rounds: int = 200, bad_prior: float = 0.05) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """EM over vote patterns: the posterior probability of good by pattern; the prior and accuracies.

    Starts from a bad prior of 5 percent and the guess that a pattern with a bad vote is bad: this and that a rule about bad
    documents is never estimated to be worse than about good ones ties the classes to their names.
    right_good, right_bad: how often a rule that votes is right about good and about bad documents.
    """
    if not patterns:
        return {}, {}
    names = sorted(patterns)
    votes = np.array([[{"g": 1, "b": -1}.get(c, 0) for c in p] for p in names]).reshape(len(names), -1)
    n = np.array([patterns[p] for p in names], float)
    good, bad = (votes == 1).astype(float), (votes == -1).astype(float)
    post = np.where(bad.any(1), 0.1, 1 - bad_prior / 2)
    prior = right_good = right_bad = np.zeros(0)
    for _ in range(rounds):
        yes, no = n * post, n * (1 - post)
        prior = (yes.sum() + 1) / (n.sum() + 2)
        right_good = (yes @ good + GOOD_VOTES[0]) / (yes @ (good + bad) + GOOD_VOTES[1])
        right_bad = (no @ bad + BAD_VOTES[0]) / (no @ (good + bad) + BAD_VOTES[1])
        # a bad vote never speaks for a document: it is as likely about a bad document as about a good one, at least
        right_bad = np.maximum(right_bad, 1 - right_good)
        odds = np.log(prior / (1 - prior)) + good @ np.log(right_good / (1 - right_bad)) + bad @ np.log((1 - right_good) / right_bad)
        after = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(after - post).max() < 1e-9:
            break
        post = after
    return dict(zip(names, post.tolist(), strict=True)), {"prior": prior, "right_good": right_good, "right_bad": right_bad}


def judge(counted: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.8) -> DataFrame:
    """Adds base_failed, quality (the posterior) and kept to a table with the COUNTS as columns.

    Learns from the documents that pass the base rules; the others are rejected anyway, and their many
    one-line texts would make up the class of bad documents. The posteriors come back as a join with at most 3 ** rules rows, which is the proven bound of the broadcast.
    """
    spark = counted.sparkSession
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    seen = {r["pattern"]: r["n"] for r in counted.where(~base).groupBy(pattern(rules).alias("pattern")).agg(F.count("*").alias("n")).collect()}
    assert len(seen) <= 3 ** len(rules)
    post, _ = fit(seen)
    table = spark.createDataFrame(list(post.items()), "quill_pattern string, quality double")
    judged = counted.withColumn("quill_pattern", pattern(rules)).join(F.broadcast(table), "quill_pattern", "left").drop("quill_pattern")
    return judged.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= least))


def score_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.8) -> DataFrame:
    """doc_id, the counts, base_failed, kept and quality for every row."""
    counted = store.write(docs.select("doc_id", counts("text").alias("c")).select("doc_id", "c.*"), "counts")
    return judge(counted, rules, least)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.8) -> DataFrame:
    """The rows whose verdict is kept, with all their columns. Each text is counted once: the rows and their counts are written, then judged."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("quill_row"), counts(docs["text"]).alias("quill_c"))
    counted = store.write(whole.select("quill_row", "quill_c.*"), "counted")
    return judge(counted, rules, least).where("kept").select("quill_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(store.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
