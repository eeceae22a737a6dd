"""License scans by diagonal voting.

All rolling three-word hashes of every text are joined with the templates' (the same test against the templates' hash
set is made where the hashes are computed, so only hashes that will join are shuffled). A match of word
position p with template position q votes for the diagonal p - q, on which an unchanged copy lies whole:
1. votes are aggregated by document, template and diagonal. A base phrase is found where a diagonal has all its votes;
2. the matches of a document with a template are chained in the order of both; a template position occurs once in a chain, so
   copies stay apart, and words may be inserted or missing as far as the least likeness of a template so long allows. Spans from
   the first to the last matched word are compared with the template word by word; similar ones give the template's
   label, of overlapping ones the best.

Templates are a parameter; their number of three-word runs is that of the words given here, which bounds the
broadcast. Defined results: a null text has no words and no labels; equal rows get equal results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .words import Words, joined, lists, runs, signed, slices

GRAM, LEAST_VOTES, LEAST_SIMILARITY = 3, 0.4, 0.8


@dataclass(frozen=True)
class Template:
    """base: the phrase counts wherever it stands unchanged, and only there."""

    label: str
    text: str
    base: bool = False


#: The base phrases, and public license notices.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("all-rights-reserved", "all rights reserved"),
)


def words_of(text: str) -> Words:
    return Words(pa.array([text]), "letters", lower=True)


def template_grams(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """(template, position, hash) of every three-word run."""
    return [(i, q, int(h)) for i, t in enumerate(templates) for q, h in enumerate(signed(runs(words_of(t.text).hashes(), GRAM)))]


def survey(text: pa.Array, known: np.ndarray, reach: int) -> pa.Array:
    """Per text: n_words; (hash, pos) of the runs that a template has; the words around them as (start, words)."""
    known = np.sort(known.view(np.uint64))
    maybe = np.zeros(1 << 18, bool)
    maybe[(known & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
    counts, hashes, places, sizes, clips = [], [], [], [], []
    for part in slices(text):
        w = Words(part, "letters", lower=True)
        grams = runs(w.hashes(), GRAM)
        at = np.flatnonzero(maybe[(grams & np.uint64(len(maybe) - 1)).astype(np.int64)])
        at = at[np.isin(grams[at], known)]
        at = at[w.left()[at] >= GRAM]
        rows = w.rows[at]
        counts.append(w.counts)
        hashes.append(signed(grams[at]))
        places.append(at - w.first[rows])
        sizes.append(np.bincount(rows, minlength=len(part)))
        cells: list[list[dict] | None] = [None] * len(part)
        for r in np.unique(rows).tolist():
            first, end = w.first[r], w.first[r + 1]
            spans: list[list[int]] = []
            for p in at[rows == r].tolist():
                low, high = max(first, p - reach), min(end, p + reach)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            cells[r] = [{"start": int(a - first), "words": [w.text(i).decode() for i in range(a, b)]} for a, b in spans]
        clips.append(pa.array(cells, CLIPS))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    size = cat(sizes)
    found = pa.StructArray.from_arrays([pa.array(cat(hashes), pa.int64()), pa.array(cat(places), pa.int64())], ["hash", "pos"])
    return pa.StructArray.from_arrays([pa.array(cat(counts), pa.int64()), lists(found, size, found.type), joined(clips, CLIPS)], ["n_words", "grams", "clips"])


CLIPS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string()))]))
CLIP_TYPE = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))])
GRAM_TYPE = T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.LongType())])
SURVEY = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(GRAM_TYPE)), T.StructField("clips", T.ArrayType(CLIP_TYPE))])


def chains(hits: list[tuple[int, int]], length: int, most: int) -> list[list[tuple[int, int]]]:
    """Chains of (position, template position), the best first, none with a match of another.

    A span of m words with M of them matched is alike enough where M - share * m >= share * length, share being half
    the least likeness; so a chain's value is M - share * m, and no gap over 1.5 * length can pay. most: how many words of a gap may
    count as matched.
    """
    share, hits = LEAST_SIMILARITY / 2, sorted(hits)
    value, back, first = [], [-1] * len(hits), 0
    for j, (p, q) in enumerate(hits):
        while p - hits[first][0] > 1.5 * length:
            first += 1
        best = GRAM * (1 - share)
        for i in range(j - 1, first - 1, -1):
            a, b = p - hits[i][0], q - hits[i][1]
            if a > 0 and b > 0 and (v := value[i] + min(most, a, b) - share * a) > best:
                best, back[j] = v, i
        value.append(best)
    used, out = [False] * len(hits), []
    for j in sorted(range(len(hits)), key=lambda j: (-value[j], j)):
        own = []
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(hits[j])
            j = back[j]
        if own:
            out.append(own[::-1])
    return out


def copies(template: list[str], hits: list[tuple[int, int]], words: dict[int, str]) -> list[tuple[int, int, float]]:
    """(start, end, likeness) of the spans that are alike enough, none overlapping a better one. Likeness is twice the words in order in both over all words."""
    n, spans, matcher = len(template), {}, SequenceMatcher(None, template, autojunk=False)
    for most in (GRAM, n):
        for chain in chains(hits, n, most):
            if len(chain) < LEAST_VOTES * (n - GRAM + 1):
                continue
            (a, qa), (b, qb) = chain[0], chain[-1]
            wide = max(a - qa, 0), b + n - qb
            own = [words.get(k, "") for k in range(*wide)]
            matcher.set_seq2(own)
            blocks = [x for x in matcher.get_matching_blocks() if x.size]
            # single words at the ends match too; the span ends at the last matched word
            for low, high in ((a, b + GRAM), (wide[0] + blocks[0].b, wide[0] + blocks[-1].b + blocks[-1].size) if blocks else (a, b + GRAM)):
                if (low, high) not in spans:
                    matcher.set_seq2([words.get(k, "") for k in range(low, high)])
                    spans[low, high] = matcher.ratio()
    out: list[tuple[int, int, float]] = []
    taken: set[int] = set()
    for (low, high), score in sorted(spans.items(), key=lambda x: (-x[1], x[0][0] - x[0][1], x[0])):
        if score >= LEAST_SIMILARITY and taken.isdisjoint(range(low, high)):
            taken.update(range(low, high))
            out.append((low, high, score))
    return out


def likeness(templates: tuple[Template, ...], template: pa.Array, hits: pa.Array, clips: pa.Array) -> pa.Array:
    own = [t.text.split() for t in templates]
    out = []
    for t, found, clip in zip(template.to_pylist(), hits.to_pylist(), clips.to_pylist(), strict=True):
        words = {i: w for c in clip or [] for i, w in enumerate(c["words"], c["start"])}
        out.append([{"start": a, "end": b, "score": x} for a, b, x in copies(own[t], [(h["pos"], h["at"]) for h in found], words)])
    return pa.array(out, COPIES)


COPIES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
COPY_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(surveyed, spans): doc_id, key (the text's hash), n_words of every row; the labelled spans: doc_id, key, label, base, start, end, score."""
    spark = docs.sparkSession
    grams = template_grams(templates)
    reach = 2 * max(len(t.text.split()) for t in templates)
    known = np.array(sorted({h for _, _, h in grams}), np.int64)
    look = F.arrow_udf(lambda text: survey(text, known, reach), SURVEY).asNondeterministic()
    surveyed = store.write(docs.select("doc_id", F.xxhash64("text").alias("key"), look("text").alias("s")).select("doc_id", "key", "s.*"), "licenses")
    joined_to = spark.createDataFrame(grams, "template int, at long, hash long")
    facts = spark.createDataFrame([(i, t.label, t.base, len(t.text.split())) for i, t in enumerate(templates)], "template int, label string, base boolean, length long")
    votes = surveyed.select("doc_id", "key", F.explode("grams").alias("g")).select("doc_id", "key", "g.*").distinct()
    votes = votes.join(F.broadcast(joined_to), "hash").withColumn("diagonal", F.col("pos") - F.col("at"))
    votes = store.write(votes.join(F.broadcast(facts), "template"), "votes")
    diagonals = votes.where("base").groupBy("doc_id", "key", "template", "label", "base", "length", "diagonal").agg(F.count("*").alias("votes"))
    exact = diagonals.where(F.col("votes") == F.col("length") - GRAM + 1)
    exact = exact.select("doc_id", "key", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("score"))
    near = votes.where("not base").groupBy("doc_id", "key", "template", "label", "length").agg(F.collect_list(F.struct("pos", "at")).alias("hits"))
    near = near.where(F.size("hits") >= LEAST_VOTES * (F.col("length") - GRAM + 1))
    compare = F.arrow_udf(lambda *x: likeness(templates, *x), COPY_TYPE).asNondeterministic()
    clips = surveyed.where("size(clips) > 0").groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.first("clips").alias("clips"))
    near = near.join(clips, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "label", F.explode(compare("template", "hits", "clips")).alias("copy"))
    spans = exact.unionByName(near.select("doc_id", "key", "label", F.lit(False).alias("base"), "copy.*"))
    # of spans that overlap, only the most alike (of equals the longest) gives its label; base phrases always do
    best = """filter(spans, x -> x.base or not exists(spans, y -> y.start < x.end and y.end > x.start
        and (y.score > x.score or y.score = x.score and y.end - y.start > x.end - x.start)))"""
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("label", "base", "start", "end", "score")).alias("spans"))
    return surveyed.select("doc_id", "key", "n_words"), spans.select("doc_id", "key", F.explode(F.expr(best)).alias("s")).select("doc_id", "key", "s.*")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    surveyed, spans = scan(store.read(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_doc = spans.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        text(F.when(F.col("base"), F.col("label"))).alias("base_labels"), text("label").alias("labels"), F.max("score").alias("score"),
    )
    out = surveyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
