"""Substring dedup: word passages that recur across documents, located by Aho-Corasick automata.

A window is 50 consecutive words. A word goes if a window over it also starts in a document with a smaller
doc_id. The steps, each over all documents:
0. a text equal to that of a smaller doc_id goes whole, and only the first of equal texts takes part in the rest. Those are
   dealt by doc_id to shards of bounded size and written once, in buckets that every later step reads in place;
1. every window picks the least hash among its 31 runs of 20 words as its anchor. Equal windows pick equal
   anchors, so only windows whose anchor occurs in two documents can recur. Shards count their anchors first, so an anchor of
   every document is a row a shard and not a row a document; windows likewise;
2. the windows with such anchors are counted whole; those in two documents are confirmed, and each is
   owned by its smallest doc_id. Consecutive windows of an owner form a passage, which is sent with its text to the shards that
   have one of its anchors;
3. a shard's passages are cut into phrases of 25 words, one in every 50-word window, and compiled into an automaton over word hashes.
   All documents of the shard are streamed through it whole. The windows around each hit are looked up among the passages',
   compared with them word by word, and go if the owner's doc_id is smaller.

Windows are counted by 64-bit hashes; what is removed has been compared as words. Defined results: a null text has no words; a null doc_id
neither causes nor suffers removals; rows with equal doc_id don't remove each other's words; extra columns pass through
remove_repeats(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .words import U, Words, lists, mix, runs, signed, sliding_min, slices

WINDOW, GRAM, PHRASE = 50, 20, 25
#: Words of documents in a shard, and in a bucket of the written table.
SHARD_WORDS, TASK_WORDS = 2_000_000, 2_000_000
#: Parts into which the rows of one whole text are dealt when its copies are told.
SALTS = 64
LONGS = T.ArrayType(T.LongType())


def anchored(hashes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows and the hash of each one's anchor."""
    grams = runs(hashes, GRAM)
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = U((1 << 28) - 1)
    least = sliding_min((mix(grams) & ~low) | np.arange(len(grams), dtype=U), WINDOW - GRAM + 1)
    at = np.flatnonzero(left[: len(least)] >= WINDOW)
    return at, grams[(least[at] & low).astype(np.int64)]


def keyed(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values that differ between rows."""
    return x ^ mix(rows.astype(U) + U(1))


def digest(words: Words, row: int, keep: np.ndarray | None = None) -> str:
    """The hex SHA-256 of a row's words (those kept, if given), joined by one space."""
    return hashlib.sha256(text_of(words, row, keep)).hexdigest()


def text_of(words: Words, row: int, keep: np.ndarray | None = None) -> bytes:
    data = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
    return b" ".join(data if keep is None else [w for w, k in zip(data, keep.tolist(), strict=True) if k])


def survey(text: pa.Array) -> pa.Array:
    """Per text: n_words, the digest of all its words, and its distinct anchors."""
    counts, digests, anchors, sizes = [], [], [], []
    for part in slices(text):
        w = Words(part)
        at, anchor = anchored(w.hashes(), w.left())
        rows = w.rows[at]
        _, first = np.unique(keyed(anchor, rows), return_index=True)
        first.sort()
        anchors.append(anchor[first])
        sizes.append(np.bincount(rows[first], minlength=len(part)))
        counts.append(w.counts)
        digests += [digest(w, r) for r in range(len(part))]
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return pa.StructArray.from_arrays([pa.array(cat(counts, np.int64), pa.int64()), pa.array(digests, pa.string()), lists(signed(cat(anchors, U)), cat(sizes, np.int64), pa.int64())], ["n_words", "full_sha256", "anchors"])


def without_copies(texts: pa.Table, given: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(texts without the shard's copies, given without the rows that name them by doc_id and key)."""
    named = given.column("doc_id").is_valid()
    copies = given.filter(named)
    if copies.num_rows:
        gone = set(zip(copies.column("doc_id").to_pylist(), copies.column("key").to_pylist(), strict=True))
        texts = texts.filter(pa.array([x not in gone for x in zip(texts.column("doc_id").to_pylist(), texts.column("key").to_pylist(), strict=True)], pa.bool_()))
    return texts, given.filter(pc.invert(named))


def shard_windows(texts: pa.Table, anchors: pa.Table) -> pa.Table:
    """The distinct windows with one of the given anchors in a shard, each with its smallest and largest doc_id."""
    texts, anchors = without_copies(texts, anchors)
    own, ids, at_row = np.sort(anchors.column("anchor").to_numpy()).view(U), texts.column("doc_id").to_numpy(), 0
    found, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for part in parts_of(texts) if len(own) else ():
        w = Words(part)
        hashes = w.hashes()
        at, anchor = anchored(hashes, w.left())
        at = at[np.isin(anchor, own)]
        found.append(runs(hashes, WINDOW)[at] if len(at) else np.zeros(0, U))
        docs.append(ids[at_row + w.rows[at]])
        at_row += len(part)
    window, doc = np.concatenate(found), np.concatenate(docs)
    order = np.lexsort((doc, window))
    window, doc = window[order], doc[order]
    _, first = np.unique(window, return_index=True)
    last = np.append(first[1:], len(window)) - 1 if len(first) else first
    return pa.table({"window": pa.array(signed(window[first]), pa.int64()), "low": pa.array(doc[first], pa.int64()), "high": pa.array(doc[last], pa.int64())})


def parts_of(texts: pa.Table):
    """The texts of a table in slices that fit a CPU's cache."""
    for chunk in texts.column("text").chunks:
        yield from slices(chunk)


def shard_passages(texts: pa.Table, owned: pa.Table) -> pa.Table:
    """The maximal runs of owned windows in a shard's documents: owner, the passage's words joined by one space, its windows' anchors."""
    ids, at_row = texts.column("doc_id").to_numpy(), 0
    windows = owned.column("window").to_numpy().view(U) ^ mix(owned.column("owner").to_numpy().view(U) + U(1))
    owners, out, seen = set(owned.column("owner").to_pylist()), [], set()
    for part in parts_of(texts):
        mine = [r for r in range(len(part)) if int(ids[at_row + r]) in owners]
        base, at_row = at_row, at_row + len(part)
        if not mine:
            continue
        part = part.take(pa.array(mine))
        w = Words(part)
        hashes = w.hashes()
        at, anchor = anchored(hashes, w.left())
        rows = w.rows[at]
        doc = ids[base + np.array(mine)]
        hit = np.flatnonzero(np.isin(runs(hashes, WINDOW)[at] ^ mix(doc[rows].view(U) + U(1)), windows))
        for run in np.split(hit, np.flatnonzero(np.diff(at[hit]) > 1) + 1) if len(hit) else []:
            start, end, owner = int(at[run[0]]), int(at[run[-1]]) + WINDOW, int(doc[rows[run[0]]])
            words = b" ".join(w.data[w.starts[start] : w.ends[end - 1]].tobytes().split())
            if (owner, words) not in seen:  # rows may share a doc_id
                seen.add((owner, words))
                out.append((owner, words, signed(np.unique(anchor[run]))))
    owner, words, anchors = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"owner": pa.array(owner, pa.int64()), "words": pa.array(words, pa.binary()), "anchors": pa.array(anchors, pa.list_(pa.int64()))})


def letters(hashes: np.ndarray) -> tuple[int, ...]:
    """Word hashes as the automaton's 31-bit letters; the windows that it leads to are compared in full."""
    return tuple((hashes >> U(33)).astype(np.int64).tolist())


class PassageFinder:
    """An automaton over the 25-word phrases of some passages (words joined by one space), and the passages' windows to confirm its hits."""

    def __init__(self, owners: list[int], passages: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.passages = passages
        windows, held, owned, places = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (owner, words) in enumerate(zip(owners, passages, strict=True)):
            hashes = Words(pa.array([words], pa.binary()).cast(pa.string())).hashes()
            whole = letters(hashes)
            for at in range(0, len(whole) - PHRASE + 1, PHRASE):
                self.automaton.add_word(whole[at : at + PHRASE])
            own = runs(hashes, WINDOW)
            windows.append(own)
            held.append(np.full(len(own), i))
            owned.append(np.full(len(own), owner))
            places.append(np.arange(len(own)))
        self.automaton.make_automaton()
        window, held_, owned_, places_ = map(np.concatenate, (windows, held, owned, places))
        order = np.lexsort((owned_, window))
        self.windows, first = np.unique(window[order], return_index=True)
        self.passage, self.owners, self.places = (x[order][first] for x in (held_, owned_, places_))

    def removed(self, doc_id: int, hashes: np.ndarray, text: bytes) -> list[tuple[int, int]]:
        """The runs (start, end) of words in windows that a passage of a smaller document holds."""
        if len(hashes) < WINDOW:
            return []
        last = np.fromiter((end for end, _ in self.automaton.iter(letters(hashes))), np.int64)
        if not len(last):
            return []
        # the windows that hold a phrase found: they start up to 25 words before it
        near = np.zeros(len(hashes) + WINDOW + 1, np.int64)
        np.add.at(near, np.maximum(0, last - WINDOW + 1), 1)
        np.add.at(near, last - PHRASE + 2, -1)
        starts = np.flatnonzero(np.cumsum(near)[: len(hashes) - WINDOW + 1] > 0)
        found = runs(hashes, WINDOW)[starts]
        at = np.minimum(np.searchsorted(self.windows, found), len(self.windows) - 1)
        hit = (self.windows[at] == found) & (self.owners[at] < doc_id)
        starts, at = starts[hit], at[hit]
        if not len(starts):
            return []
        words = text.split()
        good = np.zeros(len(starts), bool)
        # stretches that run along one passage are compared as one
        cuts = np.flatnonzero((np.diff(starts) != 1) | (np.diff(self.places[at]) != 1) | (np.diff(self.passage[at]) != 0)) + 1
        for run in np.split(np.arange(len(starts)), cuts):
            passage = self.passages[self.passage[at[run[0]]]].split(b" ")
            a, b, n = int(starts[run[0]]), int(self.places[at[run[0]]]), len(run) - 1 + WINDOW
            if words[a : a + n] == passage[b : b + n]:
                good[run] = True
            else:
                for k in run.tolist():
                    a, b = int(starts[k]), int(self.places[at[k]])
                    good[k] = words[a : a + WINDOW] == passage[b : b + WINDOW]
        starts = starts[good]
        cuts = np.flatnonzero(np.diff(starts) > WINDOW) + 1
        return [(int(x[0]), int(x[-1]) + WINDOW) for x in np.split(starts, cuts) if len(x)]


def shard_removals(texts: pa.Table, passages: pa.Table) -> pa.Table:
    """The runs of words to remove from each of a shard's documents that has any, and what is left of it."""
    rows: list[tuple] = []
    texts, passages = without_copies(texts, passages)
    if passages.num_rows:
        finder = PassageFinder(passages.column("owner").to_pylist(), passages.column("words").to_pylist())
        ids, keys, at_row = texts.column("doc_id").to_pylist(), texts.column("key").to_pylist(), 0
        for part in parts_of(texts):
            w = Words(part)
            hashes = w.hashes()
            for r in range(len(part)):
                text = w.data[w.offsets[r] : w.offsets[r + 1]].tobytes()
                own = finder.removed(ids[at_row + r], hashes[w.first[r] : w.first[r + 1]], text)
                if own:
                    keep = np.ones(w.first[r + 1] - w.first[r], bool)
                    for a, b in own:
                        keep[a:b] = False
                    left = text_of(w, r, keep)
                    rows.append((ids[at_row + r], keys[at_row + r], [{"start": a, "end": b} for a, b in own], int((~keep).sum()), hashlib.sha256(left).hexdigest()))
            at_row += len(part)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, REMOVED.types, strict=True)], schema=REMOVED)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
REMOVED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("runs", RUNS), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
REMOVED_DDL = "doc_id long, key long, runs array<struct<start: long, end: long>>, n_removed long, kept_sha256 string"


def udf(f, kind: T.DataType, *args: Column | str) -> Column:
    return F.arrow_udf(f, kind).asNondeterministic()(*args)


SURVEY = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("full_sha256", T.StringType()), T.StructField("anchors", LONGS)])


def with_copies(surveyed: DataFrame) -> DataFrame:
    """Adds copy: the whole text (of a window or more) is that of a smaller doc_id. A text's many copies meet its digest in SALTS parts."""
    salted = surveyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    long = salted.where(f"n_words >= {WINDOW} and doc_id is not null").groupBy("full_sha256", "salt").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    whole = long.groupBy("full_sha256").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("full_sha256", "first")
    firsts = whole.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = salted.join(firsts, ["full_sha256", "salt"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return out.drop("first", "salt")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survey, removed): doc_id, key (of the text), n_words, full_sha256 and copy of every row; the removed runs of words, n_removed and
    kept_sha256 by doc_id and key of the rows that lose words and are no copies. Texts are shuffled once.

    A copy loses all its words; only the first of equal texts takes part in what follows. Its doc_id is the smallest, so no window gets
    another owner by that.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("key"))
    surveyed = store.write(docs.select("doc_id", "key", udf(survey, SURVEY, "text").alias("s")).select("doc_id", "key", "s.*"), "survey")
    first, surveyed = surveyed, store.write(with_copies(surveyed).select("doc_id", "key", "n_words", "full_sha256", "copy", F.when(~F.col("copy"), F.col("anchors")).alias("anchors")), "survey")
    store.drop(first)
    taking = surveyed.where(f"doc_id is not null and not copy and n_words >= {WINDOW}")
    total = taking.agg(F.sum("n_words")).first()[0] or 0
    shards, buckets = max(1, -(-total // SHARD_WORDS)), max(1, -(-total // TASK_WORDS))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    dealt = store.write_bucketed(docs.where("doc_id is not null").select(shard("doc_id"), "doc_id", "key", "text"), "texts", "shard", buckets)
    texts = dealt.groupBy("shard")
    copies = surveyed.where("copy").select(shard("doc_id"), "doc_id", "key").distinct()
    given = lambda df: df.unionByName(copies, allowMissingColumns=True).groupBy("shard")
    anchors = taking.select(shard("doc_id"), "doc_id", F.explode("anchors").alias("anchor")).groupBy("shard", "anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    anchors = store.write(anchors, "anchors")
    recurring = anchors.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor")
    shared = store.write(anchors.select("shard", "anchor").join(recurring, "anchor"), "anchors")
    store.drop(anchors)
    windows = texts.cogroup(given(shared)).applyInArrow(shard_windows, "window long, low long, high long")
    owned = windows.groupBy("window").agg(F.min("low").alias("owner"), F.max("high").alias("high")).where("owner < high").select(shard("owner"), "owner", "window")
    owned = store.write(owned, "owned")
    passages = texts.cogroup(owned.groupBy("shard")).applyInArrow(shard_passages, "owner long, words binary, anchors array<long>")
    passages = store.write(passages.withColumn("passage", F.xxhash64("owner", "words")), "passages")
    # which passages are compiled in which shards; words follow when that is known
    routes = passages.select("passage", F.explode("anchors").alias("anchor")).join(shared, "anchor").select("shard", "passage").distinct()
    routes = routes.join(passages.select("passage", "owner", "words"), "passage").drop("passage")
    found = store.write(texts.cogroup(given(routes)).applyInArrow(shard_removals, REMOVED_DDL), "runs")
    store.drop(dealt, shared, owned, passages)
    return surveyed.drop("anchors"), found


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row."""
    surveyed, found = removals(docs)
    # rows may share doc_id and text, and are then found alike
    found = found.groupBy("doc_id", "key").agg(F.first("n_removed").alias("n_removed"), F.first("kept_sha256").alias("kept_sha256"))
    out = surveyed.join(found, ["doc_id", "key"], "left")
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "full_sha256"))
    return out.select("doc_id", "n_words", gone.alias("n_removed"), kept.alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows with removed words cut out of text (then words are joined by one space) and n_chars, if a column, kept in step. Rows that lose all words go."""
    surveyed, found = removals(docs)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    copies = surveyed.where("copy").select("doc_id", "key", whole.alias("runs"))
    cuts = found.select("doc_id", "key", "runs").unionByName(copies).groupBy(F.col("doc_id").alias("quill_id"), F.col("key").alias("quill_key")).agg(F.first("runs").alias("quill_runs"))
    cuts = store.write(cuts, "cuts")
    store.drop(surveyed, found)
    both = docs.join(cuts, (docs["doc_id"] == cuts["quill_id"]) & (F.xxhash64(docs["text"]) == cuts["quill_key"]), "left")
    cut = both.withColumn("quill_text", F.when(F.col("quill_runs").isNotNull(), udf(cut_out, T.StringType(), "text", "quill_runs")))
    cut = cut.where("quill_text is null or quill_text <> ''").withColumn("text", F.coalesce("quill_text", "text"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("quill_text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def cut_out(text: pa.Array, runs_: pa.Array) -> pa.Array:
    """Per text: what is left without the given runs of words, joined by one space; a text without runs is left out, as it stays."""
    texts, at_row = [], 0
    for part in slices(text):
        w = Words(part)
        for r in range(len(part)):
            own = runs_[at_row + r].as_py()
            keep = np.ones(w.first[r + 1] - w.first[r], bool)
            for x in own or []:
                keep[x["start"] : x["end"]] = False
            texts.append(text_of(w, r, keep).decode() if own else None)
        at_row += len(part)
    return pa.array(texts, pa.string())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(store.read(spark, sf_dir, "documents"))


OP6_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i+49], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)
), own as (
  select s, min(doc_id) as m from win group by s
), cut as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from win join own using (s) where m < doc_id
), word as (
  select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w
), kept as (
  select word.doc_id, string_agg(x, ' ' order by word.p) as t from word left join cut on cut.doc_id = word.doc_id and cut.p = word.p where cut.p is null group by 1
), gone as (
  select doc_id, count(*) as n from cut group by 1
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(gone.n, 0)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join gone on gone.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id
"""
