"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: t coordinates are bins. In round i < t each shingle is thrown into one hashed bin, in round
i >= t all of them go to bin i - t, so 2t rounds at most fill every coordinate, however small the
set; a bin keeps the least hash of the first round that reached it. Rounds end when all bins are full,
so a set of n shingles costs O(n + t log t), and the share of equal coordinates of two sets
concentrates about their similarity as that of t independent MinHashes does.

Linking, without all pairs of a group:
1. equal shingle sets become one class (an aggregate by the set's 128-bit hash);
2. in each band bucket every class meets only the bucket's smallest class; verified links give components;
3. only buckets in which more than one component is left go on. Classes of different components in a bucket of up to
   SMALL are paired where the sketches' sign bits don't rule 0.75 out, and verified. The larger buckets of one
   smallest class are taken together and cut into blocks of bounded size; each pair of blocks is compared in one task, as
   a product of membership matrices, and gives one link for two components at most. No pairs are written out.
Each pair that shares a bucket is thus verified or already connected. 32 bands of 4 rows miss a pair of
similarity 0.75 with probability 5e-6, and a pair of 0.8 with 5e-8. The sign-bit filter of step 3 passes a
pair of 0.75 or more but for 2e-7.

Defined results: null and empty texts have no set and link with nothing; a null doc_id links with nothing,
has a null component and is kept; rows that share a doc_id count as one document; extra columns are ignored
by near_duplicates() and passed through by filter_documents(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .words import U, Words, joined, lists, mix, shingles, signed, slices

SHINGLE, SIMILARITY = 5, 0.75
#: What tells a shingle set.
KEY = ["set1", "set2", "n_shingles"]
BINS, ROWS, MOST_SIGNS = 128, 4, 40
#: Classes in a bucket that are paired as rows; shingles in a block of a larger one; block pairs in a task.
SMALL, BLOCK_SHINGLES, PAIRS_A_TASK = 16, 80_000, 8
#: Pairs of one hub that are verified with one copy of its text.
HUB_PAIRS = 1024
#: Bytes of text that a task sketches at a time: its arrays take some 100 MB.
SKETCHED = 4 << 20


def similarity_sketch(rows: np.ndarray, found: np.ndarray, n_rows: int, bins: int = BINS) -> np.ndarray:
    """The sketch of each row's set: an array (n_rows, bins) of hashes. Rows without shingles stay all ones."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(n_rows * bins, empty)
    for i in range(2 * bins):
        h = mix(found + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        cell = rows * bins + (h % U(bins) if i < bins else U(i - bins)).astype(np.int64)
        new = np.full(len(sketch), empty) if i else sketch
        np.minimum.at(new, cell, np.minimum(h, empty - U(1)))
        sketch = np.where(sketch == empty, new, sketch)
        unfilled = (sketch.reshape(n_rows, bins) == empty).any(1)
        going = unfilled[rows]
        if not going.any():
            break
        rows, found = rows[going], found[going]
    return sketch.reshape(n_rows, bins)


def sketch_text(text: pa.Array) -> pa.Array:
    """Per text: n_shingles, the set's hash (set1, set2), 128 sign bits (bits1, bits2) and its band keys. Made for SKETCHED bytes of text at a time, whatever the batch's size."""
    return joined([sketch_part(part) for part in slices(text, SKETCHED)], pa.struct([(f.name, pa.list_(pa.int64()) if f.name == "bands" else pa.int64()) for f in SKETCH]))


def sketch_part(text: pa.Array) -> pa.Array:
    parts, base = [], 0
    for part in slices(text):
        rows, found = shingles(Words(part, lower=True), SHINGLE)
        parts.append((rows + base, found))
        base += len(part)
    n = len(text)
    rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    found = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, U)
    size = np.bincount(rows, minlength=n)
    sets = []
    for salt in (U(1), U(2)):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(found * U(2) + salt))])
        at = np.concatenate([[0], np.cumsum(size)])
        sets.append(mix(sums[at[1:]] - sums[at[:-1]]))
    full = np.flatnonzero(size)
    ranks = np.cumsum(size > 0) - 1
    sketch = similarity_sketch(ranks[rows], found, len(full))
    signs = np.zeros((n, 2), np.int64)
    signs[full] = np.packbits((mix(sketch) & U(1)).astype(np.uint8), axis=1).view(np.int64).reshape(len(full), -1)
    keys = np.zeros((len(full), BINS // ROWS), U)
    for k in range(ROWS):
        keys = mix(keys * U(31) + sketch[:, k::ROWS])
    keys = mix(keys + np.arange(BINS // ROWS, dtype=U))
    bands = lists(signed(keys.ravel()), np.where(size > 0, BINS // ROWS, 0), pa.int64())
    ints = [pa.array(signed(x), pa.int64()) for x in (size, *sets, signs[:, 0].copy(), signs[:, 1].copy())]
    return pa.StructArray.from_arrays([*ints, bands], ["n_shingles", "set1", "set2", "bits1", "bits2", "bands"])


SKETCH = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_shingles", "set1", "set2", "bits1", "bits2")), T.StructField("bands", T.ArrayType(T.LongType()))])


def sketches(text: Column | str) -> Column:
    return F.arrow_udf(sketch_text, SKETCH).asNondeterministic()(text)


def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether 100 * intersection >= 75 * union of the two texts' full shingle sets, and neither is empty."""
    out, at = [], 0
    for x in slices(a):
        (rows_a, found_a), (rows_b, found_b) = (shingles(Words(t, lower=True), SHINGLE) for t in (x, b.slice(at, len(x))))
        at += len(x)
        keys = np.concatenate([found_a ^ mix(rows_a.astype(U) + U(1)), found_b ^ mix(rows_b.astype(U) + U(1))])
        _, first, times = np.unique(keys, return_index=True, return_counts=True)
        n = len(x)
        both = np.bincount(rows_a[first[times > 1]], minlength=n)
        union = np.bincount(rows_a, minlength=n) + np.bincount(rows_b, minlength=n) - both
        out.append(pa.array((both > 0) & (both >= SIMILARITY * union)))
    return joined(out, pa.bool_())


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts' full sets are similar enough; pairs: a written table. Only texts that are in a pair are shuffled.

    A hub's text goes once to each HUB_PAIRS or so of its pairs, not to all of them in one task.
    """
    texts = lambda c: docs.select(F.col("doc_id").alias("id"), F.col("text").alias("quill_text")).join(pairs.select(F.col(c).alias("id")), "id", "left_semi")
    large = store.write(pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("salts")).where("salts > 1"), "hubs")
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(large, pairs["a"] == large["hub"], "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    hubs = texts("a").join(large, F.col("id") == large["hub"], "left").select("id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"), "quill_text")
    # of one kind at every size: the texts meet their pairs by a shuffle
    left = salted.hint("merge").join(hubs, (F.col("a") == F.col("id")) & (F.col("salt") == F.col("part"))).select("a", "b", F.col("quill_text").alias("text_a"))
    both = left.hint("merge").join(texts("b"), left["b"] == F.col("id")).select("a", "b", "text_a", F.col("quill_text").alias("text_b"))
    check = F.arrow_udf(similar, T.BooleanType()).asNondeterministic()
    out = store.write(both.select("a", "b", check("text_a", "text_b").alias("ok")).where("ok").select("a", "b"), "links")
    store.drop(large)
    return out


def set_of(text: pa.Array) -> pa.Array:
    """Each text's shingle set as bytes."""
    out: list[bytes] = []
    for part in slices(text):
        rows, found = shingles(Words(part, lower=True), SHINGLE)
        out += [x.tobytes() for x in np.split(found, np.searchsorted(rows, np.arange(1, len(part))))]
    return pa.array(out, pa.binary())


def similar_in_blocks(a: list[dict], b: list[dict], columns: int = 4096) -> list[tuple[int, int]]:
    """For every two components with members in blocks a and b, one pair of members that are similar enough, if any."""
    sets = [np.frombuffer(m["set"], U) for m in [*a, *b]]
    sizes = np.array([len(x) for x in sets])
    shared, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    rank = np.cumsum(times > 1) - 1
    common = times[column] > 1
    rows, column = rows[common], rank[column[common]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        at = slice(*np.searchsorted(column, [low, low + columns]))
        m = np.zeros((len(sets), columns), np.float32)
        m[rows[at], column[at] - low] = 1
        both += m[: len(a)] @ m[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - both
    labels = [np.array([m["label"] for m in x], np.int64) for x in (a, b)]
    i, j = np.nonzero((both > 0) & (both >= SIMILARITY * union) & (labels[0][:, None] != labels[1][None, :]))
    _, first = np.unique(np.stack([labels[0][i], labels[1][j]]), axis=1, return_index=True)
    return [(a[i[k]]["rep"], b[j[k]]["rep"]) for k in first]


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            a, b = (batch.column(c)[r].as_py() for c in ("members_a", "members_b"))
            if found := similar_in_blocks(a, b):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])


def links_in_blocks(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components among the members of each hub's group: (hub, rep, label, n_shingles)."""
    cuts = groups.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = store.write(groups.join(cuts, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), "placed")
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("text").alias("text"))
    sets = texts.join(placed.select("rep").distinct(), "rep").select("rep", F.arrow_udf(set_of, T.BinaryType()).asNondeterministic()("text").alias("set"))
    blocks = placed.join(sets, "rep").groupBy("hub", "block").agg(F.collect_list(F.struct("rep", "label", "set")).alias("members"))
    blocks = store.write(blocks, "blocks")
    numbers = blocks.select("hub", "block")
    x, y = numbers.withColumnRenamed("block", "a"), numbers.withColumnRenamed("block", "b")
    pairs = numbered = store.write(x.join(y, "hub").where("a <= b"), "pairs")
    tasks = max(1, -(-pairs.count() // PAIRS_A_TASK))
    for s in "ab":
        pairs = pairs.join(blocks.select("hub", F.col("block").alias(s), F.col("members").alias(f"members_{s}")), ["hub", s])
    out = store.write(pairs.repartition(tasks, "hub", "a", "b").mapInArrow(compare_blocks, "a long, b long"), "links")
    store.drop(placed, blocks, numbered)
    return out


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches, named): the written tables of every row's sketch and of each shingle set's component; all others are gone when this returns."""
    keyed = store.write(docs.select("doc_id", sketches("text").alias("s")).select("doc_id", "s.*"), "sketches")
    classes = store.write(
        keyed.where("n_shingles > 0 and doc_id is not null").groupBy(*KEY).agg(F.min("doc_id").alias("rep"), *(F.any_value(c).alias(c) for c in ("bits1", "bits2", "bands"))), "classes"
    )
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    # most buckets hold one class and end here: what follows is about the others' members. Of one kind at every size
    shared = store.write(buckets.join(hubs.hint("merge"), "band").select("band", "rep", "hub", "n"), "shared")
    stars = store.write(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = verified(stars, docs)
    label = store.components(links)
    # what is left: buckets that hold members of several components
    member = store.write(shared.join(label, F.col("rep") == F.col("node"), "left").select("band", "rep", "hub", "n", F.coalesce("component", "rep").alias("label")), "member")
    store.drop(shared, label)
    mixed = member.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    rest = store.write(member.join(mixed, "band", "left_semi").join(classes.select("rep", "n_shingles", "bits1", "bits2"), "rep"), "rest")
    store.drop(member)
    x, y = rest.where(f"n <= {SMALL}").alias("x"), rest.where(f"n <= {SMALL}").alias("y")
    differ = F.bit_count(F.col("x.bits1").bitwiseXOR(F.col("y.bits1"))) + F.bit_count(F.col("x.bits2").bitwiseXOR(F.col("y.bits2")))
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") < F.col("y.label")) & (differ <= MOST_SIGNS))
    across = across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    across = store.write(across, "across")
    store.drop(stars)
    more = verified(across, docs)
    large = links_in_blocks(rest.where(f"n > {SMALL}").select("hub", "rep", "label", "n_shingles").distinct(), docs)
    store.drop(across, rest)
    final = store.components(links.unionByName(more).unionByName(large))
    store.drop(links, more, large)
    named = store.write(classes.join(final, F.col("rep") == F.col("node"), "left").select(*KEY, F.coalesce("component", "rep").alias("component")), "named")
    store.drop(classes, final)
    return keyed, named


def rows_of(keyed: DataFrame, named: DataFrame) -> DataFrame:
    linked = F.expr("n_shingles > 0 and doc_id is not null")
    found = keyed.where(linked).join(named, KEY).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    # texts without words take no part in the join, where they would all have one key
    return found.unionByName(keyed.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) for every row."""
    return rows_of(*classed(docs))


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns. Rows that share a doc_id count as one document."""
    keyed, named = classed(docs)
    fates = rows_of(keyed, named).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n")).where("n <> 1")
    # the few that go, not the many that stay, are what the documents are joined with
    fates = store.write(fates, "fates")
    store.drop(keyed, named)
    out = docs.where("doc_id is not null").join(fates.where("n = 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if fates.where("n > 1").limit(1).count():
        # of rows that share a doc_id the least by text, then by all columns
        first = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*(docs[c] for c in docs.columns))))
        out = out.withColumn("quill_n", F.row_number().over(first)).where("quill_n = 1").drop("quill_n")
    return out.unionByName(docs.where("doc_id is null"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(store.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Link classes by brute force over an inverted index of shingles, then reachability.
OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i+4], ' ') end as sh
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2
), l as (
  select x, y from p join n u on u.doc_id = x join n v on v.doc_id = y where 100 * c >= 75 * (u.n + v.n - c)
), r(doc_id, m) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, l.y from r join l on l.x = r.m
)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.m) as component_id, d.doc_id = min(r.m) as kept
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""
