"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c). Vectors are put in the order of their grid cells (of width
epsilon) on the leading principal dimensions, label by label, and the ordered sequence is cut into blocks.
1. Equal vectors of a label become one class that carries its count.
2. Mean and covariance of all classes (summed in the tasks, 64 * 64 numbers to the driver) give the principal dimensions.
3. Classes are range-partitioned into grid order; each partition cuts its sequence into blocks with bounding boxes.
4. Blocks of a label meet if the first dimension's cells are the same or adjacent (an equi-join on cells)
   and their boxes are within epsilon. Only the small box rows are joined; vectors follow for the pairs left.
5. A pair of blocks is joined recursively: intervals of the two sequences whose boxes are farther apart than epsilon are
   skipped, others are halved down to a leaf, where one matrix product gives all cosines in double precision.
   A pair of blocks returns each linked vector's number of links and the smallest vector it reaches, not the links. Pairs are dealt
   in tiles of 8 by 8 neighbouring blocks, and a block goes once to each tile that has a pair of it.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and those without a
label, link with nothing; vectors of different lengths neither; rows that share a vec_id count one by one in n_links; a null
vec_id links with nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

COSINE, BLOCK, LEAF, GRID_DIMS, BOX_DIMS = 0.93, 512, 64, 4, 16
#: Neighbouring blocks in a side of a tile, as a power of two.
TILE_BITS = 3
VALID = """vec_id is not null and label is not null and embedding is not null and size(embedding) > 0
    and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"""


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each vector length in the batch."""
    column = batch.column("embedding")
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, units(flat[at[rows][:, None] + np.arange(dim)])


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products by vector length."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in matrices(batch):
            d = x.shape[1]
            total[d] = total.get(d, 0) + np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    for d, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["dim", "sums"])


def principal(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: the mean and the leading principal dimensions as columns."""
    sums = classes.select("embedding").mapInArrow(moments, "dim long, sums array<double>").select("dim", F.posexplode("sums").alias("at", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in sums.groupBy("dim", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["dim"], {})[r["at"]] = r["v"]
    out = {}
    for d, v in found.items():
        x = np.array([v[i] for i in range(len(v))])
        mean = x[1 : d + 1] / x[0]
        _, axes = np.linalg.eigh(x[d + 1 :].reshape(d, d) / x[0] - np.outer(mean, mean))
        out[d] = mean, np.ascontiguousarray(axes[:, ::-1][:, :BOX_DIMS])
    return out


def to_cells(batches: Iterator[pa.RecordBatch], basis: dict, epsilon: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = np.zeros((batch.num_rows, GRID_DIMS), np.int64)
        for rows, x in matrices(batch):
            mean, axes = basis[x.shape[1]]
            y = np.floor((x - mean) @ axes[:, :GRID_DIMS] / epsilon).astype(np.int64)
            cells[rows, : y.shape[1]] = y
        columns = [batch.column("label"), pa.array(batch.column("embedding").value_lengths(), pa.int64()), *(pa.array(c) for c in cells.T.copy()), *(batch.column(c) for c in ("rep", "n", "embedding"))]
        yield pa.RecordBatch.from_arrays(columns, ["label", "dim", *(f"c{i}" for i in range(GRID_DIMS)), "rep", "n", "embedding"])


def to_blocks(batches: Iterator[pa.RecordBatch], basis: dict) -> Iterator[pa.RecordBatch]:
    """The partition's ordered sequence as blocks of one label and length, each with its bounding box."""
    made = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    key = None

    def block() -> pa.RecordBatch:
        x = units(np.array([h[1] for h in held], np.float64))
        mean, axes = basis[x.shape[1]]
        y = (x - mean) @ axes
        reps, ns = (np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 2))
        row = {"block": made, "label": key[0], "dim": key[1], "low": y.min(0).tolist(), "high": y.max(0).tolist(), "reps": reps, "ns": ns, "vectors": np.array([h[1] for h in held], np.float64).tobytes()}
        return pa.RecordBatch.from_pylist([row], BLOCKS)

    for batch in batches:
        for label, dim, rep, n, vector in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "rep", "n", "embedding")), strict=True):
            if held and (key != (label, dim) or len(held) >= BLOCK):
                yield block()
                made, held = made + 1, []
            key = (label, dim)
            held.append((rep, vector, n))
    if held:
        yield block()


BLOCKS = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("reps", pa.binary()), ("ns", pa.binary()), ("vectors", pa.binary())])
BLOCKS_DDL = "block long, label long, dim long, low array<double>, high array<double>, reps binary, ns binary, vectors binary"


def join_intervals(a: np.ndarray, b: np.ndarray, box_a: np.ndarray, box_b: np.ndarray, cosine: float, base: tuple[int, int] = (0, 0), same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with enough cosine between two sequences (a with itself if same); box_a, box_b: their projections."""
    if same and base[0] > base[1]:
        return  # the mirrored half
    gap = np.maximum(0, np.maximum(box_a.min(0) - box_b.max(0), box_b.min(0) - box_a.max(0)))
    if (gap * gap).sum() > 2 - 2 * cosine + 1e-9:
        return
    if len(a) > LEAF or len(b) > LEAF:
        cuts_a, cuts_b = (range(0, len(x), max(1, -(-len(x) // 2))) for x in (a, b))
        half_a, half_b = -(-len(a) // 2), -(-len(b) // 2)
        for i in cuts_a:
            for j in cuts_b:
                yield from join_intervals(a[i : i + half_a], b[j : j + half_b], box_a[i : i + half_a], box_b[j : j + half_b], cosine, (base[0] + i, base[1] + j), same)
        return
    dots = a @ b.T
    i, j = np.nonzero(dots >= cosine - 1e-9)
    close = np.abs(dots[i, j] - cosine) < 1e-9
    good = ~close
    good[close] = [float(np.dot(a[x], b[y])) >= cosine for x, y in zip(i[close], j[close], strict=True)]
    i, j = i[good] + base[0], j[good] + base[1]
    if same:
        i, j = i[i < j], j[i < j]
    yield i, j


def summed(i: np.ndarray, j: np.ndarray, reps: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, others, least) of each vector that a link i-j touches: the vectors linked with it and the smallest rep reachable by these links."""
    others = np.bincount(i, ns[j], len(reps)) + np.bincount(j, ns[i], len(reps))
    least, before = reps.copy(), None
    while before is None or (before != least).any():
        before, low = least.copy(), np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
    at = np.flatnonzero(others)
    return reps[at], others[at].astype(np.int64), least[at]


def join_tile(members: pa.Table, pairs: pa.Table, basis: dict, cosine: float) -> pa.Table:
    """A row for each vector and pair of blocks that have links, not for each link: a large group of near vectors stays linear. A block comes once to a tile of pairs."""
    held = {}
    for r in members.to_pylist():
        x = units(np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"]))
        mean, axes = basis[r["dim"]]
        held[r["block"]] = x, (x - mean) @ axes, np.frombuffer(r["reps"], np.int64), np.frombuffer(r["ns"], np.int64)
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        (xa, box_a, reps_a, ns_a), (xb, box_b, reps_b, ns_b) = held[a], held[b]
        same = a == b
        links = list(join_intervals(xa, xb, box_a, box_b, cosine, same=same))
        if sum(len(i) for i, _ in links):
            i, j = (np.concatenate([x[k] for x in links]) for k in (0, 1))
            reps, ns = (reps_a, ns_a) if same else (np.concatenate([reps_a, reps_b]), np.concatenate([ns_a, ns_b]))
            out.append(summed(i, j if same else j + len(xa), reps, ns))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "others", "least"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links and component_id of every row of (vec_id, label, embedding)."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    whole = isinstance(vectors.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    keys = [F.when(F.expr(VALID), F.xxhash64(*c)) for c in (["label", "embedding"], [F.lit(1), "embedding", "label"])]
    rows = rows.withColumn("k1", keys[0]).withColumn("k2", keys[1])
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = store.write(classes, "classes")
    basis = principal(classes)
    grid = [f"c{i}" for i in range(GRID_DIMS)]
    cells = classes.select("label", "rep", "n", "embedding").mapInArrow(lambda it: to_cells(it, basis, epsilon), f"label long, dim long, {', '.join(f'{c} long' for c in grid)}, rep long, n long, embedding {classes.schema['embedding'].dataType.simpleString()}")
    cells = store.write(cells, "cells")
    order = ["label", "dim", *grid, "rep"]
    blocks = store.write(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: to_blocks(it, basis), BLOCKS_DDL), "blocks")
    boxes = blocks.select("block", "label", "dim", "low", "high").withColumn("from", F.floor(F.col("low")[0] / epsilon)).withColumn("to", F.floor(F.col("high")[0] / epsilon))
    x = boxes.withColumn("cell", F.explode(F.sequence("from", "to"))).alias("x")
    y = boxes.withColumn("cell", F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1))).alias("y")
    gap = "aggregate(zip_with(zip_with(x.low, y.high, (p, q) -> p - q), zip_with(y.low, x.high, (p, q) -> p - q), (p, q) -> greatest(p, q, 0D)), 0D, (s, g) -> s + g * g)"
    near = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.block") <= F.col("y.block"))
    pairs = x.join(y, near).where(F.expr(gap) <= epsilon**2 + 1e-9).select(F.col("x.block").alias("a"), F.col("y.block").alias("b"), F.col("x.dim").alias("dim")).distinct()
    pairs = store.write(pairs.withColumn("ta", F.shiftright("a", TILE_BITS)).withColumn("tb", F.shiftright("b", TILE_BITS)), "pairs")
    members = pairs.select(F.col("ta").alias("ma"), F.col("tb").alias("mb"), F.explode(F.array("a", "b")).alias("block")).distinct()
    members = members.join(blocks.select("block", "dim", "reps", "ns", "vectors"), "block")
    links = members.groupBy("ma", "mb").cogroup(pairs.groupBy("ta", "tb")).applyInArrow(lambda m, p: join_tile(m, p, basis, cosine), "a long, others long, least long")
    links = store.write(links, "links")
    group = store.components(links, "a", "least")
    linked = links.groupBy("a").agg(F.sum("others").alias("others"))
    named = classes.select("k1", "k2", "rep", "n").join(linked, F.col("rep") == F.col("a"), "left").join(group, F.col("rep") == F.col("node"), "left")
    named = named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    found = rows.where("k1 is not null").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    # vectors that link with nothing take no part in the join, where they would all have one key
    return found.unionByName(rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(store.read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP7_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), r(vec_id, m) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.y from r join l on l.x = r.m
), n as (
  select x, count(*) as n from l group by x
)
select d.vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(r.m) as component_id, d.vec_id = min(r.m) as kept
from embeddings d join r on r.vec_id = d.vec_id left join n on n.x = d.vec_id group by d.vec_id
"""
