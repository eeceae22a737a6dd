"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

A document may belong to several sources. Documents are counted by membership pattern (which sources
hold them), so the flow's graph has a node for each pattern and source, not for each document. A pattern
can give its words once at no cost, a second time at cost 1 and a k-th time at cost (k - 1) ** 2 a word, which makes
repetition convex; a source takes words up to its target. The flow of least cost among the largest says
how many words each pattern gives; documents are then selected in a seeded order.

The order is by MD5 of seed and doc_id. Sums by the digest's first three digits (4096 ranges of each pattern)
find the range that holds the cut, and only that range's digests are put in order, so no task
sorts a hot source. What comes out is a plan: for each pattern how many copies each of its documents gives and the digest up to which
they give one more. To carry it out is a map over the documents, whose texts are never shuffled.

Only patterns come to the driver and to every task: MOST_PATTERNS of them at most (there are as many as distinct combinations of sources). Of more, where no
document has two sources, each source gives its own target, found by joins and aggregates alone; where documents share sources, more raise an error. Defined results: a null text has size 0 and is taken 0 words; a null source is a source of
its own, last in order; rows that share a doc_id and sources are taken alike, as one unit of their summed size; extra columns pass
through mixed_documents(); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

WORD = r"[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, MOST_COPIES, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: The flow's patterns are solved in the driver and broadcast: some MB at this bound.
MOST_PATTERNS = 50_000


def ordered(sources) -> list:
    """By code point, null last."""
    return sorted(set(sources), key=lambda s: (s is None, s or ""))


def targets(sizes: dict, total: float, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict:
    """The share of the total by weight; a source stops at most times its size, and the rest share its excess by weight."""
    names = ordered(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * total, {}, sorted(names, key=lambda s: most * sizes[s] / weight[s])
    weight_left = float(sum(weight.values()))
    for i, s in enumerate(open_):
        if left * weight[s] >= most * sizes[s] * weight_left:
            out[s] = float(most * sizes[s])
            left, weight_left = left - out[s], weight_left - weight[s]
            continue
        return out | {s: left * weight[s] / weight_left for s in open_[i:]}
    return out


def least_cost_flow(capacity: dict[tuple, float], quota: dict, most: int = MOST_COPIES) -> dict[tuple[tuple, object], float]:
    """Words from each pattern to each source: the cheapest of the largest flows, by successive shortest paths.

    Patterns that share no source don't meet, so each connected part of the graph is solved alone.
    """
    part: dict = {s: s for s in quota}

    def root(s):
        while part[s] != s:
            part[s] = part[part[s]]
            s = part[s]
        return s

    for pattern in capacity:
        for s in pattern[1:]:
            part[root(s)] = root(pattern[0])
    groups: dict = defaultdict(dict)
    for pattern, size in capacity.items():
        if pattern and size > 0:
            groups[root(pattern[0])][pattern] = size
    flow: dict = {}
    for members in groups.values():
        flow |= _flow(members, {s: quota[s] for p in members for s in p}, most)
    return flow


def _flow(capacity: dict[tuple, float], quota: dict, most: int) -> dict:
    edges: list[list] = []  # [to, left, cost], the reverse of edge e is e ^ 1
    out = defaultdict(list)

    def edge(a, b, room: float, cost: float) -> int:
        edges.extend(([b, room, cost], [a, 0.0, -cost]))
        out[a].append(len(edges) - 2)
        out[b].append(len(edges) - 1)
        return len(edges) - 2

    at = {}
    for p, size in capacity.items():
        for copy in range(most):
            edge("from", ("p", p), float(size), float(copy**2))
        at |= {(p, s): edge(("p", p), ("s", s), float("inf"), 0.0) for s in p}
    for s, room in quota.items():
        edge(("s", s), "to", float(room), 0.0)
    height: dict = defaultdict(float)
    while True:
        far, came, heap, n = {"from": 0.0}, {}, [(0.0, 0, "from")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = edges[e]
                reach = d + cost + height[a] - height[b]
                if room > 1e-6 and reach < far.get(b, float("inf")) - 1e-9:
                    far[b], came[b], n = reach, e, n + 1
                    heapq.heappush(heap, (reach, n, b))
        if "to" not in far:
            return {k: edges[e ^ 1][1] for k, e in at.items()}
        for b in [*out]:
            height[b] += min(far.get(b, float("inf")), far["to"])
        path, b = [], "to"
        while b != "from":
            path.append(came[b])
            b = edges[came[b] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room


def marked(docs: DataFrame, sources: Column, seed: str = SEED) -> DataFrame:
    """The rows with quill_sources (distinct, sorted) and quill_key, the digest that orders them."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumns({"quill_sources": F.array_sort(F.array_distinct(sources)), "quill_key": key})


def copies_of(plan: DataFrame, rows: DataFrame, has_words: Column, side: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """rows, from marked(), with quill_copies; plan: one row a pattern, which is broadcast (side) where their number is bounded."""
    both = rows.join(side(plan), F.col("quill_sources").eqNullSafe(F.col("quill_pattern")), "left")
    more = F.coalesce((F.col("quill_key") <= F.col("quill_last")).cast("int"), F.lit(0))
    copies = F.when(has_words, F.least("quill_most", F.col("quill_whole") + more)).otherwise(0)
    return both.withColumn("quill_copies", F.coalesce(copies, F.lit(0))).drop("quill_pattern", "quill_last", "quill_whole", "quill_most")


def flow_shares(spark: SparkSession, counts: list, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(shares, by_source) of MOST_PATTERNS patterns at most, by the flow in the driver."""
    # in a fixed order, so that of equally cheap flows reruns find the same
    counted = dict(sorted(((tuple(r["quill_sources"]), r["size"]) for r in counts), key=lambda x: [(s is None, s or "") for s in x[0]]))
    sizes: dict = defaultdict(int)
    for p, n in counted.items():
        for s in p:
            sizes[s] += n
    wanted = targets(sizes, sum(counted.values()), weights, share, most)
    flow = least_cost_flow(counted, wanted, most)
    given: dict = defaultdict(float)
    for (p, _), n in flow.items():
        given[p] += n
    rows = [(list(p), min(most, int(given[p] // n)) if n else 0, given[p] - n * min(most, int(given[p] // n)) if n else 0.0) for p, n in counted.items()]
    by_source = spark.createDataFrame([([s], int(n), wanted[s]) for s, n in sizes.items()], BY_SOURCE)
    return spark.createDataFrame(rows, "sources array<string>, whole int, rest double"), by_source


BY_SOURCE = "sources array<string>, source_size long, target double"


def apart_shares(patterns: DataFrame, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(shares, by_source) of any number of sources that no document shares: each gives its own target, so there is nothing to route, and no source comes to the driver.

    Places in the order of sources come from a sort by range and the sizes of its ranges. The level of the targets rises until no other source is filled, an aggregate each time.
    """
    spark = patterns.sparkSession
    if not patterns.where(F.size("quill_sources") > 1).isEmpty():
        raise ValueError(f"more than {MOST_PATTERNS} combinations of sources that share documents")
    one = patterns.select(F.col("quill_sources").alias("sources"), F.col("quill_sources")[0].alias("source"), F.col("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = store.write(one.repartitionByRange(parts, "none", "source").sortWithinPartitions("none", "source").withColumn("at", F.monotonically_increasing_id()), "places")
    before, sizes = 0, {}
    for r in placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect():  # a row for each range
        sizes[r["range"]], before = before, before + r["n"]
    start = spark.createDataFrame(list(sizes.items()), "range long, before long")
    placed = placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(start), "range")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.array(*(F.lit(float(w)) for w in weights))[(place % len(weights)).cast("int")]
    rated = store.write(placed.select("sources", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap")), "rated")
    total, weigh = rated.agg(F.sum("source_size"), F.sum("w")).first()
    level, last = share * total / weigh, -1.0
    while level > last:
        last = level
        filled = F.col("cap") <= F.lit(level) * F.col("w")
        full, open_ = rated.agg(F.sum(F.when(filled, F.col("cap")).otherwise(0.0)), F.sum(F.when(~filled, F.col("w")).otherwise(0.0))).first()
        level = (share * total - full) / open_ if open_ else level
    target = F.least("cap", F.lit(level) * F.col("w"))
    by_source = rated.select("sources", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    shares = by_source.withColumn("whole", whole).select("sources", "whole", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0).alias("rest"))
    return shares, by_source


def planned(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(plan, by_source, side) of a table with quill_sources, quill_key and size.

    plan: quill_pattern, quill_whole (copies of each of its documents), quill_last (documents up to this digest give one more) and quill_most. by_source: each source's size and
    target. side: how the plan is joined, as a broadcast where the number of patterns is bounded.
    """
    spark = sized.sparkSession
    patterns = sized.groupBy("quill_sources").agg(F.sum("size").alias("size"))
    counts = patterns.limit(MOST_PATTERNS + 1).collect()
    few = len(counts) <= MOST_PATTERNS
    side = F.broadcast if few else lambda d: d
    shares, by_source = flow_shares(spark, counts, weights, share, most) if few else apart_shares(store.write(patterns, "patterns"), weights, share, most)
    # units are put in the digest's order; one is taken once more if the cut lies behind its middle, so those taken are the first ones
    ranges = sized.groupBy("quill_sources", F.substring("quill_key", 1, 3).alias("range")).agg(F.sum("size").alias("n"))
    ranges = ranges.withColumn("after", F.expr("sum(n) over (partition by quill_sources order by range rows unbounded preceding)")).join(side(shares), F.col("quill_sources").eqNullSafe(F.col("sources"))).drop("sources")
    ranges = store.write(ranges.withColumn("before", F.col("after") - F.col("n")), "ranges")
    cut = ranges.where("before < rest and after > rest").select(F.col("quill_sources").alias("sources"), F.col("range").alias("cut"), "before", "rest")
    inside = sized.join(side(cut), F.col("quill_sources").eqNullSafe(F.col("sources")) & (F.substring("quill_key", 1, 3) == F.col("cut")))
    units = inside.groupBy("quill_sources", "quill_key", "before", "rest").agg(F.sum("size").alias("n"))
    units = units.withColumn("sum", F.expr("before + sum(n) over (partition by quill_sources order by quill_key rows unbounded preceding)"))
    within = units.where("2 * sum - n <= 2 * rest").groupBy("quill_sources").agg(F.max("quill_key").alias("last"))
    # a range that is taken whole: all digests that begin with its three digits come before its name and a g
    whole = ranges.where("after <= rest").groupBy("quill_sources").agg(F.max(F.concat("range", F.lit("g"))).alias("last"))
    last = whole.unionByName(within).groupBy("quill_sources").agg(F.max("last").alias("quill_last"))
    plan = side(shares).join(last, F.col("quill_sources").eqNullSafe(F.col("sources")), "left")
    plan = plan.select(F.col("sources").alias("quill_pattern"), F.col("whole").alias("quill_whole"), "quill_last", F.lit(most).alias("quill_most"))
    return store.write(plan, "plan"), by_source, side


def mixed(docs: DataFrame, sources: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sources, size and copies of every row; each source's size and target). sources: an array column."""
    size = F.expr(f"cast(coalesce(regexp_count(text, '{WORD}'), 0) as bigint)").alias("size")
    sized = store.write(marked(docs.select("doc_id", "text", sources.alias("quill_in")), F.col("quill_in"), seed).select("doc_id", "quill_sources", size, "quill_key"), "sized")
    plan, by_source, side = planned(sized, weights, share, most)
    taken = copies_of(plan, sized, F.col("size") > 0, side)
    return taken.select("doc_id", F.col("quill_sources").alias("sources"), "size", F.col("quill_copies").alias("copies")), by_source


def mix(docs: DataFrame, sources: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED) -> tuple[DataFrame, dict, dict]:
    """As mixed(), with the sources' sizes and targets as dictionaries, for callers who know that their sources are few."""
    taken, by_source = mixed(docs, sources, weights, share, most, seed)
    rows = by_source.collect()
    return taken, {r["sources"][0]: r["source_size"] for r in rows}, {r["sources"][0]: r["target"] for r in rows}


def mixed_documents(docs: DataFrame, sources: Column | None = None) -> DataFrame:
    """The rows with all their columns, each as often as the mix takes it. Texts are mapped, not shuffled."""
    sources = F.array("source") if sources is None else sources
    size = F.expr(f"cast(coalesce(regexp_count(text, '{WORD}'), 0) as bigint)").alias("size")
    sized = store.write(marked(docs, sources).select("quill_sources", "quill_key", size), "sized")
    plan, _, side = planned(sized)
    taken = copies_of(plan, marked(docs, sources), F.coalesce(F.col("text").rlike(WORD.replace("\\\\", "\\")), F.lit(False)), side).where("quill_copies > 0")
    return taken.withColumn("quill_copy", F.explode(F.sequence(F.lit(1), "quill_copies"))).select(docs.columns)


def mix_overlapping_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by sources that overlap: a document belongs to its source and to its language, and may fill either quota.

    Returns doc_id, n_sources, size and taken; sources may be null.
    """
    docs = store.read(spark, sf_dir, "documents")
    taken, _ = mixed(docs, F.array(F.concat(F.lit("source "), "source"), F.concat(F.lit("language "), "lang")))
    return taken.select("doc_id", F.size("sources").cast("long").alias("n_sources"), "size", (F.col("size") * F.col("copies")).alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, by_source = mixed(store.read(spark, sf_dir, "documents"), F.array("source"))
    rounded = by_source.withColumn("target", F.round("target", 6))
    return taken.join(rounded, "sources").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix-1:' || coalesce(doc_id::varchar, '')) as k from documents
), s as (
  select source, sum(size) as n, row_number() over (order by source nulls last) - 1 as i from d group by source
), w as (
  select source, n, 2.0 * n as cap, case i % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end as w from s
), c as (
  select *, (1.5 * sum(n) over () - (sum(cap) over o - cap)) / (sum(w) over () - (sum(w) over o - w)) as lam
  from w window o as (order by cap / w, source nulls last rows unbounded preceding)
), f as (
  select source, n, least(cap, w * coalesce((select arg_min(lam, cap / w) from c where lam * w < cap), 1e18)) as target from c
), g as (
  select source, n, target, case when n > 0 then least(2, floor(target / n)) else 0 end as whole from f
), t as (
  select d.doc_id, d.size, g.n, g.target, g.whole, g.target - g.whole * g.n as rest,
    sum(d.size) over (partition by d.source order by d.k, d.size rows unbounded preceding) as cum
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, n::bigint as source_size, round(target, 6)::double as target,
  case when size > 0 then (size * least(2, whole + (2 * cum - size <= 2 * rest)::int))::bigint else 0 end as taken
from t
"""
