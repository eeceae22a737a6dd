"""Filter interaction audit: what each of a chain of filters removes in every order, by inclusion and exclusion.

Filters are flags of a document (1: it fails). For each set S of filters one pass sums the products of its flags, J(S): the documents
that fail all of S, whatever the others say. All else follows from these 32 sums of a part, without another look at the documents:

- survivors of the filters P: the sum over S within P of (-1)^|S| J(S);
- removed by f after P: survivors of P less survivors of P and f; redundant: J(f) less these;
- failing f alone: the sum over S with f of (-1)^(|S| - 1) J(S) (Moebius inversion over the sets that hold f);
- Shapley: the Harsanyi dividend of S in the game "documents removed" is (-1)^(|S| + 1) J(S), shared evenly by its filters. Summed
  over all n! orders instead of averaged it is a whole number, as |S| divides n!.

The sums are taken for all documents, for those labelled good and for those labelled toxic.

One filter looks at the whole table: a text that a smaller doc_id has too. Rows are counted by id and digest first, so that a text
or an id with a third of all rows is one row a task when it is shuffled; the least id of a text meets its rows as counts by part.

Defined results: a null text is empty, and identical to other empty ones; a null doc_id has no smaller one and no label; repeated
rows with equal ids don't repeat each other, and each counts; a document is good (toxic) if any of its labels says so; a null part is the
empty string; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add, mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: The filters of op12 that look at one text, by letter: conditions on n_words, n_distinct, n_upper, n_chars and has_mark.
FILTERS = {"A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_upper > 10 * n_chars", "D": "has_mark"}
REPEATED = "E"
WEIGHTS = ("n", "good", "toxic")


def measured(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, the counts that FILTERS read, and a digest of the text."""
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("words", F.array_remove(F.split("text", WORD_BREAK), ""))
    return words.select(
        "doc_id", "part", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"), F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
        F.length("text").alias("n_chars"), F.col("text").rlike("[#$%&*|]").alias("has_mark"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1). Rows without an id are dealt out by their digests, as they match nothing."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    out = rows.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    return out.drop("spread").na.fill(0, ["good", "toxic"])


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, str] = FILTERS) -> DataFrame:
    """Counts of documents: part, a 0 or 1 for each letter of the filters, good, toxic, n, and how many of the n repeat the text of a smaller doc_id."""
    flags = [F.expr(c).cast("long").alias(k) for k, c in filters.items()]
    rows = measured(docs, part).select("doc_id", "part", "digest", *flags).groupBy("doc_id", "part", "digest", *filters).agg(F.count("*").alias("n"))
    by_text = labelled(rows, labels).groupBy("digest", "part", *filters, "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
    )
    first = F.expr("min(least) over (partition by digest)")
    return by_text.withColumn("first", first).withColumn(REPEATED, F.expr("with_id - if(least = first, n_least, 0)")).drop("digest", "with_id", "least", "n_least", "first").na.fill(0, [REPEATED])


def subsets(mask: int) -> list[int]:
    out, s = [mask], mask
    while s:
        s = (s - 1) & mask
        out.append(s)
    return out


def signed_sum(terms: list[tuple[int, Column]]) -> Column:
    return reduce(add, (c * F.lit(k).cast("long") for k, c in terms))


def joint_counts(counted: DataFrame, letters: str, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """A row for each part: for each weight w an array joint_w of the 2^n sums of flag products; set S is at the sum of its letters' bits.

    counted: part, n, the weights' columns (0 or 1), a flag for each letter but the last, and for the last one how many of the n it holds for.
    """

    def product(mask: int, weight: str) -> Column:
        size = F.col(letters[-1] if mask >> (len(letters) - 1) else "n")
        return reduce(mul, [size, *([F.col(weight)] if weight != "n" else []), *(F.col(x) for k, x in enumerate(letters[:-1]) if mask >> k & 1)])

    every = range(1 << len(letters))
    sums = counted.groupBy("part").agg(*(F.sum(product(s, w)).alias(f"{w}_{s}") for w in weights for s in every))
    return sums.select("part", *(F.array(*(F.col(f"{w}_{s}") for s in every)).alias(f"joint_{w}") for w in weights))


def inverted(joint: DataFrame, letters: str, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """Adds kept_w (survivors of each set of filters), alone (failing one filter only, by letter) and shapley (by letter, summed over all orders)."""
    n, every = len(letters), range(1 << len(letters))
    bits = {s: s.bit_count() for s in every}
    at = lambda w, s: F.col(f"joint_{w}")[s]
    kept = {f"kept_{w}": F.array(*(signed_sum([((-1) ** bits[s], at(w, s)) for s in subsets(p)]) for p in every)) for w in weights}
    holds = [[s for s in every if s >> k & 1] for k in range(n)]
    alone = F.array(*(signed_sum([((-1) ** (bits[s] - 1), at("n", s)) for s in own]) for own in holds))
    shapley = F.array(*(signed_sum([((-1) ** (bits[s] + 1) * (factorial(n) // bits[s]), at("n", s)) for s in own]) for own in holds))
    return joint.withColumns(kept | {"alone": alone, "shapley": shapley})


def in_all_orders(inverse: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step: what that step keeps, removes and loses, and what its filter does by itself."""
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    rows = inverse.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = "locate(substring(filter_order, {}, 1), '" + letters + "') - 1"
    before = reduce(add, (F.when(F.col("step") > k, F.expr(f"shiftleft(1, {place.format(k)})")).otherwise(0) for k in range(1, len(letters) + 1)))
    rows = rows.withColumn("own", F.expr(place.format("step"))).withColumn("before", before).withColumn("after", F.expr("before + shiftleft(1, own)"))
    left, gone = F.expr("kept_n[after]"), F.expr("kept_n[before] - kept_n[after]")
    return rows.select(
        "part", "filter_order", "step", left.alias("kept"), gone.alias("removed"), (F.expr("joint_n[shiftleft(1, own)]") - gone).alias("redundant"), F.expr("alone[own]").alias("unique_fails"),
        F.expr("kept_good[before] - kept_good[after]").alias("good_lost"), F.expr("kept_toxic[before] - kept_toxic[after]").alias("toxic_lost"), F.expr("shapley[own]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, str] = FILTERS) -> DataFrame:
    """The audit of the filters (at most seven, of one letter each) and of repeated texts, by part."""
    letters = "".join(filters) + REPEATED
    if len(letters) > 8 or len(set(letters)) < len(letters):
        raise ValueError("at most seven filters with distinct letters other than E")
    return in_all_orders(inverted(joint_counts(flagged(docs, labels, part, filters), letters), letters), letters)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "labels"))


OP12_SQL = """
with texts as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
firsts as (select t, min(doc_id) least from texts group by t),
counted as (select x.*, least, regexp_extract_all(x.t, '[^\\x20\\x09-\\x0D]+') w from texts x join firsts f on x.t = f.t),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
judged as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    case when len(w) < 100 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when counted.doc_id > least then 'E' else '' end fails
  from counted left join known on counted.doc_id = known.doc_id),
cells as (select part, fails, good, toxic, count(*) n from judged group by all),
l(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.x || b.x || c.x || d.x || e.x filter_order from l a, l b, l c, l d, l e
  where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x and c.x <> d.x and c.x <> e.x and d.x <> e.x),
steps as (select filter_order, s step, substr(filter_order, s, 1) f from orders, (select unnest([1, 2, 3, 4, 5])::int s)),
first_failed as (
  select cells.*, filter_order, list_min([strpos(filter_order, k) for k in string_split(fails, '')]) p
  from cells, orders where fails <> '' union all select cells.*, filter_order, 99 from cells, orders where fails = ''),
sums as (
  select part, s.filter_order, step, f, sum(case when p > step then n else 0 end)::bigint kept, sum(case when p = step then n else 0 end)::bigint removed,
    sum(case when p < step and contains(fails, f) then n else 0 end)::bigint redundant, sum(case when fails = f then n else 0 end)::bigint unique_fails,
    sum(case when p = step then n * good else 0 end)::bigint good_lost, sum(case when p = step then n * toxic else 0 end)::bigint toxic_lost
  from first_failed x join steps s on x.filter_order = s.filter_order group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint shapley from sums
"""
