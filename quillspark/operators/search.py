"""Search and retrieval: substring search, code containment with fallback, keyword and vector top-k, first-seen dedup.

Queries, codes and corpora carry a position column wherever their order decides. Searches of a stated query set (keyword_topk,
any_term_search, substring_search_batch, contained_quotes, vector_topk) take the queries in blocks of bounded size, and each block
is one pass over the searched rows: a task finds all the block's terms in a text at once by an automaton, scores all its queries by a matrix
product, and sends on only its own best rows of each query. So what is shuffled depends on tasks, queries and k, not on matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import text as X

#: Queries in a block, their distinct terms, and distinct words of texts that a task remembers.
BLOCK_QUERIES, BLOCK_TERMS, MOST_WORDS = 512, 20_000, 200_000
ROWS_AT_ONCE = 256


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def in_blocks(queries: DataFrame, terms: str | None = None, most: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> Iterator[list[Row]]:
    """The rows of a stated query set, a bounded block at a time (by rows and, if named, by the terms of an array column)."""
    block: list[Row] = []
    n = 0
    for row in queries.toLocalIterator():
        own = len(row[terms] or ()) if terms else 0
        if block and (len(block) >= most or n + own > most_terms):
            yield block
            block, n = [], 0
        block.append(row)
        n += own
    if block:
        yield block


def substring_search(table: DataFrame, query: str, columns: list[str], position: str, limit: int = 15, least: int = 2) -> DataFrame:
    """The first rows whose columns hold the query, ignoring case; a query that is too short finds nothing."""
    if len(query) < least:
        return table.limit(0)
    q = query.lower()
    return table.where(any_of([F.contains(F.lower(c), F.lit(q)) for c in columns])).orderBy(position).limit(limit)


class TermFinder:
    """Which of some terms stand in a text, literally and without overlap: the terms' numbers, one for each occurrence."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.known: dict[bytes, list[int]] = {}

    def in_text(self, text: str) -> list[int]:
        ends: dict[int, int] = {}
        out = []
        for end, (i, n) in self.automaton.iter(text):
            if end - n >= ends.get(i, -1):
                ends[i] = end
                out.append(i)
        return out

    def in_words(self, text: str) -> list[int]:
        """in_text() for terms without white space: an occurrence lies within a word, and distinct words are searched once."""
        out: list[int] = []
        for word, times in Counter(text.encode("utf-8", "surrogatepass").split()).items():
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                found = self.known[word] = self.in_text(word.decode("utf-8", "surrogatepass"))
            if found:
                out += found if times == 1 else found * times
        return out


class Best:
    """The k best groups of each query seen so far, each with its best row; ties go to the smaller position."""

    def __init__(self, queries: int, k: int, scored: bool):
        self.k, self.scored = k, scored
        self.rows: list[dict] = [{} for _ in range(queries)]
        self.least = np.full(queries, -np.inf)
        self.last = np.full(queries, np.inf)

    def add(self, scores: np.ndarray, found: np.ndarray, groups: list, positions: list) -> None:
        """scores, found: (rows, queries) arrays."""
        mask = found & (scores >= self.least)
        if not self.scored and isinstance(positions[0], int):
            mask &= np.array(positions, float)[:, None] <= self.last
        for r, q in zip(*(x.tolist() for x in np.nonzero(mask)), strict=True):
            own = self.rows[q]
            order = (-scores[r, q], positions[r] is not None, positions[r])
            if groups[r] not in own or order < own[groups[r]]:
                own[groups[r]] = order
                if len(own) >= 4 * self.k + 16:
                    self.cut(q)
        for q in range(len(self.rows)):
            self.cut(q)

    def cut(self, q: int) -> None:
        own = sorted(self.rows[q].items(), key=lambda x: x[1])[: self.k]
        self.rows[q] = dict(own)
        if len(own) == self.k:
            self.least[q] = -own[-1][1][0]
            if isinstance(own[-1][1][2], int):
                self.last[q] = own[-1][1][2]

    def batch(self, keys: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
        rows = [(keys[q], g, order[2], float(-order[0])) for q, own in enumerate(self.rows) for g, order in own.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["q", "g", "p", "score"])


def _term_pass(rows: DataFrame, block: list[Row], text: Column, group: str, position: str, k: int, scored: bool, words: bool, kind: T.DataType) -> DataFrame:
    keys, asked = [r[0] for r in block], [r[1] or [] for r in block]
    terms = sorted({t for own in asked for t in own if t})
    number = {t: i for i, t in enumerate(terms)}
    kinds = [to_arrow_type(kind), *(to_arrow_type(rows.schema[c].dataType) for c in (group, position)), pa.float64()]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros((len(terms), len(keys)))
        for q, own in enumerate(asked):
            for t in own:
                weight[number[t], q] += 1
        many = np.array([max(len(own), 1) for own in asked], float)
        finder, best = TermFinder(terms), Best(len(keys), k, scored)
        look = finder.in_words if words else finder.in_text
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                hits = [look(t) if t else [] for t in part.column(0).to_pylist()]
                flat = np.fromiter(chain.from_iterable(hits), np.int64)
                row = np.repeat(np.arange(len(hits)), np.fromiter(map(len, hits), np.int64, len(hits)))
                counts = np.bincount(row * len(terms) + flat, minlength=len(hits) * len(terms)).reshape(len(hits), -1).astype(float)
                sums = counts @ weight
                found = sums > 0
                if found.any():
                    best.add(sums / many if scored else np.ones_like(sums), found, part.column(1).to_pylist(), part.column(2).to_pylist())
        yield best.batch(keys, kinds)

    fields = [T.StructField("q", kind), T.StructField("g", rows.schema[group].dataType), T.StructField("p", rows.schema[position].dataType), T.StructField("score", T.DoubleType())]
    source = rows.select(text.alias("quill_text"), F.col(group).alias("quill_g"), F.col(position).alias("quill_p"))
    return source.mapInArrow(find, T.StructType(fields)) if terms else rows.sparkSession.createDataFrame([], T.StructType(fields))


def term_topk(rows: DataFrame, queries: DataFrame, text: Column, terms: Column, key: str, group: str, position: str, k: int, scored: bool = True, words: bool = True) -> DataFrame:
    """key, group, position, score, rank: the k best groups of each query by occurrences of its terms over their number, each with its best row.

    terms: an array column of the queries, repeats count again. Unless scored, any term found is enough and the smallest positions are
    best. words: no term has white space (only spaces and ASCII controls count), so texts can be searched word by word.
    """
    asked = queries.select(F.col(key).alias("quill_key"), terms.alias("quill_terms"))
    kind = asked.schema["quill_key"].dataType
    parts = [_term_pass(rows, b, F.lower(text), group, position, k, scored, words, kind) for b in in_blocks(asked, "quill_terms")]
    found = reduce(DataFrame.unionByName, parts) if parts else _term_pass(rows, [], text, group, position, k, scored, words, kind)
    order = [F.desc("score"), F.col("p")]
    top = ranked(first_best(found, ["q", "g"], order), ["q"], order).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(key), F.col("g").alias(group), *([F.col("p").alias(position)] if position != group else []), "score", "rank")


def first_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in any order; first_seen() combines before the shuffle, but takes ascending orders only."""
    return ranked(df, key, order, "quill_n").where("quill_n = 1").drop("quill_n")


def substring_search_batch(table: DataFrame, queries: DataFrame, query: str, key: str, columns: list[str], position: str, limit: int = 15, least: int = 2) -> DataFrame:
    """key, position, rank: substring_search for each row of a stated set of queries. Positions are unique."""
    asked = queries.where(F.length(query) >= least)
    text = F.concat_ws("\x00", *columns)  # no query holds a NUL
    return term_topk(table, asked, text, F.array(F.lower(query)), key, position, position, limit, scored=False, words=False).drop("score")


def any_term_search(docs: DataFrame, queries: DataFrame, text: Column, query: str, key: str, position: str, limit: int = 5) -> DataFrame:
    """key, position, rank: the first documents that hold any of the query's terms as a substring. Positions are unique."""
    return term_topk(docs, queries, text, X.keyword_terms(query), key, position, position, limit, scored=False).drop("score")


def contained_quotes(quotes: DataFrame, sources: DataFrame, key: str, source_key: str, quote: Column, text: Column) -> DataFrame:
    """Pairs of a quote of a stated set and a source whose text holds it as a substring; an empty quote is in no source."""
    asked = quotes.select(F.col(key).alias("quill_key"), F.array(quote).alias("quill_terms")).where("quill_terms[0] <> ''")
    fields = T.StructType([T.StructField(key, quotes.schema[key].dataType), T.StructField(source_key, sources.schema[source_key].dataType)])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def one(block: list[Row]) -> DataFrame:
        own: dict[str, list] = {}
        for k, (q,) in block:
            own.setdefault(q, []).append(k)
        held = list(own)

        def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = TermFinder(held)
            for batch in batches:
                pairs = [(k, s) for t, s in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True) if t for i in sorted(set(finder.in_text(t))) for k in own[held[i]]]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True), kinds, strict=True)], fields.names)

        return sources.select(text.alias("quill_text"), source_key).mapInArrow(find, fields)

    parts = [one(b) for b in in_blocks(asked, "quill_terms", most=4 * BLOCK_QUERIES)]
    return reduce(DataFrame.unionByName, parts) if parts else quotes.sparkSession.createDataFrame([], fields)


#: Keys of more characters are found by one of their runs of so many.
GRAM = 8


def held_keys(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(long, short): which keys of one distinct column hold which of the other as a substring, by equality of short runs.

    A key has at most GRAM runs from each of its characters. A short key of at most GRAM characters must be one of them; of a longer one the run that the fewest long keys
    have finds them, then the whole key is looked for.
    """
    of = "flatten(transform(sequence({}), n -> transform(sequence(1, greatest(length(quill_key) - n + 1, 1)), i -> substr(quill_key, i, n))))"
    runs = lambda keys, lengths: keys.select("quill_key", F.explode(F.array_distinct(F.expr(of.format(lengths)))).alias("quill_run"))
    have = runs(longer.where("quill_key <> ''"), f"1, least({GRAM}, length(quill_key))").withColumnRenamed("quill_key", "long")
    some = shorter.where("quill_key <> ''").withColumn("quill_n", F.length("quill_key"))
    often = have.where(F.length("quill_run") == GRAM).groupBy("quill_run").agg(F.count("*").alias("quill_often"))
    own = runs(some.where(F.col("quill_n") > GRAM), f"{GRAM}, {GRAM}").join(often, "quill_run", "left")
    rarest = own.groupBy("quill_key").agg(F.min_by("quill_run", F.struct(F.coalesce("quill_often", F.lit(0)), "quill_run")).alias("quill_run"))
    asked = some.where(F.col("quill_n") <= GRAM).select("quill_key", F.col("quill_key").alias("quill_run")).unionByName(rarest)
    found = have.join(asked, "quill_run").select("long", F.col("quill_key").alias("short"))
    return found.where((F.length("short") <= GRAM) | F.contains("long", F.col("short")))


def containment_join(queries: DataFrame, codes: DataFrame, query: str, code: str) -> DataFrame:
    """Pairs of a query code and a listed code of which one holds the other, both without points, hyphens and white space.

    An empty query key meets nothing; an empty listed key is in every query. All joins are by equality.
    """
    q = queries.withColumn("query_key", X.code_key(query)).where("query_key <> ''")
    c = codes.withColumn("code_key", X.code_key(code))
    # distinct keys meet each other, then their members join by equality
    of_q, of_c = q.select(F.col("query_key").alias("quill_key")).distinct(), c.select(F.col("code_key").alias("quill_key")).distinct()
    pairs = held_keys(of_c, of_q).select(F.col("short").alias("query_key"), F.col("long").alias("code_key"))
    pairs = pairs.unionByName(held_keys(of_q, of_c).select(F.col("long").alias("query_key"), F.col("short").alias("code_key")))
    pairs = pairs.unionByName(of_q.select(F.col("quill_key").alias("query_key"), F.lit("").alias("code_key"))).distinct()
    return q.join(pairs, "query_key").join(c, "code_key")


def in_window(quote: np.ndarray, source: np.ndarray) -> bool:
    """has_ordered_window() of token numbers."""
    window = len(quote) + max(6, (3 * len(quote) + 3) // 4)
    for start in np.flatnonzero(source == quote[0]).tolist():
        n = 0
        for t in source[start : start + window].tolist():
            n += t == quote[n]
            if n == len(quote):
                return True
    return False


def window_join(quotes: DataFrame, sources: DataFrame, key: str, source_key: str, quote: str, source: str) -> DataFrame:
    """Pairs of a quote of a stated set and a source (token arrays) that holds the quote in order within a window (has_ordered_window).

    A source must have every token of the quote: a matrix product of the tokens of sources and quotes finds those pairs in the source's own task, then
    comes the exact test. Nothing is shuffled.
    """
    asked = quotes.where(F.size(quote) >= 4).select(F.col(key).alias("quill_key"), F.col(quote).alias("quill_terms"))
    fields = T.StructType([T.StructField(key, quotes.schema[key].dataType), T.StructField(source_key, sources.schema[source_key].dataType)])
    kind = to_arrow_type(fields[0].dataType)
    rows = sources.select(source_key, source)

    def one(block: list[Row]) -> DataFrame:
        keys, own = [r[0] for r in block], [r[1] for r in block]

        def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sorted({t for q in own for t in q})
            number = {t: i for i, t in enumerate(words)}
            terms, names = pa.array(words, pa.string()), pa.array(keys, kind)
            asked_for = [np.array([number[t] for t in q]) for q in own]
            weight = np.zeros((len(words), len(keys)), np.float32)
            for q, x in enumerate(asked_for):
                weight[x, q] = 1
            many = weight.sum(0)
            for batch in (b.slice(low, ROWS_AT_ONCE) for b in batches for low in range(0, b.num_rows, ROWS_AT_ONCE)):
                size = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
                has = np.zeros((len(size), len(words)), np.float32)
                has[row[term >= 0], term[term >= 0]] = 1
                pairs = zip(*(x.tolist() for x in np.nonzero(has @ weight == many)), strict=True)
                met = [(r, q) for r, q in pairs if in_window(asked_for[q], term[ends[r] - size[r] : ends[r]])]
                if met:
                    r, q = (pa.array(x) for x in zip(*met, strict=True))
                    yield pa.RecordBatch.from_arrays([names.take(q), batch.column(0).take(r)], fields.names)

        return rows.mapInArrow(find, fields)

    parts = [one(b) for b in in_blocks(asked, "quill_terms")]
    return reduce(DataFrame.unionByName, parts) if parts else quotes.sparkSession.createDataFrame([], fields)


def first_seen(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: an aggregate of the least, combined before the shuffle, so a key with many rows is no hot task."""
    rest = [c for c in df.columns if c not in key]
    row = F.min_by(F.struct(*rest) if rest else F.lit(1), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    out = df.groupBy(*key).agg(row.alias("quill_row"))
    return out.select(*key, "quill_row.*") if rest else out.select(*key)


def keyword_topk(chunks: DataFrame, queries: DataFrame, text: str, query: str, key: str, group: str, position: str, k: int = 3) -> DataFrame:
    """key, group, position, score, rank: the best chunk of each group by occurrences of the query's terms over their number, then the k best groups."""
    return term_topk(chunks, queries, F.col(text), X.keyword_terms(query), key, group, position, k)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norms == 0, 0.0).otherwise(dot / norms)


def vector_topk(chunks: DataFrame, queries: DataFrame, vector: str, query: str, key: str, group: str, position: str, k: int = 5) -> DataFrame:
    """key, group, position, score, rank: the best chunk of each group by cosine, then the k best groups.

    Every query of a stated set meets every chunk: a block of queries and a batch of chunks are one matrix product. A vector without length
    scores 0; null vectors, those with null components and those of another length than the query's are left out.
    """
    asked = queries.select(F.col(key).alias("quill_key"), F.col(query).cast("array<double>").alias("quill_v")).where("quill_v is not null and not exists(quill_v, x -> x is null)")
    fields = [T.StructField("q", queries.schema[key].dataType), T.StructField("g", chunks.schema[group].dataType), T.StructField("p", chunks.schema[position].dataType), T.StructField("score", T.DoubleType())]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    rows = chunks.select(F.col(vector).cast("array<double>").alias("quill_v"), F.col(group).alias("quill_g"), F.col(position).alias("quill_p")).where("quill_v is not null and not exists(quill_v, x -> x is null)")

    def one(block: list[Row]) -> DataFrame:
        keys, vectors = [r[0] for r in block], [r[1] for r in block]

        def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(keys), k, True)
            of_length = {n: [i for i, v in enumerate(vectors) if len(v) == n] for n in set(map(len, vectors))}
            sides = {n: units(np.array([vectors[i] for i in own], float).reshape(len(own), n)) for n, own in of_length.items()}
            # a few rows at a time: until the first have set the bounds, each row is a candidate of each query
            for batch in (b.slice(low, ROWS_AT_ONCE) for b in batches for low in range(0, b.num_rows, ROWS_AT_ONCE)):
                size = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                at = np.cumsum(size) - size
                groups, positions = (batch.column(c).to_pylist() for c in (1, 2))
                for n, own in of_length.items():
                    rows_n = np.flatnonzero(size == n)
                    scores = np.zeros((len(rows_n), len(keys)))
                    found = np.zeros(scores.shape, bool)
                    scores[:, own] = units(flat[at[rows_n][:, None] + np.arange(n)].reshape(len(rows_n), n)) @ sides[n].T
                    found[:, own] = True
                    if len(rows_n):
                        best.add(scores, found, [groups[r] for r in rows_n], [positions[r] for r in rows_n])
            yield best.batch(keys, kinds)

        return rows.mapInArrow(find, T.StructType(fields))

    parts = [one(b) for b in in_blocks(asked)]
    found = reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], T.StructType(fields))
    order = [F.desc("score"), F.col("p")]
    top = ranked(first_best(found, ["q", "g"], order), ["q"], order).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(key), F.col("g").alias(group), *([F.col("p").alias(position)] if position != group else []), "score", "rank")


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without length stay zero."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def retrieve(cases: DataFrame, codes: DataFrame, chunks: DataFrame, *, key: str, case_codes: str, case_query: str, policy: str, code: str, policy_order: str, text: str, chunk_order: str, k: int = 3) -> DataFrame:
    """Policies of each case by its codes (in code order, then policy order, first seen, score 1); cases without any by keywords.

    case_codes: an array column. Returns key, policy, score, rank, by_code.
    """
    asked = cases.select(key, F.posexplode(case_codes).alias("code_order", "query_code"))
    # of one code key's policies, those after the first k have k others before them in every case that the key meets
    listed = first_seen(codes.select(policy, code, policy_order, X.code_key(code).alias("quill_key")), ["quill_key", policy], [F.col(policy_order)])
    listed = ranked(listed, ["quill_key"], [F.col(policy_order)], "quill_n").where(F.col("quill_n") <= k).drop("quill_key", "quill_n")
    hits = containment_join(asked, listed, "query_code", code)
    hits = first_seen(hits, [key, policy], [F.col("code_order"), F.col(policy_order)])
    by_code = ranked(hits, [key], [F.col("code_order"), F.col(policy_order)]).where(F.col("rank") <= k)
    by_code = by_code.select(key, policy, F.lit(1.0).alias("score"), "rank", F.lit(True).alias("by_code"))
    left = cases.join(by_code.select(key).distinct(), key, "left_anti").select(key, F.col(case_query).alias("quill_query"))
    by_word = keyword_topk(chunks, left, text, "quill_query", key, policy, chunk_order, k)
    return by_code.unionByName(by_word.select(key, policy, "score", "rank", F.lit(False).alias("by_code")))
