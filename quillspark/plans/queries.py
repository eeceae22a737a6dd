"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunks as C
from quillspark.operators import evaluation as E
from quillspark.operators import evidence as V
from quillspark.operators import history as H
from quillspark.operators import safety as S
from quillspark.operators import search as R
from quillspark.profiles import PLAIN
from quillspark.sources import documents as D
from quillspark.sources.tables import file_system
from quillspark.streaming import stages as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of more bytes are read in place: their splits keep all cores busy, and dealing them out would shuffle the texts.
SMALL_TABLE = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small table of fewer files than cores is dealt out anew, as one file's only row group is one task."""
    spark = rows.sparkSession
    cores, paths = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not 0 < len(paths) < cores:
        return rows
    total = 0
    for path in paths:
        files, at = file_system(spark, path)
        total += files.getFileStatus(at).getLen()
    return rows.repartition(cores) if total <= SMALL_TABLE else rows


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Parts of the SQL below that several queries share.
TERMS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda t: length(t) >= {n})"
TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9.]+'), lambda t: length(t) >= 4 and not list_contains(['then','that','with','this','from'], t))"


@query("select p_partkey, p_name, p_brand, p_type from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1') order by p_partkey limit 15")
def code_search(spark, d):
    return R.substring_search(table(spark, d, "part"), "Brand#1", ["p_name", "p_brand", "p_type"], "p_partkey").select("p_partkey", "p_name", "p_brand", "p_type")


@query("""with q as (select substr('redsmallringwidget', (n_nationkey % 16 + 1)::int, 2) as q, n_nationkey from nation), h as (
  select n_nationkey, q, p_partkey, row_number() over (partition by n_nationkey order by p_partkey) as rank from q join (select *, lower(p_name) as a, lower(p_brand) as b, lower(p_type) as c from part) on contains(a, lower(q)) or contains(b, lower(q)) or contains(c, lower(q)))
select * from h where rank <= 15""")
def code_search_batch(spark, d):
    q = table(spark, d, "nation").select("n_nationkey", F.expr("substr('redsmallringwidget', n_nationkey % 16 + 1, 2)").alias("q"))
    out = R.substring_search_batch(table(spark, d, "part"), q, "q", "n_nationkey", ["p_name", "p_brand", "p_type"], "p_partkey").join(q, "n_nationkey")
    return out.select("n_nationkey", "q", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query(rf"""with q as (select item_id, {TERMS.format(n=3)} as ts from benchmark), h as (
  select item_id, doc_id, row_number() over (partition by item_id order by doc_id) as rank from (select doc_id, lower(text || coalesce(source, '')) as t from documents) join q on len(list_filter(ts, lambda x: contains(t, x))) > 0)
select item_id, doc_id, rank from h where rank <= 5""")
def any_term_search(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    out = R.any_term_search(table(spark, d, "documents"), q, F.concat("text", F.coalesce("source", F.lit(""))), "q", "item_id", "doc_id")
    return out.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(r"""with c as (select distinct p_brand from part), q as (select s_suppkey, 'b-rand#' || (s_suppkey % 30) as code from supplier), k as (
  select s_suppkey, code, p_brand, regexp_replace(upper(code), '[.\-\s]', '', 'g') as a, regexp_replace(upper(p_brand), '[.\-\s]', '', 'g') as b from q, c)
select s_suppkey, code, p_brand from k where contains(a, b) or contains(b, a)""")
def code_containment_join(spark, d):
    q = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("b-rand#"), F.col("s_suppkey") % 30).alias("code"))
    return R.containment_join(q, table(spark, d, "part").select("p_brand").distinct(), "code", "p_brand").select("s_suppkey", "code", "p_brand")


@query(rf"""with code as (select doc_id as policy, source as code from documents), ask as (
  select item_id, unnest([case when item_id % 3 = 0 then 'none' else 'src' || (item_id % 20) end, case when item_id % 3 = 0 then '' else 'SRC-' || (item_id % 7) end]) as q, unnest([0, 1]) as o from benchmark), k as (
  select item_id, o, policy, regexp_replace(upper(q), '[.\-\s]', '', 'g') as a, regexp_replace(upper(code), '[.\-\s]', '', 'g') as b from ask, code), hit as (
  select item_id, policy, min(o) as o from k where a <> '' and (contains(a, b) or contains(b, a)) group by all), by_code as (
  select item_id, policy, 1.0::double as score, row_number() over (partition by item_id order by o, policy) as rank, true as by_code from hit), asked as (
  select item_id, {TERMS.format(n=3)} as ts from benchmark where item_id not in (select item_id from by_code)), sc as (
  select item_id, doc_id as policy, list_sum(list_transform(ts, lambda x: (length(t) - length(replace(t, x, ''))) / length(x))) / greatest(len(ts), 1) as score from (select doc_id, lower(text) as t from documents), asked), by_word as (
  select item_id, policy, score, row_number() over (partition by item_id order by score desc, policy) as rank, false as by_code from sc where score > 0)
select item_id, policy, round(score, 6) as score, rank, by_code from (select * from by_code union all select * from by_word) where rank <= 3""")
def retrieve_with_fallback(spark, d):
    docs = table(spark, d, "documents")
    cases = table(spark, d, "benchmark").select("item_id", "text", F.expr("case when item_id % 3 = 0 then array('none', '') else array(concat('src', item_id % 20), concat('SRC-', item_id % 7)) end").alias("codes"))
    codes = docs.select(F.col("doc_id").alias("policy"), F.col("source").alias("code"), F.col("doc_id").alias("pos"))
    out = R.retrieve(cases, codes, docs.select(F.col("doc_id").alias("policy"), F.col("text").alias("chunk"), F.col("doc_id").alias("chunk_pos")), key="item_id", case_codes="codes", case_query="text", policy="policy", code="code", policy_order="pos", text="chunk", chunk_order="chunk_pos")
    return out.select("item_id", "policy", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "by_code")


@query(rf"""with q as (select item_id, {TERMS.format(n=3)} as ts from benchmark), s as (
  select item_id, doc_id, list_sum(list_transform(ts, lambda x: (length(t) - length(replace(t, x, ''))) / length(x))) / greatest(len(ts), 1) as score from (select doc_id, lower(text) as t from documents), q), r as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, doc_id, round(score, 6) as score, rank from r where rank <= 3""")
def keyword_topk(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = R.keyword_topk(docs, q, "text", "q", "item_id", "doc_id", "doc_id")
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""with q as (select vec_id as q_id, embedding::double[] as q from embeddings where vec_id % 100 = 0), s as (
  select q_id, vec_id, label, list_cosine_similarity(embedding::double[], q) as score from embeddings, q), b as (
  select *, row_number() over (partition by q_id, label order by score desc, vec_id) as n from s), r as (
  select *, row_number() over (partition by q_id order by score desc, vec_id) as rank from b where n = 1)
select q_id, vec_id, label, round(score, 6) as score, rank from r where rank <= 5""")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))  # the query set of searches
    out = R.vector_topk(v, q, "embedding", "q", "q_id", "label", "vec_id")
    return out.select("q_id", "vec_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by all")
def first_seen_dedup(spark, d):
    out = R.first_seen(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "event_id")


@query("select md5(text) as text_md5, min(doc_id) as doc_id from documents group by text")
def first_seen_documents(spark, d):
    out = R.first_seen(table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "doc_id"), ["text_md5"], [F.col("doc_id")])
    return out.select("text_md5", "doc_id")


@query(r"""with recursive p as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ps from documents), f(doc_id, i, now, chunk_pos, out) as (
  select doc_id, 0, '', 0, null::varchar from p
  union all
  select f.doc_id, i + 1,
    case when full_ then right(now, 100) || chr(10) || x when now = '' then x else now || chr(10) || x end, chunk_pos + full_::int, case when full_ then now end
  from (select f.*, ps[i + 1] as x, length(now) + length(ps[i + 1]) > 600 and length(now) > 100 as full_ from f join p using (doc_id) where i < len(ps)) f
), e as (
  select doc_id, chunk_pos - 1 as chunk_pos, out as text from f where out is not null
  union all
  select f.doc_id, chunk_pos, now from f join p using (doc_id) where i = len(ps) and trim(now) <> ''
)
select doc_id, doc_id || '-chunk-' || chunk_pos as chunk_id, chunk_pos::int as chunk_pos, length(text)::int as n, md5(text) as text_md5 from e""")
def chunk_documents(spark, d):
    out = C.chunks(table(spark, d, "documents"), "doc_id", "text", separator="\n")
    return out.select("doc_id", "chunk_id", "chunk_pos", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query(rf"""select doc_id, len({TOKENS.format(c="text")})::int as n_analysis, len(list_distinct({TOKENS.format(c="text")}))::int as n_distinct,
  len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 4 and not list_contains(['then','that','with','this','from'], t) and not regexp_matches(t, '^[0-9]+$'))))::int as n_relevance,
  len({TERMS.format(n=3)})::int as n_terms from documents""")
def tokenize_stats(spark, d):
    a = X.analysis_tokens("text", PLAIN.stop_words)
    return table(spark, d, "documents").select("doc_id", F.size(a).alias("n_analysis"), F.size(F.array_distinct(a)).alias("n_distinct"), F.size(X.relevance_tokens("text", PLAIN.stop_words)).alias("n_relevance"), F.size(X.keyword_terms("text")).alias("n_terms"))


NORMALIZED = r"trim(regexp_replace(replace(lower(translate({c}, '“”‘’–—−²³', '-------23')), '&', ' and '), '[^a-z0-9%/]+', ' ', 'g'))"


@query(rf"""select doc_id, md5(n) as text_md5, len(list_filter(string_split(n, ' '), lambda t: length(t) > 1 or regexp_matches(t, '[0-9]')))::int as n_tokens
  from (select doc_id, {NORMALIZED.format(c="text")} as n from documents)""")
def grounding_normalize_no_nfkc(spark, d):
    """grounding_normalize of all texts but for NFKC, which SQL doesn't have."""
    n = table(spark, d, "documents").select("doc_id", X.grounding_normalized("text", full=False).alias("n"))
    return n.select("doc_id", F.md5("n").alias("text_md5"), F.size(X.grounding_tokens("n")).alias("n_tokens"))


@query()
def grounding_normalize(spark, d):
    n = table(spark, d, "documents").select("doc_id", X.grounding_normalized("text").alias("n"))
    return n.select("doc_id", F.md5("n").alias("text_md5"), F.size(X.grounding_tokens("n")).alias("n_tokens"))


@query(rf"""with q as (select item_id, {NORMALIZED.format(c="text")} as q from benchmark), s as (
  select doc_id, {NORMALIZED.format(c="text")} as s from documents)
select item_id, count_if(contains(s, q))::bigint as n_containing, count_if(contains(s, q)) > 0 as grounded from q, s group by item_id""")
def quote_grounding(spark, d):
    q, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    normal = X.grounding_normalized("text", full=False)
    hit = R.contained_quotes(q, docs, "item_id", "doc_id", normal, normal).groupBy("item_id").agg(F.count("*").alias("n"))
    return q.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_containing"), (F.coalesce("n", F.lit(0)) > 0).alias("grounded"))


@query()
def quote_window(spark, d):
    """Documents that hold all of a passage's tokens in order within a window."""
    q = table(spark, d, "benchmark").select("item_id", X.grounding_tokens(X.grounding_normalized("text")).alias("q"))
    s = table(spark, d, "documents").select("doc_id", X.grounding_tokens(X.grounding_normalized("text")).alias("s"))
    return R.window_join(q, s, "item_id", "doc_id", "q", "s").select("item_id", "doc_id")


FACTS = r"[0-9]+(?:\.[0-9]+)? ?(?:mm|kg|days|%)"


@query(rf"""select l_orderkey, l_linenumber, array_to_string(list_filter(regexp_extract_all(t, '{FACTS}'), lambda x: true), ';') as facts from (
  select l_orderkey, l_linenumber, 'took ' || l_quantity::int || ' days and ' || (l_linenumber * 3) || ' mm at ' || l_linenumber || '% off' as t from lineitem)""")
def numeric_facts(spark, d):
    t = F.expr("concat('took ', cast(l_quantity as int), ' days and ', l_linenumber * 3, ' mm at ', l_linenumber, '% off')")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(X.numeric_facts(t, FACTS), ";").alias("facts"))


@query("""with l as (select doc_id, [doc_id % 7, (doc_id % 3) + 1] as refs, (doc_id % 5) as n from documents), b as (
  select doc_id, n, unnest(list_distinct(refs)) as r from l)
select doc_id, 'INVALID_GUIDELINE_CITATION' as code, 'error' as severity, '[' || r || ']' as evidence from b where r < 1 or r > n
union all select doc_id, 'MISSING_GUIDELINE_CITATIONS', 'warning', null from (select doc_id + 1000000 as doc_id, n from l) where n > 0""")
def citation_check(spark, d):
    docs = table(spark, d, "documents")
    cited = docs.select("doc_id", F.expr("concat('as [', doc_id % 7, '] and [', doc_id % 3 + 1, '] say')").alias("letter"))
    bare = docs.select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("nothing cited").alias("letter"))
    n = docs.select("doc_id", (F.col("doc_id") % 5).alias("n"))
    n = n.unionByName(n.select((F.col("doc_id") + 1000000).alias("doc_id"), "n"))
    return S.citation_issues(cited.unionByName(bare), n, "doc_id", "letter").select("doc_id", "code", "severity", "evidence")


@query(r"""with l as (select o_orderkey, o_orderpriority as a, (o_orderkey % 9)::varchar as b, 'Reference ' || (o_orderkey % 3) as c from orders)
select o_orderkey, case when p > 0 then 'FAIL' else 'PASS' end as verdict, p::int as n_issues from (
  select o_orderkey, (not regexp_matches(a, '(?i)^(?:[0-9]+|PubMed\s+[0-9]+|Reference\s+[0-9]+)$') and o_orderkey % 2 = 0)::int as p from l)""")
def placeholder_check(spark, d):
    o = table(spark, d, "orders")
    letter = F.expr("concat('See [', o_orderkey % 9, '], [Reference ', o_orderkey % 3, '] ', case when o_orderkey % 2 = 0 then concat('[', o_orderpriority, ']') else '' end)")
    letters = o.select("o_orderkey", letter.alias("letter"))
    return S.report(letters.select("o_orderkey"), S.placeholder_issues(letters, "o_orderkey", "letter"), "o_orderkey").select("o_orderkey", "verdict", "n_issues")


SPANS = rf"""p as (select doc_id, regexp_extract_all(text, '[^\n.!?;:]{{8,260}}(?:[.!?;:]|\n|$)') as xs from documents), x as (
  select doc_id, unnest(xs) as x, unnest(range(1, len(xs) + 1)) as i from p), s as (
  select doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') as text, row_number() over (partition by doc_id order by i) as span from x where regexp_matches(x, '[0-9]|ing|tion|ung|ment|ado') and regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), sp as (
  select doc_id, span, text, case when regexp_matches(text, 'tion|ment') then 'action' when regexp_matches(text, 'ing|ung') then 'course' when regexp_matches(text, 'ed|ado') then 'state' when regexp_matches(text, '[0-9]') then 'figure' else 'other' end as category from s where span <= 80)"""


@query(f"with {SPANS} select doc_id, span, md5(text) as text_md5, category from sp")
def evidence_spans(spark, d):
    out = V.spans(table(spark, d, "documents"), "doc_id", "text", PLAIN)
    return out.select("doc_id", F.col("span").cast("long").alias("span"), F.md5("text").alias("text_md5"), "category")


@query(rf"""with recursive {SPANS}, w as (select doc_id, text, regexp_extract_all(text, '[^\n.!?;:]{{8,260}}(?:[.!?;:]|\n|$)') as xs from documents), f(doc_id, i, rest, done, "start", "end", x) as (
  select doc_id, 0, text, 0, null::int, null::int, null::varchar from w
  union all
  select f.doc_id, i + 1, substr(rest, instr(rest, xs[i + 1]) + length(xs[i + 1])), done + instr(rest, xs[i + 1]) - 1 + length(xs[i + 1]),
    (done + instr(rest, xs[i + 1]) - 1)::int, (done + instr(rest, xs[i + 1]) - 1 + length(xs[i + 1]))::int, xs[i + 1] from f join w using (doc_id) where i < len(xs)), k as (
  select doc_id, "start", "end", row_number() over (partition by doc_id order by i) as span from f where regexp_matches(x, '[0-9]|ing|tion|ung|ment|ado') and regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')
select doc_id, span, "start", "end", md5(text) as text_md5, category from k join sp using (doc_id, span)""")
def evidence_offsets(spark, d):
    out = V.spans(table(spark, d, "documents"), "doc_id", "text", PLAIN, offsets=True)
    return out.select("doc_id", F.col("span").cast("long").alias("span"), "start", "end", F.md5("text").alias("text_md5"), "category")


def _criteria(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("criterion"))


MATCHED = f"""c as (select item_id, text as criterion, {TOKENS.format(c="text")} as ct from benchmark), st as (select *, {TOKENS.format(c="text")} as tt from sp), sc as (
  select item_id, doc_id, span, category, len(list_distinct(list_intersect(ct, tt))) + 2 * (regexp_matches(criterion, 'tion|ment') and regexp_matches(text, 'tion|ment'))::int
    + 3 * (regexp_matches(criterion, 'ing|ung') and regexp_matches(text, 'ing|lich'))::int as score from c, st), top as (
  select item_id, doc_id, span, category, score, row_number() over (partition by item_id, doc_id order by score desc, span) as rank from sc where score >= 2)"""


@query(f"with {SPANS}, {MATCHED} select item_id, doc_id, span, score::int as score, rank from top where rank <= 3")
def criterion_top3(spark, d):
    out = V.top_spans_of_all(_criteria(spark, d), table(spark, d, "documents"), "item_id", "doc_id", "text", PLAIN)
    return out.select("item_id", "doc_id", F.col("span").cast("long").alias("span"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with {SPANS}, {MATCHED}, e as (select item_id, list_filter([case when contains(criterion, 'tion') then 'an action' end, case when contains(criterion, 'ing') then 'a course' end, case when regexp_matches(criterion, '[0-9]') then 'a figure' end], lambda x: x is not null) as es from c), m as (
  select doc_id, item_id, case when len(es) = 0 then ['any evidence'] else es end as es from e, documents where (item_id, doc_id) not in (select item_id, doc_id from top)), g as (
  select doc_id, item_id, i, 'item ' || (item_id % 4) || ': ' || es[i] as gap from (select *, unnest(range(1, len(es) + 1)) as i from m)), f as (
  select doc_id, gap, min((item_id, i)) as place from g group by all), r as (select *, row_number() over (partition by doc_id order by place) as n from f)
select doc_id, string_agg(gap, '; ' order by n) as gaps from r where n <= 20 group by doc_id""")
def gap_rollup(spark, d):
    criteria = _criteria(spark, d).withColumn("title", F.expr("concat('item ', item_id % 4)"))
    out = V.gaps_of_all(criteria, table(spark, d, "documents"), "title", "item_id", "doc_id", "text", PLAIN)
    return out.where("size(gaps) > 0").select("doc_id", F.array_join("gaps", "; ").alias("gaps"))


@query(rf"""with {SPANS}, k as (select doc_id, count(*) as n, count_if(category = 'action') > 0 as a from sp group by doc_id), t as (
  select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, n, a from documents left join k using (doc_id)), h as (
  select doc_id, length(t) as len, coalesce(n, 0) as n, regexp_matches(lower(t), 'tion|ment|ung') or coalesce(a, false) as e1, regexp_matches(t, '[0-9]') as e2, regexp_matches(lower(t), 'ing|ando|lich') as e3, regexp_matches(lower(t), 'with|avec|con|mit') as e4 from t), w as (
  select *, least(100, 30 * e1::int + 20 * e2::int + 20 * e3::int + 20 * e4::int + least(10, n)) as score from h)
select doc_id, score::int as score, (len < 120)::int + (not e1 and not e2)::int + (score < 45)::int as n_blocking,
  case when len < 120 or (not e1 and not e2) or score < 45 then 'block' when score < 75 or not (e1 and e2 and e3 and e4) then 'needs_review' else 'pass' end as status from w""")
def sufficiency_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = V.sufficiency(docs, "doc_id", "text", V.spans(docs, "doc_id", "text", PLAIN), PLAIN)
    return out.select("doc_id", "score", F.size("blocking").alias("n_blocking"), "status")


@query(rf"""with {SPANS}, k as (select doc_id, count(*) as n, count_if(category = 'action') > 0 as a from sp group by doc_id), t as (
  select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, case doc_id % 3 when 0 then 'XYZZY' when 1 then 'LA' else '' end as service, n, a from documents left join k using (doc_id)), h as (
  select doc_id, length(t) as len, coalesce(n, 0) as n, regexp_matches(lower(t), 'tion|ment|ung') or coalesce(a, false) as e1, regexp_matches(t, '[0-9]') as e2, regexp_matches(lower(t), 'ing|ando|lich') as e3,
    regexp_matches(lower(t), 'with|avec|con|mit') or contains(lower(t), lower(service)) as e4 from t), w as (
  select *, least(100, 30 * e1::int + 20 * e2::int + 20 * e3::int + 20 * e4::int + least(10, n)) as score from h), b as (
  select *, case when len < 120 or (not e1 and not e2) or score < 45 then 'block' when score < 75 or not (e1 and e2 and e3 and e4) then 'needs_review' else 'pass' end as status from w)
select doc_id, score::int as score, status, array_to_string(list_filter([case when e1 then 'action' end, case when e2 then 'figure' end, case when e3 then 'course' end, case when e4 then 'link' end], lambda x: x is not null), ',') as labels,
  array_to_string(list_filter([case when not e1 then 'action' end, case when not e2 then 'figure' end, case when not e3 then 'course' end, case when not e4 then 'link' end], lambda x: x is not null), ',') as suggestions,
  case status when 'block' then 'The clinical notes are not sufficient to generate a medically grounded appeal yet.' when 'needs_review' then 'The clinical notes can be used, but adding the missing details would strengthen the appeal.'
    else 'The clinical notes contain the core elements needed for a grounded appeal.' end as summary from b""")
def sufficiency_denied_service(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.expr("case doc_id % 3 when 0 then 'XYZZY' when 1 then 'LA' else '' end").alias("service"))
    out = V.sufficiency(docs, "doc_id", "text", V.spans(docs, "doc_id", "text", PLAIN), PLAIN, service=F.col("service"))
    return out.select("doc_id", "score", "status", F.array_join("labels", ",").alias("labels"), F.array_join("suggestions", ",").alias("suggestions"), "summary")


@query("""select o_orderkey, case when a > 900 then 'stale' when a > 365 then 'review_due' else 'current' end as freshness from (
  select o_orderkey, date_diff('day', o_orderdate::date, date '2000-06-01') as a from orders)""")
def freshness(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.freshness(F.col("o_orderdate").cast("date"), F.lit("2000-06-01")).alias("freshness"))


@query("""select p_partkey, case when regexp_matches(p_type, '(?i)eco') then 'cheap' when regexp_matches(p_type, '(?i)promo|small') then 'special' when regexp_matches(p_type, '(?i)m') then 'plain' else 'OTHER' end as kind from part""")
def policy_type(spark, d):
    kinds = (("cheap", "(?i)eco"), ("special", "(?i)promo|small"), ("plain", "(?i)m"))
    return table(spark, d, "part").select("p_partkey", X.first_label("p_type", kinds, "OTHER").alias("kind"))


@query(r"""select page_id, nullif(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '') as title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') as lang,
  coalesce(nullif(regexp_extract(url, 'id=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)', 1), '')) as number,
  case when page_id % 2 = 0 then lpad((page_id % 12 + 1)::varchar, 2, '0') || '/' || lpad((page_id % 28 + 1)::varchar, 2, '0') || '/20' || lpad((page_id % 30)::varchar, 2, '0') else 'no date' end as day from pages""")
def field_extract(spark, d):
    day = F.expr("case when page_id % 2 = 0 then concat('on ', page_id % 12 + 1, '/', page_id % 28 + 1, '/', lpad(page_id % 30, 2, '0')) else 'no date' end")
    p = table(spark, d, "pages").withColumn("raw_day", day)
    return p.select(
        "page_id", F.nullif(F.regexp_extract("html", r"<title[^>]*>([^<]*)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"),
        X.first_match("url", ["id=([0-9]+)", "/([0-9]+)"]).alias("number"), X.normalized_date("raw_day").alias("day"),
    )


@query("""select event_id, coalesce(nullif(case when event_id % 3 = 0 then '' else event_type end, ''), 'k' || (json_extract(props, '$.k'))::varchar) as merged,
  case when event_id % 4 = 0 then event_type else 'typed' end as filled from events""")
def record_merge(spark, d):
    e = table(spark, d, "events")
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    primary = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    current = F.when(F.col("event_id") % 4 == 0, "  ").otherwise("typed")
    return e.select("event_id", H.merged(primary, k).alias("merged"), H.filled(current, F.col("event_type")).alias("filled"))


@query(r"""select page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) as text_md5,
  md5(regexp_replace(regexp_replace(regexp_replace(html, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as kept_md5 from pages""")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(D.xml_text("html")).alias("text_md5"), F.md5(X.whitespace_normalized("html")).alias("kept_md5"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(s, '\s*\[SOURCE [A-Z]\]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as text_md5 from (
  select doc_id, chr(10) || '  Kept [3] and ' || (doc_id % 10) || case when doc_id % 2 = 0 then ' ' else ' [note: keep]' end || ' end.' || chr(10) || chr(10) || case when doc_id % 3 = 0 then 'last' else '' end as s from documents)""")
def sanitize_lines(spark, d):
    letter = F.expr("""concat('SECTION 1: PURPOSE\n[INSERT DATE]\n  Kept [3] and [SOURCE A] ', doc_id % 10, case when doc_id % 2 = 0 then ' [PHONE]' else ' [note: keep]' end, ' end.\n[Your Name]\n', case when doc_id % 3 = 0 then 'last' else '' end)""")
    letter = F.replace(letter, F.lit("and [SOURCE A] "), F.lit("and [SOURCE B] "))
    return table(spark, d, "documents").select("doc_id", F.md5(S.sanitized(letter)).alias("text_md5"))


CONTEXT = r"""r as (select lang, source, doc_id, left(text, 300) as t, row_number() over (partition by lang, source order by n_chars desc, doc_id) as rank from documents), ctx as (
  select lang, source, string_agg('[Reference ' || rank || '] ' || t || '...', chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from r where rank <= 3 group by all)"""


def _context(spark, d) -> DataFrame:
    rows = R.ranked(table(spark, d, "documents"), ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")]).where("rank <= 3")
    rows = rows.withColumn("key", F.concat_ws("/", "lang", "source"))
    return C.context(rows, "key", "rank", F.concat(F.left("text", F.lit(300)), F.lit("...")))


@query(f"with {CONTEXT} select lang || '/' || source as key, md5(context) as context_md5 from ctx")
def context_build(spark, d):
    return _context(spark, d).select("key", F.md5("context").alias("context_md5"))


@query(f"""with {CONTEXT} select lang || '/' || source as key, 'Reference ' || rank as label,
  md5('[Reference ' || rank || '] ' || t || '...' || case when rank < max(rank) over (partition by lang, source) then chr(10) || chr(10) || '---' || chr(10) || chr(10) else '' end) as text_md5 from r where rank <= 3""")
def split_sources(spark, d):
    return C.split_context(_context(spark, d), "key", "context").select("key", "label", F.md5("text").alias("text_md5"))


@query("""select o_orderkey, o_orderdate, c_name from orders join customer on c_custkey = o_custkey
  where contains(lower(c_name), '00012') or contains(lower(o_orderpriority), '00012') or contains(lower(c_mktsegment), '00012') order by o_orderdate desc, o_orderkey limit 50""")
def history_list(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return H.newest(H.matching(rows, ["c_name", "o_orderpriority", "c_mktsegment"], "00012"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderdate", "c_name")


@query("select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def status_counts(spark, d):
    return H.status_counts(table(spark, d, "orders"), "o_orderstatus")


@query("select count(*) as total, count_if(o_orderstatus = 'F')::bigint as finished, count_if(o_orderstatus = 'O')::bigint as open, count_if(o_orderstatus = 'X')::bigint as failed from orders")
def status_pivot(spark, d):
    return H.status_pivot(table(spark, d, "orders"), "o_orderstatus", {"finished": "F", "open": "O", "failed": "X"})


@query("select o_orderkey, o_orderstatus, l_linenumber, l_quantity from orders left join lineitem on l_orderkey = o_orderkey where o_orderkey = 7")
def point_lookup(spark, d):
    o = H.point_lookup(table(spark, d, "orders"), "o_orderkey", 7)
    return o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_version(spark, d):
    return H.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""select lower(r_name) || '-' || v as case_id, upper(r_name) || '-' || lpad(v::varchar, 2, '0') as reference, n_name from region, (select n_name, row_number() over (order by n_nationkey) as v from nation)""")
def scenario_cross(spark, d):
    base = table(spark, d, "region").withColumn("key", F.lower("r_name"))
    return E.scenarios(base, table(spark, d, "nation"), "key", "r_regionkey", "n_nationkey").select("case_id", "reference", "n_name")


METRICS = r"""m as (select doc_id, quality, toxic, ((regexp_matches(text, '[.]'))::int + regexp_matches(text, '(?i)the|der|le')::int + regexp_matches(text, chr(10))::int) / 3 as structure,
  (select len(list_filter(ws, lambda w: contains(lower(text), w))) / greatest(len(ws), 1) from (select list_filter(regexp_split_to_array('about thand ofering other', '[ ]+'), lambda w: length(w) > 4) as ws)) as coverage from labels join documents using (doc_id))"""


@query(f"""with {METRICS} select quality, toxic, count(*) as n, count_if(structure = 1)::bigint as passed, count_if(structure <> 1)::bigint as failed, round(sum(structure), 6) as structure, count_if(coverage >= 0.3)::bigint as covered from m group by all""")
def eval_tally(spark, d):
    parts = (("stop", "[.]"), ("word", "(?i)the|der|le"), ("lines", "\n"))
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rows = rows.withColumn("s", E.structure("text", parts)).withColumn("c", E.word_coverage(F.lit("about thand ofering other"), "text"))
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("s.passed").alias("passed"), F.count_if(~F.col("s.passed")).alias("failed"), F.round(F.sum("s.score"), 6).alias("structure"), F.count_if("c.passed").alias("covered"))


@query("""with v as (select doc_id, case when quality = 0 then 'FAIL' when toxic = 1 then 'NEEDS_REVIEW' else 'PASS' end as r, case when doc_id % 3 = 0 then 'FAIL' else 'PASS' end as m from labels)
select doc_id, case when r = 'FAIL' then 'FAIL' when r = 'NEEDS_REVIEW' and m = 'PASS' then 'NEEDS_REVIEW' else m end as merged, r as offline, case when r = 'PASS' then 0.8 else 0.6 end::double as confidence from v""")
def verdict_merge(spark, d):
    r = S.verdict(F.col("quality") == 0, F.col("toxic") == 1)
    m = F.when(F.col("doc_id") % 3 == 0, "FAIL").otherwise("PASS")
    rows = table(spark, d, "labels").select("doc_id", r.alias("r"), m.alias("m")).withColumn("o", S.offline_verification("r"))
    return rows.select("doc_id", S.merged_verdict("r", "m").alias("merged"), F.col("o.verdict").alias("offline"), F.col("o.confidence").cast("double").alias("confidence"))


STAGE_OF = """case event_type when 'signup' then 'guidelines_started' when 'view' then 'pubmed_started' when 'click' then 'generation_done' when 'error' then 'error' else 'complete' end"""


@query(f"""with e as (select user_id, ts, event_id, {STAGE_OF} as s from events), m as (
  select *, case when starts_with(s, 'guidelines') then 'guidelines' when starts_with(s, 'pubmed') then 'pubmed' when starts_with(s, 'generation') then 'generation' when s = 'complete' then 'save' end as stage,
    case when ends_with(s, '_started') then 'active' when s = 'error' then 'error' else 'done' end as status from e), f as (
  select user_id, stage, arg_max(status, (ts, event_id)) as status, max((ts, event_id)) as at from m where stage is not null group by all), a as (
  select user_id, max((ts, event_id)) as at from m where status = 'active' and stage is not null group by user_id)
select f.user_id, f.stage, case when f.status = 'active' and f.at < a.at then 'done' else f.status end as status from f left join a using (user_id)""")
def stage_status(spark, d):
    stage = F.expr("case event_type when 'signup' then 'guidelines_started' when 'view' then 'pubmed_started' when 'click' then 'generation_done' when 'error' then 'error' else 'complete' end")
    return G.stage_status(table(spark, d, "events").withColumn("event", stage), "user_id", "event", ["ts", "event_id"])


@query("select conv_id, turn, role, text from conversations")
def sse_roundtrip(spark, d):
    rows = table(spark, d, "conversations")
    frames = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", G.sse_frame(F.col("role"), F.struct("turn", "text")).alias("f")))), lambda x: x["f"]), "").alias("stream"))
    return G.sse_events(frames, "conv_id", "stream", "turn long, text string").select("conv_id", "data.turn", F.col("stage").alias("role"), "data.text")


@query("select event_id, (json_extract(props, '$.k'))::bigint as k from events")
def props_json(spark, d):
    text = F.concat(F.lit("Result: "), "props", F.lit(" (end)"))
    return table(spark, d, "events").select("event_id", S.json_in_text(text, "k long")["k"].alias("k"))


@query("""with k as (select doc_id, sha256('["' || source || '", "' || lang || '", "' || (doc_id % 50) || '"]') as cache_key from documents), c as (select distinct cache_key from k where doc_id < 100)
select doc_id, k.cache_key, c.cache_key is not null as cached from k left join c on c.cache_key = k.cache_key""")
def response_cache(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    parts = [F.col("source"), F.col("lang"), F.expr("doc_id % 50")]
    cache = docs.where("doc_id < 100").select(H.cache_key(parts).alias("cache_key")).distinct()  # what earlier requests have left
    hit, miss = H.cached_responses(docs, cache, parts)
    return hit.select("doc_id", "cache_key", F.lit(True).alias("cached")).unionByName(miss.select("doc_id", "cache_key", F.lit(False).alias("cached")))


@query("select not exists (select vec_id from embeddings where label < 5 except select vec_id from embeddings) and (select count(*) from embeddings where label < 5) = (select count(*) from embeddings) as valid")
def embedding_cache_valid(spark, d):
    v = table(spark, d, "embeddings")
    return H.cache_is_valid(v.where("label < 5"), v, "vec_id")


@query("""select item_id, len(list_filter(xs, lambda x: x <> '')) as n_codes, array_to_string(list_filter(xs, lambda x: x <> ''), '|') as codes from (
  select item_id, [ 'E' || (item_id % 90), 'I' || item_id, case when item_id % 2 = 0 then 'X9' else '' end ] as xs from benchmark)""")
def code_lists(spark, d):
    c = F.expr("concat('E', item_id % 90, '; ', ' I', item_id, ' ,', case when item_id % 2 = 0 then 'X9' else ' ' end)")
    return table(spark, d, "benchmark").select("item_id", F.size(X.code_list(c)).cast("long").alias("n_codes"), F.array_join(X.code_list(c), "|").alias("codes"))


@query("""select custkey, valid, errors from (select c_custkey as custkey, (length(c_name) >= 10 and length(c_mktsegment) >= 9) as valid,
  array_to_string(list_filter([case when length(c_name) < 10 then 'c_name' end, case when length(c_mktsegment) < 9 then 'c_mktsegment' end], lambda x: x is not null), ',') as errors from customer)""")
def input_validation(spark, d):
    good, bad = H.rejects(table(spark, d, "customer"), {"c_name": 10, "c_mktsegment": 9})
    out = good.select(F.col("c_custkey").alias("custkey"), F.lit(True).alias("valid"), F.lit("").alias("errors"))
    return out.unionByName(bad.select(F.col("c_custkey").alias("custkey"), F.lit(False).alias("valid"), F.array_join("errors", ",").alias("errors")))


@query(r"""with b as (select page_id, 'T' || page_id as title, 'Body <b>' || page_id || '</b> &amp; more' as body, page_id % 4 as k from pages)
select page_id::varchar as pmid, title, regexp_replace(body, '<[^>]+>', '', 'g') as abstract, case k when 1 then 'Review' else 'Journal Article' end as kinds from b where k <> 3""")
def article_parse(spark, d):
    xml = F.expr("""concat('<Set><PubmedArticle><PMID Version="1">', page_id, '</PMID><ArticleTitle>T', page_id, '</ArticleTitle><AbstractText>Body <b>', page_id, '</b> &amp; more</AbstractText><PublicationType UI="x">',
        case page_id % 4 when 1 then 'Review' when 3 then 'Retracted Publication' else 'Journal Article' end, '</PublicationType></PubmedArticle></Set>')""")
    return D.articles(table(spark, d, "pages").select(xml.alias("xml")), "xml").select("pmid", "title", "abstract", F.array_join("publication_types", ",").alias("kinds"))
