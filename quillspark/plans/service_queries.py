"""Queries of work that calls services (answers, repairs, vectors) and of all checks of a letter, over whole documents, with SQL.

The services are functions of the text, so that SQL can say what they answer.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from quillspark.functions import tables as TF
from quillspark.operators import evidence as V
from quillspark.operators import generation as G
from quillspark.operators import history as H
from quillspark.operators import repair as R
from quillspark.operators import safety as S
from quillspark.plans.queries import SQL, STAGE_OF, query, table
from quillspark.sources import tables as T
from quillspark.streaming import stages as B
from quillspark.streaming import upserts as U


def no_wait(seconds: float) -> None:
    pass


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def first_answer(system: str, prompt: str, temperature: float) -> str:
    return f"first {digest(prompt)}"


def small_answer(system: str, prompt: str, temperature: float) -> str | None:
    h = digest(prompt)
    if h < "4":
        raise RuntimeError("429 quota")
    if h < "6":
        raise RuntimeError("429 Retry-After: 1")
    return None if h < "8" else f"small {h}"


def large_answer(system: str, prompt: str, temperature: float) -> str:
    h = digest(prompt)
    if h.endswith("0"):
        raise ValueError("broken")
    return f"large {h}"


@query("""with d as (select doc_id, coalesce(text, '') as t from documents), old as (select distinct t from d where doc_id % 3 = 0), h as (select doc_id, t in (select t from old) as cached, md5(t) as h from d)
select doc_id, cached, case when cached then 'first ' || h when h >= '8' then 'small ' || h when not ends_with(h, '0') then 'large ' || h end as response,
  case when cached then 'first' when h >= '8' then 'small' when not ends_with(h, '0') then 'large' end as provider,
  case when not cached and h < '8' and ends_with(h, '0') then 'small: ' || case when h < '6' then 'rate limit' else 'no text' end || '; large: broken' end as error,
  case when cached then 0 when h >= '8' then 1 when h >= '4' and h < '6' then 3 else 2 end as n_calls from h""")
def cached_generation(spark, d):
    """Every document is asked about; a third of them has been before. Copies of a text are one question."""
    docs, cache = table(spark, d, "documents").select("doc_id", "text"), T.fresh_dir(spark, "answers")
    ask = lambda rows, chain, batch: G.answered(rows, cache, chain, F.lit("Describe the text."), F.col("text"), batch, wait=no_wait)
    ask(docs.where("doc_id % 3 = 0"), [G.Provider("first", first_answer)], "1")
    out = ask(docs, [G.Provider("small", small_answer, attempts=2), G.Provider("large", large_answer)], "2")
    return out.select("doc_id", "cached", "response", "provider", "error", "n_calls")


def text_measures(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def _two_versions(spark, d):
    """The present documents, and a folder of vectors made when some were missing, some had another text and some were there that are gone."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    old = docs.where("doc_id % 10 <> 0").select("key", F.expr("if(doc_id % 7 = 0, concat(text, ' old'), text)").alias("text"))
    gone = docs.where("doc_id % 13 = 0").select(F.expr("concat('x', key)").alias("key"), "text")
    path = T.fresh_dir(spark, "vectors")
    G.refresh_vectors(old.unionByName(gone), path, "key", "text", text_measures, 1, wait=no_wait)
    return docs.select("key", "text"), path


@query("""with d as (select doc_id, doc_id::varchar as key, coalesce(text, '') as t from documents)
select key, case when doc_id % 10 = 0 then 'added' when doc_id % 7 = 0 then 'changed' else 'same' end as change, length(t)::double as chars, (length(t) - length(replace(t, ' ', '')))::double as spaces,
  case when doc_id % 10 = 0 or doc_id % 7 = 0 then 2 else 1 end as version from d
union all select 'x' || key, 'gone', null, null, null from d where doc_id % 13 = 0""")
def vector_refresh(spark, d):
    """Vectors after a refresh: only texts that are new to their key are asked for."""
    docs, path = _two_versions(spark, d)
    changes = G.refresh_vectors(docs, path, "key", "text", text_measures, 2, wait=no_wait)
    out = G.read_vectors(spark, path).join(changes, "key", "full")
    return out.select("key", F.coalesce("change", F.lit("same")).alias("change"), F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("spaces"), F.col("version").cast("int").alias("version"))


@query("""with d as (select doc_id from documents), old as (select doc_id::varchar as key from d where doc_id % 10 <> 0 union all select 'x' || doc_id from d where doc_id % 13 = 0)
select 'before' as cache, (select count(*) from old) = (select count(*) from d) and not exists (select key from old except select doc_id::varchar from d) as valid
union all select 'after', (select count(distinct doc_id) from d) = (select count(*) from d)""")
def vector_cache_states(spark, d):
    """Whether the vectors belong to the documents, before and after a refresh."""
    docs, path = _two_versions(spark, d)
    before = H.cache_is_valid(G.read_vectors(spark, path), docs, "key")
    G.refresh_vectors(docs, path, "key", "text", text_measures, 2, wait=no_wait)
    after = H.cache_is_valid(G.read_vectors(spark, path), docs, "key")
    return before.select(F.lit("before").alias("cache"), "valid").unionByName(after.select(F.lit("after").alias("cache"), "valid"))


#: Letters of whole documents: their letters and full stops, then lines with marks that the checks look at, by the remainders of doc_id.
MARKS = (
    ("doc_id % 4 = 0", "[Insert Date]"), ("doc_id % 3 = 0", "as [1] says"), ("doc_id % 5 = 0", "as [9] says"), ("doc_id % 6 = 0", "as [PubMed 2] says"),
    ("doc_id % 7 = 0", 'with "pain of the xyzzy kind" noted'), ("doc_id % 11 = 0", "for 99 weeks"),
)
BASE = {"spark": r"regexp_replace(coalesce(text, ''), '[^A-Za-z .,\n]', ' ')", "sql": r"regexp_replace(coalesce(text, ''), '[^A-Za-z .,\n]', ' ', 'g')"}


def marked(base: str, marks: tuple[tuple[str, str], ...] = MARKS) -> str:
    return f"concat({base}, chr(10), {', '.join(f'''case when {c} then concat({chr(39)}{m}{chr(39)}, chr(10)) else '' end''' for c, m in marks)}, 'ref ', doc_id)"


def _letters(spark, d):
    docs = table(spark, d, "documents")
    letters = docs.select("doc_id", F.expr(marked(BASE["spark"])).alias("letter"))
    policy = docs.where("doc_id % 2 = 1").select("doc_id", F.lit("policy").alias("kind"), F.lit("a policy").alias("source_text"))
    article = docs.select("doc_id", F.explode(F.expr("slice(array(1, 2, 3), 1, cast(doc_id % 4 as int))")).alias("x")).select("doc_id", F.lit("article").alias("kind"), F.expr("concat('article ', x)").alias("source_text"))
    case = docs.select("doc_id", F.lit("case").alias("kind"), F.expr("concat('kept: ', if(doc_id % 14 = 0, 'Pain of the XYZZY kind.', ''), if(doc_id % 22 = 0, ' It lasted 99 weeks.', ''))").alias("source_text"))
    return letters, policy.unionByName(article).unionByName(case)


#: What is wrong with these letters, as SQL of the remainders.
FOUND = """f as (select doc_id, text, doc_id % 4 = 0 as ph, doc_id % 3 = 0 and doc_id % 2 = 0 as one, doc_id % 5 = 0 as nine, doc_id % 6 = 0 and doc_id % 4 < 2 as pm,
  doc_id % 2 = 1 and doc_id % 3 <> 0 as bare, doc_id % 7 = 0 and doc_id % 14 <> 0 as quote, doc_id % 11 = 0 and doc_id % 22 <> 0 as number from documents)"""


@query(f"""with {FOUND}, c as (select *, case when bare and not nine then ' ' || '{S.MESSAGES["MISSING_GUIDELINE_CITATIONS"]}' else '' end as missing,
  case when one then ' Guideline citation [1] does not map to any retrieved guideline source.' else '' end || case when nine then ' Guideline citation [9] does not map to any retrieved guideline source.' else '' end as guideline,
  case when pm then ' PubMed citation [PubMed 2] does not map to any retrieved PubMed source.' else '' end as pubmed from f)
select doc_id, 0 as "at", 'Deterministic Placeholder Check' as "check", case when ph then 'FAIL' else 'PASS' end as status,
  case when ph then 'Potential unresolved placeholder or unsupported bracketed text: [Insert Date]' else 'No unresolved bracket placeholders were detected.' end as details from c
union all select doc_id, 1, 'Deterministic Citation Check', case when one or nine or pm then 'FAIL' else 'PASS' end,
  case when one or nine or pm then trim(missing || guideline || pubmed) else 'All numbered guideline and PubMed citations map to retrieved sources.' end from c
union all select doc_id, 2, 'Deterministic Grounding Check', case when quote or number then 'WARNING' else 'PASS' end,
  case when quote or number then trim(case when quote then '{S.MESSAGES["UNGROUNDED_QUOTE"]} pain of the xyzzy kind ' else '' end || case when number then '{S.MESSAGES["UNGROUNDED_NUMERIC_CLAIM"]} 99 weeks' else '' end)
    else 'Quoted and numeric claims were found in the supplied sources.' end from c""")
def letter_verification(spark, d):
    """The three checks of each letter, with what they say; all five kinds of finding occur."""
    letters, sources = _letters(spark, d)
    _, report = S.check_letters(letters, sources, "doc_id", "letter")
    return report.select("doc_id", F.posexplode(S.verification_checks()).alias("at", "c")).select("doc_id", "at", "c.*")


def careful_repair(system: str, prompt: str, temperature: float) -> str:
    """Takes out the citation [9], keeps the rest of the draft; refuses every thirteenth."""
    draft = re.search(r"(?s)== ORIGINAL LETTER ==\n(.*?)\n\n== CLINICAL NOTES ==", prompt)[1]
    if int(draft.rpartition(" ")[2]) % 13 == 0:
        raise RuntimeError("429")
    return draft.replace("[9]", "the guideline").replace("[PubMed 2]", "an article")


REPAIRED_MARKS = tuple((c, m.replace("[Insert Date]", "").replace("[9]", "the guideline").replace("[PubMed 2]", "an article")) for c, m in MARKS)


@query(rf"""with {FOUND}, v as (select *, ph or one or nine or pm as failed from f),
  o as (select *, failed and doc_id % 13 <> 0 as done from v)
select doc_id, failed as repair_attempted, case when failed then 'FAIL' end as pre_repair_verdict, case when failed and not done then 'careful: rate limit' end as repair_error,
  case when failed and not done then 'FAIL' when done and one then 'FAIL' when quote or number or (bare and (done or not nine)) then 'NEEDS_REVIEW' else 'PASS' end as verdict,
  case when (failed and not done) or (done and one) then 'failed' else 'completed' end as status,
  md5(case when done then regexp_replace(regexp_replace({marked(BASE["sql"], REPAIRED_MARKS)}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') else {marked(BASE["sql"])} end) as letter_md5 from o""")
def letter_repair(spark, d):
    """All letters after the repair loop: those that pass or need review stay, failing ones are repaired once and checked again."""
    letters, sources = _letters(spark, d)
    out = R.repaired_letters(letters, sources, "doc_id", "letter", [G.Provider("careful", careful_repair)], T.fresh_dir(spark, "repairs"), "1", "You repair letters.", "Repair the letter.", "Return the letter only.", wait=no_wait)
    return out.select("doc_id", "repair_attempted", "pre_repair_verdict", "repair_error", "verdict", "status", F.md5("letter").alias("letter_md5"))


@query(SQL["stage_status"])
def stage_stream(spark, d):
    """stage_status from a stream of the events: all that the stream has said of a key and stage, the last of it."""
    events = T.parquet_stream(spark, d, "events.parquet", table(spark, d, "events").schema).withColumn("event", F.expr(STAGE_OF))
    where = T.fresh_dir(spark, "stages")
    states = B.stream_stage_status(events, "user_id", "event", "ts", "event_id", late="60 days", keep_idle="365 days")
    save = lambda rows, n: T.written_once(rows.withColumn("batch", F.lit(n)), f"{where}/rows/{n}") and None
    states.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    said = T.appended(spark, f"{where}/rows", "key string, stage string, status string, batch int")
    return said.groupBy(F.col("key").cast("long").alias("user_id"), "stage").agg(F.max_by("status", "batch").alias("status"))


@query("select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders union all select -o_orderkey - 1, 'N', null, o_orderdate from orders where o_orderkey % 5 = 0")
def upsert_stream(spark, d):
    """Orders after two streams of changes: their first versions with other values, then the present ones (some in both, one batch delivered twice) and new keys."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = T.fresh_dir(spark, "orders")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema) + ", at long"
    first = orders.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("?"), "at": F.lit(1).cast("long")})
    new = orders.where("o_orderkey % 5 = 0").selectExpr("-o_orderkey - 1 as o_orderkey", "'N' as o_orderstatus", "cast(null as double) as o_totalprice", "o_orderdate", "2L as at")
    write = U.version_writer(path)
    write(first, 0)
    write(orders.withColumn("at", F.lit(2).cast("long")).unionByName(new.withColumn("o_totalprice", F.col("o_totalprice").cast(orders.schema["o_totalprice"].dataType))), 1)
    write(first, 0)
    write(first.withColumn("o_orderstatus", F.lit("late")), 2)  # changes older than what is known
    return U.upserted(spark, path, kept, "o_orderkey", "at").drop("at")


@query(SQL["chunk_documents"])
def chunk_function(spark, d):
    """chunk_documents as a table function of SQL, dealt out by document."""
    TF.register(spark)
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("quill_documents")
    out = spark.sql("select * from chunks(table(select doc_id, text from quill_documents) partition by (doc_id), 'doc_id', 'text', '\\n')")
    return out.select("doc_id", "chunk_id", "chunk_pos", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


#: Notes of whole documents with clinical sentences, and the rules of evidence once more, as SQL of their own.
NOTE = "concat('Assessment: type 2 diabetes with A1c ', doc_id % 9 + 5, '. Failed metformin therapy for ', doc_id % 12, ' months; walking causes pain.', chr(10), case when doc_id % 3 = 0 then 'Plan: request semaglutide. The endocrinologist recommends it! ' else 'No smoking history, sleep well at home. ' end, coalesce(text, ''))"


@query(rf"""with n as (select doc_id, {NOTE} as t from documents), p as (select doc_id, regexp_extract_all(t, '[^\n.!?;:]{{8,260}}(?:[.!?;:]|\n|$)') as xs from n), x as (
  select doc_id, regexp_replace(unnest(xs), '^\s+|\s+$', '', 'g') as x, unnest(range(1, len(xs) + 1)) as i from p), k as (
  select doc_id, x, i, row_number() over (partition by doc_id order by i) as span from x where x <> '' and regexp_matches(x, '(?i)[0-9]|diagnos|pain|failed|therapy|mri|ct|pet|x-?ray|biopsy|lab|symptom|function|medication|risk|plan|recommend|conservative|provider|prescriber|physician|clinician|endocrinolog|diabetes specialist|\bFACE\b|ordering/rendering|clinic|practice|facility'))
select doc_id, span, md5(x) as text_md5, case
  when regexp_matches(x, '(?i)provider|prescriber|physician|clinician|endocrinolog|diabetes specialist|\bFACE\b|ordering/rendering|clinic|practice|facility') then 'provider'
  when regexp_matches(x, '(?i)diagnos|icd|cancer|osteoarthritis|stenosis|spondylolisthesis|apnea|diabetes|obesity|malignan') then 'diagnosis'
  when regexp_matches(x, '(?i)mri|ct|pet|x-?ray|radiograph|imaging|biopsy|patholog|lab|a1c|ahi') then 'imaging'
  when regexp_matches(x, '(?i)therapy|pt\b|nsaid|injection|conservative|surgery|medication|trial|failed|treatment') then 'treatment'
  when regexp_matches(x, '(?i)adl|walking|stairs|function|womac|koos|pain|vas|limitation|mobility') then 'functional'
  when regexp_matches(x, '(?i)risk|bmi|smok|hypertension|contraindicat|infection|cardiac') then 'risk'
  when regexp_matches(x, '(?i)mg|dose|methotrexate|biologic|cpap|drug|medication') then 'medication' else 'other' end as category from k where span <= 80""")
def medical_spans(spark, d):
    """Evidence of clinical notes by the clinical rules."""
    notes = table(spark, d, "documents").select("doc_id", F.expr(NOTE).alias("t"))
    return V.spans(notes, "doc_id", "t").select("doc_id", F.col("span").cast("long").alias("span"), F.md5("text").alias("text_md5"), "category")
