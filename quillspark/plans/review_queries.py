"""Queries of letters, forms and reviews, with SQL. Most texts are built from the driver's tables by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fields as P
from quillspark.functions import logs as L
from quillspark.functions import text as X
from quillspark.operators import chunks as C
from quillspark.operators import evaluation as E
from quillspark.operators import evidence as V
from quillspark.operators import history as H
from quillspark.operators import safety as S
from quillspark.plans.queries import query, spread, table
from quillspark.profiles import CLINICAL_CLAIM, HEADING_QUOTE
from quillspark.sources import documents as D

BLANK = r"'^\s+|\s+$'"


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {BLANK}, '', 'g')"


def cleaned(x: str) -> str:
    return f"nullif({trimmed(rf"regexp_replace(regexp_replace({x}, '\*\*', '', 'g'), '^[\s:,\-]+|[\s,;]+$', '', 'g')")}, '')"


def first_of(patterns: tuple[str, ...], text: str = "t") -> str:
    return "coalesce(" + ", ".join(cleaned(f"regexp_extract({text}, {sql_text(p)}, 1)") for p in patterns) + ")"


def dated(x: str) -> str:
    p = r"'\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b'"
    part = lambda k: f"regexp_extract({x}, {p}, {k})"
    return f"case when regexp_matches({x}, {p}) then lpad({part(1)}, 2, '0') || '/' || lpad({part(2)}, 2, '0') || '/' || case when length({part(3)}) = 2 then '20' || {part(3)} else {part(3)} end else {x} end"


def coded(x: str, pattern: str) -> str:
    firsts = f"list_filter(regexp_extract_all({x}, {sql_text(pattern)}), lambda c, i: list_position(regexp_extract_all({x}, {sql_text(pattern)}), c) = i)"
    return f"nullif(array_to_string(({firsts})[1:12], ', '), '')"


def built(spark, d, name: str, key: str, **columns: str) -> DataFrame:
    # a few columns of a small file become long texts: dealt out before they are built
    return spread(table(spark, d, name)).select(key, *(F.expr(e).alias(c) for c, e in columns.items()))


DENIAL = """concat('Payer: **Acme ', c_mktsegment, '**,', chr(10), 'Patient Name: ', c_name, chr(10), '  member id: M-', c_custkey, ' ;', chr(10), 'DOB: ', c_custkey % 12 + 1, '/', c_custkey % 28 + 1, '/', 60 + c_custkey % 40, chr(10),
  case when c_custkey % 3 = 0 then 'Procedure: knee 27447' when c_custkey % 3 = 1 then 'Requested Medication:   ' else 'Notes none' end, chr(10), case when c_custkey % 2 = 0 then 'ICD-10: M17.11, E11.9 M17.11' else 'seen for J45.40' end, chr(10),
  case when c_custkey % 5 = 0 then 'CPT: none given' else concat('CPT Code: ', 10000 + c_custkey % 900, ' and J1745') end, chr(10), 'Denial Date: 2-3-2024', chr(10), 'Case / Authorization Number: A', c_custkey, chr(10),
  'Reason for Denial: not needed,', chr(10), 'too new; ', chr(10), case when c_custkey % 4 = 0 then 'Appeal Deadline: soon' else 'and so on' end)"""
DENIAL_NAMES = [*P.DENIAL_FIELDS, "denial_reason"]


def _denial_sql() -> str:
    f = {k: first_of(p) for k, p in P.DENIAL_FIELDS.items()}
    f["icd10_codes"] = f"coalesce({coded(f['icd10_codes'], P.ICD10)}, {coded('t', P.ICD10)})"
    f["cpt_codes"] = f"coalesce({coded(f['cpt_codes'], P.CPT)}, {f['cpt_codes']})"
    f["patient_dob"], f["denial_date"] = dated(f["patient_dob"]), dated(f["denial_date"])
    f["denial_reason"] = cleaned(trimmed(f"regexp_extract(t, {sql_text(f'(?ism)(?:{P.DENIAL_REASON})(.*?)(?:{P.DENIAL_REASON_END}' + r'|\z)')}, 1)"))
    return f"select c_custkey, {', '.join(f'{v} as {k}' for k, v in f.items())} from (select c_custkey, {DENIAL} as t from customer)"


@query(_denial_sql())
def denial_profile(spark, d):
    return built(spark, d, "customer", "c_custkey", t=DENIAL).select("c_custkey", P.denial_details("t").alias("f")).select("c_custkey", "f.*")


NOTE = """concat('Patient ', c_name, ' DOB / Age 0', c_custkey % 9 + 1, '-04-1971 / Age 50', chr(10), case when c_custkey % 2 = 0 then concat('Member ID: ', c_custkey) else 'Insurance' end, chr(10), 'Clinic North Side Primary Insurance Acme Visit Type new', chr(10),
  case c_custkey % 4 when 0 then 'Plan: request to initiate home oxygen after review.' when 1 then 'Start Ozempic 1 mg weekly; recheck' when 2 then concat('Orders today', chr(10), '- Trulicity pen: weekly') else 'nothing asked' end, chr(10), 'Dx E11.9  and M54.5, again E11.9')"""


def _note_sql() -> str:
    f = {k: first_of(p) for k, p in P.NOTE_FIELDS.items()}
    f["patient_dob"] = dated(f"regexp_replace({f['patient_dob']}, '(?im)\\s*/\\s*Age\\b.*$', '')")
    f["denied_service"] = cleaned(f"regexp_replace({f['denied_service']}, '(?i)^Start\\s+', '')")
    f["icd10_codes"] = f"coalesce({coded(f['icd10_codes'], P.ICD10)}, {coded('t', P.ICD10)})"
    return f"select c_custkey, {', '.join(f'{v} as {k}' for k, v in f.items())} from (select c_custkey, {NOTE} as t from customer)"


@query(_note_sql())
def note_profile(spark, d):
    return built(spark, d, "customer", "c_custkey", t=NOTE).select("c_custkey", P.note_details("t").alias("f")).select("c_custkey", "f.*")


@query("""select event_id, coalesce(nullif(den, ''), nullif(typed, ''), nullif(inf, ''), '') as cpt_codes, coalesce(nullif(typed, ''), nullif(inf, ''), '') as member_id,
  (coalesce(length(den), 0) > 0)::int * 2 as n_filled, length(event_type) > 5 as step1, typed <> '' and coalesce(inf, '') <> '' as step2 from (
  select event_id, event_type, case when event_id % 2 = 0 then event_type else '' end as typed, case when event_id % 3 = 0 then 'd' || user_id end as den, case when event_id % 5 = 0 then 'i' || user_id end as inf from events)""")
def case_payload(spark, d):
    names = ["cpt_codes", "member_id"]
    e = built(spark, d, "events", "event_id", event_type="event_type", typed="case when event_id % 2 = 0 then event_type else '' end", den="case when event_id % 3 = 0 then concat('d', user_id) end", inf="case when event_id % 5 = 0 then concat('i', user_id) end")
    side = lambda c: F.struct(*(F.col(c).alias(n) for n in names))
    sent, gate = P.payload(side("typed"), side("den"), side("inf"), names), P.gates("event_type", "typed", F.lit(""), F.col("inf"), F.col("inf"), F.lit(None), 5)
    return e.select("event_id", sent.alias("p"), P.filled_count(side("den"), names).alias("n_filled"), gate.alias("g")).select("event_id", "p.*", "n_filled", "g.*")


LETTER = """concat('# Head ', s_suppkey, chr(10), 'RE: case [SOURCE A]', chr(10), '**Documentation Gaps**', chr(10), '- *first* point', chr(10), s_suppkey, '. numbered', chr(10), '---', chr(10), chr(10), chr(10), chr(10),
  'Date of birth 1', chr(10), '[DOCUMENTATION GAP: scan ', s_suppkey % 7, '] end', chr(10), 'Conclusion', chr(10), 'plain **bold** text')"""


def _lines_sql() -> str:
    t = "t"
    for pattern, to in (S.SOURCE_MARK, *S.GAPS, *S.STYLE_MARKS):
        t = f"regexp_replace({t}, {sql_text(pattern)}, {sql_text(to.replace('$1', chr(92) + '1'))}, 'g')"
    t = trimmed(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")
    any_start = lambda words: " or ".join(f"starts_with(line, {sql_text(w)})" for w in words)
    return rf"""with x as (select s_suppkey, string_split({t}, chr(10)) as ls from (select s_suppkey, {LETTER} as t from supplier)), l as (
  select s_suppkey, unnest(range(0, len(ls)))::int as "at", {trimmed('unnest(ls)')} as line from x), k as (
  select *, case when line = '' then 'blank' when {any_start(S.HEADING_STARTS)} or line in ({', '.join(map(sql_text, S.HEADINGS))}) then 'header' when regexp_matches(line, '^[-*] ') then 'bullet'
    when regexp_matches(line, '^\d+\.\s') then 'numbered' when {any_start(S.BOLD_STARTS)} then 'bold' else 'plain' end as kind from l)
select s_suppkey, "at", kind, case when kind = 'bullet' then substr(line, 3) else line end as line from k"""


@query(_lines_sql())
def submission_lines(spark, d):
    return S.lines(built(spark, d, "supplier", "s_suppkey", t=LETTER), "s_suppkey", "t").select("s_suppkey", "at", "kind", "line")


@query("""select doc_id, 'model:' || case when quality = 1 then 'PASS' else 'FAIL' end || ';rules:' || case when toxic = 1 then 'FAIL' else 'PASS' end as checks, case when toxic = 1 then 'note;TOXIC: d' || doc_id else 'note' end as flagged from labels""")
def merged_checks(spark, d):
    one = lambda name, status: f"array(named_struct('check', '{name}', 'status', {status}, 'details', ''))"
    rows = built(spark, d, "labels", "doc_id", model=one("model", "if(quality = 1, 'PASS', 'FAIL')"), rules=one("rules", "if(toxic = 1, 'FAIL', 'PASS')"), flags="array('note')",
                 issues="if(toxic = 1, array(named_struct('code', 'TOXIC', 'evidence', concat('d', doc_id))), array())")
    rows = rows.select("doc_id", S.merged_verification(F.col("model"), F.col("rules"), F.col("flags"), F.col("issues")).alias("m"))
    return rows.select("doc_id", F.array_join(F.transform("m.checks", lambda c: F.concat_ws(":", c["check"], c["status"])), ";").alias("checks"), F.array_join("m.flagged", ";").alias("flagged"))


QUOTED = """concat('It says "', left(text, 12), '" and "Assessment" or "https://x.org/1" and "pain for ', doc_id, '" "abc"')"""


@query(rf"""select doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '"([^"]{{4,240}})"', 1), lambda x: {trimmed('x')}),
    lambda x: length(x) >= 8 and not regexp_matches(x, '(?i)^https?://') and not regexp_matches(x, {sql_text(HEADING_QUOTE)}) and regexp_matches(x, {sql_text(CLINICAL_CLAIM)})), ' | ') as quotes
  from (select doc_id, {QUOTED.replace('text', 'txt')} as t from (select doc_id, regexp_replace(text, '[\n"]', ' ', 'g') as txt from documents))""")
def quotes_to_ground(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", '[\n"]', " ").alias("text")).select("doc_id", F.expr(QUOTED).alias("t"))
    return rows.select("doc_id", F.array_join(F.filter(X.quotes("t"), lambda q: X.needs_grounding(q, HEADING_QUOTE, CLINICAL_CLAIM)), " | ").alias("quotes"))


@query("""select doc_id, 'zz xyzzy' as claim from documents where doc_id % 2 = 1
union all select doc_id, 'page ' || (doc_id % 7) from documents where doc_id % 7 >= 3""")
def ungrounded_claims(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    claims = docs.where("doc_id % 2 = 1").select("doc_id", F.lit("zz xyzzy").alias("claim"))
    claims = claims.unionByName(docs.select("doc_id", F.expr("concat('page ', doc_id % 7)").alias("claim"))).unionByName(docs.select("doc_id", F.lit(" — ").alias("claim")))
    sources = docs.select("doc_id", F.lit("See PAGE 0, page 1 & page-2.").alias("text")).unionByName(docs.select("doc_id", F.lit("nothing").alias("text")))
    return S.ungrounded(claims, sources, "doc_id", "claim", "text")


@query("""with l as (select o_orderkey, o_orderkey % 3 = 0 as ph, o_orderkey % 4 as cited, o_orderkey % 2 as n from orders)
select o_orderkey, not ph as placeholder_free, cited <= n as guideline_citations_valid, case when ph or cited > n then 'FAIL' when n > 0 and cited = 0 then 'NEEDS_REVIEW' else 'PASS' end as verdict,
  case when ph then 'FAIL' else 'PASS' end || ',' || case when cited > n then 'FAIL' else 'PASS' end || ',PASS' as statuses from l""")
def letter_checks(spark, d):
    letters = built(spark, d, "orders", "o_orderkey", letter="concat('Dear [', if(o_orderkey % 3 = 0, 'INSERT NAME', '1'), '] ', if(o_orderkey % 4 > 0, concat('[', o_orderkey % 4, ']'), ''))")
    letters = letters.withColumn("letter", F.replace("letter", F.lit("Dear [1] "), F.lit("Dear ")))
    sources = table(spark, d, "orders").where("o_orderkey % 2 = 1").select("o_orderkey", F.lit("policy").alias("kind"), F.lit("text").alias("source_text"))
    _, report = S.check_letters(letters, sources, "o_orderkey", "letter")
    statuses = F.array_join(F.transform(S.verification_checks(), lambda c: c["status"]), ",")
    return report.select("o_orderkey", "placeholder_free", "guideline_citations_valid", "verdict", statuses.alias("statuses"))


@query("""select lang, count(*) as n, count_if(n_chars > 500)::bigint as passed, count_if(n_chars <= 500)::bigint as failed from documents group by lang""")
def check_tally(spark, d):
    return E.tally(table(spark, d, "documents").withColumn("passed", F.col("n_chars") > 500), "passed", ["lang"])


REFERENCES = """concat('PATIENT: ', c_name, chr(10), 'as [', c_custkey % 3, '] and [', c_custkey % 2, '] of CMS Manual-', c_custkey % 4, ' and LCD L', c_custkey % 5)"""


@query(f"""select c_custkey, len(list_distinct([c_custkey % 3, c_custkey % 2]))::int as found, len(list_distinct([c_custkey % 3, c_custkey % 2])) >= (c_custkey % 5) * 0.5 as enough,
  array_to_string(list_filter(['CMS Manual-' || (c_custkey % 4), 'LCD L' || (c_custkey % 5)], lambda r: not contains('the cms manual-2 of 2020', lower(r)) and not contains('lcd l1, lcd l3', lower(r))), ';') as unknown,
  c_custkey % 2 = 0 as named, case when c_custkey % 3 = 0 then 'c' else '' end as lacking, case when c_custkey % 3 = 0 then 'a,b' else 'b,c' end as hits from customer""")
def letter_metrics(spark, d):
    rows = built(spark, d, "customer", "c_custkey", c_name="c_name", t=REFERENCES, letter="if(c_custkey % 2 = 0, lower(c_name), 'someone')", ids="if(c_custkey % 3 = 0, array('b', 'a'), array('c', 'b'))")
    titles = F.array(F.lit("the cms manual-2 of 2020"), F.lit("lcd l1, lcd l3"))
    cited, hit = E.citations_present("t", F.col("c_custkey") % 5), E.expected_found(F.array(*map(F.lit, "abc")), F.col("ids"))
    lacking = F.array_join(F.filter(E.missing_keys(["b", "c"], F.col("ids")), lambda x: x.isNotNull()), ",")
    return rows.select("c_custkey", cited["found"].alias("found"), cited["passed"].alias("enough"), F.array_join(E.unknown_references("t", titles), ";").alias("unknown"), E.name_present("t", "letter").alias("named"), lacking.alias("lacking"), F.array_join(hit["hits"], ",").alias("hits"))


SOURCE_NAMES = "case p_partkey % 5 when 0 then 'CMS National Coverage Determination 220' when 1 then 'Local coverage determination' when 2 then 'NCCN v2' when 3 then 'commercial policy' else p_name end"
CRITERION_TEXTS = "case p_partkey % 4 when 0 then 'Not covered for obesity' when 1 then 'No contraindications' else p_type end"


@query(f"""select p_partkey, case when regexp_matches(s, '(?i)National Coverage Determination|NCD') then 'CMS_NCD' when regexp_matches(s, '(?i)Local Coverage Determination|LCD') then 'CMS_LCD' when regexp_matches(s, '(?i)National Comprehensive Cancer Network|NCCN') then 'NCCN'
  when regexp_matches(s, '(?i)Commercial') then 'COMMERCIAL_POLICY' else 'OTHER' end as kind, case when regexp_matches(c, '(?i)non-covered|not covered|contraindicat') then 'not_met' else 'unclear' end as status
  from (select p_partkey, {SOURCE_NAMES} as s, {CRITERION_TEXTS} as c from part)""")
def policy_and_criterion_kinds(spark, d):
    rows = built(spark, d, "part", "p_partkey", s=SOURCE_NAMES, c=CRITERION_TEXTS)
    return rows.select("p_partkey", V.policy_type("s").alias("kind"), V.criterion_status("c").alias("status"))


POLICY = """concat('Intro', chr(10), chr(10), 'Non-Covered Indications:', chr(10), '- severe ', lower(n_name), ' disease', chr(10), '2. cosmetic', chr(10), '- late stage obesity', chr(10), chr(10), 'Coverage:', chr(10), '- severe pain cases')"""


@query("""select s_suppkey, count(*) filter (where s_suppkey % 3 = 0) + count(*) filter (where s_suppkey % 2 = 0) as n from supplier group by s_suppkey having n > 0""")
def contraindicated(spark, d):
    """Lines of a policy's non-covered block of which the supplier's note holds a word."""
    names = table(spark, d, "nation").select("n_nationkey", F.expr(POLICY).alias("content"))
    policies = table(spark, d, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lit(1).alias("pos"), "content")
    notes = built(spark, d, "supplier", "s_suppkey", note="concat(if(s_suppkey % 3 = 0, 'has a rare disease; ', ''), if(s_suppkey % 2 = 0, 'morbid OBESITY', 'cosmetic pain cases'))")
    return V.contraindications(policies, notes, ["s_suppkey"], "content", "note", "pos").groupBy("s_suppkey").agg(F.count("*").alias("n"))


ADVICE_DENIAL = "case o_orderkey % 4 when 0 then 'No METFORMIN trial' when 1 then 'step therapy needed' when 2 then 'physical therapy not shown' else 'MRI missing' end"
ADVICE_NOTES = "case o_orderkey % 3 when 0 then 'failed metformin' when 1 then 'semaglutide and an mri report' else 'nothing' end"


def _advice_sql() -> str:
    due = ", ".join(f"case when regexp_matches(dn, {sql_text(r.denial)}) and not regexp_matches(nt, {sql_text(r.notes)}) then {sql_text(r.text)} end" for r in V.PAYER_ADVICE)
    return f"select o_orderkey, array_to_string(list_filter([{due}], lambda x: x is not null), ' ') as advice from (select o_orderkey, lower({ADVICE_DENIAL}) as dn, lower({ADVICE_NOTES}) as nt from orders)"


@query(_advice_sql())
def payer_advice(spark, d):
    rows = built(spark, d, "orders", "o_orderkey", dn=ADVICE_DENIAL, nt=ADVICE_NOTES)
    return rows.select("o_orderkey", F.array_join(V.payer_suggestions("dn", "nt"), " ").alias("advice"))


@query(rf"""select page_id, {coded('t', P.CPT)} as cpt, {coded('t', P.ICD10)} as icd10, nullif({trimmed("regexp_extract(t, '(?ism)(?:From:)(.*?)(?:To:|\\z)', 1)")}, '') as part from (
  select page_id, 'From: ' || page_id || ' A12.3 J' || (1000 + page_id % 50) || chr(10) || case when page_id % 2 = 0 then 'to: x' else '' end || ' 90210 B20 A12.3' as t from pages)""")
def section_and_codes(spark, d):
    rows = built(spark, d, "pages", "page_id", t="concat('From: ', page_id, ' A12.3 J', 1000 + page_id % 50, chr(10), if(page_id % 2 = 0, 'to: x', ''), ' 90210 B20 A12.3')")
    return rows.select("page_id", P.codes("t", P.CPT).alias("cpt"), P.codes("t", P.ICD10).alias("icd10"), X.section("t", "From:", "To:").alias("part"))


@query("""select page_id, case page_id % 5 when 0 then 'Guideline' when 1 then 'Systematic review/meta-analysis' when 2 then 'Randomized controlled trial' when 3 then 'Clinical trial' else 'Peer-reviewed article' end as level from pages where page_id % 3 = 0 or page_id % 2 = 0""")
def relevant_articles(spark, d):
    """Articles about the service, or with three words of its context, and the kind of evidence they are."""
    kinds = "case page_id % 5 when 0 then array('Review', 'Practice Guideline') when 1 then array('Meta-Analysis') when 2 then array('Randomized Controlled Trial') when 3 then array('Clinical Trial, Phase I') else array('Letter') end"
    rows = built(spark, d, "pages", "page_id", kinds=kinds, text="concat(if(page_id % 3 = 0, 'On OXYGEN at home', 'none'), if(page_id % 2 = 0, ' severe hypoxemia denied', ' severe'))")
    tokens = lambda x: X.relevance_tokens(F.lit(x), D.RELEVANCE_STOP_WORDS)
    found = D.relevant(rows, F.col("text"), tokens("requested oxygen service"), tokens("oxygen severe hypoxemia denied 2024"))
    return found.select("page_id", D.evidence_level("kinds").alias("level"))


@query("""select p_partkey, p_partkey || '-criteria' as chunk_id, 'Criteria of ' || p_brand || chr(10) || '1. ' || p_name || chr(10) || '2. ' || p_type || chr(10) || 'CPT: A' || (p_partkey % 9) || ', B1' as text from part""")
def criteria_chunk(spark, d):
    rows = built(spark, d, "part", "p_partkey", title="concat('Criteria of ', p_brand)", criteria="array(p_name, p_type)", cpt="array(concat('A', p_partkey % 9), 'B1')")
    return C.criteria_chunks(rows, "p_partkey", "title", "criteria", {"CPT": "cpt"}).select("p_partkey", "chunk_id", "text")


@query(f"""select c_custkey, array_to_string(list_filter(['(' || c_mktsegment || ') AND medical necessity AND ' || e, '(' || c_mktsegment || ') AND clinical outcomes AND evidence-based AND ' || e,
    case when c_custkey % 2 = 0 then '(' || c_mktsegment || ') AND (' || left(repeat(c_name || ' ', 9), 100) || ') AND coverage criteria AND humans[MeSH Terms]' end, case when c_custkey % 3 = 0 then '(' || c_mktsegment || ') AND (' || c_custkey || ' ) AND medical policy AND humans[MeSH Terms]' end], lambda x: x is not null), chr(10)) as queries,
  'appeal-letter-' || replace(lower(c_name || ' Jr'), ' ', '-') || '.docx' as file from (select *, {sql_text(P.EVIDENCE_FILTER)} as e from customer)""")
def literature_queries(spark, d):
    rows = built(spark, d, "customer", "c_custkey", c_name="c_name", service="c_mktsegment", reason="if(c_custkey % 2 = 0, repeat(concat(c_name, ' '), 9), '')", cpt="if(c_custkey % 3 = 0, cast(c_custkey as string), '')")
    asked = P.search_queries(F.col("service"), F.col("reason"), F.col("cpt"), F.lit(None).cast("string"))
    return rows.select("c_custkey", F.array_join(asked, "\n").alias("queries"), P.download_name(F.concat("c_name", F.lit(" Jr"))).alias("file"))


@query("""select item_id, '{"instructions":"plan only","evidenceSpans":["E' || item_id || '"],"criteria":["c"],"documentationGaps":["gap ' || (item_id % 3) || '"],"contraindicationWarnings":[],"policyMetadata":["p"]}' as aid from benchmark""")
def planning_aids(spark, d):
    rows = built(spark, d, "benchmark", "item_id", spans="array(concat('E', item_id))", gaps="array(concat('gap ', item_id % 3))")
    aid = V.planning_aid(F.col("spans"), F.array(F.lit("c")), F.col("gaps"), F.array().cast("array<string>"), F.array(F.lit("p")), "plan only")
    return rows.select("item_id", aid.alias("aid"))


MESSAGE = """case event_id % 6 when 0 then concat('HTTP 429: retryDelay: ', event_id % 90, 's') when 1 then concat('RESOURCE_EXHAUSTED retry_delay { seconds: ', event_id % 60, ' }') when 2 then concat('Rate Limit; Retry-After=', event_id % 45)
  when 3 then 'daily QUOTA used' when 4 then concat('status 500 retry-after: ', event_id % 30) else 'timeout' end"""
SERVICE_KEY = "case event_id % 5 when 0 then ' Your-Key-Here ' when 1 then '' when 2 then 'replace-me' when 3 then concat('k', event_id) end"


@query(f"""select event_id, regexp_matches(m, {sql_text(L.RATE_LIMIT)}) as limited, coalesce({', '.join(f"nullif(regexp_extract(m, {sql_text(p)}, 1), '')" for p in L.RETRY_AFTER)})::bigint as wait,
  coalesce(trim(lower(k)) not in ({', '.join(map(sql_text, L.NO_KEY))}), false) as configured from (select event_id, {MESSAGE} as m, {SERVICE_KEY} as k from events)""")
def service_log(spark, d):
    rows = built(spark, d, "events", "event_id", m=MESSAGE, k=SERVICE_KEY)
    return rows.select("event_id", L.rate_limited("m").alias("limited"), L.retry_seconds("m").alias("wait"), L.configured("k").alias("configured"))


POLICY_SOURCE = "case c_custkey % 4 when 0 then 'CMS LCD L1' when 1 then 'NCD 2' when 2 then 'NCCN' else c_name end"


def _metadata_sql(join: str) -> str:
    return f"""with p as (select c_custkey as k, c_name as title, {POLICY_SOURCE} as source, date '2022-01-01' + (c_custkey % 1200)::int as since from customer where c_custkey % 3 > 0)
select o_orderkey, title, case when source is null then null when source like 'CMS LCD%' then 'CMS_LCD' when source like 'NCD%' then 'CMS_NCD' when source = 'NCCN' then 'NCCN' else 'OTHER' end as policy_type,
  case when since is null then null when date_diff('day', since, date '2025-01-01') > 900 then 'stale' when date_diff('day', since, date '2025-01-01') > 365 then 'review_due' else 'current' end as freshness
from orders {join} join p on o_custkey = k"""


def _metadata(spark, d, keep_missing: bool) -> DataFrame:
    policies = table(spark, d, "customer").where("c_custkey % 3 > 0")
    policies = policies.selectExpr("c_custkey as o_custkey", "c_name as title", f"{POLICY_SOURCE} as source", "cast(date_add(date'2022-01-01', cast(c_custkey % 1200 as int)) as string) as effective_date")
    out = V.policy_metadata(table(spark, d, "orders").select("o_orderkey", "o_custkey"), policies, "o_custkey", F.lit("2025-01-01"), keep_missing)
    return out.select("o_orderkey", "title", "policy_type", "freshness")


@query(_metadata_sql("inner"))
def policy_metadata(spark, d):
    return _metadata(spark, d, False)


@query(_metadata_sql("left"))
def policy_by_id(spark, d):
    return _metadata(spark, d, True)


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 7 > 0 then o_clerk when o_orderkey % 2 = 0 then 'clerk ' || o_orderkey end as o_clerk,
  o_orderkey % 7 = 0 as touched from (select o_orderkey, o_orderstatus, 'c' || o_custkey as o_clerk from orders)""")
def record_update(spark, d):
    """Stored rows after updates of some of them and of keys that aren't there."""
    stored = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus", "concat('c', o_custkey) as o_clerk", "false as touched")
    news = stored.where("o_orderkey % 7 = 0").selectExpr("o_orderkey", "'X' as o_orderstatus", "if(o_orderkey % 2 = 0, concat('clerk ', o_orderkey), null) as o_clerk")
    strangers = news.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return H.updated(stored, news.unionByName(strangers), "o_orderkey", "touched", F.lit(True))


DRAFT = "concat('RE: ', p_name, chr(10), chr(10), '- ', p_type, ' <&>', chr(10), p_partkey, '. ', p_brand, chr(10), 'Physician: ', p_brand, chr(10), 'plain ', p_name)"


@query("""select p_partkey, 'RE: ' || trim(p_name) || chr(10) || chr(10) || p_type || ' <&>' || chr(10) || p_partkey || '. ' || trim(p_brand) || chr(10) || 'Physician: ' || trim(p_brand) || chr(10) || 'plain ' || trim(p_name) as text from part""")
def letter_file(spark, d):
    """The text of letters written as DOCX files and read again."""
    files = D.docx_files(built(spark, d, "part", "p_partkey", t=DRAFT), "p_partkey", S.line_array("t")).withColumn("path", F.concat("p_partkey", F.lit(".docx")))
    return D.document_texts(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("p_partkey"), "text")
