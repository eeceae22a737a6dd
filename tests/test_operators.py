"""Small cases with results known by hand, and brute-force versions of the trickier functions."""

import io
import random
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillspark import profiles as P
from quillspark.functions import text as X
from quillspark.operators import chunks as C
from quillspark.operators import evidence as V
from quillspark.operators import history as H
from quillspark.operators import safety as S
from quillspark.operators import search as R
from quillspark.sources import documents as D
from quillspark.sources import records as Q
from quillspark.streaming import stages as G


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def letters_and_sources(spark, letter, notes="", policies=(), articles=()):
    rows = [(1, "case", notes)] + [(1, "policy", p) for p in policies] + [(1, "article", a) for a in articles]
    return spark.createDataFrame([(1, letter)], "id long, letter string"), spark.createDataFrame(rows, "id long, kind string, source_text string")


def codes(spark, *args, **kw):
    issues, report = S.check_letters(*letters_and_sources(spark, *args, **kw), "id", "letter")
    return report.first()["verdict"], {r["code"] for r in issues.collect()}


def test_grounded_letter_passes(spark):
    letter = 'The notes say "MRI shows severe stenosis at L4" [1] after 6 weeks of care [PubMed 1].'
    assert codes(spark, letter, "MRI shows severe stenosis at L4; 6 weeks of care.", ["Policy"], ["Article"]) == ("PASS", set())


def test_bad_citation_and_placeholder_fail(spark):
    verdict, found = codes(spark, "Dear [INSERT NAME], see [4].", "x", ["one"])
    assert verdict == "FAIL" and {"UNRESOLVED_PLACEHOLDER", "INVALID_GUIDELINE_CITATION"} <= found


def test_missing_citation_and_ungrounded_claims_need_review(spark):
    verdict, found = codes(spark, 'Says "patient has severe pain" for 12 weeks.', "nothing", ["policy"])
    assert verdict == "NEEDS_REVIEW" and found == {"MISSING_GUIDELINE_CITATIONS", "UNGROUNDED_QUOTE", "UNGROUNDED_NUMERIC_CLAIM"}


def test_headings_urls_and_punctuation_variants_are_no_issue(spark):
    assert codes(spark, 'See "Physical Examination" and "https://x.org/1".', "x")[0] == "PASS"
    assert codes(spark, 'It says "BMI of 38 kg/m2 — and rising".', "BMI of 38 kg/m² - and rising")[1] == set()


def test_sanitizer(spark):
    text = "SECTION 1: PURPOSE\n**Documentation Gaps**\n[INSERT DATE]\nSee [1] and [PHONE] now [SOURCE A]\n[DOCUMENTATION GAP: more tests]\n\n\n\nEnd"
    assert one(spark, S.sanitized("t"), t=text) == "**Clinical Rationale for Exception\n\nSee [1] and  now\nAdditional supporting rationale: more tests\n\nEnd"


def window(quote, source):
    if len(quote) < 4 or len(source) < len(quote):
        return False
    span = len(quote) + max(6, -(-3 * len(quote) // 4))
    for s in range(len(source)):
        if source[s] == quote[0]:
            k = 0
            for t in source[s : s + span]:
                if k < len(quote) and t == quote[k]:
                    k += 1
            if k == len(quote):
                return True
    return False


def test_ordered_window_equals_brute_force(spark):
    r = random.Random(5)
    cases = [([r.choice("abcd") for _ in range(r.randrange(7))], [r.choice("abcd") for _ in range(r.randrange(25))]) for _ in range(300)]
    rows = spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(cases)], "i long, q array<string>, s array<string>")
    got = {x["i"]: x["w"] for x in rows.select("i", X.has_ordered_window("q", "s").alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == [window(q, s) for q, s in cases]


def fold(text, most=600, overlap=100):
    now, done = "", []
    for p in [p for p in text.split("\n\n") if p.strip(" ")]:
        if len(now) + len(p) > most and len(now) > overlap:
            done.append(now)
            now = now[-overlap:] + "\n\n" + p
        else:
            now = now + "\n\n" + p if now else p
    return done + ([now] if now.strip(" ") else [])


def test_chunks_equal_brute_force(spark):
    r = random.Random(6)
    texts = ["\n\n".join("x" * r.choice([0, 1, 50, 99, 100, 101, 300, 700]) + str(k) for k in range(r.randrange(9))) for _ in range(60)] + ["", " ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {}
    for x in C.chunks(rows, "id", "t").orderBy("id", "chunk_pos").collect():
        got.setdefault(x["id"], []).append(x["text"])
    assert got == {i: fold(t) for i, t in enumerate(texts) if t and fold(t)}


def test_context_round_trip(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k long, r int, t string")
    back = C.split_context(C.context(rows, "k", "r", F.col("t")), "k", "context").orderBy("k", "source_at").collect()
    assert [(x["k"], x["label"], x["text"].removesuffix("\n\n---\n\n")) for x in back] == [(1, "Reference 1", "[Reference 1] a"), (1, "Reference 2", "[Reference 2] b"), (2, "Reference 1", "[Reference 1] c")]
    assert C.split_context(spark.createDataFrame([(1, "bare"), (2, "  ")], "k long, t string"), "k", "t").select("k", "label").collect() == [(1, "Context")]


def test_retrieval_prefers_codes_and_falls_back(spark):
    cases = spark.createDataFrame([(1, ["7114-8", "M54.5"], "words"), (2, ["99999"], "knee pain pain")], "id long, codes array<string>, q string")
    policies = spark.createDataFrame([("b", "M54.50", 2), ("a", "71148", 1)], "policy string, code string, pos int")
    chunks = spark.createDataFrame([("a", "back", 1), ("b", "knee pain", 2)], "policy string, chunk string, at int")
    out = R.retrieve(cases, policies, chunks, key="id", case_codes="codes", case_query="q", policy="policy", code="code", policy_order="pos", text="chunk", chunk_order="at")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1.0, 1, True), (1, "b", 1.0, 2, True), (2, "b", 1.0, 1, False)]


def test_containment_join_without_cartesian_product(spark):
    r = random.Random(4)
    key = lambda most: "".join(r.choice("ab1") for _ in range(r.randrange(most)))
    listed = ["", " - ", None, "abababab1", "abababab", "ABABAB.ABAB-1", *(key(24) for _ in range(60))]
    asked = ["", ".", None, "abababab", "b abababab1 1", *(key(30) for _ in range(60)), *(x + key(9) for x in listed if x)]
    plain_key = lambda x: re.sub(r"[.\-\s]", "", x.upper())
    q, c = (spark.createDataFrame([*enumerate(x)], f"{n} long, {n}_code string") for n, x in (("q", asked), ("c", listed)))
    out = R.containment_join(q, c, "q_code", "c_code")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    pairs = [(i, k, plain_key(a), plain_key(b)) for i, a in enumerate(asked) for k, b in enumerate(listed) if a is not None and b is not None]
    want = sorted((i, k) for i, k, a, b in pairs if a and (a in b or b in a))
    assert sorted((x["q"], x["c"]) for x in out.collect()) == want and len(want) > 200


def test_table_functions(spark):
    from quillspark.functions import tables

    tables.register(spark)
    r = random.Random(6)
    texts = ["\n\n".join("x" * r.choice([0, 1, 50, 99, 100, 101, 300, 700]) + str(k) for k in range(r.randrange(9))) for _ in range(60)] + ["", " ", None, "ü\n\n\n\nb"]
    rows = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id long, t string, chunk_id string")
    rows.createOrReplaceTempView("texts")
    want = sorted(map(tuple, C.chunks(rows, "id", "t").collect()))
    assert sorted(map(tuple, spark.sql("select * from chunks(table(texts) partition by (id), 'id', 't')").collect())) == want and len(want) > 60
    got = spark.sql("select * from segments(table(select id, t from texts where id = 63), 'id', 't', '[^\\n]+')")
    assert got.columns == ["id", "segment", "start", "end", "text"] and [tuple(x) for x in got.collect()] == [(63, 1, 0, 1, "ü"), (63, 2, 5, 6, "b")]
    assert spark.sql("select * from chunks(table(select id, t from texts where id < 0), 'id', 't')").count() == 0
    with pytest.raises(Exception, match="has no columns"):
        spark.sql("select * from chunks(table(texts), 'id', 'none')")


def test_short_queries_find_nothing(spark):
    t = spark.createDataFrame([("E11", "diabetes", 1)], "code string, name string, pos int")
    assert R.substring_search(t, "d", ["code", "name"], "pos").count() == 0
    assert R.substring_search(t, "IABE", ["code", "name"], "pos").count() == 1


def test_cosine(spark):
    assert one(spark, R.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.0]) == pytest.approx(1)
    assert one(spark, R.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 2.0]) == 0
    assert one(spark, R.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[0.0, 2.0]) == 0


def test_evidence_and_sufficiency(spark):
    note = "Assessment: type 2 diabetes with A1c 8.9. Failed metformin therapy for 6 months. Walking causes pain. Plan: request semaglutide; the endocrinologist recommends it. " * 2
    notes = spark.createDataFrame([(1, note), (2, "short note"), (3, None)], "id long, t string")
    found = V.spans(notes, "id", "t")
    out = {r["id"]: (r["status"], r["score"]) for r in V.sufficiency(notes, "id", "t", found).collect()}
    assert out[1][1] >= 75 and out[1][0] == "pass" and out[2][0] == out[3][0] == "block"
    # failed and therapy in common, and the topic of treatments: 4 points for the second span, the topic alone gives 2
    top = V.top_spans(spark.createDataFrame([(1, 0, "Failed conservative therapy")], "id long, c int, criterion string"), found, ["id"], ["id", "c"])
    assert [(x["span"], x["score"], x["category"]) for x in top.orderBy("rank").limit(2).collect()] == [(2, 4, "treatment"), (6, 4, "treatment")]


def test_offsets_are_code_points(spark):
    text = "Ünïcode 🙂 ends here. Second piece!"
    got = one(spark, V.span_offsets("t"), t=text)
    assert [(x["start"], x["end"]) for x in got] == [m.span() for m in re.finditer(P.SPAN.replace("(?d)", ""), text)]


def test_field_functions(spark):
    assert one(spark, X.normalized_date("t"), t="on 3/4/21.") == "03/04/2021"
    assert one(spark, X.normalized_date("t"), t="none") == "none"
    assert one(spark, X.extracted_codes("t", r"\b[A-Z]\d{2}(?:\.\d+)?\b"), t="M54.5 M54.5 E11") == "M54.5, E11"
    assert one(spark, X.first_match("t", [r"(?im)^\s*Payer\s*:\s*(.+)$", r"(?im)^Plan\s*:\s*(.+)$"]), t="Payer: ** \nPlan: **Acme**,") == "Acme"
    assert one(spark, X.section("t", "Reason:", "Next:"), t="Reason: too new\nNext: x") == "too new"
    assert one(spark, X.section("t", "Reason:", "Next:"), t="Reason: to the end") == "to the end"
    assert one(spark, X.citations("t"), t="[1] PubMed [2] [1] pubmed is far away [3]") == ["1", "3"]
    assert one(spark, X.numeric_facts("t", P.NUMERIC_FACT), t="12 weeks, 38 kg/m² and 5/6/2020, 7") == ["12 weeks", "38 kg/m2", "5/6/2020"]
    assert one(spark, H.with_element(F.col("t"), F.lit("c")), t="a, b") == "a, b, c"


def test_freshness_and_policy_type(spark):
    for d, want in (("2020-01-01", "stale"), ("2023-06-01", "review_due"), ("2024-05-01", "current"), ("soon", "review_due")):
        assert one(spark, V.freshness(F.col("d"), F.lit("2024-06-01")), d=d) == want
    assert one(spark, V.policy_type("d"), d="Local Coverage Determination L1") == "CMS_LCD"


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_uploads(spark):
    files = [("a.docx", docx("One", "Two")), ("b.txt", "﻿café  x".encode()), ("c.txt", b"caf\xe9"), ("d.pdf", b"stream\n(Hello) Tj [(W)(orld)] TJ\nendstream"), ("e.docx", b"no zip"), ("f.exe", b"x"), ("g.txt", b"")]
    got = {r["path"]: (r["text"], r["error"]) for r in D.document_texts(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.docx"] == ("One\nTwo", None) and got["b.txt"] == ("café x", None) and got["c.txt"] == ("café", None)
    assert got["d.pdf"] == ("Hello World", None) and got["e.docx"][1] and got["f.exe"][1] == "unsupported format" and got["g.txt"][1] == "no text"


def test_letter_file(spark):
    letter = "RE: **Case** <1> & 2\n\n- first\n1. one\nPatient Name: A\n\x01end"
    files = spark.createDataFrame([("a.docx", letter), ("b.docx", None), ("c.docx", "")], "path string, t string").transform(D.docx_files, "path", S.line_array("t"))
    content = {r["path"]: r["content"] for r in files.collect()}
    assert content["b.docx"] is None and content["a.docx"] == files.where("path = 'a.docx'").first()["content"]
    with zipfile.ZipFile(io.BytesIO(content["a.docx"])) as z:
        body = z.read("word/document.xml").decode()
        assert z.testzip() is None and all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    assert body.count("<w:b/>") == 2 and body.count("ListBullet") == 1
    got = {r["path"]: r["text"] for r in D.document_texts(files).collect()}
    assert got["a.docx"] == "RE: Case <1> & 2\n\nfirst\n1. one\nPatient Name: A\nend" and got["c.docx"] == ""


def test_json_tables(spark, tmp_path):
    def table(name, text):
        (tmp_path / name).write_text(text)
        return [tuple(r) for r in Q.json_table(spark, f"file://{tmp_path}/{name}", "id string, n int").collect()]

    assert table("a.json", '[{"id": "x", "n": 1},\n {"id": "y", "more": [2]}]') == [(0, "x", 1), (1, "y", None)]
    assert table("b.json", '[{"id": "x", "n": 1}, {"id": ') == [] and table("c.json", "") == [] and table("d.json", "[]") == []
    missing = Q.codes(spark, f"file://{tmp_path}/none.json")
    assert missing.collect() == [] and missing.columns == ["corpus_pos", "code", "description"]
    cases = spark.createDataFrame([("a", True)], "id string, passed boolean")
    for _ in range(2):
        Q.write_results(cases, cases.groupBy("passed").count(), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/cases").count() == 1 and spark.read.json(f"file://{tmp_path}/out/summary").first()["count"] == 1


def test_partitions_do_not_matter(spark):
    rows = spark.createDataFrame([(k % 7, k, k % 3) for k in range(200)], "key long, pos long, v long")
    want = sorted(map(tuple, R.first_seen(rows, ["key", "v"], [F.col("pos")]).collect()))
    for n in (1, 3, 17):
        assert sorted(map(tuple, R.first_seen(rows.repartition(n), ["key", "v"], [F.col("pos")]).collect())) == want
