"""What tasks hold and how often steps run, where results alone don't show it."""

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quillspark.operators import evidence as V
from quillspark.operators import generation as G
from quillspark.operators import repair as R
from quillspark.operators import safety as S
from quillspark.operators import search as Q
from quillspark.plans import review_queries
from quillspark.profiles import PLAIN, SPAN


def map_function(monkeypatch, make):
    """The first function that make() gives to mapInArrow, and the rows it was given to."""
    seen = []
    kept = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: seen.append((f, self)) or kept(self, f, *a, **k))
    make()
    monkeypatch.undo()
    return seen[0]


def test_top_spans_go_on_in_parts(spark, monkeypatch):
    criteria = spark.createDataFrame([(i, f"a question about section {i % 3}") for i in range(40)], "item_id long, criterion string")
    notes = spark.createDataFrame([(i, "One question about something here. Another section was mentioned there. A third section follows.") for i in range(60)], "doc_id long, text string")
    find, rows = map_function(monkeypatch, lambda: V.top_spans_of_all(criteria, notes, "item_id", "doc_id", "text", PLAIN))
    whole = pa.Table.from_batches(find(rows.coalesce(1).toArrow().combine_chunks().to_batches()))
    monkeypatch.setattr(V, "ROWS_OUT", 500, raising=False)
    parts = list(find(rows.coalesce(1).toArrow().combine_chunks().to_batches()))
    assert pa.Table.from_batches(parts).equals(whole) and whole.num_rows > 2000
    assert max(p.num_rows for p in parts) < 500 + 40 * 3


def test_offsets_of_a_repeating_run(spark):
    """A piece's text may stand before the piece, too: here 260 of 300 characters without a mark match, the last ones."""
    text = "Es ist ein Anfang mit 1. " + "tung " * 60
    notes = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["start"], r["end"]) for r in V.spans(notes, "doc_id", "text", PLAIN, offsets=True).collect()]
    assert got == [m.span() for m in re.finditer(PLAIN.span, text)] and text.find(text[got[1][0] : got[1][1]], got[0][1]) < got[1][0]


def test_letters_are_made_once(spark, tmp_path):
    def made(check):
        n = spark.sparkContext.accumulator(0)
        letter = F.udf(lambda i: n.add(1) or f'"severe pain {i}" for 9 weeks [3] [INSERT NAME]')
        check(spark.range(20).select("id", letter("id").alias("letter")))
        return n.value

    sources = spark.createDataFrame([(i, "case", f"severe pain {i}") for i in range(20)], "id long, kind string, source_text string")
    assert made(lambda letters: S.check_letters(letters.select("id", "letter"), sources, "id", "letter")[0].collect()) <= 20
    chain = [G.Provider("p", lambda system, prompt, temperature: "short")]
    assert made(lambda letters: R.repaired_letters(letters, sources, "id", "letter", chain, f"file://{tmp_path}", "1", "", "", "").collect()) <= 20


def test_vector_search_takes_few_rows_at_a_time(spark, monkeypatch):
    v = spark.range(3000).selectExpr("id as vec_id", "id % 3 as label", "array(float(id % 7), float(id % 11), 1f) as embedding")
    q = v.where("vec_id % 100 = 0").selectExpr("vec_id as q_id", "embedding as q")
    find, rows = map_function(monkeypatch, lambda: Q.vector_topk(v, q, "embedding", "q", "q_id", "label", "vec_id"))
    sizes = []
    add = Q.Best.add
    monkeypatch.setattr(Q.Best, "add", lambda self, scores, *a: sizes.append(len(scores)) or add(self, scores, *a))
    assert sum(b.num_rows for b in find(rows.coalesce(1).toArrow().combine_chunks().to_batches())) >= 30 * 3
    assert sum(sizes) == 3000 and max(sizes) <= Q.ROWS_AT_ONCE


def test_windows_are_found_in_place(spark):
    quotes = spark.createDataFrame([(1, "a b c d".split()), (2, "a b c".split()), (3, "d c b a".split())], "item_id long, q array<string>")
    sources = spark.createDataFrame([(i, ["x"] * i + ["a", "b", "x", "c", "d"]) for i in range(50)] + [(99, None)], "doc_id long, s array<string>")
    out = Q.window_join(quotes, sources, "item_id", "doc_id", "q", "s")
    assert {tuple(r) for r in out.collect()} == {(1, i) for i in range(50)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_runs_are_matched_in_one_go(spark):
    r = random.Random(3)
    texts = ["".join("".join(r.choices("aé🙂1 ", k=r.choice((3, 7, 8, 200, 259, 260, 261, 262, 700)))) + r.choice([".", "!", "\n", ":", "", ".."]) for _ in range(6)) for _ in range(60)]
    texts += ["", "x" * 260, "x" * 261, "x" * 261 + "\n", "x" * 300 + "."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", V.span_matches("t").alias("m"), V.span_offsets("t").alias("o"))
    got = {x["id"]: (x["m"], [(o["start"], o["end"]) for o in x["o"]]) for x in rows.collect()}
    pattern = re.compile(SPAN.replace("(?d)", ""))
    assert got == {i: (pattern.findall(t), [m.span() for m in pattern.finditer(t)]) for i, t in enumerate(texts)}
    one = spark.createDataFrame([("x" * 4_000_000,)], "t string")
    began = time.perf_counter()
    assert len(one.select(F.element_at(V.span_matches("t"), 1).alias("m")).first()["m"]) == 260
    assert time.perf_counter() - began < 8


def test_built_texts_keep_all_cores_busy(spark, tmp_path):
    spark.range(2000).selectExpr("id as c_custkey", "concat('Customer ', id) as c_name", "'BUILDING' as c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("denial_profile", "note_profile"):
        out = getattr(review_queries, name)(spark, f"file://{tmp_path}")
        assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 2000
