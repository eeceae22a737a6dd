"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import glob
import hashlib
import math
import os
import random
import re
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(map(str, (tuple(plain(r[i]) for i in order) for r in data)))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    want = db.sql(plans.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(5).collect() is not None


def grounding_tokens(text):
    """The reference's normalisation (F4) and tokens (F5) in plain Python."""
    text = unicodedata.normalize("NFKC", text)
    for many, one in (("“”", '"'), ("‘’", "'"), ("–—−", "-"), ("²", "2"), ("³", "3")):
        text = re.sub(f"[{many}]", one, text)
    text = re.sub("[^a-z0-9%/]+", " ", text.lower().replace("&", " and ")).strip()
    return text, [x for x in text.split() if len(x) > 1 or re.search("[0-9]", x)]


def holds(quote, source):
    if len(quote) < 4 or len(source) < len(quote):
        return False
    for start in (i for i, x in enumerate(source) if x == quote[0]):
        at = 0
        for x in source[start : start + len(quote) + max(6, (3 * len(quote) + 3) // 4)]:
            at += x == quote[at]
            if at == len(quote):
                return True
    return False


def fixture(spark, path, benchmark, documents):
    spark.createDataFrame([*enumerate(benchmark)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, t, None) for i, t in enumerate(documents)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_quote_window_takes_all_tokens(spark, tmp_path):
    r = random.Random(7)
    word = [f"word{k}" for k in range(9)] + ["5", "x", "ﬁne", "A—b"]
    quotes = [" ".join(r.choices(word, k=n)) for n in (2, 4, 5, 8, 13, 20, 30) for _ in range(3)]
    docs = [" ".join(x for w in q.split() for x in ([w] if r.random() < 0.97 else []) + r.choices(word, k=r.random() < 0.3)) for q in quotes for _ in range(3)]
    opening = quotes[-1].split()[:14]
    docs += [" ".join(opening + ["other"] * 30), "", f"so {quotes[-1]} ends", f"so {quotes[-4].upper()} ends"]
    got = {(x["item_id"], x["doc_id"]) for x in plans.QUERIES["quote_window"](spark, fixture(spark, tmp_path, quotes, docs)).collect()}
    tokens = [[grounding_tokens(x)[1] for x in many] for many in (quotes, docs)]
    want = {(i, k) for i, q in enumerate(tokens[0]) for k, s in enumerate(tokens[1]) if holds(q, s)}
    assert got == want and len(want) > 15 and (len(quotes) - 1, len(docs) - 4) not in got and (len(quotes) - 1, len(docs) - 2) in got


def test_grounding_normalize_of_all_texts(spark, tmp_path):
    texts = ["plain & simple, 5%", "“Quoted” – it’s 5−3 m² and x³ — a/b", "ﬁne Ｆｕｌｌ ½ ① naïve Äpfel", "漢字 ΑΒΓ ï", "İstanbul ß K Å", "a\u00a0b\u2003c", "", "‘7’ x y 8"]
    got = {r["doc_id"]: (r["text_md5"], r["n_tokens"]) for r in plans.QUERIES["grounding_normalize"](spark, fixture(spark, tmp_path, [], texts)).collect()}
    want = {}
    for i, x in enumerate(texts):
        normal, tokens = grounding_tokens(x)
        want[i] = (hashlib.md5(normal.encode()).hexdigest(), len(tokens))
    assert got == want


def test_grounding_normalize_takes_every_document(spark, db):
    texts = dict(db.sql("select doc_id, text from documents where text is not null").fetchall())
    assert any(not x.isascii() for x in texts.values())
    got = {r["doc_id"]: (r["text_md5"], r["n_tokens"]) for r in plans.QUERIES["grounding_normalize"](spark, SF).collect() if r["doc_id"] in texts}
    plain_version = {i: grounding_tokens(x) for i, x in texts.items()}
    assert got == {i: (hashlib.md5(n.encode()).hexdigest(), len(t)) for i, (n, t) in plain_version.items()}



def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
