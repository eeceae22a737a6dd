"""What the steps leave on disk and hold in memory."""

from __future__ import annotations

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import minhash, store, substring
from quillspark.llm.words import slices


def tables(spark):
    return {x for x in os.listdir(store.shared_dir(spark).removeprefix("file://")) if x.startswith("quill")}


def corpus(spark):
    """200 texts, every fourth almost that of its neighbour, some without words."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)] if i % 4 != 1 else [*rows[-1][1].split()[:-2], "other", "end"]
        rows.append((i, " ".join(words) if i % 50 != 49 else None))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_dedup_leaves_only_what_its_rows_need(spark):
    docs, before = corpus(spark), tables(spark)
    found = minhash.near_duplicates(docs)
    assert sorted(x.split("-")[1] for x in tables(spark) - before) == ["named", "sketches"]
    assert found.where("doc_id <> component_id").count() == 48  # 49 and 149 have no text
    before = tables(spark)
    assert minhash.filter_documents(docs).count() == 152
    assert [x.split("-")[1] for x in tables(spark) - before] == ["fates"]


def test_substring_dedup_leaves_only_what_its_rows_need(spark):
    docs, before = corpus(spark), tables(spark)
    left = substring.remove_repeats(docs)
    assert [x.split("-")[1] for x in tables(spark) - before] == ["cuts"]
    assert left.count() == 200


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(f"{spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0]}/*/shuffle_*"))
    before = files()
    out = store.write(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert out.count() == 100
    assert not {x for x in files() - before if x.endswith(".data") and os.path.getsize(x) > 1000}


def test_sketches_are_made_in_bounded_runs(monkeypatch):
    text = pa.array([f"a{i} b{i} c d e f" * 20 for i in range(300)] + [None, ""])
    whole = minhash.sketch_text(text)
    sizes, part = [], minhash.sketch_part
    monkeypatch.setattr(minhash, "SKETCHED", 4096)
    monkeypatch.setattr(minhash, "sketch_part", lambda t: sizes.append(t.nbytes) or part(t))
    assert minhash.sketch_text(text).equals(whole)
    assert len(sizes) > 5 and len(sizes) == len(list(slices(text, 4096)))
    assert minhash.sketch_text(text.slice(0, 0)).type == whole.type


def test_near_dedup_keeps_rows_as_before_where_ids_repeat(spark):
    """A doc_id stays if any of its rows is the first of its group, one row of it only if several are; null ids stay."""
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, text), (3, text), (3, "quite other words stand in this one"), (4, "alone a b c d e"), (4, "alone a b c d e"), (5, text), (None, text), (None, text)]
    out = minhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 0, 1, 3, 4]
