"""Operators 11 to 13 against brute force, held-out labels and their defined results on edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspark.llm import alignment, audit, passages

R = random.Random(12)
MIXED = "doc_id long, text string, lang string, source string, n long, good string, block long, digest string"


def saved(table, tmp_path, name):
    table.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def with_extras(spark, rows):
    """(doc_id, text, lang) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "s", 7, "x", 1, "d") for r in rows], MIXED).repartition(3)


# --- op13


def decoded():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = decoded()
    counts, out = Counter(), []
    for _, text in rows:
        want = f" {text or ''}".encode()
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            out.append(([], [], [], []))
            continue
        a_end, b_end = ([*itertools.accumulate(map(len, x))] for x in (a_bytes, b_bytes))
        groups, low = [], 0
        for high in sorted({*a_end} & {*b_end}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= high) for ids, ends in ((a, a_end), (b, b_end))))
            low = high
        links = [(i, k) for i, e, x in zip(a, a_end, a_bytes, strict=True) for k, f, y in zip(b, b_end, b_bytes, strict=True) if min(e, f) > max(e - len(x), f - len(y))]
        counts.update(links)
        out.append((a, b, groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter(
        (i, len(a), len(b), len(g), len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (i, _), (a, b, g, li) in zip(rows, out, strict=True)
    )


ODD = [
    None, "", " ", "a▁b c", "tab\t x\n  y  z　 w  q", "<|endoftext|> <s> </s> <unk> <0x41> ﬁne 漢字 かな 😀 é́ x\x00y", "  two  spaces  ", "x" * 3000, "trailing ", "\n", "­ soft‍join", "naïve Äpfel straße ½ ② ™",
    "don't we'll 'tis 12345 a1b2 \r\n \x0b\x0c\x1c\x1d\x85  x", "Ⴀ ꙮ 𐐀 ᏸ ࢠ ಀ ௭", "▁", "word ▁ word",
]


def test_op13_equals_brute_force(spark, tmp_path):
    words = ["alpha", "Beta,", "gamma.", "épée", "the", "of", "漢字", "x1", "(MIT)", "don't", "\n", "", "%%%", "aaa\tb"]
    texts = ODD + [" ".join(R.choice(words) for _ in range(R.randrange(1, 60))) for _ in range(30)]
    rows = [*enumerate(texts)] + [(None, "null id"), (3, "again"), (3, "again"), (3, "other")]
    docs = with_extras(spark, [(*r, "en") for r in rows])
    want = brute_alignment(rows)
    out = alignment.op13_align_tokenizers(spark, saved(docs, tmp_path, "documents"))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == want
    assert {r[0] for r in want if r[1] == 0} == {0, 1, 3, 14, 15}
    groups = {r["doc_id"]: r["groups"] for r in alignment.token_groups(docs).where("doc_id > 3").collect()}
    assert groups[8] and not groups[14]


def test_op13_blocks_and_forgotten_segments(spark, monkeypatch):
    """Small blocks and a small memory change nothing."""
    texts = [" ".join(f"w{R.randrange(40)}" for _ in range(R.randrange(80))) for _ in range(40)] + ODD
    whole = Counter(map(tuple, alignment.align_documents(with_extras(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()))
    for name, value in (("BLOCK_BYTES", 300), ("PART_BYTES", 90), ("MOST_SEGMENTS", 5)):
        monkeypatch.setattr(alignment, name, value)
    assert Counter(map(tuple, alignment.align_documents(with_extras(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect())) == whole


def test_op13_row_groups_hold_few_blocks(spark, monkeypatch):
    """A reader of blocks has a whole row group in memory, so its rows must not grow with the task's."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    texts = [" ".join(f"w{R.randrange(4000)}" for _ in range(400)) for _ in range(90)]
    blocks = alignment.blocks_of(with_extras(spark, [(i, t, "en") for i, t in enumerate(texts)]).coalesce(1))
    footers = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert sum(f.num_rows for f in footers) >= 60
    assert max(f.row_group(k).num_rows for f in footers for k in range(f.num_row_groups)) <= 4


def test_op13_row_groups_after_a_small_block(spark, monkeypatch):
    """A group's first block may be far smaller than those that follow."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    texts = ["w"] + [" ".join(f"w{R.randrange(4000)}" for _ in range(700)) for _ in range(60)]
    blocks = alignment.blocks_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    footers = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert sum(f.num_rows for f in footers) == 61
    assert max(f.row_group(k).num_rows for f in footers for k in range(f.num_row_groups)) <= 4


def test_op13_empty_and_without_tokens(spark):
    assert alignment.align_documents(with_extras(spark, [(1, None, None)])).collect() == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.align_documents(with_extras(spark, [(1, None, None)]).where("doc_id > 5")).count() == 0


# --- op12


def brute_audit(rows, labels):
    word = re.compile("[^\x20\x09-\x0d]+")
    known = {d: (any(q == 1 for i, q, _ in labels if i == d), any(t == 1 for i, _, t in labels if i == d)) for d, *_ in labels if d is not None}
    fails = []
    for i, text, part in rows:
        t = text or ""
        w = word.findall(t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * (i is not None and any(k is not None and k < i and (x or "") == t for k, x, _ in rows))
        fails.append((part or "", f, *known.get(i, (False, False))))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, total = [x for x in fails if x[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == f for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_op12_equals_brute_force(spark, tmp_path):
    base = ["plain words here", "SHOUTED WORDS", "marks # and | more", "same same same same same", "", None, "Ünï çödé É É É"]
    rows = [(k, (R.choice(base) or "") + R.choice(["", " tail", " x" * 120, " ".join(f"u{n}" for n in range(130))]), R.choice(["en", "de", None, ""])) for k in range(70)]
    rows += [(None, "marks # and | more", "en")] * 3 + [(None, None, "fr"), (200, None, "en"), (201, "", "de"), (201, "", "de"), (202, "w " * 20_000, "long"), (5, "again", "en"), (5, "again", "en"), (6, "again", "en")]
    labels = [(k, R.choice([0, 1, None]), R.choice([0, 1, None])) for k in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    d = saved(with_extras(spark, rows), tmp_path, "documents")
    saved(spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, n long"), tmp_path, "labels")
    out = audit.op12_filter_audit(spark, d).collect()
    assert {tuple(r) for r in out} == brute_audit(rows, labels) and len(out) == 600 * len({p or "" for *_, p in rows})
    none = with_extras(spark, rows[:1]).where("doc_id > 5")
    assert audit.audit(none, spark.read.parquet(f"{d}/labels.parquet")).count() == 0


# --- op11


def synthetic(n):
    """Bags of plain prose; a bad one has a passage of shouted words somewhere."""
    out = []
    for k in range(n):
        words = [R.choice(["lorem", "ipsum", "dolor", "sit", "amet,", "elit."]) + R.choice(["", "us", "a"]) for _ in range(R.randrange(30, 400))]
        bad = k % 4 == 0
        if bad:
            at = R.randrange(len(words))
            words[at : at + 40] = [w.upper() + "!!" for w in words[at : at + 40]] or ["LOUD!!"]
        out.append((k, " ".join(words), int(not bad)))
    return out


def test_op11_gradients():
    r = np.random.default_rng(3)
    net = passages.Attention(np.zeros(passages.N_FEATURES), np.ones(passages.N_FEATURES))
    n, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(8, passages.N_FEATURES))
    _, grad = net.loss(x, n, y)
    for name, g in grad.items():
        p = net.p[name]
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(4)]:
            old, both = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = old + step
                both.append(net.loss(x, n, y)[0])
            p[at] = old
            assert g[at] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-6), name


def test_op11_held_out_labels(spark, tmp_path):
    rows = synthetic(400)
    extra = [(1000, None), (1001, ""), (None, "lorem ipsum"), (None, "lorem ipsum"), (2, rows[2][1]), (1002, "lorem " * 300_000), (1003, "x" * 2_500_000), (1004, "漢字 " * 50)]
    d = saved(with_extras(spark, [(i, t, "en") for i, t, _ in rows] + [(*e, "en") for e in extra]), tmp_path, "documents")
    labels = [(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5000, 0, 0), (3, None, 1), (1001, None, 0)]
    saved(spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string"), tmp_path, "labels")
    out = passages.op11_quality_classifier(spark, d).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    by_text = defaultdict(set)
    for r in out:
        by_text[r["doc_id"]].add(r["score"])
    assert len(by_text[None]) == 1 and len(by_text[2]) == 1 and by_text[1000] == by_text[1001]
    # what is held out, and columns other than the text, teach nothing
    other = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, 1) for i, q, _ in [(i, q, 0) for i, _, q in rows]]
    moved = spark.read.parquet(f"{d}/documents.parquet").withColumnsRenamed({"lang": "source", "source": "lang"})
    again = passages.classify(moved, spark.createDataFrame(other, "doc_id long, quality int, toxic int"))
    assert {(r["doc_id"], r["score"]) for r in again.collect()} == {(r["doc_id"], r["score"]) for r in out}


def test_op11_one_text_does_not_touch_another():
    texts = [t for _, t, _ in synthetic(30)] + ["", "a", None, "!!! ???", "end."]
    x, n = passages.features(pa.array(texts))
    low = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        own, m = passages.features(pa.array([t], pa.string()))
        assert m.tolist() == [k] == [max(1, -(-len((t or "").split()) // passages.PASSAGE))] and np.array_equal(own, x[low : low + k])
        low += k
    assert "".join(passages.stretches("ab " * 900_000)) == "ab " * 900_000 and passages.stretches("") == [""]


def test_op11_few_labels(spark):
    docs = with_extras(spark, [(1, "some words", "en"), (2, None, "en")])
    label = lambda *rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in passages.classify(docs, label((9, None, 1))).collect()} == {0.5}
    assert {r["score"] for r in passages.classify(docs, label((1, 1, 0), (2, 1, 0))).collect()} == {1.0}
    assert passages.classify(docs.where("doc_id > 5"), label((1, 1, 0))).count() == 0


# --- op10


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_op10_is_better_than_its_base(spark, sf):
    from pyspark.sql import functions as F

    from quillspark.llm import recurrent

    out = recurrent.op10_language_model(spark, f"/root/testdata/sf{sf}").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1] and out[2] > 1000


def test_op10_probabilities_sum_to_one_with_other_odds():
    from quillspark.llm import recurrent

    counts = np.array([50.0, 10, 30, 20, 9, 8, 5, 3])
    net, h = recurrent.Network(counts), np.linspace(-1, 1, 16).astype(np.float32)[None]
    plain = np.exp([net.log_probs(h, np.array([k]))[0] for k in range(8)])
    for odds in (0.2, 3.0):
        p = np.exp([net.log_probs(h, np.array([k]), odds)[0] for k in range(8)])
        assert p.sum() == pytest.approx(1) and p[0] / p[3] == pytest.approx(odds * plain[0] / plain[3], rel=1e-4)


def test_op10_unpacks_each_block_once(spark, tmp_path, monkeypatch):
    """Three rounds and the judges read the training documents that one pass over the blocks has written, and these are removed."""
    from quillspark.llm import recurrent, store

    unpack, seen = recurrent.training_documents, str(tmp_path)

    def counted(batches, *x):
        import pathlib
        import uuid

        for batch in batches:
            for _ in range(batch.num_rows):
                pathlib.Path(seen, uuid.uuid4().hex).touch()
            yield from unpack(iter([batch]), *x)

    monkeypatch.setattr(recurrent, "training_documents", counted)
    monkeypatch.setattr(recurrent, "TRAINER_TOKENS", 500)
    docs = spark.createDataFrame([(k, " ".join(f"w{R.randrange(30)}" for _ in range(40))) for k in range(80)], "doc_id long, text string").coalesce(2)
    shared = store.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    assert recurrent.score_documents(docs).count() == 80
    assert len(os.listdir(seen)) == docs.rdd.getNumPartitions()
    assert sorted(x.split("-")[1] for x in set(os.listdir(shared)) - before if x.startswith("quill")) == ["blocks", "totals"]


def test_op10_exponentials_of_far_values():
    from quillspark.llm import recurrent

    x = np.array([[0.5, -1, 2], [700, 690, -700], [-900, -905, -901]], np.float32)
    for rows in (x, x[:1], x[1:], x[2:], x[:0]):
        e, sums, top = recurrent.exponentials(rows)
        want = rows.astype(float) - rows.max(1, keepdims=True, initial=-1e9)
        assert e / sums[:, None] == pytest.approx(np.exp(want) / np.exp(want).sum(1, keepdims=True), rel=1e-5)
        assert np.log(sums) + top == pytest.approx(np.log(np.exp(want).sum(1)) + rows.max(1, initial=-1e9), rel=1e-5)


def test_op10_long_document_read_last_is_not_trained_alone():
    """Lanes stay full: the updates are those of all words side by side, also where the longest document comes last."""
    from quillspark.llm import recurrent

    net, calls = recurrent.Network(np.ones(12)), []
    gradients = net.gradients
    net.gradients = lambda *x: (calls.append(1), gradients(*x))[1]
    rng = np.random.default_rng(5)
    lengths = [20] * 4000 + [4900]
    net.train((np.append(np.int32(recurrent.END), rng.integers(2, 12, n)) for n in lengths), steps=24, lanes=16)
    assert len(calls) <= 1.02 * sum(lengths) / (24 * 16)


def test_op10_steps_take_little_new_memory():
    """Large arrays are used again: fresh pages took a third of a step's CPU seconds."""
    import tracemalloc

    from quillspark.llm import recurrent

    rng = np.random.default_rng(6)
    net = recurrent.Network(1e6 / np.arange(1, 4003.0))
    x, y = np.minimum(rng.zipf(1.2, (2, 24, 256)), 4001)
    h, ids = np.zeros((256, net.hidden), np.float32), x.ravel().astype(np.int64)
    for call in (lambda: net.gradients(x, y, h), lambda: net.log_probs(np.zeros((len(ids), net.hidden), np.float32), ids)):
        call()
        tracemalloc.start()
        call()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 2_500_000


def test_op10_classes_of_far_logits():
    """Logits out of an exponential's range take the way by their maxima, which gives what the plain way gives where both can go."""
    from quillspark.llm import recurrent

    rng = np.random.default_rng(7)
    net = recurrent.Network(np.sort(rng.integers(1, 500, 60))[::-1].astype(float), classes=6)
    net.w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in net.w.items()}
    x, y, h = *rng.integers(0, 60, (2, 5, 4)), np.tanh(rng.standard_normal((4, net.hidden))).astype(np.float32)
    assert net.tame()
    plain, probs = net.gradients(x, y, h), net.log_probs(h, y[0], 1.3)
    net.tame = lambda: False
    other = net.gradients(x, y, h)
    assert other[0] == pytest.approx(plain[0], rel=1e-5) and net.log_probs(h, y[0], 1.3) == pytest.approx(probs, abs=1e-5)
    assert all(np.allclose(other[1][k], v, atol=1e-5) for k, v in plain[1].items())
    del net.tame
    net.w["to_symbol"] *= 3000
    assert not net.tame()
    assert np.exp([net.log_probs(h, np.full(4, k)) for k in range(60)]).sum(0) == pytest.approx(1, abs=2e-3)
    loss, g, _ = net.gradients(x, y, h)
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


# --- op5


def test_op5_tasks_of_a_worker_share_what_is_encoded(monkeypatch):
    """A second task loads no vocabulary and encodes only pieces that the first has not had."""
    from types import SimpleNamespace

    from quillspark.llm import packing

    load, loaded, given = packing.load_tokenizer, [], []

    def counted(path):
        loaded.append(path)
        ids_of = load(path)
        return lambda pieces: (given.append(len(pieces)), ids_of(pieces))[1]

    monkeypatch.setattr(packing, "load_tokenizer", counted)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    path = str(packing.tokenizer_path())
    texts = ["one two  three\n", "", None, "two three one\u3000one"]
    batch = lambda more: pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1), pa.int64()), pa.array([*texts, more])], ["doc_id", "text"])
    if hasattr(packing, "encoder_of"):
        packing.encoder_of.cache_clear()
    first, again, other = (pa.Table.from_batches(packing.encode(iter([batch(more)]), path, 1)) for more in (" two", " two", " four four"))
    assert first == again and len(loaded) == 1 and len(given) == 2 and given[1] == 1
    assert other["ids"].to_pylist()[:-1] == first["ids"].to_pylist()[:-1]
    if hasattr(packing, "encoder_of"):
        packing.encoder_of.cache_clear()  # it holds the counting function


def test_op5_encoder_forgets_at_its_bound():
    from quillspark.llm import packing

    parts = [" a", "b", " \n", "\u3000", "\u2003\t ", " é", "\x85", "漢字 ", "  ", *(f" w{k}" for k in range(40))]
    texts = ["".join(R.choices(parts, k=R.randrange(30))) for _ in range(120)]
    small, large = packing.Encoder(packing.tokenizer_path(), most=25), packing.Encoder(packing.tokenizer_path())
    json = packing.Encoder(packing.tokenizer_path().replace(".tiktoken", ".json"))
    for k in range(0, 120, 5):
        column = pa.array([*texts[k : k + 5], None])
        want = [x.tolist() for x in json(column)]
        assert [x.tolist() for x in small(column)] == [x.tolist() for x in large(column)] == want


# --- op3


def test_op3_without_a_bound_on_sources(spark, tmp_path, monkeypatch):
    """More sources than the flow takes: the same rows as by the flow."""
    from quillspark.llm import mixing

    source = lambda k: None if k % 31 == 0 else f"s{k % 23}" if k % 3 else "hot"
    rows = [(k, " ".join(["w"] * R.randrange(0, 90)) if k % 17 else None, "en", source(k)) for k in range(700)] + [(None, "a b", "en", "s1"), (5, "x", "en", "hot"), (900, "", "en", "empty")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], MIXED)
    d = saved(docs, tmp_path, "documents")
    want = sorted(map(str, mixing.op3_mix_sources(spark, d).collect()))
    kept = sorted(map(str, mixing.mixed_documents(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 4)
    assert sorted(map(str, mixing.op3_mix_sources(spark, d).collect())) == want and len(want) == len(rows)
    assert sorted(map(str, mixing.mixed_documents(docs).collect())) == kept
    with pytest.raises(ValueError, match="share documents"):
        mixing.mix_overlapping_sources(spark, d)
