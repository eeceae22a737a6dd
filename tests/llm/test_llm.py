"""The corpus operators against brute force, round trips and their defined results on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, embeddings, licenses, minhash, mixing, packing, quality, recurrent, store, substring, tokencount

R = random.Random(11)
JSON = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = ["alpha", "Beta", "gamma,", "delta.", "épée", "zeta", "the", "of", "漢字", "x1", "MIT", "license"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, sum long"  # with clashing extra names


def prose(n):
    return " ".join(R.choice(VOCABULARY) + (str(R.randrange(60)) if R.random() < 0.7 else "") for _ in range(n))


def corpus():
    base, passage = prose(300).split(), prose(90)
    texts = [None, "", " \n\t ", "one", "two words", "one", prose(40), prose(700), prose(2500), "x\x1fy\x0bz w " * 30]
    texts += [" ".join(base)] * 3
    for k in range(40):
        words = base[:]
        for _ in range(k % 9):
            words[R.randrange(len(words))] = f"new{R.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(6)] + [f"{prose(20)} {passage[40:]}", passage]
    texts += [f"{prose(60)}\nReleased under the MIT License." for _ in range(3)] + ["Licensed under CC BY-NC 4.0. apache license version 2 apache license version 2"]
    texts += [" ".join(["junk$$$", "###"] * 60), "dup line\n" * 50]
    return [(3 * i + 1, t, "en", None if i % 11 == 0 else f"s{i % 4}", 0, "r", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text, lower=False):
    data = (text or "").encode()
    return [w.decode() for w in (data.translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))) if lower else data).split()]


def reachable(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    links = [(R.randrange(80), R.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    want = reachable(links, {x for p in links for x in p})
    got = dict(map(tuple, store.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert store.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_round_trip_windows_and_masks(spark):
    odd = ["\\### Assistant: </turn> ok", "### user: x </turn>\n", "\\", "#<", "", None, ": ", "a" * 50]
    turns = []
    for conv in [*range(6), None]:
        for t in range(R.randrange(1, 60)):
            role = "system" if t == 0 and conv == 1 else R.choice(["user", "assistant", None, "a: b\\#"])
            turns.append((conv, t // 2, role, R.choice([*odd, prose(R.randrange(120))])))
    turns.append((99, 0, "assistant", prose(2000)))
    out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=200).collect()
    order = lambda x: (x is not None, x or "")
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], order(t[2]), order(t[3])))
        windows = sorted((w for w in out if w["conv_id"] == conv), key=lambda w: w["window"])
        back = [(r, t) for w in windows for r, t, _, _ in chat.read_back(w["formatted"])[w["repeated_turns"] :]]
        assert back == [(t[2] or "", t[3] or "") for t in own]
        loss = [chat.unescape(w["formatted"][s["start"] : s["end"]]) for w in windows for s in w["loss_spans"]]
        assert loss == [t[3] or "" for t in own if t[2] == "assistant"]
        assert all(w["n_tokens"] <= 200 or w["over_budget"] for w in windows)
        if own[0][2] == "system":
            assert all(chat.read_back(w["formatted"])[0][0] == "system" for w in windows)
    assert any(w["over_budget"] for w in out) and any(w["repeated_turns"] for w in out)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_op2_counts_and_verdicts(docs, rows, empty):
    out = {r["doc_id"]: r for r in quality.score_documents(docs).collect()}
    for i, text, *_ in rows:
        n, chars, symbols, dups, again = base_counts(text)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (r["kept"] and r["base_failed"])
    assert out[3 * 7 + 1]["kept"]
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}
    assert quality.score_documents(empty).count() == quality.filter_documents(empty).count() == 0


def test_op2_em_weighs_rules():
    post, found = quality.fit({"ggggggg": 9000, "bgggggg": 40, "bbggggg": 300, "bbbgggg": 200, "ggbgggg": 30, "-gggggg": 100})
    assert post["bbggggg"] < 0.1 < 0.9 < post["-gggggg"] and found["prior"] > 0.8
    assert quality.fit({})[0] == {}


def test_op3_targets_flow_and_selection(spark, docs, empty):
    sizes = {"a": 100, "b": 10, "c": 1000, None: 50}
    t = mixing.targets(sizes, 1160)
    assert sum(t.values()) == pytest.approx(1740) and all(t[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and t["b"] == 20
    flow = mixing.least_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 14})
    into = Counter()
    for (p, s), n in flow.items():
        assert s in p
        into[s] += n
    assert into["a"] == pytest.approx(12) and into["b"] == pytest.approx(14)
    # only as much repetition as must be: 26 words of 22
    given = Counter()
    for (p, _), n in flow.items():
        given[p] += n
    assert sum(max(0, given[p] - n) for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 2}.items()) == pytest.approx(4)
    many = spark.createDataFrame([(i, "w " * R.randrange(1, 30), f"s{i % 3 if i % 2 else 0}") for i in range(3000)], "doc_id long, text string, source string")
    taken, sizes, wanted = mixing.mix(many, F.array("source"))
    got = {r["source"]: r["n"] for r in taken.groupBy(F.col("sources")[0].alias("source")).agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    assert all(abs(got[s] - wanted[s]) <= 30 for s in wanted) and taken.agg(F.max("copies")).first()[0] <= 2
    again, _, _ = mixing.mix(many.repartition(7), F.array("source"))
    assert sorted(map(str, again.collect())) == sorted(map(str, taken.collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(empty, F.array("source"))[0].count() == 0


def test_op3_rows_that_share_an_id_are_one_unit(spark):
    rows = [(1, "w " * 10, "a")] * 4 + [(2, None, "a"), (3, "", None), (None, "x y", None), (None, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, sizes, wanted = mixing.mix(docs, F.array("source"))
    got = sorted((r["doc_id"] or 0, r["size"], r["copies"]) for r in taken.collect())
    out = mixing.mixed_documents(docs)
    assert len({c for i, n, c in got if i == 1}) == len({c for i, n, c in got if i == 0}) == 1
    assert Counter(r["doc_id"] or 0 for r in out.collect()) == Counter({i: n for i, n in ((i, sum(c for j, _, c in got if j == i)) for i in (0, 1)) if n})
    assert abs(sum(10 * c for i, _, c in got if i == 1) - wanted["a"]) <= 20 and sizes["a"] == 40


def test_op3_overlapping_sources_equal_brute_force(spark):
    """The selection by midpoints for each pattern's share of the flow, which keeps the quotas and repeats no more than it must."""
    kinds = [["s", "l"], ["s"], ["l", "m"], ["m"]]
    rows = [(i, "w " * (1 + i % 5), kinds[i % 4 if i % 7 else 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups array<string>")
    taken, sizes, wanted = mixing.mix(docs, F.col("groups"))
    got = {r["doc_id"]: (tuple(r["sources"]), r["size"], r["copies"]) for r in taken.collect()}
    by_pattern = Counter()
    for p, n, _ in got.values():
        by_pattern[p] += n
    flow = mixing.least_cost_flow(dict(sorted(by_pattern.items())), wanted)
    given = Counter()
    for (p, _), n in flow.items():
        given[p] += n
    into = Counter()
    for (_, s), n in flow.items():
        into[s] += n
    assert all(into[s] <= wanted[s] + 1e-6 for s in wanted)
    for p, n in by_pattern.items():
        whole, rest = int(given[p] // n), given[p] % n
        own = sorted((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), i) for i in got if got[i][0] == p)
        before = 0
        for _, i in own:
            size = got[i][1]
            assert got[i][2] == min(2, whole + (2 * before + size <= 2 * rest)), (p, i)
            before += size
    # no cheaper way of as many words: moving a word from a repeated pattern to an unrepeated one must be impossible
    cost = sum(max(0.0, given[p] - n) for p, n in by_pattern.items())
    least = max(0.0, sum(wanted.values()) - sum(by_pattern.values()))
    assert cost >= least - 1e-6


def shingle_set(text):
    w = words(text, True)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_op4_equals_brute_force(docs, rows, empty, monkeypatch):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reachable(links, sets)
    for small in (minhash.SMALL, 1):  # also with all mixed buckets compared in blocks
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
        monkeypatch.setattr(minhash, "HUB_PAIRS", 3)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"] for r in minhash.filter_documents(docs).collect()} == {i for i, c in want.items() if i == c}
    assert minhash.near_duplicates(empty).count() == 0


def test_op4_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0, r["component_id"]) for r in out), key=str) == sorted([(1, 1), (1, 1), (2, 1), (0, None), (0, None)], key=str)
    assert minhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_op4_sketch_fills_and_estimates():
    for n in (1, 3, 400):
        sketch = minhash.similarity_sketch(np.zeros(n, np.int64), np.arange(n, dtype=np.uint64) * np.uint64(77), 1)
        assert (sketch != np.uint64(2**64 - 1)).all()
    a, b = np.arange(300, dtype=np.uint64), np.arange(60, 360, dtype=np.uint64)
    x, y = (minhash.similarity_sketch(np.zeros(300, np.int64), s, 1)[0] for s in (a, b))
    assert abs((x == y).mean() - 240 / 360) < 0.15


def test_op5_pieces(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    out = packing.pack_documents(docs).toPandas()
    for i, g in out.sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[i])) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    assert set(out.doc_id) == set(ids)
    lengths = []
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        lengths.append(g.length.sum())
    assert max(lengths) <= 2048 and sum(n < 2048 for n in lengths) <= 1
    assert packing.pack_documents(empty).count() == 0
    same = packing.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"))
    assert same.count() == 2


def test_op5_ids_equal_the_tokenizer():
    encoder = packing.Encoder(packing.tokenizer_path())
    signs = " \n\t\r\x0b\x1c\x1f\x85  　ab'sZ9é—🙂漢<|endoftext|>###"
    texts = ["".join(R.choice(signs) for _ in range(R.randrange(60))) for _ in range(1500)] + ["<|endoftext|> it's we'll  go\n\n x "]
    json, column = packing.Encoder(JSON), pa.array([*texts, None])
    flat, sizes = json.ids_of([t.encode() for t in texts])
    want = [x.tolist() for x in np.split(flat, np.cumsum(sizes))]
    assert [x.tolist() for x in encoder(column)] == [x.tolist() for x in json(column)] == want


def test_op5_added_tokens_equal_the_tokenizer_at_its_defaults(spark):
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(JSON), packing.Encoder(packing.tokenizer_path())
    parts = ["<|endoftext|>", "<|endoftext|>", " ", "  ", "\n\n", "word", "é's", "<|endo", "|>", "\u3000", "9"]
    texts = ["".join(R.choices(parts, k=R.randrange(12))) for _ in range(1500)] + ["a  <|endoftext|>  b<|endoftext|><|endoftext|>", "plain"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder(pa.array([*texts, None]))] == [*want, []] and 50256 in want[-2]
    out = packing.pack_documents(spark.createDataFrame([(1, texts[-2])], "doc_id long, text string")).collect()
    assert [r["ids_crc32"] for r in out] == [zlib.crc32(np.array([*want[-2], 1], "<u4").tobytes())]


def test_op5_scores_all_terms_of_the_seed():
    r = np.random.default_rng(4)
    rests = [r.integers(0, 200, n, dtype=np.uint32) for n in (300, 50, 120, 200, 90)]
    n, mean = len(rests), np.mean([len(x) for x in rests])
    df = Counter(t for x in rests for t in set(x.tolist()))
    idf = {t: np.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    k1, b = packing.K1, packing.B
    for seed, q in enumerate(rests):
        got = packing.Shard(rests).scores(seed)
        for d, x in enumerate(rests):
            if d != seed:
                c = Counter(x.tolist())
                assert got[d] == pytest.approx(sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(x) / mean)) for t in set(q.tolist()) if c[t]))


def test_op5_bm25_neighbours_come_first():
    topic = lambda k: np.random.default_rng(k).integers(1000 * (k % 4), 1000 * (k % 4) + 40, 500, dtype=np.uint32)
    sequences, left = packing.fill([topic(k) for k in range(40)])
    assert sum(len({i % 4 for i, _, _ in s}) == 1 for s in sequences) >= len(sequences) - 4
    used = Counter()
    for s in sequences:
        assert sum(b - a for _, a, b in s) == 2048
        for i, a, b in s:
            used[i] += b - a
    assert sum(used.values()) + sum(500 - a for _, a in left) == 40 * 500


def test_op6_equals_brute_force(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)  # several shards and salts
    monkeypatch.setattr(substring, "TASK_WORDS", 2000)
    texts = {i: words(t) for i, t, *_ in rows}
    owner = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - 49):
            owner.setdefault(tuple(texts[i][s : s + 50]), i)
    out = {r["doc_id"]: r for r in substring.repeated_words(docs).collect()}
    left = {}
    for i, w in texts.items():
        gone = {p for s in range(len(w) - 49) if owner[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        left[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(left[i].encode()).hexdigest())
    cut = substring.remove_repeats(docs)
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    touched = {i for i in out if out[i]["n_removed"]}
    assert cut.columns == docs.columns and touched and all(got.get(i, "") == left[i] for i in touched)
    assert all(got[i] == t for i, t, *_ in rows if i not in touched)
    assert substring.repeated_words(empty).count() == 0


def test_op7_equals_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = []
    for k in range(12):
        centre = r.standard_normal(8)
        vectors += [(centre + r.standard_normal(8) * s).tolist() for s in np.linspace(0, 0.5, 25)]
    rows = [(5 * i, int(i % 3) if i % 7 else 1, v) for i, v in enumerate(vectors)] + [(9001 + i, 1, vectors[0]) for i in range(5)]
    odd = [(8001, 1, None), (8002, None, vectors[0]), (8003, 1, [0.0] * 8), (8004, 1, [float("nan")] * 8), (8005, 1, [1.0, None]), (8006, 1, []), (8007, 1, vectors[0][:4]), (8008, 1, [float("inf")] + [1.0] * 7)]
    out = {x["vec_id"]: x for x in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and unit[a[0]] @ unit[b[0]] >= 0.93]
    n, want = Counter(x for p in links for x in p), reachable(links, [x[0] for x in rows + odd])
    assert {i: (x["n_links"], x["component_id"]) for i, x in out.items()} == {i: (n[i], c) for i, c in want.items()}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
    named = [(i, f"kind {label}", v) for i, label, v in rows[:60]]  # labels may be text
    got = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(spark.createDataFrame(named, "vec_id long, label string, embedding array<double>")).collect()}
    own = {i for i, *_ in named}
    assert got == {i: sum(i in p and set(p) <= own for p in links) for i in own}


def test_op8_equals_brute_force(docs, rows, empty):
    pieces = tokencount.load_pieces(tokencount.vocabulary_path())

    def naive(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            options = [(best[e - 1][0] + n * tokencount.BYTE_SCORE, best[e - 1][1] - n)]
            options += [(best[s][0] + pieces[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in pieces]
            best.append(max(options))
        return -best[-1][1]

    known = {w: naive("▁" + w) for _, t, *_ in rows for w in set(words(t))}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.count_tokens(docs).collect()}
    assert got == {i: (len(words(t)), sum(known[w] for w in words(t))) for i, t, *_ in rows}
    assert tokencount.count_tokens(empty).count() == 0
    whole = tokencount.ForwardTrie(pieces)
    longs = ["▁" + "".join(R.choices("abtheing漢é", k=n)) for n in (1, 30, 511, 3000)]
    assert [whole.long(w) for w in longs] == [whole.insert(w) for w in longs]
    trie = tokencount.ForwardTrie(pieces, most_nodes=5)
    assert [trie.insert("▁" + w) for w in list(known)[:20]] == list(known.values())[:20]


def test_op9_base_and_labels(docs, rows, empty):
    surveyed, spans = licenses.scan(docs)
    found = {}
    for r in spans.collect():
        found.setdefault(r["doc_id"], []).append(r)
    lower = {i: i + 32 for i in range(65, 91)}
    n_words = {r["doc_id"]: r["n_words"] for r in surveyed.collect()}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        want = sorted((s, t.label) for t in licenses.TEMPLATES if t.base for s in range(len(w)) if w[s : s + len(t.text.split())] == t.text.split())
        assert n_words[i] == len(w) and sorted((r["start"], r["label"]) for r in found.get(i, []) if r["base"]) == want
    assert licenses.scan(empty)[0].count() == 0


def test_op9_changed_notices(spark):
    gpl = "This work is licensed under the brave new GNU General Public License, version 3."
    texts = [gpl, "Redistribution and use in source or binary forms, with or without any modification, are permitted provided that following conditions are met", "the gnu general idea", "All rights reserved."]
    _, spans = licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["label"]) for r in spans.collect()) == [(0, "gpl-3"), (1, "bsd"), (3, "all-rights-reserved")]


def test_op9_repeated_and_widely_changed_notices(spark):
    text = {t.label: t.text for t in licenses.TEMPLATES if not t.base}
    cc0, isc, half = text["cc0"].split(), text["isc"].split(), len(text["cc0"].split()) // 2
    wide = " ".join([*cc0[:half], "one", "two", "three", "four", "five", *cc0[half:]])
    texts = [
        "All rights reserved. All rights reserved.",
        "\n".join(f"All rights reserved {k % 3 * 'x'}" for k in range(300)),
        wide,
        f"{wide} {wide} and {' '.join(isc)}. {' '.join(isc)}",
        " ".join([*isc[:8], "the", "to", *isc]),  # a torn copy before a whole one
        " ".join([*cc0, *["other"] * 6, *cc0[-4:]]),  # and a stray tail after one
        " ".join([*cc0[:half], *["more"] * 16, *cc0[half:]]),  # too much between
    ]
    _, spans = licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    got = {k: [] for k in range(len(texts))}
    for r in spans.collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["label"], round(r["score"], 3)))
    n, m = len(cc0), len(isc)
    assert sorted(got[0]) == [(0, 3, "all-rights-reserved", 1.0), (3, 6, "all-rights-reserved", 1.0)]
    assert len(got[1]) == 300
    like = round(2 * n / (2 * n + 5), 3)
    assert got[2] == [(0, n + 5, "cc0", like)]
    assert sorted(got[3]) == [(0, n + 5, "cc0", like), (n + 5, 2 * n + 10, "cc0", like), (2 * n + 11, 2 * n + 11 + m, "isc", 1.0), (2 * n + 11 + m, 2 * n + 11 + 2 * m, "isc", 1.0)]
    assert got[4] == [(10, 10 + m, "isc", 1.0)] and got[5] == [(0, n, "cc0", 1.0)] and got[6] == []


def test_op10_base_scores_and_rest(docs, rows, empty):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*words(t, True), None] for i, t, *_ in rows}
    c = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    out = {r["doc_id"]: r for r in recurrent.score_documents(docs, share=1.0).collect()}
    for i, x in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in x))
        assert r["score"] < 0
    assert recurrent.score_documents(empty).count() == 0


def test_op10_gradients_scores_and_learning():
    r = np.random.default_rng(0)
    net = recurrent.Network(np.sort(r.integers(1, 500, 40))[::-1].astype(float), classes=6, hidden=5, embedded=4)
    net.w = {k: x + r.standard_normal(x.shape) * 0.3 for k, x in net.w.items()}
    x, y = r.integers(0, 40, (5, 3)), r.integers(0, 40, (5, 3))

    def loss():
        h, total = np.zeros((3, 5)), 0.0
        for t in range(5):
            h = net.step(net.w["embed"][x[t]] @ net.w["inner"] + net.w["bias"], h)[0]
            total -= net.log_probs(h, y[t]).sum()
        return total

    _, g, _ = net.gradients(x, y, np.zeros((3, 5)))
    for name, w in net.w.items():
        at = tuple(r.integers(0, s) for s in w.shape) if name != "embed" else (x[0, 0], 1)
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert g[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5)
    ids, lengths = r.integers(0, 40, 60), np.array([7, 1, 30, 2, 20])
    got, at = net.score(ids, lengths, lanes=2, steps=8), 0
    for n in lengths:
        h, before = np.zeros((1, 5)), recurrent.END
        for i in range(at, at + n):
            h = net.step(net.w["embed"][[before]] @ net.w["inner"] + net.w["bias"], h)[0]
            assert got[i] == pytest.approx(net.log_probs(h, ids[i : i + 1])[0], abs=1e-4)
            before = ids[i]
        at += n
    assert np.exp([net.log_probs(h, np.array([k]))[0] for k in range(40)]).sum() == pytest.approx(1)
    # held-out text of a regular language is learned well below its word frequencies' entropy
    line = np.tile(np.arange(2, 12, dtype=np.int32), 400)
    windows = np.stack([line[s : s + 97] for s in r.integers(0, 3000, 400)])
    net = recurrent.Network(np.ones(12))
    for _ in range(8):
        last = net.train(windows)
    assert last < 0.7 * np.log(12)


def test_op10_learns_from_short_texts_and_ends():
    r = np.random.default_rng(2)
    # a one-line document, and one whose second step holds two words and the end
    for n in (4, recurrent.STEPS + 3):
        row = np.full((1, 97), -1, np.int32)
        row[0, : n + 1] = [recurrent.END, *r.integers(2, 12, n - 1), recurrent.END]
        net = recurrent.Network(np.ones(12))
        before = net.score(row[0, 1 : n + 1], np.array([n]))
        for _ in range(20):
            net.train(row)
        after = net.score(row[0, 1 : n + 1], np.array([n]))
        assert after[-1] > before[-1] + 0.1 and after.sum() > before.sum()
    # what lies beyond a lane's end changes neither loss nor gradients
    x, y = r.integers(0, 12, (6, 2)), r.integers(0, 12, (6, 2))
    y[4:, 1] = -1
    h = np.zeros((2, net.hidden), np.float32)
    loss, g, _ = net.gradients(x, y, h)
    parts = [net.gradients(x[:, :1], y[:, :1], h[:1]), net.gradients(x[:4, 1:], y[:4, 1:], h[1:])]
    assert loss == pytest.approx(sum(p[0] for p in parts), rel=1e-4)
    assert all(np.allclose(g[k], parts[0][1][k] + parts[1][1][k], atol=1e-4) for k in g)


def test_op10_fits_on_all_training_documents_whole(docs, rows, monkeypatch):
    seen, fit = [], recurrent.fit
    monkeypatch.setattr(recurrent, "fit", lambda documents, *x: (seen.append(documents), fit(documents, *x))[1])
    monkeypatch.setattr(recurrent, "TRAINER_TOKENS", 500)  # several trainers and groups of them
    out = recurrent.score_documents(docs).collect()
    got = sorted(r["n"] for r in seen[0].select("n").collect())  # what the trainers are given
    assert got == sorted(r["n_tokens"] for r in out if not r["held_out"]) and sum(got) == out[0]["train_tokens"]


def test_op10_carries_state_through_a_document():
    r = np.random.default_rng(3)
    ids = [np.append(np.int32(recurrent.END), r.integers(0, 12, n)) for n in (150, 40)]
    got, want = recurrent.Network(np.ones(12)), recurrent.Network(np.ones(12))
    got.train(ids[:1], rate=0.1)
    past, h = {k: np.ones_like(v) for k, v in want.w.items()}, np.zeros((1, want.hidden), np.float32)
    for t in range(0, 150, recurrent.STEPS):
        x, y = (ids[0][t + i : min(t + i + recurrent.STEPS, 150 + i)][:, None] for i in (0, 1))
        _, g, h = want.gradients(x, y, h)
        for k, v in g.items():
            past[k] += v * v
            want.w[k] -= (0.1 * v / np.sqrt(past[k])).astype(np.float32)
    assert all(np.allclose(got.w[k], want.w[k], atol=1e-5) for k in want.w)
    # two documents in a lane: neither state nor gradient crosses from one to the next
    x, y = (np.concatenate([d[i : len(d) - 1 + i] for d in ids])[:, None] for i in (0, 1))
    new = np.zeros(x.shape, bool)
    new[[0, 150]] = True
    zero = np.zeros((1, want.hidden), np.float32)
    loss, g, _ = want.gradients(x, y, zero, new)
    parts = [want.gradients(d[:-1, None], d[1:, None], zero) for d in ids]
    assert loss == pytest.approx(sum(p[0] for p in parts), rel=1e-4)
    assert all(np.allclose(g[k], parts[0][1][k] + parts[1][1][k], atol=1e-3) for k in g)


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    n = [now.count()]
    for name, stage in pipeline.STAGES:
        after = store.write(stage(spark, now, ""), "stage")
        if name != "packing":
            assert after.columns == now.columns
        now = after
        n.append(now.count())
    assert n[0] > n[1] > n[2] >= n[3] and n[4] > 0 and n[5] > 0
    none = docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def saved(df, tmp_path, table):
    df.write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_op1_query_equals_brute_force(spark, tmp_path):
    sizes = {1: 12, 2: 1, 3: 150, 4: 3}
    turns = [(c, t, "system" if t == 0 and c == 1 else R.choice(["user", "assistant"]), R.choice([None, "", "a\\b <x> ###", prose(R.randrange(200))])) for c, n in sizes.items() for t in range(n)]
    turns += [(4, 2, "assistant", "again")] * 2 + [(4, 3, "assistant", prose(20_000)), (None, 0, "user", "no id")]
    table = spark.createDataFrame([(*t, 0, "x") for t in turns], "conv_id long, turn long, role string, text string, window long, formatted string")
    out = {r["conv_id"]: r for r in chat.op1_chat_format(spark, saved(table, tmp_path, "conversations")).collect()}
    control = r"\### Assistant: </turn> ok"
    turns += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    assert set(out) == {t[0] for t in turns}
    for conv, r in out.items():
        own = sorted((t[1], t[2], t[3] or "") for t in turns if t[0] == conv)
        loss = "".join(text for _, role, text in own if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        want = len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want and r["formatted_chars"] >= len(whole)


def test_op9_query_equals_brute_force(spark, rows, docs, tmp_path):
    texts = [(i, t) for i, t, *_ in rows] + [(None, "cc by nc")] * 2 + [(90001, "Under the MIT License. all rights reserved")] * 2 + [(90002, "x " * 50_000 + "cc-by-nc cc by nc")]
    table = spark.createDataFrame([(*x, 1, "l") for x in texts], "doc_id long, text string, n_base long, key string")
    out = licenses.op9_license_scan(spark, saved(table, tmp_path, "documents")).collect()
    lower, phrases = {i: i + 32 for i in range(65, 91)}, [(t.text.split(), t.label) for t in licenses.TEMPLATES if t.base]
    want = []
    for i, text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = sorted((s, label) for p, label in phrases for s in range(len(w)) if w[s : s + len(p)] == p)
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == Counter(want)
    for r in out:
        base, labels = ([x for x in r[c].split(",") if x] for c in ("base_labels", "labels"))
        assert labels == sorted(set(labels)) and set(base) <= set(labels)
        assert r["score"] == 1 if base else r["score"] == 0 if not labels else 0.8 <= r["score"] <= 1
    assert [r["labels"] for r in out if r["doc_id"] == 90001] == ["all-rights-reserved,mit"] * 2


def test_null_ids_repeated_rows_and_long_texts(spark):
    passage, long = prose(60), prose(30_000)
    texts = [(None, passage), (None, passage), (5, passage), (5, passage), (7, passage), (8, long), (9, None), (10, "y" * 300_000)]
    docs = spark.createDataFrame([(*x, "en", "s", 0, "r", 1) for x in texts], DOCS)
    removed = Counter((r["doc_id"], r["n_removed"]) for r in substring.repeated_words(docs).collect())
    assert removed == {(None, 0): 2, (5, 0): 2, (7, 60): 1, (8, 0): 1, (9, 0): 1, (10, 0): 1}
    for out in (recurrent.score_documents(docs), quality.score_documents(docs), tokencount.count_tokens(docs)):
        got = Counter(tuple(r) for r in out.collect())
        assert sum(got.values()) == len(texts) and {n for r, n in got.items() if r[0] in (None, 5)} == {2}
    assert {r["held_out"] for r in recurrent.score_documents(docs).where("doc_id is null").collect()} == {recurrent.held_out(None)}
    # op4: the long text has all its shingles
    sizes = {r["doc_id"]: r["n_shingles"] for r in minhash.near_duplicates(docs).collect()}
    assert sizes[8] == len(shingle_set(long)) and sizes[9] == 0 and sizes[10] == 1


def test_op7_clashing_columns_and_repeated_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, 0, a), (1, 0, a), (2, 0, a), (None, 0, a), (3, 0, b), (4, 1, a)]
    table = spark.createDataFrame([(*x, 5, 6, "k", 7) for x in rows], "vec_id long, label int, embedding array<double>, n long, rep long, k1 string, block long")
    out = embeddings.near_duplicates(table).collect()
    assert Counter(tuple(r[c] for c in ("vec_id", "n_links", "component_id")) for r in out) == {(1, 2, 1): 2, (2, 2, 1): 1, (None, 0, None): 1, (3, 0, 3): 1, (4, 0, 4): 1}


def test_pipeline_run_equals_brute_force(spark, docs, rows, tmp_path):
    """run() against the stages one by one in plain Python; the verdicts of the quality rules, a fitted model, are op2's."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    where = saved(docs.select("doc_id", "text", "lang", "source", "n_chars"), tmp_path, "documents")
    kept = {r["doc_id"] for r in quality.score_documents(docs).where("kept").collect()}
    texts = {i: t for i, t, *_ in rows if i in kept}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = reachable([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    texts = {i: t for i, t in texts.items() if label[i] == i}
    owner, left = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        for s in range(len(w) - 49):
            owner.setdefault(tuple(w[s : s + 50]), i)
        gone = {p for s in range(len(w) - 49) if owner[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        if len(gone) < len(w):
            left[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[i]
    source = {i: s for i, _, _, s, *_ in rows if i in left}
    size = {i: len(words(t)) for i, t in left.items()}
    by_source = Counter()
    for i, n in size.items():
        by_source[source[i]] += n
    wanted, copies = mixing.targets(by_source, sum(size.values())), {}
    for s, n in by_source.items():
        whole = min(2, int(wanted[s] // n))
        rest, before = wanted[s] - n * whole, 0
        for i in sorted((i for i in left if source[i] == s), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
            copies[i] = min(2, whole + (2 * before + size[i] <= 2 * rest))
            before += size[i]
    tokenizer = Tokenizer.from_file(JSON)
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    out = pipeline.run(spark, where).collect()
    assert Counter(r["doc_id"] for r in out if r["start"] == 0) == {i: n for i, n in copies.items() if n}
    assert all(r["doc_tokens"] == length[r["doc_id"]] for r in out)
    tokens = Counter()
    for r in out:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: n * length[i] for i, n in copies.items() if n}
    assert len(left) < len(kept) < len(rows)
