"""Services outside of Spark: how often they are called, what their failures become, and what is done again on a second run."""

import sys
from collections import Counter

from pyspark import cloudpickle

from pyspark.sql import functions as F

from quillspark.operators import generation as G
from quillspark.operators import repair as R
from quillspark.operators import safety as S
from quillspark.sources import tables as T
from quillspark.streaming import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counted:
    """A service that leaves a line in a file for each call, so that calls in other processes count too."""

    def __init__(self, path, answer):
        self.path, self.answer = str(path), answer

    def __call__(self, *args):
        asked = args[1] if len(args) == 3 else args[0]
        with open(self.path, "a") as f:
            f.write(f"{asked!r}\n")
        return self.answer(asked)

    def calls(self):
        try:
            with open(self.path) as f:
                return Counter(line.rstrip("\n") for line in f)
        except FileNotFoundError:
            return Counter()


def failing(message):
    def call(*_):
        raise RuntimeError(message)

    return call


def test_chain_of_providers():
    waits = []
    ask = lambda *chain: G.ask([*chain], "s", "p", 0.3, waits.append)
    say = lambda text: lambda *_: text
    assert ask() == (None, None, "no provider is configured", 0)
    assert ask(G.Provider("a", say("x")), G.Provider("b", failing("never"))) == ("x", "a", None, 1)
    assert ask(G.Provider("a", say(None)), G.Provider("b", say("")), G.Provider("c", say("y"))) == ("y", "c", None, 3)
    assert ask(G.Provider("a", failing("boom")), G.Provider("b", failing("HTTP 429"))) == (None, None, "a: boom; b: rate limit", 2)
    assert ask(G.Provider("a", failing("boom"), last=True), G.Provider("b", say("y"))) == (None, None, "a: boom", 1)
    assert ask(G.Provider("a", failing("quota"), last=True), G.Provider("b", say("y"))).response == "y" and waits == []
    assert ask(G.Provider("a", failing("429 retryDelay: '7s'"), attempts=2), G.Provider("b", say("y"))) == ("y", "b", None, 3) and waits == [7]
    assert ask(G.Provider("a", failing("429 Retry-After: 21"), attempts=2), G.Provider("b", say("y"))) == ("y", "b", None, 2) and waits == [7]
    turns = iter([RuntimeError("rate limit; retry_delay { seconds: 3 }"), "z"])

    def second_time(*_):
        got = next(turns)
        if isinstance(got, Exception):
            raise got
        return got

    assert ask(G.Provider("a", second_time, attempts=2)) == ("z", "a", None, 2) and waits == [7, 3]


def test_each_question_is_asked_once(spark, tmp_path):
    service, cache = Counted(tmp_path / "calls", lambda p: None if p == "silent" else p.upper()), f"file://{tmp_path}/cache"
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "silent"), (7, 'q"\\\n')] + [(k, "a") for k in range(8, 40)]
    requests = spark.createDataFrame([(*r, "mine") for r in rows], "id long, q string, response string").drop("response").repartition(7)
    run = lambda d, batch: {r["id"]: (r["cached"], r["response"], r["provider"], r["error"]) for r in G.answered(d, cache, [G.Provider("up", service)], F.lit("s"), F.col("q"), batch, tasks=3).collect()}
    first = run(requests.where("id <= 3"), "1")
    assert first == {1: (False, "A", "up", None), 2: (False, "B", "up", None), 3: (False, "A", "up", None)} and sum(service.calls().values()) == 2
    second = run(requests, "2")
    assert second[8] == (True, "A", "up", None) and second[7] == (False, 'Q"\\\n', "up", None) and second[6] == (False, None, None, "up: no text") and len(second) == len(rows)
    assert second[4][3] == second[5][3] == "up: no text"
    asked = service.calls()
    assert set(asked.values()) == {1} and len(asked) == 5
    # a job that runs again under the same name reads what it has; a later one asks only what got no answer
    assert run(requests, "2") == second and service.calls() == asked
    run(requests, "3")
    assert service.calls() - asked == Counter({"'silent'": 1, "''": 1})
    other = G.answered(requests, cache, [G.Provider("up", service)], F.lit("s"), F.col("q"), "4", temperature=0.5).where("cached").count()
    assert other == 0


def test_no_requests_and_no_cache(spark, tmp_path):
    none = spark.createDataFrame([], "id long, q string")
    out = G.answered(none, f"file://{tmp_path}/c", [], F.lit("s"), F.col("q"), "1")
    assert out.count() == 0 and {"cached", "response", "provider", "error", "n_calls"} <= set(out.columns)
    assert G.read_cache(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_unfinished_batches_do_not_count(spark, tmp_path):
    rows = spark.createDataFrame([("k", "r", "p", None, 1)], G.ANSWERS)
    rows.write.parquet(f"file://{tmp_path}/cache/1")
    (tmp_path / "cache/1/_SUCCESS").unlink()
    assert G.read_cache(spark, f"file://{tmp_path}/cache").count() == 0
    assert T.written_once(rows, f"file://{tmp_path}/cache/1").count() == 1 and G.read_cache(spark, f"file://{tmp_path}/cache").count() == 1


def test_vectors_follow_the_corpus(spark, tmp_path):
    service, path, waits = Counted(tmp_path / "calls", lambda texts: [[float(len(t))] for t in texts]), f"file://{tmp_path}/vectors", Counted(tmp_path / "waits", lambda s: None)
    corpus = lambda **texts: spark.createDataFrame([*texts.items()], "id string, t string")
    run = lambda d, version, call=service: {r["key"]: (r["change"], r["error"]) for r in G.refresh_vectors(d, path, "id", "t", call, version, size=2, tasks=1, waits=(40, 80), wait=waits).collect()}
    have = lambda: {r["key"]: (r["vector"], r["version"]) for r in G.read_vectors(spark, path).collect()}
    assert run(corpus(a="x", b="yy", c="x", d=None), 1) == {k: ("added", None) for k in "abcd"}
    assert have() == {"a": ([1.0], 1), "b": ([2.0], 1), "c": ([1.0], 1), "d": ([0.0], 1)}
    assert sum(len(eval(k)) for k in service.calls()) == 3  # distinct texts
    before = service.calls()
    assert run(corpus(a="x", b="zzz", d=None, e="x"), 2) == {"b": ("changed", None), "c": ("gone", None), "e": ("added", None)}
    assert have() == {"a": ([1.0], 1), "b": ([3.0], 2), "d": ([0.0], 1), "e": ([1.0], 2)}
    assert sorted(t for k in service.calls() - before for t in eval(k)) == ["x", "zzz"]
    before = service.calls()
    assert run(corpus(a="x"), 2) == {"b": ("changed", None), "c": ("gone", None), "e": ("added", None)} and service.calls() == before  # version 2 is there
    assert run(corpus(a="x", b="zzz", d="", e="x"), 3) == {} and service.calls() == before
    # what fails is asked again next time
    assert run(corpus(a="x", b="new", d="", e="x"), 4, failing("429")) == {"b": ("changed", "429")} and waits.calls() == {"40": 1, "80": 1} and "b" not in have()
    assert run(corpus(a="x", b="new", d="", e="x"), 5) == {"b": ("added", None)} and have()["b"] == ([3.0], 5)
    assert run(corpus(a="y", b="new", d="", e="x"), 6, lambda texts: []) == {"a": ("changed", "0 vectors for 1 texts")}


LETTERS = [
    (1, "Dear [Insert Name], as [1] says."), (2, "All fine, as [1] says."), (3, "No citation here."), (4, "As [7] says."), (5, "As [8] says."), (6, None), (7, "[Insert Date] refuse"),
]


def test_repair_loop(spark, tmp_path):
    def answer(prompt):
        if "refuse" in prompt:
            raise RuntimeError("no")
        draft = prompt.split("== ORIGINAL LETTER ==\n")[1].split("\n\n== CLINICAL NOTES ==")[0]
        assert '"verdict":"FAIL"' in prompt and "== GUIDELINE CONTEXT ==\npolicy one\n\n---\n\npolicy two" in prompt and "== CLINICAL NOTES ==\nnotes" in prompt
        return draft.replace("[7]", "[2]")

    service = Counted(tmp_path / "calls", answer)
    letters = spark.createDataFrame([(*x, "extra") for x in LETTERS], "id long, letter string, message string")
    kinds = [("policy", "policy two"), ("policy", "policy one"), ("case", "notes")]
    sources = spark.createDataFrame([(i, *k) for i, _ in LETTERS for k in kinds], "id long, kind string, source_text string")
    loop = lambda batch: R.repaired_letters(letters, sources, "id", "letter", [G.Provider("s", service)], f"file://{tmp_path}/cache", batch, "system", "Repair.", "Only the letter.")
    out = {r["id"]: r for r in loop("1").collect()}
    got = {i: (r["verdict"], r["repair_attempted"], r["pre_repair_verdict"], r["status"], r["repair_error"]) for i, r in out.items()}
    assert got == {
        1: ("PASS", True, "FAIL", "completed", None), 2: ("PASS", False, None, "completed", None), 3: ("NEEDS_REVIEW", False, None, "completed", None), 4: ("PASS", True, "FAIL", "completed", None),
        5: ("FAIL", True, "FAIL", "failed", None), 6: ("NEEDS_REVIEW", False, None, "completed", None), 7: ("FAIL", True, "FAIL", "failed", "s: no"),
    }
    assert out[1]["letter"] == "Dear , as [1] says." and out[2]["letter"] == LETTERS[1][1] and out[4]["letter"] == "As [2] says." and out[7]["letter"] == LETTERS[6][1] and out[2]["message"] == "extra"
    assert [i["code"] for i in out[5]["issues"]] == ["INVALID_GUIDELINE_CITATION"] and sum(service.calls().values()) == 4
    # a second run asks only for the draft that got no answer
    loop("2").collect()
    assert sum(service.calls().values()) == 5
    told = {}
    for r in R.progress(loop("3"), "id").orderBy("id", "at").collect():
        told.setdefault(r["id"], []).append((r["event"], r["data"]))
    assert told[2] == [("safety_done", '{"verdict":"PASS"}'), ("save_started", "{}"), ("save_done", '{"status":"completed"}')]
    assert [e for e, _ in told[4]] == ["safety_done", "repair_started", "repair_done", "save_started", "save_done"] and told[4][2][1] == '{"verdict":"PASS"}'
    events = spark.createDataFrame([(i, at, e) for i, steps in told.items() for at, (e, _) in enumerate(steps)], "id long, at long, event string")
    status = {(r["id"], r["stage"]): r["status"] for r in stages.stage_status(events, "id", "event", ["at"]).collect()}
    assert status[4, "safety"] == status[4, "save"] == "done"


def test_messages_of_checks(spark):
    letters = spark.createDataFrame([(1, 'Dear [Your Name], [4] and [PubMed 3] say "pain for 12 weeks"'), (2, "as [1] says")], "id long, letter string")
    sources = spark.createDataFrame([(i, k, "text") for i in (1, 2) for k in ("policy", "article")], "id long, kind string, source_text string")
    _, report = S.check_letters(letters, sources, "id", "letter")
    got = {r["id"]: [(c["check"], c["status"], c["details"]) for c in r["c"]] for r in report.select("id", S.verification_checks().alias("c")).collect()}
    assert got[2] == [(name, "PASS", good) for name, good in S.CHECKS.values()]
    assert got[1] == [
        ("Deterministic Placeholder Check", "FAIL", "Potential unresolved placeholder or unsupported bracketed text: [Your Name]"),
        ("Deterministic Citation Check", "FAIL", "Guideline citation [4] does not map to any retrieved guideline source. PubMed citation [PubMed 3] does not map to any retrieved PubMed source."),
        ("Deterministic Grounding Check", "WARNING", f"{S.MESSAGES['UNGROUNDED_QUOTE']} pain for 12 weeks {S.MESSAGES['UNGROUNDED_NUMERIC_CLAIM']} 12 weeks"),
    ]
    bare = spark.createDataFrame([(3, "no citation")], "id long, letter string")
    report = S.check_letters(bare, sources.withColumn("id", F.lit(3).cast("long")), "id", "letter")[1].first()
    assert report["guideline_citations_valid"] and report["verdict"] == "NEEDS_REVIEW"


