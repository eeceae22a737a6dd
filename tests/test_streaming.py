"""Streams against their batch versions, for any order of arrival, any cut and batches that come twice."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quillspark.streaming import stages as G

START = datetime(2024, 1, 1, tzinfo=UTC)
NAMES = ["guidelines_started", "guidelines_done", "sufficiency_started", "sufficiency_done", "pubmed_started", "pubmed_done", "generation_started", "generation_done", "safety_started", "repair_started", "repair_done", "error", "complete", "other"]


def landed(folder, parts):
    """A JSON file for each part, oldest first."""
    folder.mkdir(parents=True, exist_ok=True)
    n = len(list(folder.iterdir()))
    for k, rows in enumerate(parts, n):
        (folder / f"{k:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(folder / f"{k:03}.json", (1_700_000_000 + k,) * 2)


def run(stream, tmp_path, mode, got):
    """One micro-batch for each file; got: receives (batch, row)."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda d, n: got.extend((n, r) for r in d.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


def test_stages_in_any_order_and_any_batches(spark, tmp_path):
    r = random.Random(5)
    events = [{"id": f"k{r.randrange(6)}", "event": r.choice(NAMES), "ts": (START + timedelta(seconds=r.randrange(900))).isoformat(), "n": n} for n in range(160)]
    events += [{"id": "one", "event": "pubmed_done", "ts": (START + timedelta(seconds=5)).isoformat(), "n": 900}, {"id": "one", "event": "pubmed_started", "ts": (START + timedelta(seconds=2)).isoformat(), "n": 901}]
    schema = "id string, event string, ts timestamp, n long"
    batch = G.stage_status(spark.createDataFrame([(e["id"], e["event"], datetime.fromisoformat(e["ts"]), e["n"]) for e in events], schema), "id", "event", ["ts", "n"])
    want = {(x["id"], x["stage"]): x["status"] for x in batch.collect()}
    assert want["one", "pubmed"] == "done" and {"active", "done", "error"} >= set(want.values()) > {"done"}
    for k, n in enumerate((1, 5)):
        if n > 1:
            r.shuffle(events[:-2])
        cut = sorted(r.sample(range(len(events)), n - 1))
        landed(tmp_path / f"in{k}", [events[a:b] for a, b in zip([0, *cut], [*cut, len(events)], strict=True)])
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / f"in{k}"))
        got = []
        run(G.stream_stage_status(source, "id", "event", "ts", "n"), tmp_path / f"q{k}", "update", got)
        assert {(x["key"], x["stage"]): x["status"] for _, x in sorted(got, key=lambda g: g[0])} == want


def test_finished_keys_leave_the_state(spark, tmp_path):
    at = lambda minutes: (START + timedelta(minutes=minutes)).isoformat()
    landed(tmp_path / "in", [
        [{"id": "a", "event": "save_started", "ts": at(0)}, {"id": "a", "event": "complete", "ts": at(1)}, {"id": "b", "event": "pubmed_started", "ts": at(1)}],
        [{"id": "c", "event": "pubmed_started", "ts": at(300)}], [{"id": "c", "event": "pubmed_done", "ts": at(301)}], [{"id": "b", "event": "pubmed_done", "ts": at(302)}],
    ])
    source = spark.readStream.schema("id string, event string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    run(G.stream_stage_status(source, "id", "event", "ts", late="1 minute", keep_finished="10 minutes", keep_idle="20 hours"), tmp_path, "update", got)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "marks").load()
    assert {x["key"]["key"] for x in state.collect()} == {"b", "c"}
    last = {(x["key"], x["stage"]): x["status"] for _, x in got}
    assert last == {("a", "save"): "done", ("b", "pubmed"): "done", ("c", "pubmed"): "done"}


def test_frames_cut_anywhere(spark, tmp_path):
    events = [("guidelines_started", {"n": 1, "text": "Größe 漢字"}), ("pubmed_done", {"n": 2, "text": "a\n\nb"}), ("complete", {"n": 3, "text": "😀"})]
    whole = "".join(f"event: {e}\ndata: {json.dumps(d, ensure_ascii=False)}\n\n" for e, d in events) + ": a comment\n\nevent: cut off\ndata: {"
    data = whole.encode()
    streams = spark.createDataFrame([("s", whole)], "key string, t string")
    want = [(x["at"], x["stage"], tuple(x["data"])) for x in G.sse_events(streams, "key", "t", "n long, text string").orderBy("at").collect()]
    assert [(s, d[0]) for _, s, d in want] == [("guidelines_started", 1), ("pubmed_done", 2), ("complete", 3)]
    r = random.Random(2)
    # a stream for each place where it may be cut in two, and one of single bytes; out of order, some chunks twice
    chunks = [(f"cut{k}", at, part) for k in range(len(data) + 1) for at, part in enumerate((data[:k], data[k:]))]
    chunks += [("bytes", k, data[k : k + 1]) for k in range(len(data))]
    r.shuffle(chunks)
    chunks += chunks[:40]
    parts = [chunks[k::2] for k in range(2)]
    landed(tmp_path / "in", [[{"key": k, "at": at, "chunk": part.hex(), "ts": START.isoformat()} for k, at, part in p] for p in parts])
    source = spark.readStream.schema("key string, at long, chunk string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    run(G.stream_sse_events(source.withColumn("chunk", F.unhex("chunk")), "key", "at", "chunk", "ts", "n long, text string"), tmp_path, "append", got)
    found = {}
    for _, x in got:
        found.setdefault(x["key"], []).append((x["at"], x["stage"], tuple(x["data"])))
    assert set(found) == {k for k, *_ in chunks} and all(sorted(v) == want for v in found.values())
