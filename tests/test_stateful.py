"""Streams with keyed state: rows that come late, twice and out of order give the batch result."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.functions.text import request_key
from quillspark.operators import batches
from quillspark.operators.transcript import merge_runs
from quillspark.streaming import stateful


def run(spark, folder, files, schema, made):
    """All rows that a stream gives for files that arrive one after the other, with a restart before each."""
    (folder / "in").mkdir()
    for k, rows in enumerate(files):
        (folder / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        with stateful.state_store(spark):
            stream = made(spark.readStream.schema(schema).json(str(folder / "in")))
            query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()]


def test_transcripts_merge_as_their_segments_arrive(spark, tmp_path):
    rng = random.Random(2)
    words = "the river turns a water wheel by the old mill and then it falls".split()
    documents = {f"d{i}": [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), k * 5.0 + 30 * (k % 6 == 0), k * 5.0 + 4 + 30 * (k % 6 == 0)) for k in range(rng.randint(1, 25))] for i in range(12)}
    rows = [{"document": d, "seq": k, "text": t, "start": a, "end": b, "at": f"2024-01-01T00:{rng.randint(0, 9):02d}:00Z"} for d, own in documents.items() for k, (t, a, b) in enumerate(own)]
    lost = [r for r in rows if not (r["document"] == "d3" and r["seq"] == 0)]  # one never comes
    rng.shuffle(lost)
    third = len(lost) // 3
    tick = {"document": None, "at": "2024-01-02T00:00:00Z"}
    files = [lost[:third] + lost[:5], lost[third : 2 * third] + lost[:third:3], lost[2 * third :] + lost[::4], [tick], [lost[0] | {"at": "2024-01-02T00:00:01Z"}]]
    schema = "document string, seq long, text string, start double, end double, at timestamp"
    got = run(spark, tmp_path, files, schema, lambda s: stateful.merge_stream(s, most_words=20))
    want = []
    for d, own in documents.items():
        kept = own[1:] if d == "d3" else own
        want += [(d, i, *m) for i, m in enumerate(merge_runs(*zip(*kept, strict=True), most_words=20) if kept else [])]
    assert sorted(got) == sorted(want)


def test_requests_are_answered_once(spark, tmp_path):
    rng = random.Random(3)
    at = lambda s: f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"
    tasks = spark.createDataFrame([(f"t{i:02d}",) for i in range(40)], "task_id string")
    keys = {r["task_id"]: r["k"] for r in tasks.select("task_id", request_key(F.col("task_id")).alias("k")).collect()}
    events, results = [], defaultdict(list)
    for i, (task, key) in enumerate(sorted(keys.items())):
        events.append({"request_key": key, "kind": "submitted", "at": at(i)})
        for n in range((0, 1, 2)[i % 3]):
            when = i + rng.choice([5, 200, 900 + i]) + n
            kind = "errored" if i % 7 == 0 else "succeeded"
            results[task].append((when, kind, f"answer {i}"))
            events.append({"request_key": key, "kind": kind, "text": f"answer {i}", "at": at(when)})
    rng.shuffle(events)
    half = len(events) // 2
    tick = {"request_key": None, "kind": "submitted", "at": at(20000)}
    files = [events[:half], events[half:] + events[::3], [tick]]
    got = run(spark, tmp_path, files, "request_key string, kind string, text string, at timestamp", lambda s: stateful.track_requests(s, 600, "30 minutes"))
    batch = []
    for i, task in enumerate(sorted(keys)):
        when, kind, text = min(results[task], default=(10**9, "expired", None))
        batch.append((keys[task], kind if when <= i + 600 else "expired", text, 1, 1))
    answers = batches.remap(spark.createDataFrame(batch, "request_key string, kind string, text string, input_tokens int, output_tokens int"), tasks)
    want = [(keys[r["task_id"]], r["answer"]["text"], r["answer"]["error"]) for r in answers.collect()]
    assert sorted((((k, t, e) for k, _, t, e in got)), key=str) == sorted(want, key=str)
    assert len({k for k, *_ in got}) == len(got) == 40 and {"expired", "errored", "succeeded"} == {kind for _, kind, *_ in got}
