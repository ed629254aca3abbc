"""Answers are asked once, and runs that fail half-way leave nothing that counts."""

import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.operators import enrichment, evaluation
from quillspark.operators.answers import AnswerStore
from quillspark.plans import catalogue

GOOD = json.dumps({"title": "t", "summary": "s", "key_concepts": [], "important_features_or_tools": [], "practical_workflow": [], "common_mistakes_or_confusions": [], "project_usage_notes": ["n"]})


def counting(folder, answer, fails=lambda text: False):
    """A model that leaves a file for each call."""
    os.makedirs(folder, exist_ok=True)

    @F.pandas_udf("text string, error string, input_tokens int, output_tokens int")
    def asked(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for prompt in prompts:
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(prompt)
            rows.append((None, "timeout", 1, 0) if fails(prompt) else (answer, None, 1, 2))
        return pd.DataFrame(rows, columns=["text", "error", "input_tokens", "output_tokens"])

    return asked, lambda: sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


@pytest.fixture
def tasks(spark):
    return spark.createDataFrame([(f"t{i}", f"prompt {i}", f"source {i}") for i in range(12)], "task_id string, prompt string, source_content string")


def test_metrics_file_and_rerun_ask_each_task_once(spark, tasks, tmp_path):
    model, asked = counting(f"{tmp_path}/model", GOOD)
    judge, judged = counting(f"{tmp_path}/judge", '{"groundedness":4,"completeness":3,"schema_quality":5}')
    for _ in range(2):
        store = AnswerStore(spark, f"{tmp_path}/store")
        rows = evaluation.judge(evaluation.evaluate(tasks, model, model="m", store=store), judge, judge_name="j", store=store)
        assert evaluation.metrics(rows).first()["judged_tasks"] == 12
        rows.write.mode("overwrite").json(f"{tmp_path}/file")
        assert rows.filter("groundedness = 4").count() == 12
    assert asked() == sorted(f"source {i}" for i in range(12)) and len(judged()) == 12
    evaluation.evaluate(tasks, model, model="other", store=store).count()
    assert len(asked()) == 24


def test_failed_requests_are_asked_again_by_the_next_run(spark, tasks, tmp_path):
    model, asked = counting(f"{tmp_path}/a", GOOD, lambda p: p == "prompt 3")
    store = AnswerStore(spark, f"{tmp_path}/store")
    got = store.ask(tasks, "m", F.col("prompt"), model).select("task_id", "answer.error", "answer.text").collect()
    assert [r["task_id"] for r in got if r["error"]] == ["t3"] and sum(r["text"] == GOOD for r in got) == 11
    better, again = counting(f"{tmp_path}/b", GOOD)
    got = store.ask(tasks, "m", F.col("prompt"), better).filter("answer.text is not null")
    assert got.count() == 12 and again() == ["prompt 3"] and len(asked()) == 12


def test_one_answer_for_rows_of_one_task_and_prompt(spark, tasks, tmp_path):
    model, asked = counting(f"{tmp_path}/a", GOOD)
    got = AnswerStore(spark).ask(tasks.unionByName(tasks).withColumn("answer", F.lit("clash")), "m", F.col("prompt"), model)
    assert got.count() == 24 and len(asked()) == 12 and got.filter(F.col("answer.text") == GOOD).count() == 24


def test_a_run_that_fails_between_its_tables_loses_and_repeats_nothing(spark, tasks, tmp_path, monkeypatch):
    path, none = f"{tmp_path}/out", spark.createDataFrame([], "task_id string")
    model, asked = counting(f"{tmp_path}/m", GOOD, lambda p: "prompt 5" in p)
    store = AnswerStore(spark, f"{tmp_path}/store")
    before = lambda name: storage.committed(spark, path, name, "task_id string")
    write = storage.Run.write

    def broken(self, table, df):
        if table == "rejects":
            raise OSError("the disk is full")
        write(self, table, df)

    monkeypatch.setattr(storage.Run, "write", broken)
    with pytest.raises(OSError):
        enrichment.run(tasks, none, none, model, path, most_rejects=0.5, store=store)
    assert before("notes").count() == before("rejects").count() == 0
    monkeypatch.setattr(storage.Run, "write", write)
    paid = len(asked())
    enrichment.run(tasks, before("notes"), before("rejects"), model, path, most_rejects=0.5, store=store)
    assert before("notes").count() == before("notes").distinct().count() == 11
    assert [r["task_id"] for r in before("rejects").collect()] == ["t5"]
    assert len(asked()) == paid + 2  # only what failed, in both rounds, is asked again
    assert sum(r.n for r in storage.committed(spark, path, "counts", "asked long, rejected long").selectExpr("asked + rejected as n").collect()) == 13


def test_a_committed_run_stays_as_it_is(spark, tmp_path):
    run = storage.Run(spark, str(tmp_path), "one")
    run.write("t", spark.range(3))
    assert not run.done and storage.committed(spark, str(tmp_path), "t", "id long").count() == 0
    run.commit()
    assert run.done and storage.committed(spark, str(tmp_path), "t", "id long").count() == 3
    with pytest.raises(Exception, match="exist"):
        storage.Run(spark, str(tmp_path), "one").commit()


@pytest.mark.parametrize("rejects, fails", [(5, False), (6, True)])
def test_the_breaker_opens_above_its_share(spark, tmp_path, rejects, fails):
    """5 % of 100 tasks are allowed, one more isn't."""
    every = spark.range(100).select(F.format_string("t%03d", "id").alias("task_id"), F.format_string("prompt %03d", "id").alias("prompt"))
    model = lambda prompt: F.struct(F.when(F.col("task_id") < f"t{rejects:03d}", "no").otherwise(GOOD).alias("text"))
    none = spark.createDataFrame([], "task_id string")
    if fails:
        with pytest.raises(enrichment.TooManyRejects):
            enrichment.run(every, none, none, model, str(tmp_path))
    else:
        assert enrichment.run(every, none, none, model, str(tmp_path)).first()["rejected"] == 5
    assert storage.committed(spark, str(tmp_path), "rejects", "task_id string").count() == rejects


@pytest.mark.parametrize("name, most", [("judged_rows", 0), ("eval_rows", 0), ("enrich_rounds", 0), ("note_errors", 1), ("json_extract", 1)])
def test_models_and_parsers_stand_once_in_a_plan(spark, name, most):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= most


def test_a_client_waits_longer_each_time_and_gives_up():
    from quillspark.operators.clients import Reply, Unavailable, persistent

    waits, calls = [], []

    def send(prompt):
        calls.append(prompt)
        if prompt == "bad":
            raise KeyError("no such model")
        if prompt == "busy" or len(calls) < 3:
            raise Unavailable("slow down")
        return Reply(prompt.upper(), 3, 4)

    ask = persistent(send, attempts=4, wait=1.0, most_wait=3.0, sleep=waits.append)
    assert ask("hello") == ("HELLO", None, 3, 4) and len(waits) == 2 and 1 <= waits[0] <= 1.25 and 2 <= waits[1] <= 2.5
    assert ask("bad") == (None, "KeyError: 'no such model'", None, None) and len(waits) == 2
    assert ask("busy")[1].startswith("gave up after 4 attempts: Unavailable") and max(waits) <= 3.75


def test_a_client_is_a_model(spark, tasks):
    from quillspark.operators.clients import Reply, asking

    def send(prompt):
        if prompt.endswith("7"):
            raise ValueError("refused")
        return Reply(prompt[::-1], len(prompt))

    got = AnswerStore(spark).ask(tasks.unionByName(spark.createDataFrame([("t99", None, "")], tasks.schema)), "m", F.col("prompt"), asking(send)).select("task_id", "answer.*").collect()
    by_id = {r["task_id"]: r for r in got}
    assert by_id["t3"]["text"] == "3 tpmorp" and by_id["t3"]["input_tokens"] == 8 and by_id["t3"]["output_tokens"] is None
    assert by_id["t7"]["error"] == "ValueError: refused" and by_id["t99"]["error"] == "no prompt" and len(got) == 13
