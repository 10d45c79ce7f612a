import json

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import scoring
from prosegauge.sources import models, tables
from prosegauge.streaming import scores


def test_json_sources(spark, tmp_path):
    item = {"id": 1, "genre": "g", "audience": "a", "prompt": "p", "budget": 50, "asks": ["x"], "assumed": [], "source": "s"}
    (tmp_path / "items.json").write_text(json.dumps({"version": "1", "prompts": [item, item | {"id": 2}]}))
    assert [r.id for r in tables.read_items(spark, str(tmp_path / "items.json")).collect()] == [1, 2]
    problem = {"id": "q", "genre": "g", "audience": "a", "assumed": ["z"], "checkpoints": [{"spec": "s1", "budget": 1, "asks": []}, {"spec": "s2", "budget": 2, "asks": ["k"]}]}
    (tmp_path / "problems.json").write_text(json.dumps({"problems": [problem]}))
    assert [(r.checkpoint, r.spec) for r in tables.read_problems(spark, str(tmp_path / "problems.json")).collect()] == [(1, "s1"), (2, "s2")]
    (tmp_path / "controls.json").write_text(json.dumps({"cases": [{"name": "n", "expect": "low", "text": "t", "item": {"budget": 5}}]}))
    cases, pairs = tables.read_controls(spark, str(tmp_path / "controls.json"))
    assert cases.count() == 1 and pairs.count() == 0
    (tmp_path / "r1.json").write_text(json.dumps({"summary": {"model": "m", "score": 3.0}}))
    (tmp_path / "r2.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "r3.json").write_text(json.dumps({"summary": {"model": "n", "condition": "brief"}}))
    assert [r.model for r in tables.read_results(spark, str(tmp_path / "r*.json")).collect()] == ["m"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a/b:c", 1)], "label string, x int")
    tables.write_runs(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "label=a_b_c").exists()
    assert tables.markdown([{"a": 1, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 |  |\n"
    assert "&lt;m" in tables.svg_bars([{"model": "<m", "score": 90.0}])


def test_answers(spark):
    def make(model):
        def call(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return "" if prompt == "mute" else f"{model}:{prompt}"

        return call

    models.register("test", make)
    got = models.answers(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "mute")], "id long, prompt string"), "m", "test").orderBy("id").collect()
    assert [(r.response, r.error) for r in got] == [("m:ok", None), (None, "no"), (None, "empty answer")]
    with pytest.raises(ValueError):
        models.answers(spark.range(1), "m", "nowhere")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "We delve into it."), (2, "Plain words here.")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scores.scored_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).select("id", "slop")
    run = stream.writeStream.format("memory").queryName("slop_stream").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(spark.table("slop_stream").collect()) == sorted(scores.scored_stream(rows).select("id", "slop").collect())


def test_saved_runs_round_trip_and_rescore(spark, tmp_path):
    runs = [("a/b", 1, "Plain words here.", '{"clarity": "clear", "facts_delivered": [true]}', None), ("a/b", 2, None, None, "empty answer")]
    rows = spark.createDataFrame(runs, "label string, id int, response string, judge string, error string")
    summary = spark.createDataFrame([("a/b", "a/b", 88.8)], "label string, model string, score double")
    tables.write_results(summary, rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "label=a_b").exists()
    back = tables.read_runs(spark, str(tmp_path / "out" / "label=*"))
    assert sorted((r.model, r.id, r.response, r.error) for r in back.collect()) == [("a/b", 1, "Plain words here.", None), ("a/b", 2, None, "empty answer")]
    # a judge's answer may also be saved as an object
    (tmp_path / "r.json").write_text(json.dumps({"summary": {"model": "m"}, "runs": [{"id": 1, "response": "x", "judge": {"clarity": "opaque"}}]}))
    assert json.loads(tables.read_runs(spark, str(tmp_path / "r.json")).first().judge) == {"clarity": "opaque"}
    items = spark.createDataFrame([(1, 100, 1, ["x"], "")], "id int, budget int, required int, assumed array<string>, audience string")
    again = {r.id: r for r in scoring.rescored(back, items).collect()}
    assert again[1].score == 95.6 and again[1].rule4 == 7.0 and again[2].score is None and again[2].error == "empty answer"
    with pytest.raises(Exception, match="no item for saved row 1"):
        scoring.rescored(back, items.where("id = 7")).collect()


def test_versions_appear_whole(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(ValueError):
        tables.latest(spark, root)
    tables.write_version(spark.range(3), root)
    tables.write_version(tables.latest(spark, root).where("id > 0"), root)
    with pytest.raises(Exception):
        tables.write_version(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), root)
    assert tables.versions(spark, root) == [1, 2] and tables.latest(spark, root).count() == 2


def test_reports(spark):
    rows = [{"model": m, "n": n, "score": s, "clarity": 8.0, "slop": 1.0, "n_words": 100.0, "rule2": 5.0} for m, n, s in (("a", 30, 70.0), ("b", 30, 80.0), ("c", 5, 99.0))]
    board = tables.leaderboard(rows)
    assert board.index("Full run (30") < board.index("`b`") < board.index("`a`") < board.index("Smoke sample (5") < board.index("`c`")
    assert board.count(tables.MEDALS[0]) == 1 and tables.MEDALS[2] not in board
    assert [tables.axis_floor(x) for x in ([73.0], [95.0, 99.0], [85.0], [])] == [65.0, 80.0, 80.0, 80.0]
    assert tables.svg_scatter(rows).count("<circle") == 3
    out, err = tables.console_summary({"n": 1}, [{"id": 4, "error": "no"}])
    assert json.loads(out) == {"n": 1} and err == "  prompt 4: no\n"


def test_publish_fails_closed():
    said = []
    tables.publish({"a": lambda: said.append("a")}, lambda: said.append("report"))
    assert said == ["a", "report"]

    def bad():
        raise OSError("no")

    with pytest.raises(RuntimeError, match="b: no"):
        tables.publish({"a": lambda: None, "b": bad}, lambda: said.append("second"))
    assert "second" not in said


def test_rolling_slop(spark, tmp_path):
    rows = spark.createDataFrame([("We delve into it.", "2024-01-01 00:01:00"), ("Plain words here.", "2024-01-01 00:02:00"), ("Late.", "2024-01-01 03:00:00")], "text string, at string").select("text", F.to_timestamp("at").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = scores.rolling_slop(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("rolling").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.n, r.slop > 0) for r in spark.table("rolling").collect()] == [(2, True)]
