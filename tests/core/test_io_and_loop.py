import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakewright.plans import round_loop
from lakewright.sources import readers, writers
from lakewright.streaming import service


def test_corpus_takes_language_from_the_file(spark, tmp_path):
    for name, text in (("eng", "a"), ("rus", "b")):
        with gzip.open(tmp_path / f"{name}-docs.jsonl.gz", "wt") as f:
            f.write(json.dumps({"id": name, "text": text, "url": "u", "date": "d"}) + "\n")
    names = {"eng": "en", "rus": "ru"}
    got = readers.read_corpus(spark, str(tmp_path), names)
    assert {(r["id"], r["lang"]) for r in got.collect()} == {("eng", "en"), ("rus", "ru")}
    with pytest.raises(PySparkException):
        readers.read_corpus(spark, str(tmp_path), {"eng": "en"}).collect()


def test_topics_lines_or_concatenated(spark, tmp_path):
    a, b = ({"topic_id": str(i), "title": f"t{i}", "limit": 5} for i in (1, 2))
    (tmp_path / "lines").write_text(json.dumps(a) + "\n" + json.dumps(b))
    (tmp_path / "joined").write_text(json.dumps(a) + json.dumps(b))
    for name in ("lines", "joined"):
        assert [r["topic_id"] for r in readers.read_topics(spark, str(tmp_path / name)).orderBy("topic_id").collect()] == ["1", "2"]
    (tmp_path / "bad").write_text(json.dumps({"topic_id": "3"}))
    with pytest.raises(PySparkException):
        readers.read_topics(spark, str(tmp_path / "bad")).collect()


def test_run_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([("t", "b", 2, 0.5), ("t", "a", 1, 2.0**-10)], "topic_id string, doc_id string, rank int, score double")
    writers.write_run(ranked, str(tmp_path / "run"), "tag")
    got = readers.read_run(spark, str(tmp_path / "run"))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("t", "a", 1, 0.000976562, "tag"), ("t", "b", 2, 0.5, "tag")]
    assert readers.single_tag_violations(got).count() == 0
    (tmp_path / "bad").write_text("t Q0 a 1 0.5\n")
    with pytest.raises(PySparkException):
        readers.read_run(spark, str(tmp_path / "bad")).collect()


def test_writers_refuse_what_is_not_finite(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(PySparkException):
        writers.write_parquet(df, str(tmp_path / "p"))
    writers.write_parquet(spark.createDataFrame([(1.0,)], "x double"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_reports_have_sorted_references(spark, tmp_path):
    rows = [("t", 1, "two", [9, 3]), ("t", 0, "one", [5, 3])]
    out = writers.report_rows(spark.createDataFrame(rows, "topic_id string, position int, sentence string, docs array<int>"))
    report = json.loads(out.first()["json"])
    assert [r["text"] for r in report["responses"]] == ["one", "two"] and report["references"] == ["3", "5", "9"]
    (tmp_path / "r").write_text(json.dumps({"topic_id": "t", "responses": [{"text": "x", "citations": {"a": 1.0}}, {"text": "y", "citations": {"a": 1.0, "b": 0.5}}]}))
    got = {r["doc_id"]: r["position"] for r in readers.read_reports(spark, str(tmp_path / "r")).collect()}
    assert got == {"a": 0, "b": 1}


def test_requests_are_answered_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, rendering in enumerate(("original", "original", "other")):
        (inbox / f"{i}.json").write_text(json.dumps({"request_id": f"r{i}", "rendering": rendering, "queries": ["q"], "top_k": 1}))

    def run():
        q = service.answer_requests(
            service.read_requests(spark, str(inbox)),
            lambda df: df.select("request_id", F.size("queries").alias("n")),
            str(tmp_path / "out"),
            str(tmp_path / "state"),
            rendering="original",
        )
        q.awaitTermination()
        return {r["request_id"]: (r["n"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    want = {"r0": (1, None), "r1": (1, None), "r2": (None, "rendering is not original")}
    assert run() == want
    (inbox / "3.json").write_text(json.dumps({"request_id": "r3", "rendering": "original", "queries": [], "top_k": 1}))
    assert run() == want | {"r3": (0, None)}


def test_streamed_windows_and_first_writers(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:01:00", 1.0), (2, "a", "2024-01-01 00:04:00", 2.0), (1, "b", "2024-01-01 01:00:00", 4.0)]
    df = spark.createDataFrame(rows, "user_id int, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))

    def out(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    w = out(service.event_windows(stream, width="10 minutes", slide=None, late="1 minute"), "w", "complete")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in w) == [("a", 2, 3.0), ("b", 1, 4.0)]
    f = out(service.first_writers(stream, "user_id", "ts", "2 hours"), "f", "append")
    assert sorted(r["user_id"] for r in f) == [1, 2]


def test_rounds_end_when_nothing_new_comes(spark):
    seeds = spark.createDataFrame([("t", "q0"), ("t", "q1"), ("t", " ")], "topic_id string, question string")

    def step(asked, number):
        claims = asked.filter("question <> 'q1'").select("topic_id", "nugget_id", F.lit("yes").alias("answer"))
        new = asked.select("topic_id", F.lit(f"more {number}" if number < 2 else "q0").alias("question"))
        return claims, new, asked.filter("false").select("nugget_id")

    bank, records = round_loop.run_rounds(seeds, step, round_loop.LoopOptions(max_rounds=6))
    got = {r["question"]: (r["nugget_id"], r["status"], r["origin_round"]) for r in bank.collect()}
    assert got == {"q0": ("t#n0", "answered", 0), "q1": ("t#n1", "unanswered", 0), "more 1": ("t#n2", "answered", 1)}
    assert sorted(r["round"] for r in records.collect()) == [1, 2]


def test_actions_and_closures(spark):
    df = spark.createDataFrame([(0, 0), (5, 1), (2, 1)], "s int, f int")
    got = [r[0] for r in df.select(round_loop.legal_actions(F.col("s"), F.col("f"))).collect()]
    assert got == [["claim", "answer", "search"], ["claim", "answer", "abstain"], ["claim", "answer", "search", "abstain"]]
    bank = spark.createDataFrame([("t", "a", "unanswered"), ("t", "b", "pruned"), ("t", "c", "unanswered")], "topic_id string, nugget_id string, status string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "nugget_id string")
    out = {r["nugget_id"]: r["status"] for r in round_loop.apply_closures(bank, ids("a", "b"), ids("a", "c")).collect()}
    assert out == {"a": "answered", "b": "pruned", "c": "pruned"}
