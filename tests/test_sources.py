"""Readers, writers, steps that are not done twice, streams and the whole course."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import pipeline
from tessera.sources import files
from tessera.streaming import metrics


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('text,label1\n"He said ""hi"",\nthen left",positive\n,negative\nplain,\n')
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [('He said "hi",\nthen left', "positive"), (None, "negative"), ("plain", None)]
    assert [r[0] for r in files.read_texts(spark, str(path)).collect()] == ['He said "hi",\nthen left', "", "plain"]


def test_generated_csv(spark, tmp_path):
    plain, quoted = tmp_path / "p.csv", tmp_path / "q.csv"
    plain.write_text('text,label\nhe said \\, "yes",a\nb,c\n')
    quoted.write_text('text,label\n"one, two",a\n')
    assert [tuple(r) for r in files.read_generated_csv(spark, str(plain)).collect()] == [('he said , "yes"', "a"), ("b", "c")]
    assert [tuple(r) for r in files.read_generated_csv(spark, str(quoted)).collect()] == [("one, two", "a")]


@pytest.mark.parametrize(
    ("name", "body", "want"),
    [
        ("a.jsonl", '{"text": "x"}\n{"text": null}\n', ["x", ""]),
        ("b.json", '[{"text": "x",\n "n": 1},\n {"text": "y", "n": 2}]', ["x", "y"]),
        ("c.json", json.dumps({"text": ["x", "y"]}), ["x", "y"]),
        ("d.txt", "x\n\ny\n", ["x", "", "y"]),
        ("e.csv", "body,n\nx,1\n", ["x"]),
    ],
)
def test_texts(spark, tmp_path, name, body, want):
    (tmp_path / name).write_text(body)
    assert [r[0] for r in files.read_texts(spark, str(tmp_path / name)).collect()] == want


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="none of"):
        files.read_texts(spark, "a.xml")


def test_samples(spark, tmp_path):
    rows = spark.createDataFrame([(" a \n b ", "x\ty"), ("", "x\ty"), (None, "x\ty"), ("say \"c\"", "p\tq")], "text string, label string")
    files.write_samples(rows, str(tmp_path / "s"))
    back = files.read_csv(spark, str(tmp_path / "s"))
    assert back.columns == ["text", "label1", "label2"] and {tuple(r) for r in back.collect()} == {("a b", "x", "y"), ('say "c"', "p", "q")}
    assert files.sample_rows(rows.withColumn("label", F.lit("one"))).columns == ["text", "label"]
    assert files.sample_rows(rows.withColumn("label", F.lit(None).cast("string"))).columns == ["text"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "run int, fid double")
    for _ in range(2):
        files.append_metrics(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    files.write_jsonl(df, str(tmp_path / "j"), number="run")
    assert sorted(r["number"] for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]
    files.write_embeddings(df, str(tmp_path / "e"))
    assert files.read_embeddings(spark, str(tmp_path / "e")).count() == 2
    (tmp_path / "w.txt").write_text("nurse\n\n patient \n")
    assert [r["value"] for r in files.read_lines(spark, str(tmp_path / "w.txt")).collect()] == ["nurse", "patient"]


def test_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.once(spark, str(tmp_path / "0"), make).count() == 3
    assert len(calls) == 1 and files.last_step(spark, str(tmp_path), 4) == 0 and files.last_step(spark, str(tmp_path / "no"), 4) is None


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "positive", "mail a@b.org"), ("2024-01-01 00:02:00", "positive", " "), ("2024-01-01 05:00:00", "negative", "x y")], "ts string, label1 string, text string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, label1 string, text string").json(str(tmp_path / "in"))
    query = metrics.write_stream(metrics.redacted_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"mail [EMAIL]", "x y"}
    query = metrics.write_stream(metrics.class_counts(stream), str(tmp_path / "n"), str(tmp_path / "d"))
    query.awaitTermination(120)
    done = [tuple(r) for r in spark.read.parquet(str(tmp_path / "n")).select("label1", "n", "n_words").collect()]
    assert done == [("positive", 2, 2)]


def test_whole_course(spark, tmp_path):
    private = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 31}" for k in range(1, 15)), "positive" if i % 3 else "negative") for i in range(60)], "doc_id long, text string, label1 string")
    settings = pipeline.Settings([30, 30], metric_size=40)
    rows = pipeline.run(private, str(tmp_path), settings).collect()
    assert [r["run"] for r in rows] == ["0", "avg"] and all(0 <= r["mauve"] <= 1 and r["fid"] >= 0 for r in rows)
    made = spark.read.parquet(str(tmp_path / "1"))
    assert made.count() == 60 and spark.read.parquet(str(tmp_path / "filtered")).count() >= 54


def test_schedule():
    assert pipeline.schedule("5", 1) == [5, 5] and pipeline.schedule("1,2.5", 1) == [1, 2.5]
    with pytest.raises(ValueError, match="numbers are needed"):
        pipeline.schedule("1,2", 4)


def test_lines_are_numbered_without_gaps(spark, tmp_path):
    (tmp_path / "w.txt").write_text("".join(f" role {i}\n\n" for i in range(49)))
    assert sorted((r["number"], r["value"]) for r in files.read_lines(spark, str(tmp_path / "w.txt")).collect()) == [(i, f"role {i}") for i in range(49)]


def test_summary_takes_rows_of_other_columns(spark, tmp_path):
    path = str(tmp_path / "summary")
    files.append_summary(spark.createDataFrame([(0, 5)], "round int, hits int"), path)
    files.append_summary(spark.createDataFrame([(1, "x")], "round int, note string"), path)
    got = files.read_csv(spark, path).collect()
    assert sorted((r["round"], r["hits"], r["note"]) for r in got) == [("0", "5", None), ("1", None, "x")]


def test_word_counts_and_histograms_are_written(spark, tmp_path):
    files.write_word_counts(spark.createDataFrame([(10, 12), (20, 16)], "target long, made long"), str(tmp_path / "words"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "words")).collect()) == [("10", "12", "2"), ("20", "16", "-4")]
    assert [tuple(map(float, r)) for r in files.read_csv(spark, str(tmp_path / "words.summary")).collect()] == [(3.0, 1.0, -1.0, 3.0)]
    files.write_counts(spark.createDataFrame([(1, 3), (0, 4)], "slot int, votes long"), str(tmp_path / "votes"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "votes")).collect()] == [("0", "4"), ("1", "3")]


def test_switches():
    import argparse

    from tessera.__main__ import str2bool

    assert [str2bool(x) for x in ("Yes", "t", "1", True, "no", "F", "0")] == [True] * 4 + [False] * 3
    with pytest.raises(argparse.ArgumentTypeError):
        str2bool("maybe")
