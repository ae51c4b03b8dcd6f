"""Sinks with names of their own, and narrow scans."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keelson.sources import scans, sinks, writers
from keelson.sources.schema import ANNOTATION, RECORD
from keelson.streaming import ingest


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_a_file_for_each_row(spark, tmp_path):
    out = str(tmp_path / "sidecars")
    rows = spark.createDataFrame([(f"v{i}", i, [("é", None if i % 2 else 0.5)]) for i in range(23)], "video_id string, n int, segments array<struct<label:string,weight:double>>").repartition(4)
    writers.write_sidecars(rows, out)
    assert sorted(os.listdir(out)) == sorted(f"v{i}.json" for i in range(23))
    text = (tmp_path / "sidecars" / "v3.json").read_text()
    assert json.loads(text) == {"video_id": "v3", "n": 3, "segments": [{"label": "é"}]} and "\n" in text
    writers.write_sidecars(rows.where("n = 3").withColumn("n", F.lit(33)), out)  # replaced, the others stay
    assert json.loads((tmp_path / "sidecars" / "v3.json").read_text())["n"] == 33 and len(os.listdir(out)) == 23
    writers.write_sidecars(rows.where("n < 2"), out, mode="overwrite")
    assert sorted(os.listdir(out)) == ["v0.json", "v1.json"]
    assert sorted(r["n"] for r in scans.documents(spark, out, "n int").collect()) == [0, 1]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "sidecars")
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise("x").alias("content"))
    writers.register(spark)
    for broken in (rows, spark.createDataFrame([("a", "1"), ("b/c", "2")], "name string, content string"), spark.createDataFrame([("a", "1"), ("a", "2")], "name string, content string")):
        with pytest.raises(Exception, match="broken|can't be a file's name|more than once"):
            broken.write.format("file_per_row").mode("append").save(out)
        assert files(out) == [] and (not os.path.exists(out) or os.listdir(out) == [])


def test_a_retried_task_writes_once(spark, tmp_path):
    """What the first attempt left behind isn't moved."""
    writer = writers._FilePerRowWriter({"path": str(tmp_path / "out")}, False)
    first, second = (tmp_path / "out" / os.path.basename(writer.staging) / f"0-{attempt}" for attempt in (1, 2))
    for folder, text in ((first, "half"), (second, "whole")):
        folder.mkdir(parents=True)
        (folder / "0").write_text(text)
    writer.commit([writers.Wrote([("a.json", str(second / "0"))]), None])
    assert os.listdir(tmp_path / "out") == ["a.json"] and (tmp_path / "out" / "a.json").read_text() == "whole"


@pytest.mark.parametrize("n,sizes", [(25, [10, 10, 5]), (20, [10, 10]), (3, [3]), (0, [])])
def test_split_names_and_row_bounds(spark, tmp_path, n, sizes):
    out = str(tmp_path / "release")
    rows = spark.range(n).select(F.format_string("v%03d", "id").alias("video_id"), F.array(F.struct(F.col("id").alias("index"))).alias("segments")).repartition(3)
    writers.write_split(rows, out, "train", rows_a_file=10)
    names = files(out)
    assert names == [f"train-{i:05d}-of-{len(sizes):05d}.parquet" for i in range(len(sizes))]
    tables = [pq.read_table(f"{out}/{f}") for f in names]
    assert [t.num_rows for t in tables] == sizes
    assert [v for t in tables for v in t.column("video_id").to_pylist()] == [f"v{i:03d}" for i in range(n)]
    assert all(t.column_names == ["video_id", "segments"] and pq.ParquetFile(f"{out}/{f}").metadata.row_group(0).column(0).compression == "SNAPPY" for t, f in zip(tables, names, strict=True))


def test_narrow_scans(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    for v in ("a__b", "c"):
        for condition in ("full", "uniform", "uniform--shuffled", "motion"):
            (run / f"{v}__{condition}.json").write_text(json.dumps({"video_id": "wrong", "top1_correct": v == "c", "selector_failed": None, "top5_probs": [0.1] * 5, "kept_segments": [[0, 1]]}))
    (run / "c__broken.json").write_text("{")
    (run / "config.json").write_text("{}")
    rows = scans.narrow(spark, str(run), ["top1_correct", "selector_failed"], ["uniform", "full"])
    assert {tuple(r) for r in rows.collect()} == {(v, c, v == "c", None) for v in ("a__b", "c") for c in ("full", "uniform")}
    assert sorted(os.path.basename(f) for f in rows.inputFiles()) == ["a__b__full.json", "a__b__uniform.json", "c__full.json", "c__uniform.json"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<selector_failed:boolean,top1_correct:boolean,_corrupt:string>" in plan and "top5_probs" not in plan
    assert scans.narrow(spark, str(run), ["top1_correct"]).count() == 8  # all conditions, and not the broken one


def test_pruned_schemas():
    assert scans.pruned(RECORD, ["top5_probs", "condition"]) == "condition STRING,top5_probs ARRAY<DOUBLE>"
    nested = scans.pruned(ANNOTATION, ["video_id", "segments.label", "segments.weight", "mss_result.precheck_responses.confidence", "mss_result.precheck_passed"])
    assert nested == "video_id STRING,segments ARRAY<STRUCT<label: STRING, weight: DOUBLE>>,mss_result STRUCT<precheck_passed: BOOLEAN, precheck_responses: ARRAY<STRUCT<confidence: DOUBLE>>>"
    assert "raw_output" in scans.pruned(ANNOTATION, ["mss_result", "mss_result.precheck_passed"])
    for wrong in (["nothing"], ["video_id.x"], ["segments.nothing"]):
        with pytest.raises(ValueError):
            scans.pruned(ANNOTATION, wrong)


def test_nested_narrow_scan(spark, tmp_path):
    (tmp_path / "v__full.json").write_text(json.dumps({"segments": [{"index": 0, "label": "important", "weight": 0.5}], "mss_result": {"precheck_passed": True, "precheck_responses": [{"confidence": 0.9, "raw_output": "long"}]}}))
    rows = scans.narrow(spark, str(tmp_path), ["segments.label", "mss_result.precheck_passed", "mss_result.precheck_responses.confidence"], ["full"], ANNOTATION)
    assert [tuple(r) for r in rows.collect()] == [("v", "full", ["important"], True, [0.9])]
    assert "raw_output" not in rows._jdf.queryExecution().executedPlan().toString()


def test_markdown_of_any_size(spark, tmp_path):
    rows = spark.range(2500).select((2499 - F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, "a|b").alias("name")).repartition(5)
    sinks.write_markdown(rows, str(tmp_path / "report"), ["n"])
    text = "".join((tmp_path / "report" / f).read_text() for f in files(tmp_path / "report") if f.startswith("part-"))
    lines = text.splitlines()
    assert lines[:4] == ["| n | name |", "| --- | --- |", "| 0 |  |", "| 1 | a\\|b |"] and len(lines) == 2502
    assert [int(x.split(" | ")[0][2:]) for x in lines[2:]] == list(range(2500))


def test_appended_once_though_batches_are_run_again(spark, tmp_path):
    """Three batches with keys of earlier ones; then the last one's checkpoint is lost, as when a driver dies before it commits."""
    schema, source, target, state = "video_id string, n int", tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    source.mkdir()

    def run():
        ingest.append_new(ingest.record_stream(spark, str(source), schema), target, ["video_id"], str(state)).awaitTermination()

    for number, rows in enumerate([[("a", 0), ("b", 0), ("a", 0)], [("b", 1), ("c", 1)], [("a", 2), ("d", 2), ("e", 2)]]):
        (source / f"{number}.json").write_text("".join(json.dumps({"video_id": v, "n": n}) + "\n" for v, n in rows))
        run()
    want = [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 2)]
    read = lambda: ingest.read_appended(spark, target, spark.read.schema(schema).json(str(source)).schema)
    assert sorted((r["video_id"], r["n"]) for r in read().collect()) == want
    for name in ("2", ".2.crc"):
        (state / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted((r["video_id"], r["n"]) for r in read().collect()) == want and {r["_batch"] for r in read().collect()} == {0, 1, 2}


def test_curves_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ordering,fraction,metric,mean\nvlm,0.25,top1,0.5\nvlm,0.25,top5,0.75\nvlm,0.1,top1,0.125\nrandom,1.0,top5,0.5\n")
    assert [tuple(r) for r in scans.curves(spark, str(tmp_path / "c.csv")).collect()] == [("random", 100.0, None, 50.0), ("vlm", 10.0, 12.5, None), ("vlm", 25.0, 50.0, 75.0)]


def test_run_folders_together(spark, tmp_path):
    for run in ("b", "a"):
        (tmp_path / run).mkdir()
        (tmp_path / run / f"{run}__full.json").write_text(json.dumps({"top1_correct": run == "a"}))
    rows = scans.narrow(spark, [str(tmp_path / "b"), str(tmp_path / "a")], ["top1_correct"])
    assert sorted(map(tuple, rows.collect())) == [("a", "full", True), ("b", "full", False)]
