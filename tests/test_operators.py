"""Golden cases and edge cases of the engine's operators, and file sources and sinks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import agreement, align, allocate, conditions, coverage, paired, sample, search, select
from keelson.sources import scans, sinks
from keelson.streaming import ingest

SEGMENTS = "video_id string, idx int, start_s double, end_s double, dur double, weight double, label string"


def video(spark, weights=None, labels="IUIIUI", step=0.5):
    n = len(weights or labels)
    rows = [("v", i, i * step, (i + 1) * step, step, weights[i] if weights else None, "important" if not weights and labels[i] == "I" else "unimportant") for i in range(n)]
    return spark.createDataFrame(rows, SEGMENTS)


def kept(df):
    return sorted(r["idx"] for r in df.collect())


def test_golden_selectors(spark):
    a = video(spark)
    assert kept(select.important(a)) == [0, 2, 3, 5]
    assert kept(select.lowest_evidence(a)) == [0, 1, 2, 3]
    assert kept(select.until_share(a, 0.5, [F.coalesce("weight", F.lit(0.0)).desc()])) == [0, 1, 2]
    assert kept(select.until_share(a, 0.5, [F.col("idx")])) == [0, 1, 2]
    motion = a.join(spark.createDataFrame([(i, m) for i, m in enumerate((0.1, 0.9, 0.5, 0.7, 0.2, 0.6))], "idx int, motion double"), "idx")
    assert conditions.run(conditions.gather(motion, "motion"), ["motion"]).first()["kept"] == [1, 2, 3, 5]
    b = video(spark, [0.1, 0.9, 0.5, 0.7])
    assert kept(select.until_share(b, 0.5, [F.desc("weight")])) == [1, 3]
    assert kept(select.until_share(b, 0.5, [F.asc("weight")])) == [0, 2]
    c = video(spark, [0.20, 0.60, 0.85, 0.40, 0.95])
    assert kept(select.threshold_or_best(c, 0.5)) == [1, 2, 4]
    assert kept(select.threshold_or_best(c, 1.0)) == [4]
    assert kept(select.threshold_or_best(c, 0.0)) == [0, 1, 2, 3, 4]
    assert kept(select.evenly_spaced(c, F.lit(1))) == [2] and kept(select.evenly_spaced(c, F.lit(3))) == [0, 2, 4]


def by_hand(durations, order, goal):
    """The matched selection of one video, a segment at a time."""
    n, total = len(durations), sum(durations)
    tol = max(0.05, 0.5 * sorted(durations)[n // 2])
    if goal >= total - tol:
        return list(range(n))
    if goal <= tol:
        return [order[0]]
    chosen, length = [], 0.0
    for i in order:
        if abs(length - goal) <= tol:
            break
        if length + durations[i] <= goal + tol:
            chosen.append(i)
            length += durations[i]
    if abs(length - goal) > tol:
        chosen, length = [], 0.0
        for i in order:
            chosen.append(i)
            length += durations[i]
            if length >= goal:
                break
    return sorted(chosen)


def test_conditions(spark):
    """Golden cases by condition name, and matched selections against one segment at a time."""
    import random

    a = conditions.gather(video(spark), "weight")
    names = ["full", "vlm-selected", "lowest-evidence", "id-temporal-f50", "vlm-anchored", "uniform-equal-segs", "vlm-strict-0.9", "motion", "uniform-vs-strict-0.9"]
    got = {r["condition"]: (r["kept"], r["failed"], r["reason"]) for r in conditions.run(a, names).collect()}
    assert got["full"] == ([], False, None) and got["vlm-selected"][0] == [0, 2, 3, 5] and got["lowest-evidence"][0] == [0, 1, 2, 3] and got["id-temporal-f50"][0] == [0, 1, 2]
    assert got["vlm-anchored"][0] == [0, 1, 2, 3, 4, 5] and got["uniform-equal-segs"][0] == [0, 2, 3, 5]
    assert got["vlm-strict-0.9"] == ([], True, conditions.NO_STRICT) == got["uniform-vs-strict-0.9"] and got["motion"] == ([], True, conditions.NO_SCORE)
    b = conditions.gather(video(spark, [0.1, 0.9, 0.5, 0.7]), "weight")
    assert [r["kept"] for r in conditions.run(b, ["id-vlm-f50", "id-anti-vlm-f50"]).collect()] == [[1, 3], [0, 2]]
    c = conditions.gather(video(spark, [0.20, 0.60, 0.85, 0.40, 0.95]), "weight")
    assert [r["kept"] for r in conditions.run(c, ["vlm-score-threshold-t50", "vlm-score-threshold-t100", "vlm-score-threshold-t0"]).collect()] == [[1, 2, 4], [4], [0, 1, 2, 3, 4]]
    with pytest.raises(ValueError):
        conditions.choose("no-such-condition")
    nobody = conditions.gather(video(spark), "weight", spark.createDataFrame([("v",), ("empty",)], "video_id string"))
    assert {(r["video_id"], r["reason"]) for r in conditions.run(nobody, ["uniform"]).collect()} == {("v", None), ("empty", conditions.EMPTY_POOL)}
    rng = random.Random(4)
    videos = {f"v{k}": [(rng.choice([0.5, 1.0, 2.5, 7.0]), rng.random(), rng.random() < 0.4) for _ in range(rng.randint(1, 12))] for k in range(60)}
    rows = [(v, i, 0.0, 0.0, d, m, "important" if x else "unimportant") for v, items in videos.items() for i, (d, m, x) in enumerate(items)]
    kept_of = {r["video_id"]: r["kept"] for r in conditions.run(conditions.gather(spark.createDataFrame(rows, SEGMENTS), "weight"), ["motion"]).collect()}
    for v, items in videos.items():
        order = sorted(range(len(items)), key=lambda i: -items[i][1])
        assert kept_of[v] == by_hand([d for d, _, _ in items], order, sum(d for d, _, x in items if x))
    failed = conditions.run(a, ["vlm-strict-0.9", "motion"])
    assert [r["condition"] for r in conditions.to_write(failed).collect()] == ["vlm-strict-0.9"] and [r["condition"] for r in conditions.to_retry(failed).collect()] == ["motion"]


def test_agreement_conventions(spark):
    e, ab = F.array().cast("array<int>"), F.array(F.lit(1), F.lit(2))
    row = spark.range(1).select(agreement.jaccard(e, e, 0.0).alias("zero"), agreement.jaccard(e, e, None).alias("null"), agreement.jaccard(e, e, 1.0).alias("one"), agreement.set_f1(e, ab).alias("f"), agreement.set_f1(e, e).alias("g"), agreement.jaccard(ab, F.array(F.lit(2)), 0.0).alias("h")).first()
    assert tuple(row) == (0.0, None, 1.0, 0.0, 1.0, 0.5)
    flat = spark.createDataFrame([("v", i, 1.0, float(i)) for i in range(3)], "video_id string, idx int, a double, b double")
    assert agreement.spearman(flat, ["video_id"], "a", "b").first()["rho"] is None
    assert agreement.spearman(flat, ["video_id"], "a", "b", ties="ordinal").first()["rho"] == pytest.approx(1.0)
    assert agreement.kendall(flat, "video_id", "a", "b").first()["tau"] is None


def test_tests_of_pairs(spark):
    t = spark.createDataFrame([(0, 0), (5, 5), (10, 2)], "b10 long, b01 long")
    got = t.select("b10", paired.mcnemar_chi2(F.col("b10"), F.col("b01")).alias("x"), paired.binomial_p("b10", "b01").alias("p")).orderBy("b10").collect()
    assert [round(r["x"], 6) for r in got] == [0.0, 0.1, round(49 / 12, 6)]
    exact = 2 * sum(math.comb(12, k) for k in range(3)) / 2**12
    assert [r["p"] for r in got] == pytest.approx([1.0, 1.0, exact])
    p = spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1), ("d", 0.02, 1)], "name string, p double, f int")
    assert {r["name"]: r["rejected"] for r in paired.holm(p, "p", "name", 0.05, ["f"]).collect()} == {"a": True, "d": False, "c": False, "b": False}


def test_last_write_and_division(spark):
    rows = spark.createDataFrame([("v", "a", 1, True), ("v", "a", 2, False), ("v", "b", 1, None), ("w", "a", 1, True)], "video_id string, condition string, n int, failed boolean")
    assert {(r["video_id"], r["condition"], r["n"]) for r in align.last_write(rows, ["video_id", "condition"], "n").collect()} == {("v", "a", 2), ("v", "b", 1), ("w", "a", 1)}
    assert [r[0] for r in align.having_all(rows, "video_id", "condition", ["a", "b"]).collect()] == ["v"]
    assert align.eligible(rows.limit(0), "video_id", "failed").count() == 0


def test_allocation(spark):
    rows = spark.createDataFrame([("v", 0, 1.0), ("v", 1, 1.0), ("v", 2, 1.0), ("w", 0, 5.0)], "video_id string, idx int, dur double")
    seats = allocate.apportion(rows, "video_id", "idx", "dur", 16).groupBy("video_id").agg(F.sum("seats").alias("n"), F.max("seats").alias("m")).collect()
    assert {r["video_id"]: (r["n"], r["m"]) for r in seats} == {"v": (16, 6), "w": (16, 16)}
    bins = allocate.first_fit_decreasing(spark.createDataFrame([(0, i, c) for i, c in enumerate([6.0, 5.0, 4.0, 12.0, 3.0])], "g int, id int, cost double"), "g", ["id"], "cost", 10.0, 3)
    by = {}
    for r in bins.collect():
        by.setdefault(r["bin"], set()).add(r["id"])
    assert sorted(map(sorted, by.values())) == [[0, 2], [1, 4], [3]]
    assert coverage.trapezoid(rows, ["video_id"], "idx", "dur").where("video_id = 'w'").first()["auc"] is None


@pytest.mark.parametrize(
    ("raw", "how"),
    [('{"a": 1}', "strict"), ('<think>{x}</think>```json\n{"a": 1}\n```', "fenced"), ('so {"a": "}"} done', "balanced"), ('{"a": [1, 2, {"b": "c', "closed"), ("none", "none"), (None, "none")],
)
def test_json_repair(raw, how):
    found, recovery = text.repair(raw)
    assert recovery == how and (found is None) == (how == "none")


def test_minimal_subset(spark):
    segments = spark.createDataFrame([(v, i) for v in "ab" for i in range(4)], "video_id string, idx int")
    score = lambda c: c.withColumn("p", F.when(F.array_contains("kept", 2), 0.6 + F.size("kept") / 100).otherwise(0.1))
    assert {r["video_id"]: r["kept"] for r in search.minimal_subset(segments, score).collect()} == {"a": [2], "b": [2]}


def test_files(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "v__x__full.json").write_text(json.dumps({"video_id": "v__x", "condition": "full", "top1_correct": True}))
    (run / "w__full.json").write_text(json.dumps({"top1_correct": False}))
    (run / "w__full--shuffled.json").write_text(json.dumps({"top1_correct": True}))
    (run / "bad__full.json").write_text("{cut")
    (run / "config.json").write_text("{}")
    got = {(r["video_id"], r["condition"], r["top1_correct"]) for r in scans.records(spark, str(run)).collect()}
    assert got == {("v__x", "full", True), ("w", "full", False), ("w", "full--shuffled", True)}
    assert scans.twins(scans.records(spark, str(run))).count() == 1
    assert [r["file_name"] for r in scans.dead_letters(spark, str(run)).collect()] == ["bad__full.json"]
    files = spark.createDataFrame([(0, "b", bytearray(b"2")), (0, "a", bytearray(b"1")), (1, "c", bytearray(b"3"))], "shard int, name string, content binary")
    once, again = ({r["shard"]: r["sha256"] for r in sinks.archives(f).collect()} for f in (files, files.repartition(3)))
    assert once == again and len(once) == 2
    out = tmp_path / "tars"
    out.mkdir()
    for r in sinks.archives(files).collect():
        (out / f"{r['shard']}.tar.gz").write_bytes(bytes(r["content"]))
    assert sorted(r["member"] for r in scans.archive_members(spark, str(out)).collect()) == ["a", "b", "c"]
    annotated = spark.createDataFrame([("b", "l", [("important",), ("x",)], (True,)), ("a", "l", [], (False,))], "video_id string, action_label string, segments array<struct<label:string>>, mss_result struct<precheck_passed:boolean>")
    assert [tuple(r)[2:] for r in sinks.manifest(annotated).orderBy("video_id").collect()] == [(0, False, None, 0), (2, True, 0.5, 0)]
    sinks.write_release(annotated, str(tmp_path / "release"), 1)
    assert spark.read.parquet(str(tmp_path / "release")).count() == 2 and sinks.digests(spark, str(tmp_path / "release")).count() >= 2


def test_cells_shards_and_settings(spark, tmp_path):
    cell = tmp_path / "m_d"
    cell.mkdir()
    for name, body in {"a__full": {"top1_correct": True}, "b__x__full": {"video_id": "", "top1_correct": False}, "a__random": {"top1_correct": False}}.items():
        (cell / f"{name}.json").write_text(json.dumps(body))
    (cell / "c__full.json").write_text("{cut")
    assert {(r["video_id"], r["top1_correct"]) for r in scans.cell_records(spark, str(tmp_path), "m_d", "full").collect()} == {("a", True), ("b", False)}
    shards, about = str(tmp_path / "shards"), tmp_path / "about"
    spark.createDataFrame([("v", 1, [0.5, 1.0]), ("w", 0, [2.0, 0.0])], "video_id string, label int, features array<float>").repartition(2).write.parquet(shards)
    about.mkdir()
    (about / "a.json").write_text('{"num_labels": 0}')
    (about / "b.json").write_text('{"num_labels": 7}')
    (about / "c.json").write_text('{"num_labels": 9}')
    rows, stated = scans.feature_shards(spark, shards, str(about))
    assert stated == 7 and {(r["video_id"], r["label"], tuple(r["features"])) for r in rows.collect()} == {("v", 1, (0.5, 1.0)), ("w", 0, (2.0, 0.0))}
    config = {"seed": 5, "part": {"delta": 0.2, "tau": 0.9}, "other": 1}
    assert text.settings({"tau": 0.5, "seed": None}, config, {"seed": 1, "delta": 0.1, "tau": 0.0, "runs": 3}) == {"seed": 5, "delta": 0.2, "tau": 0.5, "runs": 3}


def test_incremental_ingest(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    schema = "video_id string, condition string, n int"
    for k in range(2):
        spark.createDataFrame([("v", "a", k), (f"w{k}", "a", k)], schema).write.mode("append").json(str(source))
        ingest.append_new(ingest.record_stream(spark, str(source), schema), target, ["video_id", "condition"], str(tmp_path / "state")).awaitTermination()
    assert sorted(r["video_id"] for r in spark.read.parquet(target).collect()) == ["v", "w0", "w1"]


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp_seconds(id * 40) ts, 'a' kind, id % 3 k from range(20)").write.parquet(str(tmp_path / "e"))
    stream = ingest.event_stream(spark, str(tmp_path / "e"))
    counted = ingest.windowed_counts(stream, "ts", "2 minutes", ["kind"], "1 minute")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sum(r["n"] for r in spark.table("counted").collect()) == 20


def test_any_number_of_conditions_and_labels(spark, tmp_path):
    from keelson.plans import record_queries

    rows = spark.createDataFrame([("all", f"t{i:02d}") for i in range(70)] + [("some", f"t{i:02d}") for i in range(69)], "video_id string, condition string")
    assert [r[0] for r in align.having_all(rows, "video_id", "condition").collect()] == ["all"]
    assert sorted(r[0] for r in align.having_all(rows, "video_id", "condition", ["t03", "t04"]).collect()) == ["all", "some"]
    n = 1300  # several blocks of labels
    spark.range(n).selectExpr("id AS vec_id", "CAST(id AS INT) AS label", "array(cos(id), sin(id)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: [x["label"] for x in r["ranked"]] for r in record_queries._scores(spark, str(tmp_path), 3).collect()}
    x = np.array([[math.cos(i), math.sin(i)] for i in range(n)])
    scores = np.round(x @ np.round(x, 9).T, 6)
    assert got == {i: sorted(range(n), key=lambda j: (-scores[i, j], j))[:3] for i in range(n)}


def test_known_keys_of_objects():
    keys = text.ORACLE_KEYS
    cases = [
        ('pre {"a":1} {"decision":"YES"}', '{"decision": "YES"}', "balanced"),
        ('{"segment_id": 1}', None, "none"),
        ('{"x": [{"y": 1}, {"evidence": "e", "decision": "NO"}]}', '{"evidence": "e", "decision": "NO"}', "balanced"),
        ('{"open": {"a": 1}, {"decision": "YES", "b": {"c": 2}} tail {', '{"decision": "YES", "b": {"c": 2}}', "balanced"),
        ('text "{" and {"confidence": 0.5}', '{"confidence": 0.5}', "balanced"),
        ('{"decision": "YES", "segments": [{"id": 1}, {"id"', '{"decision": "YES", "segments": [{"id": 1}]}', "closed"),
        ('{"a": [1, 2', None, "none"),
    ]
    for raw, json_, how in cases:
        assert text.repair(raw, keys) == (json_, how), raw
    assert text.repair(cases[1][0]) == (cases[1][0], "strict")


def test_nested_objects_are_read_once():
    """Time grows with the length, not with the depth times the length."""
    import time

    def seconds(depth):
        began = time.process_time()
        assert text._object_in("so " + '{"a": ' * depth + "x", lambda v: True) is None
        assert text._object_in('{"a": [' + '{"b": 1}, ' * depth + "]}", lambda v: isinstance(v, dict) and "c" in v) is None
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.01)


def test_cut_json_with_many_commas_in_its_last_member():
    cut = '{"a": 1, "b": [' + "{1, 2}, " * 100
    assert text.repair(cut) == ('{"a": 1}', "closed")


def test_markdown_raises_past_its_bound(spark):
    assert sinks.markdown(spark.range(3), 3).count("\n") == 4
    with pytest.raises(ValueError, match="more than 3"):
        sinks.markdown(spark.range(4), 3)


def test_general_format(spark):
    values = [0.0, 1.0, 0.5, 12.25, 100.0, 123456.7, 999999.4, 999999.7, 1e6, 1234567.0, 1e-4, 0.00012345678, 9.9999996, 1e-5, -2.50, 1e20, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r["i"]: r["s"] for r in rows.select("i", text.general(F.col("x")).alias("s")).collect()}
    assert got == {i: None if v is None else f"{v:g}" for i, v in enumerate(values)}


def test_pools_and_starts_at_their_edges(spark):
    one = spark.createDataFrame([([],), ([3, 5],), (list(range(10)),)], "pool array<int>")
    got = [r["c"] for r in one.select(allocate.pooled_clips(F.col("pool"), 4, 2).alias("c")).collect()]
    assert got == [[[0] * 4] * 2, [[3, 5, 5, 5]] * 2, [[0, 1, 2, 3], [6, 7, 8, 9]]]
    assert one.select(allocate.pooled_clips(F.col("pool"), 4, 1).alias("c")).collect()[2]["c"] == [[3, 4, 5, 6]]
    items = "array<struct<start_s:double,end_s:double,weight:double>>"
    rows = spark.createDataFrame([(1, [], 40), (2, [(0.0, 10.0, 0.0), (10.0, 20.0, 1.0)], 40), (3, [(0.0, 10.0, 1.0)], 0), (4, None, 40)], f"k int, items {items}, n int")
    got = {r["k"]: r["s"] for r in rows.select("k", allocate.hybrid_starts(F.col("items"), F.col("n"), 1.0, 4, 8).alias("s")).collect()}
    assert got == {1: [0, 11, 21, 32], 2: [0, 12, 18, 32], 3: [0, 0, 0, 0], 4: [0, 11, 21, 32]}


def test_random_removal(spark):
    rows = spark.createDataFrame([(v, i) for v in ("a", "b", "c", "d") for i in range(1 if v == "d" else 6)], "video_id string, idx int")
    needs = {"a": [1, 4], "b": [], "c": list(range(6)), "d": []}
    needed = F.coalesce(*[F.when(F.col("video_id") == v, F.array(*map(F.lit, n)).cast("array<int>")) for v, n in needs.items()])
    calls = lambda df: df.withColumn("ok", F.size(F.array_except(needed, "kept")) == 0)
    got = {r["video_id"]: r for r in search.random_removal(rows, calls).collect()}
    assert got["a"]["kept"] == [1, 4] and got["a"]["reason"] == "no_removable" and sorted(got["a"]["removed"]) == [0, 2, 3, 5]
    assert len(got["b"]["kept"]) == 1 and got["b"]["reason"] == "single_segment" and len(got["b"]["removed"]) == 5
    assert got["b"]["calls"] == 3 + 3 + 2 + 2 + 2
    assert got["c"]["kept"] == list(range(6)) and got["c"]["calls"] == 6
    assert got["d"]["kept"] == [0] and got["d"]["calls"] == 0
    again = {r["video_id"]: r["removed"] for r in search.random_removal(rows, calls).collect()}
    assert again == {v: r["removed"] for v, r in got.items()}


def test_general_rounds_the_exact_value(spark):
    """As C's %g: ties of the exact value go to even digits, and what only looks like a tie in decimals doesn't."""
    from keelson.functions.text import general

    xs = [112499.5, 112500.5, -100000.5, 1234565000.0, 1234575000.0, 1.2345675, 999999.5, 9.9999996e-5, 9.5e-5, 1e-17, 1e22, 0.1, 0.0, float("inf"), float("nan")]
    xs += [k / 8 for k in range(8_000_001, 8_000_041)] + [k / 2**20 for k in range(1, 10**9, 33_333_331)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", general(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in got] == [f"{x:g}" for x in xs]
    assert spark.range(1).select(general(F.lit(None).cast("double"))).first()[0] is None


def test_direct_scores_reads_an_answer_once(spark):
    """An answer's list is parsed once a row, not once for each segment and gap."""
    from keelson.functions.text import direct_scores

    raw = '{"segments": [{"segment_id": 1, "importance": 20}, {"segment_id": 5, "importance": 80}, {"segment_id": 5, "importance": 60}]}'
    frame = spark.createDataFrame([(raw, 6)], "raw string, n int").select(direct_scores(F.col("raw"), F.col("n")).alias("x"))
    found = frame.first()["x"]
    assert [round(w, 9) for w in found["weights"]] == [0.2, 0.4, 0.5, 0.55, 0.6, 0.6] and found["kept"] == [2, 3, 4, 5]
    assert frame._jdf.queryExecution().analyzed().toString().count("segment_id") == 1


def test_last_resort_reads_a_field_once(spark):
    """Each of the four fields is sought once, and null, missing and empty ones are as before."""
    from keelson.functions.text import last_resort

    texts = ['x "Decision": "YES", "confidence": .5, "evidence": "a \\" b", "cut', '{"decision": "", "evidence": "e"', '{"decision" "YES"', None, '{"decision": 1, "action_summary": "", "evidence": "e"', '{"decision": "NO", "evidence": "e"']
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, raw string").select("i", last_resort(F.col("raw")).alias("x"))
    got = [None if r["x"] is None else tuple(r["x"]) for r in frame.orderBy("i").collect()]
    assert got == [("YES", 0.5, 'a \\" b'), None, None, None, ("1", None, None), ("NO", None, "e")]
    assert frame._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 4


def test_large_tables_have_partitions_by_their_rows(spark):
    """Twice the rows, twice the partitions: a task's sorts hold no more."""
    from keelson.plans.bindings import A_PARTITION, COUNTED_FROM, by_video

    small = spark.range(COUNTED_FROM - 1, numPartitions=3)
    assert by_video(small, "id").rdd.getNumPartitions() == 3
    for n in (2 * COUNTED_FROM, 4 * COUNTED_FROM):
        assert by_video(spark.range(n), "id").rdd.getNumPartitions() == n // A_PARTITION
