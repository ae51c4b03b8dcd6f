"""Canonical records: what joins, what doesn't and why."""

import json

import pytest

from keelson.operators import release
from keelson.sources.schema import SIDECAR


def record(raw, segments, summary=None, evidence="seen", **more):
    responses = [] if raw is None else [{"decision": "YES", "confidence": 0.9, "evidence": evidence, "raw_output": raw}]
    return {"video_id": "v", "action_label": "a", "video_path": "/root/data/x/v.mp4", "summary": summary, "segments": segments, "mss_result": {"mss_runs": [{"kept_indices": [0]}], "total_oracle_calls": 1, "precheck_passed": True, "precheck_vote_yes": 1.0, "precheck_responses": responses, **more}, "elapsed_s": 2.0}


OWN = [{"index": 0, "start_s": 0.0, "end_s": 1.5, "label": "important", "weight": 0.8}, {"index": 1, "start_s": 1.5, "end_s": 3.0, "label": "unimportant", "weight": 0.25}]
SAID = [{"segment_id": 1, "importance": 80, "time_range": "0-1.5 s", "phase": "start", "reason": "r1"}, {"segment_id": 2, "importance": 25.0, "phase": None, "reason": None}]


def answer(segments, **more):
    return json.dumps({"segments": segments, **more})


CASES = [
    ("enriched", answer(SAID, action_summary="prose"), "prose"),
    ("enriched", "<think>{ no }</think> ```json\n" + answer(SAID) + "\n```", "seen"),
    ("enriched", "text " + answer([{"segment_id": 1, "importance": 3}, *SAID, "word", {"segment_id": "2"}]) + " end", "seen"),
    ("degraded:raw_unparseable", "no object", "seen"),
    ("degraded:raw_unparseable", '{"segments": [', "seen"),
    ("degraded:raw_unparseable", "[1, 2]", "seen"),
    ("degraded:raw_unparseable", "}{", "seen"),
    ("degraded:raw_unparseable", "", "seen"),
    ("degraded:no_precheck_response", None, "old"),
    ("degraded:no_raw_segments", answer([]), "seen"),
    ("degraded:no_raw_segments", '{"segments": {"a": 1}}', "seen"),
    ("degraded:no_raw_segments", "{}", "seen"),
    ("degraded:segment_count_mismatch", answer(SAID[:1]), "seen"),
    ("degraded:segment_count_mismatch", answer([{"segment_id": 1.5, "importance": 80}, SAID[1]]), "seen"),
    ("degraded:weight_join_mismatch", answer([{**SAID[0], "importance": 81}, SAID[1]]), "seen"),
    ("degraded:weight_join_mismatch", answer([{**SAID[0], "importance": "80"}, SAID[1]]), "seen"),
    ("degraded:weight_join_mismatch", answer([{**SAID[0], "importance": 1}]), "seen"),
    ("degraded:segment_count_mismatch", answer([{**SAID[1], "importance": 1}]), "seen"),
]


def canonical(spark, rows):
    frame = spark.read.schema(SIDECAR).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 2))
    return [r.asDict(recursive=True) for r in release.canonical(frame).collect()]


def test_status_codes_and_texts(spark):
    got = canonical(spark, [{**record(raw, OWN, "old"), "video_id": str(i)} for i, (_, raw, _) in enumerate(CASES)])
    got = {int(r["video_id"]): r for r in got}
    for i, (status, _, summary) in enumerate(CASES):
        r = got[i]
        assert (r["status"], r["summary"], r["label_counts"]) == (status, summary, None), CASES[i]
        assert r["video_path"] == "x/v.mp4" and r["mss_result"]["kept_indices"] == [0] and [s["weight"] for s in r["segments"]] == [0.8, 0.25]
        assert all("raw_output" not in p for p in r["mss_result"]["precheck_responses"])
        texts = [(s["time_range"], s["phase"], s["reason"]) for s in r["segments"]]
        assert texts == ([("0-1.5 s", "start", "r1"), ("1.5-3", None, None)] if status == "enriched" else [("0-1.5", None, ""), ("1.5-3", None, "")])


def test_missing_parts(spark):
    rows = [record(answer(SAID), [], '{"total_segments": 3, "important_ratio": 0.5}', None), record(answer([{"segment_id": 1}]), [{"index": 0, "label": "x"}]), {"video_id": None}, record(answer(SAID), None, None, None, scores_recovered_from_raw_output=True)]
    a, b, c, d = canonical(spark, rows)
    assert (a["status"], a["segments"], a["summary"], a["label_counts"]["total_segments"]) == ("enriched", [], None, 3)
    assert b["status"] == "degraded:weight_join_mismatch" and b["segments"][0]["time_range"] is None
    assert (c["status"], c["segments"], c["mss_result"]["kept_indices"]) == ("degraded:no_precheck_response", [], [])
    assert (d["status"], d["segments"], d["mss_result"]["scores_recovered_from_raw_output"]) == ("enriched", [], True)


def test_schema_of_the_release(spark):
    frame = release.canonical(spark.createDataFrame([], SIDECAR))
    assert frame.columns == ["video_id", "action_label", "video_path", "timestamp", "summary", "label_counts", "segments", "mss_result", "elapsed_s", "status"]
    assert frame.schema["segments"].dataType.simpleString() == "array<struct<index:int,time_range:string,start_s:double,end_s:double,label:string,weight:double,phase:string,reason:string>>"
    assert [f.name for f in frame.schema["mss_result"].dataType["precheck_responses"].dataType.elementType.fields] == ["decision", "confidence", "evidence", "rationale", "logit_yes", "logit_no", "logit_skip", "logit_confidence", "logit_p_skip"]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("least,passed", [(0.5, True), (0.9, False)])
def test_recovery_gate(spark, least, passed):
    rows = spark.createDataFrame([("enriched",), ("enriched",), ("degraded:no_raw_segments",)], "status string")
    assert release.recovery(rows, least).first()["passed"] is passed
