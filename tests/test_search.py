"""The subset search and the oracle it asks, against a search of one video after the other."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from keelson.operators import oracle, search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

NEEDS = {"a": [2], "b": [0, 3], "c": [], "d": [1]}


def model():
    """A model that finds the action where its segments are kept, less surely the fewer segments are left."""

    def answers(questions):
        out = []
        for q in questions:
            p = 0.55 + len(q["kept"]) / 20 if set(NEEDS.get(q["video_id"], [])) <= set(q["kept"]) else 0.3
            out.append({"decision": "YES" if p > 0.5 else "NO", "confidence": p, "logit_confidence": p - 0.001 * min(q["kept"], default=0)})
        return out

    return answers


def by_hand(kept, score, baseline=1.0, tau_final=None, delta=None, tau_min=None):
    """kept, removed, calls, reason of one video."""
    kept, removed, calls = sorted(kept), [], 0
    while len(kept) > 1:
        if tau_min is not None and baseline < tau_min:
            return kept, removed, calls, search.BELOW
        scores = [(baseline - score([x for x in kept if x != c]), c) for c in kept]
        calls += len(kept)
        can = [(d, c) for d, c in scores if baseline - d > 0.5 and (tau_final is None or baseline - d >= tau_final) and (delta is None or d < delta)]
        if not can:
            return kept, removed, calls, search.NONE_LEFT
        drop, gone = min(can)
        kept.remove(gone)
        removed.append(gone)
        baseline -= drop
    return kept, removed, calls, search.SINGLE if kept else search.COMPLETE


def rows_of(found):
    return {r["video_id"]: (r["kept"], r["removed"], r["calls"], r["reason"]) for r in found.collect()}


def test_search_on_an_oracle(spark, tmp_path):
    segments = spark.createDataFrame([(v, i) for v in NEEDS for i in range(5)], "video_id string, idx int")
    cached = oracle.Cached(oracle.Oracle(model, batch=3), str(tmp_path / "cache"))
    ask = lambda questions: cached.ask(questions).withColumn("score", oracle.score())
    result = search.score_based_removal(segments, ask)
    one = lambda v: lambda kept: model()([{"video_id": v, "kept": kept}])[0]["logit_confidence"]
    assert rows_of(result.found) == {v: by_hand(range(5), one(v)) for v in NEEDS}
    total = sum(r["calls"] for r in result.found.collect())
    assert cached.counts == {"rows": total, "hits": 0, "calls": total, "failed": 0} and result.trace.count() == total
    # a second run asks for nothing, in another session of the same cache
    again = oracle.Cached(oracle.Oracle(model), str(tmp_path / "cache"))
    repeated = search.score_based_removal(segments, lambda questions: again.ask(questions).withColumn("score", oracle.score()))
    assert rows_of(repeated.found) == rows_of(result.found) and again.counts == {"rows": total, "hits": total, "calls": 0, "failed": 0}
    other = oracle.Cached(oracle.Oracle(model, template="direct_scoring"), str(tmp_path / "cache"))
    other.ask(segments.groupBy("video_id").agg(F.collect_list("idx").alias("kept"), F.count("*").cast("int").alias("n")))
    assert other.counts["calls"] == len(NEEDS)


def test_random_removal_on_an_oracle(spark, tmp_path):
    """Every result is one that the model accepts, and a second run asks for nothing."""
    segments = spark.createDataFrame([(v, i) for v in NEEDS for i in range(5)], "video_id string, idx int")
    counts = []
    for _ in range(2):
        cached = oracle.Cached(oracle.Oracle(model), str(tmp_path / "cache"))
        found = search.random_removal(segments, lambda questions: cached.ask(questions).withColumn("ok", oracle.yes())).collect()  # noqa: B023
        counts.append(cached.counts)
        for r in found:
            needed = NEEDS[r["video_id"]]
            assert set(needed) <= set(r["kept"]) and len(r["kept"]) == max(1, len(needed)) and len(r["kept"]) + len(r["removed"]) == 5
    assert counts[0]["calls"] == counts[0]["rows"] == counts[1]["hits"] == sum(r["calls"] for r in found) and counts[1]["calls"] == 0


def test_all_four_ends_and_the_trace(spark):
    """Golden traces: limits that end a video in each of the ways."""
    scores = {"single": [0.9, 0.8, 0.7], "none": [0.9, 0.4, 0.4], "below": [0.7, 0.6, 0.6], "delta": [0.9, 0.7, 0.6], "final": [0.95, 0.9, 0.6]}
    limits = [("single", None, None, None, None), ("none", None, None, None, None), ("below", None, None, None, 0.8), ("delta", None, None, 0.15, None), ("final", 0.99, 0.92, None, 0.1), ("low", 0.4, None, None, 0.5)]
    segments = spark.createDataFrame([(v, i) for v in [*scores, "low"] for i in range(4)] + [("one", 7), ("empty", None)], "video_id string, idx int")
    limited = spark.createDataFrame(limits, "video_id string, baseline double, tau_final double, delta double, tau_min double")

    def scored(v, kept):
        return scores.get(v, [0.9] * 3)[3 - len(kept)] - 0.001 * (6 - sum(kept)) % 1

    known = F.udf(lambda v, kept: float(scored(v, kept)), "double")
    result = search.score_based_removal(segments, lambda q: q.withColumn("score", known("video_id", "kept")), limited)
    got = rows_of(result.found)
    given = {v: dict(zip(("tau_final", "delta", "tau_min"), rest[1:], strict=True)) | {"baseline": 1.0 if rest[0] is None else rest[0]} for v, *rest in limits}
    assert got == {**{v: by_hand(range(4), lambda kept, v=v: scored(v, kept), **given[v]) for v in given}, "one": ([7], [], 0, search.SINGLE), "empty": ([], [], 0, search.COMPLETE)}
    assert [got[v][3] for v in ("single", "none", "below", "delta", "final", "low")] == [search.SINGLE, search.NONE_LEFT, search.BELOW, search.NONE_LEFT, search.NONE_LEFT, search.BELOW]
    trace = result.trace.where("video_id = 'none'").orderBy("iteration", "candidate").collect()
    assert [r["iteration"] for r in trace] == [1] * 4 + [2] * 3 and [r["removed"] for r in trace].count(True) == 1
    assert all(abs(r["baseline"] - r["score"] - r["drop"]) < 1e-12 for r in trace) and trace[-1]["removable"] is False


def test_search_goes_on_as_long_as_there_are_segments(spark):
    """More rounds than any fixed end, and nothing to search."""
    segments = spark.createDataFrame([("long", i) for i in range(13)] + [("short", 0)], "video_id string, idx int")
    found = search.minimal_subset(segments, lambda q: q.withColumn("p", F.lit(0.9))).collect()
    assert {r["video_id"]: (r["kept"], r["rounds"]) for r in found} == {"long": ([12], 12), "short": ([0], 0)}
    nothing = search.score_based_removal(segments.limit(0), lambda q: q.withColumn("score", F.lit(0.9)))
    assert nothing.found.count() == 0 and nothing.trace.count() == 0


@pytest.mark.parametrize("fails", [1, 2])
def test_a_failed_batch_is_asked_once_more(spark, tmp_path, fails):
    """Each worker notes its attempts in a file: a batch that fails once is answered, one that fails twice has an error and isn't cached."""
    notes = tmp_path / "notes"
    notes.mkdir()

    def start():
        def answers(questions):
            mark = notes / f"{questions[0]['video_id']}-{random.random()}"
            mark.write_text("")
            seen = len(list(notes.glob(f"{questions[0]['video_id']}-*")))
            if questions[0]["video_id"] == "v0" and seen <= fails:
                raise RuntimeError("busy")
            return [{"decision": "YES", "confidence": 0.7} for _ in questions]

        return answers

    questions = spark.createDataFrame([(f"v{i}", [0], 2) for i in range(3)], "video_id string, kept array<int>, n int").coalesce(1)
    cached = oracle.Cached(oracle.Oracle(start, batch=1), str(tmp_path / "cache"))
    got = {r["video_id"]: r for r in cached.ask(questions).withColumn("score", oracle.score()).collect()}
    assert len(list(notes.glob("v0-*"))) == 2 and len(list(notes.glob("v1-*"))) == 1
    assert got["v1"]["score"] == 0.7 and got["v1"]["error"] is None
    assert (got["v0"]["score"], got["v0"]["error"]) == ((0.7, None) if fails == 1 else (0.0, "RuntimeError: busy"))
    cached.ask(questions)
    assert cached.counts == {"rows": 6, "hits": 4 - fails, "calls": 2 + fails, "failed": fails - 1}


def test_score_of_answers(spark):
    rows = [("YES", 0.8, None, None), ("YES", 0.8, 0.3, 0.2), ("NO", 0.9, None, None), ("YES", 0.9, 0.9, 0.6), ("SKIP", 0.9, None, None), ("SKIP", 0.9, 0.7, 0.1), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "decision string, confidence double, logit_confidence double, logit_p_skip double")
    assert [r[0] for r in frame.select(oracle.score()).collect()] == [0.8, 0.3, 0.0, 0.0, 0.0, 0.7, 0.0]
    assert [r[0] for r in frame.select(oracle.yes()).collect()] == [True, True, False, True, False, False, False]


def test_mask_hash(spark):
    import hashlib

    frame = spark.createDataFrame([([0, 2], 4), ([], 2), ([], 0)], "kept array<int>, n int")
    got = [r[0] for r in frame.select(oracle.mask_hash(F.col("kept"), F.col("n"))).collect()]
    assert got == [hashlib.md5(x.encode()).hexdigest()[:16] for x in ("0101", "11", "")]


def test_questions_are_read_once_and_equal_ones_asked_once(spark, tmp_path):
    """Also over several batches of one task, and columns of the limits go with the questions."""
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([(f"v{i % 3}", [0], 2) for i in range(30)], "video_id string, kept array<int>, n int").coalesce(1)
    questions = rows.withColumn("n", F.udf(counted, "int")("n")).withColumn("other", F.lit("x"))
    cached = oracle.Cached(oracle.Oracle(model), str(tmp_path / "cache"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = cached.ask(questions).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert read.value == 30 and len(got) == 30 and {r["other"] for r in got} == {"x"}
    assert {round(r["confidence"], 9) for r in got} == {0.6} and cached.counts == {"rows": 30, "hits": 27, "calls": 3, "failed": 0}
    cached.ask(rows.where("video_id = 'v1'").withColumn("kept", F.array(F.lit(1))).unionByName(rows.where("video_id = 'v0'")))
    assert cached.counts == {"rows": 50, "hits": 27 + 10 + 9, "calls": 4, "failed": 0}
    limits = spark.createDataFrame([("a", None, None, None, None, [7, 8])], "video_id string, baseline double, tau_final double, delta double, tau_min double, seen array<int>")
    segments = spark.createDataFrame([("a", 0), ("a", 1)], "video_id string, idx int")
    found = search.score_based_removal(segments, lambda q: q.withColumn("score", F.col("seen")[1] / 10), limits).found.collect()
    assert [(r["kept"], r["calls"]) for r in found] == [([1], 2)]


def test_tests_of_one_subset_are_one_question(spark, tmp_path):
    """All segments important, some, none, or no segment; a repeated index and ids that end like those of wrong labels are told apart."""
    rows = [("all", [1, 0], 2), ("some", [1], 3), ("none", [], 2), ("empty", [], 0), ("x", [0, 0], 2), ("x_wrong", [0], 2)]
    labelled = spark.createDataFrame([(*r, "a", "b") for r in rows], "video_id string, important array<int>, n int, label string, wrong_label string")
    seen = []

    def ask(questions):
        assert not {"important", "label", "wrong_label"} & set(questions.columns)
        seen.extend(questions.collect())
        share = F.when(F.col("n") > 0, F.size("kept") / F.col("n")).otherwise(0.0)
        return questions.withColumns({"score": F.when(F.col("asked_label") == "b", share / 4).otherwise(share), "skip": F.lit(False)})

    got = {r["video_id"]: r for r in search.sufficiency(labelled, ask).collect()}
    scores = {k: tuple(r[c] for c in ("full", "keep_important", "remove_unimportant", "keep_unimportant", "wrong_label", "calls")) for k, r in got.items()}
    assert scores.pop("some") == (1.0, 1 / 3, 1 / 3, 2 / 3, 0.25, 5)
    assert scores == {
        "all": (1.0, 1.0, 1.0, None, 0.25, 4), "none": (1.0, 0.0, 0.0, 1.0, 0.25, 5), "empty": (0.0, 0.0, 0.0, None, 0.0, 4),
        "x": (1.0, 1.0, 0.5, 0.5, 0.25, 5), "x_wrong": (1.0, 0.5, 0.5, 0.5, 0.25, 5),
    }
    count = lambda name: len([q for q in seen if q["video_id"] == name])
    assert [count(x) for x in ("all", "some", "none", "empty", "x", "x_wrong_wrong")] == [1, 3, 2, 1, 4, 1]
