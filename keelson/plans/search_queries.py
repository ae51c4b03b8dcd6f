"""Searches over the test tables, on the oracle contract."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.operators import oracle, search
from keelson.plans.bindings import query, segments
from keelson.session import materialize, shared_dir


def _cached(spark, model, template):
    """An oracle with a new cache in the shared folder."""
    return oracle.Cached(oracle.Oracle(model, template=template, batch=256), f"{shared_dir(spark).rstrip('/')}/oracle-{uuid.uuid4().hex}")


def _weights(spark, sf):
    """video_id, n, and the segments' weights in percent and labels, in order."""
    item = F.struct("idx", F.round(F.col("weight") * 100).cast("long").alias("w"), (F.col("label") == "important").alias("v"))
    by = segments(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    part = lambda name: F.transform("s", lambda x: x[name])
    return materialize(by.select(F.col("video_id").cast("string").alias("video_id"), F.size("s").alias("n"), part("w").alias("weights"), F.transform(F.filter("s", lambda x: x["v"]), lambda x: x["idx"]).alias("important")), "weights")


def _share():
    """A model whose confidence is the share of the kept segments in all weights: one that is cheap, and whose searches SQL can follow."""

    def answers(questions):
        shares = [sum(q["weights"][i] for i in q["kept"]) / max(1, sum(q["weights"])) for q in questions]
        return [{"decision": "YES" if p > 0.5 else "NO", "confidence": p, "logit_confidence": p} for p in shares]

    return answers


#: Segments leave in ascending order of weight, so the k-th round's score is known from running sums; the first round that a rule ends is the last.
_SEARCH = """WITH {SEG}, w AS (SELECT video_id, idx, CAST(round(weight * 100) AS BIGINT) AS w FROM seg),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY w, idx) AS k, count(*) OVER (PARTITION BY video_id) AS n, sum(w) OVER (PARTITION BY video_id) AS total, sum(w) OVER (PARTITION BY video_id ORDER BY w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM w),
l AS (SELECT *, (total - gone) / greatest(1, total) AS score, CASE WHEN k = 1 THEN CASE video_id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.95 ELSE 1.0 END ELSE (total - gone + w) / greatest(1, total) END::DOUBLE AS baseline,
  CASE WHEN video_id % 4 = 2 THEN 0.7 END AS tau_final, CASE WHEN video_id % 4 = 3 THEN 0.12 END AS delta, CASE video_id % 4 WHEN 1 THEN 0.6 WHEN 3 THEN 0.8 END AS tau_min FROM o),
e AS (SELECT *, n - k + 1 AS left_, CASE WHEN n - k + 1 = 1 THEN 'single_segment' WHEN baseline < tau_min THEN 'baseline_below_tau_min' WHEN NOT (score > 0.5 AND coalesce(score >= tau_final, true) AND coalesce(baseline - score < delta, true)) THEN 'no_removable_segments' END AS reason FROM l),
f AS (SELECT video_id, min(k) AS k FROM e WHERE reason IS NOT NULL GROUP BY video_id),
r AS (SELECT e.video_id, f.k, any_value(e.n) AS n, any_value(reason) FILTER (e.k = f.k) AS reason, coalesce(list(idx ORDER BY e.k) FILTER (e.k < f.k), []) AS removed, list(idx ORDER BY idx) FILTER (e.k >= f.k) AS kept FROM e JOIN f USING (video_id) GROUP BY e.video_id, f.k)
SELECT CAST(video_id AS VARCHAR) AS video_id, kept, removed, CAST((k - 1) * n - (k - 1) * (k - 2) / 2 + CASE WHEN reason = 'no_removable_segments' THEN n - k + 1 ELSE 0 END AS BIGINT) AS calls, reason FROM r"""


@query("g1_score_based_removal", _SEARCH)
def g1(spark, sf):
    """With limits by video: none, a low first baseline, a least score, a largest drop."""
    weights = _weights(spark, sf)
    kind = F.col("video_id").cast("long") % 4
    limits = weights.select("video_id", F.when(kind == 1, 0.5).when(kind == 2, 0.95).alias("baseline"), F.when(kind == 2, 0.7).alias("tau_final"), F.when(kind == 3, 0.12).alias("delta"), F.when(kind == 1, 0.6).when(kind == 3, 0.8).alias("tau_min"), "weights")
    cached = _cached(spark, _share, "share")
    ask = lambda questions: cached.ask(questions).withColumn("score", oracle.score())
    return search.score_based_removal(segments(spark, sf), ask, limits).found.select("video_id", "kept", "removed", "calls", "reason")


def _labels():
    """The model of _share, which doubts a wrong label by the video's number, and skips some videos."""
    share = _share()

    def answers(questions):
        out = share(questions)
        for q, a in zip(questions, out, strict=True):
            number = int(q["video_id"].removesuffix("_wrong"))
            if q["asked_label"] == "wrong":
                a["logit_confidence"] *= number % 3 / 2
            a["logit_p_skip"] = 0.9 if number % 11 == 0 else 0.1
        return out

    return answers


@query("a74_sufficiency", """WITH {SEG}, w AS (SELECT video_id, CAST(round(weight * 100) AS BIGINT) AS w, label = 'important' AS v FROM seg), s AS (SELECT video_id, video_id % 11 = 0 AS skip, sum(w) / greatest(1, sum(w)) AS whole, coalesce(sum(w) FILTER (v), 0) / greatest(1, sum(w)) AS kept, coalesce(sum(w) FILTER (NOT v), 0) / greatest(1, sum(w)) AS others, count_if(NOT v) AS n FROM w GROUP BY video_id),
p AS (SELECT *, CASE WHEN skip THEN 0 ELSE whole END AS f, CASE WHEN skip THEN 0 ELSE kept END AS k, CASE WHEN n > 0 THEN CASE WHEN skip THEN 0 ELSE others END END AS u, CASE WHEN skip THEN 0 ELSE whole * (video_id % 3 / 2) END AS x FROM s)
SELECT CAST(video_id AS VARCHAR) AS video_id, round(f, 9)::DOUBLE AS full, round(k, 9)::DOUBLE AS keep_important, round(u, 9)::DOUBLE AS keep_unimportant, round(x, 9)::DOUBLE AS wrong_label, k > 0.5 AND NOT skip AS important_suffices, f - k <= 0.2 AS others_can_go, coalesce(u < 0.5, true) AS others_do_not_do, x < 0.5 AS wrong_label_refused, CAST(4 + (n > 0)::INT AS BIGINT) AS calls FROM p""")
def a74(spark, sf):
    """The four tests of a selection, asked of an oracle."""
    cached = _cached(spark, _labels, "sufficiency")
    labelled = _weights(spark, sf).select("*", F.lit("right").alias("label"), F.lit("wrong").alias("wrong_label"))
    found = search.sufficiency(labelled, lambda questions: cached.ask(questions).withColumn("score", oracle.score()).withColumn("skip", oracle.skipped()))
    scores = [F.round(c, 9).alias(c) for c in ("full", "keep_important", "keep_unimportant", "wrong_label")]
    return found.select("video_id", *scores, "important_suffices", "others_can_go", "others_do_not_do", "wrong_label_refused", "calls")


def _scorer():
    """A model that scores all segments in one answer: by the video's number it takes one, two, three or more attempts, or leaves segments out."""
    import json

    def answer(q):
        kind = int(q["video_id"]) % 5
        if kind in (1, 2, 3) and q["attempt"] <= kind:
            return ["no object", '<think>{"segments": [1]}</think> {"segments": []}', '{"segments": [{"segment_id": 1'][(q["attempt"] + kind) % 3]
        said = [{"segment_id": i + 1, "importance": w} for i, w in enumerate(q["weights"]) if kind != 4 or i % 2 == 0]
        named = [] if kind == 4 else [1, len(q["weights"]), 99]
        return "<think>so</think> " + json.dumps({"segments": said, "minimum_sufficient_set": named}) + " end"

    return lambda questions: [{"raw_output": answer(q)} for q in questions]


@query("g7_attempt_fallback", """WITH {SEG}, w AS (SELECT video_id, idx, video_id % 5 AS kind, CAST(round(weight * 100) AS BIGINT) / 100 AS w, count(*) OVER (PARTITION BY video_id) AS n FROM seg),
f AS (SELECT *, CASE WHEN kind = 3 THEN 0.5 WHEN kind <> 4 OR idx % 2 = 0 THEN w WHEN idx = n - 1 THEN lag(w) OVER o ELSE (lag(w) OVER o + lead(w) OVER o) / 2 END::DOUBLE AS x FROM w WINDOW o AS (PARTITION BY video_id ORDER BY idx)),
g AS (SELECT video_id, kind, n, list(round(x, 9) ORDER BY idx) AS weights, coalesce(list(idx ORDER BY idx) FILTER (x >= 0.5), []) AS half, list(idx ORDER BY idx) AS everything FROM f GROUP BY video_id, kind, n)
SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN kind = 4 AND len(half) = 0 THEN [0.5::DOUBLE FOR i IN everything] ELSE weights END AS weights, CASE WHEN kind = 3 OR kind = 4 AND len(half) = 0 THEN everything WHEN kind = 4 THEN half WHEN n = 1 THEN [0] ELSE [0, CAST(n - 1 AS INTEGER)] END AS kept,
  CAST(CASE WHEN kind = 4 AND len(half) = 0 OR kind = 3 THEN 3 WHEN kind = 4 THEN 1 ELSE kind + 1 END AS INTEGER) AS calls, CASE WHEN kind = 3 OR kind = 4 AND len(half) = 0 THEN 'fallback' ELSE 'parsed' END AS source FROM g""")
def g7(spark, sf):
    """Scores in one answer, asked for up to three times, else all segments at one half."""
    cached = _cached(spark, _scorer, "direct")
    records = _weights(spark, sf).select("video_id", "n", "weights", F.sequence(F.lit(0), F.col("n") - 1).alias("kept"))
    found = search.score_directly(records, cached.ask)
    return found.select("video_id", F.transform("weights", lambda w: F.round(w, 9)).alias("weights"), "kept", "calls", "source")
