"""Selection, coverage and allocation over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators import allocate, conditions, coverage, select
from keelson.plans.bindings import query, segments

KEPT = ["video_id", "idx"]


def _kept(df: DataFrame) -> DataFrame:
    return df.select(*KEPT)


@query("c2_important", "WITH {SEG} SELECT video_id, idx FROM seg WHERE label = 'important'")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(select.important(segments(spark, sf)))


@query("c3_threshold", "WITH {SEG} SELECT video_id, idx FROM seg WHERE weight >= 0.9")
def c3(spark, sf):
    return _kept(select.threshold(segments(spark, sf), 0.9))


@query("c4_threshold_or_best", """WITH {SEG}, r AS (SELECT *, sum(CASE WHEN weight >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS hits,
  row_number() OVER (PARTITION BY video_id ORDER BY weight DESC, idx) AS best FROM seg)
SELECT video_id, idx FROM r WHERE weight >= 0.7 OR (hits = 0 AND best = 1)""")
def c4(spark, sf):
    return _kept(select.threshold_or_best(segments(spark, sf), 0.7))


@query("c5_weighted", "WITH {SEG} SELECT video_id, idx, coalesce(weight, 1.0) AS weight FROM seg WHERE label = 'important'")
def c5(spark, sf):
    return select.important(segments(spark, sf)).select(*KEPT, F.coalesce("weight", F.lit(1.0)).alias("weight"))


@query("c6_fast_forward", "WITH {SEG} SELECT video_id, idx, round(dur * CASE WHEN label = 'important' THEN 1.0 ELSE 0.25 END, 6) AS played FROM seg")
def c6(spark, sf):
    return select.fast_forward(segments(spark, sf), 0.25).select(*KEPT, F.round("played", 6).alias("played"))


@query("c7_fast_forward_inverted", "WITH {SEG} SELECT video_id, idx, round(dur * CASE WHEN label = 'important' THEN 0.4 ELSE 1.0 END, 6) AS played FROM seg")
def c7(spark, sf):
    return select.fast_forward(segments(spark, sf), 0.4, inverted=True).select(*KEPT, F.round("played", 6).alias("played"))


@query("c8_lowest_evidence", """WITH {SEG}, r AS (SELECT *, greatest(sum(CASE WHEN label = 'important' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id), 1) AS n,
  row_number() OVER (PARTITION BY video_id ORDER BY weight, idx) AS k FROM seg) SELECT video_id, idx FROM r WHERE k <= n""")
def c8(spark, sf):
    return _kept(select.lowest_evidence(segments(spark, sf)))


_POOL = """WITH RECURSIVE {SEG}, v AS (SELECT video_id, list(idx ORDER BY idx) AS i, list(dur ORDER BY idx) AS d, CAST(count(*) AS INTEGER) AS n, sum(dur) AS total, greatest(0.05, 0.5 * list_sort(list(dur))[CAST(floor(count(*) / 2) AS INTEGER) + 1])::DOUBLE AS tol,
  coalesce(sum(dur) FILTER (label = 'important'), 0) AS goal, coalesce(sum(dur) FILTER (weight >= 0.9), 0) AS strict, bool_or(weight2 >= 0.8) AS unscored FROM seg GROUP BY video_id)"""
_GREEDY = _POOL + """, o AS (SELECT video_id, idx, dur, CAST(row_number() OVER (PARTITION BY video_id ORDER BY {order}, idx) AS INTEGER) AS k FROM seg),
g AS (SELECT video_id, 0 AS k, 0.0::DOUBLE AS s, CAST([] AS INTEGER[]) AS kept FROM v UNION ALL SELECT g.video_id, o.k, CASE WHEN abs(s - goal) > tol AND s + dur <= goal + tol THEN s + dur ELSE s END,
  CASE WHEN abs(s - goal) > tol AND s + dur <= goal + tol THEN list_append(kept, idx) ELSE kept END FROM g JOIN o ON g.video_id = o.video_id AND o.k = g.k + 1 JOIN v ON v.video_id = g.video_id),
b AS (SELECT o.*, coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
x AS (SELECT b.video_id, list_sort(list(idx) FILTER (before < goal)) AS crossing, min_by(idx, k) AS first FROM b JOIN v USING (video_id) GROUP BY b.video_id)
SELECT video_id, CASE WHEN {fail} THEN CAST([] AS INTEGER[]) WHEN goal >= total - tol THEN i WHEN goal <= tol THEN [first] WHEN abs(s - goal) <= tol THEN list_sort(kept) ELSE crossing END AS kept, {fail} AS failed FROM v JOIN g USING (video_id) JOIN x USING (video_id) WHERE g.k = n"""
_UNIFORM = _POOL + """, u AS (SELECT *, {goal} AS want FROM v), e AS (SELECT *, least(greatest(CAST(round_even(want / (total / n), 0) AS INTEGER), 1), n) AS guess FROM u),
t AS (SELECT video_id, c, CASE WHEN c <= 1 THEN [n // 2] ELSE list_sort(list_distinct([CAST(round_even(j * (n - 1) / (c - 1)::DOUBLE, 0) AS INTEGER) FOR j IN range(c)])) END AS p, CASE c - guess WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 WHEN -2 THEN 4 END AS turn FROM (SELECT *, unnest(range(greatest(guess - 3, 1), least(guess + 3, n) + 1)) AS c FROM e)),
m AS (SELECT t.video_id, c, turn, [i[x + 1] FOR x IN p] AS k, abs(list_sum([d[x + 1] FOR x IN p]) - want) AS off, tol FROM t JOIN u USING (video_id)),
r AS (SELECT video_id, min_by(k, turn) FILTER (off <= tol AND turn IS NOT NULL) AS hit, (list(k ORDER BY off, c))[1] AS best FROM m GROUP BY video_id)
SELECT video_id, CASE WHEN {fail} THEN CAST([] AS INTEGER[]) WHEN want >= total - tol THEN i WHEN want <= tol THEN [i[n // 2 + 1]] ELSE coalesce(hit, best) END AS kept, {fail} AS failed FROM u JOIN r USING (video_id)"""


def _sql(text: str, **parts: str) -> str:
    for name, part in parts.items():
        text = text.replace("{" + name + "}", part)
    return text


def _gathered(spark, sf):
    """Motion scores of 0.8 or more count as missing, so that failures occur."""
    return conditions.gather(segments(spark, sf).withColumn("motion", F.when(F.col("weight2") < 0.8, F.col("weight2"))), "motion")


def _matched(name: str, condition: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf: conditions.run(_gathered(spark, sf), [condition]).select("video_id", "kept", "failed"))


_matched("c9_random_matched", "random", _sql(_GREEDY, order="md5('42|' || video_id || '|' || idx)", fail="false"))
_matched("c10_uniform_matched", "uniform", _sql(_UNIFORM, goal="goal", fail="false"))
_matched("c11_uniform_vs_strict", "uniform-vs-strict-0.9", _sql(_UNIFORM, goal="strict", fail="(strict = 0)"))
_matched("c12_motion_matched", "motion", _sql(_GREEDY, order="-weight2", fail="unscored"))

_SWEEP = ["full", "vlm-selected", "vlm-strict-0.9", "vlm-score-threshold-t70", "lowest-evidence", "uniform-equal-segs", "id-vlm-f50", "id-temporal-f10", "id-motion-f30", "vlm-anchored"]
_RUN = """WITH {SEG}, s AS (SELECT *, weight2 < 0.8 AS scored, count(*) OVER v AS n, CAST(count_if(label = 'important') OVER v AS BIGINT) AS imp, row_number() OVER (v ORDER BY weight DESC, idx) AS heavy, row_number() OVER (v ORDER BY weight, idx) AS light,
  sum(dur) OVER v AS total, coalesce(sum(dur) OVER (v ORDER BY weight DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_vlm, coalesce(sum(dur) OVER (v ORDER BY weight2 DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_motion,
  bool_and(weight2 < 0.8) OVER v AS whole, CAST(count_if(weight >= 0.7) OVER v AS BIGINT) AS hits FROM seg WINDOW v AS (PARTITION BY video_id)),
k AS (SELECT video_id, 'full' AS condition, idx, false AS k FROM s UNION ALL SELECT video_id, 'vlm-selected', idx, label = 'important' FROM s UNION ALL SELECT video_id, 'vlm-strict-0.9', idx, weight >= 0.9 FROM s
UNION ALL SELECT video_id, 'vlm-score-threshold-t70', idx, weight >= 0.7 OR (hits = 0 AND heavy = 1) FROM s UNION ALL SELECT video_id, 'lowest-evidence', idx, light <= greatest(imp, 1) FROM s
UNION ALL SELECT video_id, 'uniform-equal-segs', idx, CASE WHEN imp <= 1 THEN idx = n // 2 ELSE list_contains([CAST(round_even(j * (n - 1) / (imp - 1)::DOUBLE, 0) AS INTEGER) FOR j IN range(imp)], idx) END FROM s
UNION ALL SELECT video_id, 'id-vlm-f50', idx, b_vlm < 0.5 * total FROM s UNION ALL SELECT video_id, 'id-temporal-f10', idx, start_s < 0.1 * total FROM s UNION ALL SELECT video_id, 'id-motion-f30', idx, whole AND b_motion < 0.3 * total FROM s UNION ALL SELECT video_id, 'vlm-anchored', idx, true FROM s)
"""


@query("c0_conditions", _RUN + "SELECT video_id, condition, coalesce(list(idx ORDER BY idx) FILTER (k), []) AS kept, condition <> 'full' AND count_if(k) = 0 AS failed FROM k GROUP BY video_id, condition")
def c0(spark, sf):
    return conditions.run(_gathered(spark, sf), _SWEEP).drop("reason")


@query("c1_full", "WITH {SEG} SELECT DISTINCT video_id, c AS condition, CAST([] AS INTEGER[]) AS kept, false AS failed FROM seg, (VALUES ('full'), ('full-single')) t(c)")
def c1(spark, sf):
    return conditions.run(_gathered(spark, sf), ["full", "full-single"]).drop("reason")


@query("c15_whole_markers", "WITH {SEG} SELECT video_id, c AS condition, list(idx ORDER BY idx) AS kept, false AS failed FROM seg, (VALUES ('vlm-aggregate'), ('vlm-anchored'), ('vlm-anchored-hybrid')) t(c) GROUP BY video_id, c")
def c15(spark, sf):
    return conditions.run(_gathered(spark, sf), ["vlm-aggregate", "vlm-anchored", "vlm-anchored-hybrid"]).drop("reason")


@query("c19_failure_policy", """WITH {SEG}, v AS (SELECT video_id, count_if(weight >= 0.9) = 0 AS no_strict, bool_or(weight2 >= 0.8) AS unscored FROM seg GROUP BY video_id)
SELECT video_id, 'vlm-strict-0.9' AS condition, false AS retried FROM v WHERE no_strict UNION ALL SELECT video_id, 'motion', true FROM v WHERE unscored""")
def c19(spark, sf):
    selected = conditions.run(_gathered(spark, sf), ["vlm-strict-0.9", "motion"])
    written = conditions.to_write(selected).select("video_id", "condition", F.lit(False).alias("retried"))
    return written.unionByName(conditions.to_retry(selected).withColumn("retried", F.lit(True)))


@query("c13_evenly_spaced", """WITH {SEG}, s AS (SELECT *, CAST(count(*) OVER (PARTITION BY video_id) AS INTEGER) AS n FROM seg)
SELECT video_id, idx FROM s WHERE (n <= 3) OR list_contains([CAST(round_even(i * (n - 1) / 2.0::DOUBLE, 0) AS INTEGER) FOR i IN [0, 1, 2]], idx)""")
def c13(spark, sf):
    return _kept(select.evenly_spaced(segments(spark, sf), F.lit(3)))


def _share(name: str, spark_order, sql_order: str, share: float) -> None:
    sql = f"""WITH {{SEG}}, r AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY {sql_order}, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(dur) OVER (PARTITION BY video_id) AS total FROM seg) SELECT video_id, idx FROM r WHERE before < {share} * total OR before = 0"""
    query(name, sql)(lambda spark, sf: _kept(select.until_share(segments(spark, sf), share, [spark_order()])))


_share("c14_id_vlm_f50", lambda: F.col("weight").desc(), "weight DESC", 0.5)
_share("c14_id_anti_vlm_f30", lambda: F.col("weight").asc(), "weight", 0.3)
_share("c14_id_temporal_f70", lambda: F.col("idx").asc(), "idx", 0.7)
_share("c14_id_motion_f20", lambda: F.col("weight2").desc(), "weight2 DESC", 0.2)
_share("c14_id_random_f50", lambda: F.md5(F.concat_ws("|", F.lit("7"), F.col("video_id").cast("string"), F.col("idx").cast("string"))), "md5('7|' || video_id || '|' || idx)", 0.5)


@query("c16_tolerance", "WITH {SEG} SELECT video_id, greatest(0.05, 0.5 * list_sort(list(dur))[CAST(floor(count(*) / 2) AS INTEGER) + 1])::DOUBLE AS tolerance FROM seg GROUP BY video_id")
def c16(spark, sf):
    return segments(spark, sf).groupBy("video_id").agg(F.collect_list("dur").alias("d")).select("video_id", select.tolerance(F.col("d")).alias("tolerance"))


@query("c17_seed", "WITH {SEG} SELECT DISTINCT video_id, substr(sha256('42|' || video_id || '|random'), 1, 16) AS seed_hex FROM seg")
def c17(spark, sf):
    text = F.concat_ws("|", F.lit("42"), F.col("video_id").cast("string"), F.lit("random"))
    return segments(spark, sf).select("video_id").distinct().select("video_id", F.substring(F.sha2(text, 256), 1, 16).alias("seed_hex"))


@query("c18_shuffled_order", """WITH {SEG} SELECT video_id, idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY md5('42|' || video_id || '|' || idx || '|shuffle')) AS INTEGER) AS position, weight FROM seg""")
def c18(spark, sf):
    key = F.md5(F.concat_ws("|", F.lit("42"), F.col("video_id").cast("string"), F.col("idx").cast("string"), F.lit("shuffle")))
    return segments(spark, sf).select(*KEPT, F.row_number().over(W.partitionBy("video_id").orderBy(key)).alias("position"), "weight")


@query("f3_importance_vector", "WITH {SEG} SELECT video_id, list(coalesce(weight, 0.0) ORDER BY idx) AS importance, count_if(label = 'important') / count(*) AS keep_ratio FROM seg GROUP BY video_id")
def f3(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("weight", F.lit(0.0)).alias("w")))), lambda x: x["w"])
    return segments(spark, sf).groupBy("video_id").agg(ordered.alias("importance"), (F.count_if(F.col("label") == "important") / F.count("*")).alias("keep_ratio"))


@query("f5_min_kept_dropped", "WITH {SEG} SELECT video_id, count(*) AS n FROM seg GROUP BY video_id HAVING count_if(label = 'important') >= 2 AND count_if(label <> 'important') >= 2")
def f5(spark, sf):
    kept = F.count_if(F.col("label") == "important")
    return segments(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"), kept.alias("k")).where("k >= 2 AND n - k >= 2").select("video_id", "n")


@query("f10_complement", "WITH {SEG} SELECT video_id, list_sort(list(idx) FILTER (label <> 'important')) AS removed FROM seg GROUP BY video_id HAVING count_if(label <> 'important') > 0")
def f10(spark, sf):
    everything, kept = F.collect_list("idx"), F.collect_list(F.when(F.col("label") == "important", F.col("idx")))
    by = segments(spark, sf).groupBy("video_id").agg(everything.alias("a"), kept.alias("k"))
    return by.select("video_id", F.array_sort(F.array_except("a", "k")).alias("removed")).where(F.size("removed") > 0)


@query("a13_kept_ratio", "WITH {SEG} SELECT video_id, round(coalesce(sum(dur) FILTER (label = 'important'), 0) / max(end_s), 9) AS kept_ratio FROM seg GROUP BY video_id")
def a13(spark, sf):
    return coverage.kept_ratio(segments(spark, sf)).select("video_id", F.round("kept_ratio", 9).alias("kept_ratio"))


@query("a14_distribution", """WITH {SEG}, r AS (SELECT video_id, sum(dur) FILTER (label = 'important') / max(end_s) AS x FROM seg GROUP BY video_id)
SELECT round(avg(x), 9) AS mean, round(quantile_cont(x, 0.5), 9) AS median, round(min(x), 9) AS min, round(max(x), 9) AS max, round(quantile_cont(x, 0.1), 9) AS p10, round(quantile_cont(x, 0.9), 9) AS p90 FROM r WHERE x IS NOT NULL""")
def a14(spark, sf):
    x = coverage.kept_ratio(segments(spark, sf)).where(F.col("kept_ratio") > 0)
    q = lambda p: F.round(F.percentile("kept_ratio", p), 9)
    return x.agg(F.round(F.avg("kept_ratio"), 9).alias("mean"), q(0.5).alias("median"), F.round(F.min("kept_ratio"), 9).alias("min"), F.round(F.max("kept_ratio"), 9).alias("max"), q(0.1).alias("p10"), q(0.9).alias("p90"))


@query("a26_gini", """WITH {SEG}, r AS (SELECT video_id, weight AS x, row_number() OVER (PARTITION BY video_id ORDER BY weight, idx) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM seg WHERE weight >= 0)
SELECT video_id, round(coalesce(sum((2 * i - n - 1) * x) / nullif(max(n) * sum(x), 0), 0.0), 6) AS gini FROM r GROUP BY video_id""")
def a26(spark, sf):
    return coverage.gini(segments(spark, sf), "video_id", "weight", "idx").select("video_id", F.round("gini", 6).alias("gini"))


@query("a27_temporal_coverage", """WITH {SEG}, k AS (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY idx) AS next_start FROM seg WHERE label = 'important'),
t AS (SELECT video_id, max(end_s) AS total FROM seg GROUP BY video_id)
SELECT k.video_id, round(max(end_s) - min(start_s), 6) AS range_s, round(sum(dur) / max(total), 6) AS coverage_ratio, round(sum(dur * ((start_s + end_s) / 2)) / sum(dur) / max(total), 6) AS com_position,
  round(coalesce(avg(CASE WHEN next_start IS NOT NULL THEN greatest(next_start - end_s, 0) END), 0), 6) AS mean_gap, count(*) AS n FROM k JOIN t USING (video_id) GROUP BY k.video_id""")
def a27(spark, sf):
    return coverage.temporal(segments(spark, sf))


@query("n13_timeline_bins", """WITH {SEG}, t AS (SELECT *, max(end_s) OVER (PARTITION BY video_id) AS total FROM seg), b AS (SELECT unnest(range(10)) AS bin)
SELECT video_id, CAST(bin AS INTEGER) AS bin, round(sum(greatest(0, least(end_s, (bin + 1) * total / 10) - greatest(start_s, bin * total / 10))), 6) AS covered FROM t, b WHERE label = 'important' GROUP BY video_id, bin""")
def n13(spark, sf):
    return coverage.timeline(segments(spark, sf), 10)


@query("a28_mean_std", "WITH {SEG} SELECT label, round(avg(weight), 9) AS mean, round(stddev_pop(weight), 9) AS std FROM seg GROUP BY label")
def a28(spark, sf):
    return segments(spark, sf).groupBy("label").agg(F.round(F.avg("weight"), 9).alias("mean"), F.round(F.stddev_pop("weight"), 9).alias("std"))


@query("a60_label_summary", "WITH {SEG} SELECT video_id, count(*) AS total, count_if(label = 'important') AS important, round(count_if(label = 'important') / count(*), 9) AS important_ratio FROM seg GROUP BY video_id")
def a60(spark, sf):
    n = F.count_if(F.col("label") == "important")
    return segments(spark, sf).groupBy("video_id").agg(F.count("*").alias("total"), n.alias("important"), F.round(n / F.count("*"), 9).alias("important_ratio"))


@query("a61_inclusion_frequency", "WITH {SEG} SELECT video_id, idx, (CASE WHEN label = 'important' THEN 1 ELSE 0 END + CASE WHEN weight >= 0.5 THEN 1 ELSE 0 END + CASE WHEN weight2 >= 0.4 THEN 1 ELSE 0 END) / 3 AS frequency FROM seg")
def a61(spark, sf):
    hits = [F.col("label") == "important", F.col("weight") >= 0.5, F.col("weight2") >= 0.4]
    return segments(spark, sf).select(*KEPT, (sum(h.cast("int") for h in hits) / len(hits)).alias("frequency"))


@query("a64_histogram", "WITH {SEG} SELECT CAST(least(floor(weight * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM seg WHERE weight BETWEEN 0 AND 1 GROUP BY bin")
def a64(spark, sf):
    return coverage.histogram(segments(spark, sf), "weight", 0.0, 1.0, 20)


@query("n12_point_in_interval", """WITH {SEG}, o AS (SELECT o_orderkey AS video_id, o_orderkey % 37 + 0.5 AS t FROM orders)
SELECT o.video_id, t::DOUBLE AS t, min(idx) AS idx FROM o JOIN seg ON o.video_id = seg.video_id AND t BETWEEN start_s AND end_s GROUP BY o.video_id, t""")
def n12(spark, sf):
    points = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 37 + 0.5).cast("double").alias("t"))
    return coverage.locate(points, segments(spark, sf))


@query("a71_mean_importance", """WITH {SEG}, p AS (SELECT o_orderkey AS video_id, unnest([1.5, 7.5, 20.5, 33.5]) AS t FROM orders), m AS (SELECT p.video_id, p.t, min_by(weight, idx) AS w FROM p LEFT JOIN seg ON p.video_id = seg.video_id AND t BETWEEN start_s AND end_s GROUP BY p.video_id, p.t)
SELECT video_id, round(avg(coalesce(w, 0)), 9) AS importance FROM m GROUP BY video_id""")
def a71(spark, sf):
    points = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("video_id"), F.explode(F.array(*map(F.lit, (1.5, 7.5, 20.5, 33.5)))).alias("t"))
    return coverage.mean_at(points, segments(spark, sf))


@query("r1_fixed_segments", """WITH d AS (SELECT o_orderkey AS video_id, (o_orderkey % 50 + 1) / 4 AS duration FROM orders), k AS (SELECT *, unnest(range(CAST(ceil(duration / 2) AS BIGINT))) AS idx FROM d)
SELECT video_id, CAST(idx AS INTEGER) AS idx, (idx * 2.0)::DOUBLE AS start_s, least((idx + 1) * 2.0::DOUBLE, duration) AS end_s FROM k""")
def r1(spark, sf):
    d = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("video_id"), ((F.col("o_orderkey") % 50 + 1) / 4).alias("duration"))
    return allocate.fixed_segments(d, "duration", 2.0)


@query("r2_frame_ranges", "WITH {SEG} SELECT video_id, idx, CAST(floor(start_s * 2.5) AS INTEGER) AS first, CAST(floor(end_s * 2.5) AS INTEGER) AS last FROM seg")
def r2(spark, sf):
    return segments(spark, sf).select(*KEPT, *allocate.frame_range(F.col("start_s"), F.col("end_s"), 2.5))


@query("r3_largest_remainder", """WITH {SEG}, i AS (SELECT video_id, idx, 16 * dur / sum(dur) OVER v AS exact, count(*) OVER v AS n FROM seg WHERE label = 'important' WINDOW v AS (PARTITION BY video_id)), b AS (SELECT *, CAST(round_even(exact, 0) AS INTEGER) AS base FROM i),
g AS (SELECT *, 16 - CAST(sum(base) OVER (PARTITION BY video_id) AS INTEGER) AS gap FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY (exact - base) * sign(gap) DESC, idx) AS place FROM g)
SELECT video_id, idx, CAST(base + sign(gap) * CASE WHEN place <= abs(gap) THEN floor((abs(gap) - place) / n) + 1 ELSE 0 END AS INTEGER) AS seats FROM p""")
def r3(spark, sf):
    return allocate.apportion(select.important(segments(spark, sf)), "video_id", "idx", "dur", 16)


@query("r4_uniform_starts", """SELECT o_orderkey AS video_id, [CAST(round_even(i * (o_orderkey % 100) / 3.0::DOUBLE, 0) AS INTEGER) FOR i IN [0, 1, 2, 3]] AS starts FROM orders""")
def r4(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("video_id"), allocate.uniform_starts(F.col("o_orderkey") % 100, 4).alias("starts"))


@query("r7_importance_quantiles", """WITH {SEG}, c AS (SELECT video_id, idx, sum(weight) OVER (PARTITION BY video_id ORDER BY idx) AS cum, sum(weight) OVER (PARTITION BY video_id) AS total FROM seg), q AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q)
SELECT video_id, q, min(idx) AS idx FROM c, q WHERE total > 0 AND round(cum, 9) >= round(q * total, 9) GROUP BY video_id, q""")
def r7(spark, sf):
    return allocate.importance_quantiles(segments(spark, sf), [0.25, 0.5, 0.75])


#: One item after the other, all blocks at once: the first bin with room for it, or a new one.
_FIRST_FIT = """WITH RECURSIVE {SEG}, items AS (SELECT video_id // 128 AS shard, video_id, idx, dur, row_number() OVER (PARTITION BY video_id // 128 ORDER BY dur DESC, video_id, idx) AS k FROM seg),
packed AS (SELECT DISTINCT shard, CAST(0 AS BIGINT) AS k, []::DOUBLE[] AS room, []::INTEGER[] AS held, CAST(0 AS BIGINT) AS bin, CAST(NULL AS BIGINT) AS video_id, CAST(NULL AS INTEGER) AS idx FROM items
UNION ALL SELECT shard, k, CASE WHEN p > len(room) THEN list_append(room, 100 - dur) ELSE [CASE WHEN j = p THEN room[j] - dur ELSE room[j] END FOR j IN range(1, len(room) + 1)] END, CASE WHEN p > len(room) THEN list_append(held, 1) ELSE [CASE WHEN j = p THEN held[j] + 1 ELSE held[j] END FOR j IN range(1, len(room) + 1)] END, p - 1, video_id, idx
  FROM (SELECT s.shard, i.k, room, held, i.dur, i.video_id, i.idx, coalesce(list_min([j FOR j IN range(1, len(room) + 1) IF room[j] >= i.dur AND held[j] < 8]), len(room) + 1) AS p FROM packed s JOIN items i ON s.shard = i.shard AND i.k = s.k + 1))
SELECT shard, video_id, idx, CAST(bin AS INTEGER) AS bin FROM packed WHERE k > 0"""


@query("r13_first_fit_decreasing", _FIRST_FIT)
def r13(spark, sf):
    """Videos in blocks of 128, whatever the table's size."""
    items = segments(spark, sf).withColumn("shard", F.floor(F.col("video_id") / 128))
    return allocate.first_fit_decreasing(items, "shard", ["video_id", "idx"], "dur", 100.0, 8)


@query("r14_token_cost", "SELECT p_partkey, CAST(ceil(p_size / 2.0) * 28 * 28 AS BIGINT) * 16 + 2300 AS cost FROM part")
def r14(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", (F.ceil(F.col("p_size") / 2.0) * 28 * 28 * 16 + 2300).cast("long").alias("cost"))


@query("w8_carry_forward", """WITH {SEG} SELECT video_id, idx, last_value(CASE WHEN label = 'important' THEN idx END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM seg""")
def w8(spark, sf):
    order = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return segments(spark, sf).select(*KEPT, F.last(F.when(F.col("label") == "important", F.col("idx")), ignorenulls=True).over(order).alias("shown"))


@query("g3_mask_hash", "WITH {SEG} SELECT video_id, substr(md5(string_agg(CASE WHEN label = 'important' THEN '1' ELSE '0' END, '' ORDER BY idx)), 1, 16) AS mask_hash FROM seg GROUP BY video_id")
def g3(spark, sf):
    bits = F.array_sort(F.collect_list(F.struct("idx", F.when(F.col("label") == "important", "1").otherwise("0").alias("b"))))
    return segments(spark, sf).groupBy("video_id").agg(F.substring(F.md5(F.array_join(F.transform(bits, lambda x: x["b"]), "")), 1, 16).alias("mask_hash"))


@query("g5_confidence", "WITH {SEG} SELECT video_id, idx, round(1 / (1 + exp(-least(100, greatest(-100, weight - weight2)))), 9) AS confidence FROM seg")
def g5(spark, sf):
    gap = F.least(F.lit(100.0), F.greatest(F.lit(-100.0), F.col("weight") - F.col("weight2")))
    return segments(spark, sf).select(*KEPT, F.round(1 / (1 + F.exp(-gap)), 9).alias("confidence"))


@query("a62_corpus_distribution", "WITH {SEG}, v AS (SELECT video_id, count(*) AS n, sum(dur) AS d, count_if(label = 'important') / count(*) AS f FROM seg GROUP BY video_id) SELECT n AS segments, count(*) AS videos, round(avg(f), 9) AS kept, round(avg(d), 9) AS duration FROM v GROUP BY n")
def a62(spark, sf):
    v = segments(spark, sf).groupBy("video_id").agg(F.count("*").alias("segments"), F.sum("dur").alias("d"), (F.count_if(F.col("label") == "important") / F.count("*")).alias("f"))
    return v.groupBy("segments").agg(F.count("*").alias("videos"), F.round(F.avg("f"), 9).alias("kept"), F.round(F.avg("d"), 9).alias("duration"))


@query("a63_class_medians", """WITH {SEG}, v AS (SELECT video_id, count_if(label = 'important') / count(*) AS f FROM seg GROUP BY video_id)
SELECT o_orderpriority AS class, round(quantile_cont(f, 0.5), 9) AS median FROM v JOIN orders ON video_id = o_orderkey GROUP BY class""")
def a63(spark, sf):
    v = segments(spark, sf).groupBy("video_id").agg((F.count_if(F.col("label") == "important") / F.count("*")).alias("f"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("class"))
    return v.join(o, "video_id").groupBy("class").agg(F.round(F.median("f"), 9).alias("median"))


@query("a15_trapezoid_auc", """WITH {SEG}, p AS (SELECT video_id, start_s AS x, weight AS y, lag(start_s) OVER w AS px, lag(weight) OVER w AS py, count(*) OVER (PARTITION BY video_id) AS n FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY start_s))
SELECT video_id, round(sum((x - px) * (y + py) / 2), 6) AS auc FROM p WHERE n >= 2 GROUP BY video_id""")
def a15(spark, sf):
    return coverage.trapezoid(segments(spark, sf), ["video_id"], "start_s", "weight").select("video_id", F.round("auc", 6).alias("auc")).where(F.col("auc").isNotNull())


@query("a66_argmax", "WITH {SEG} SELECT video_id, idx, weight FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY weight DESC, idx) AS k FROM seg) WHERE k = 1")
def a66(spark, sf):
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("idx"), F.col("weight"))).alias("x")
    return segments(spark, sf).groupBy("video_id").agg(best).select("video_id", "x.idx", "x.weight")


@query("n14_frames_in_kept", """WITH {SEG}, f AS (SELECT DISTINCT video_id, unnest([2.0, 11.0, 29.0])::DOUBLE AS t FROM seg)
SELECT video_id, t FROM f WHERE EXISTS (SELECT 1 FROM seg WHERE seg.video_id = f.video_id AND label = 'important' AND f.t >= start_s AND f.t < end_s)""")
def n14(spark, sf):
    s = segments(spark, sf)
    f = s.select("video_id").distinct().select("video_id", F.explode(F.array(F.lit(2.0), F.lit(11.0), F.lit(29.0))).alias("t"))
    kept = select.important(s).select(F.col("video_id").alias("v"), "start_s", "end_s")
    return f.join(kept, (F.col("video_id") == F.col("v")) & (F.col("t") >= F.col("start_s")) & (F.col("t") < F.col("end_s")), "left_semi")


@query("r9_linspace", """WITH p AS (SELECT p_partkey, p_size AS n FROM part WHERE p_size > 0)
SELECT p_partkey, list_concat([CAST(round_even(i * (n - 1) / greatest(least(n, 8) - 1, 1)::DOUBLE, 0) AS INTEGER) FOR i IN range(least(n, 8))], [CAST(n - 1 AS INTEGER) FOR i IN range(greatest(8 - n, 0))]) AS places FROM p""")
def r9(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").where("p_size > 0").select("p_partkey", allocate.linspace(F.col("p_size"), 8).alias("places"))


@query("r10_strided", "SELECT p_partkey, [CAST(round_even(i * 2.5::DOUBLE, 0) AS INTEGER) FOR i IN range(CAST(ceil(p_size / 2.5) AS BIGINT)) IF round_even(i * 2.5::DOUBLE, 0) < p_size] AS places FROM part WHERE p_size > 0")
def r10(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").where("p_size > 0").select("p_partkey", allocate.strided(F.col("p_size"), 2.5).alias("places"))


@query("r5_kept_frames", """WITH {SEG} SELECT video_id, list_sort(flatten(list(range(CAST(start_s AS BIGINT), CAST(end_s AS BIGINT))))) AS frames FROM seg WHERE label = 'important' GROUP BY video_id""")
def r5(spark, sf):
    frames = F.sequence(F.col("start_s").cast("long"), F.col("end_s").cast("long") - 1)
    return select.important(segments(spark, sf)).groupBy("video_id").agg(F.array_sort(F.flatten(F.collect_list(frames))).alias("frames"))


@query("r6_thinned_frames", """WITH {SEG}, w AS (SELECT video_id, idx, CAST(greatest(round_even(start_s / 2, 0), 0) AS INTEGER) AS a, CAST(least(round_even(end_s / 2, 0), 79) AS INTEGER) AS b, CASE WHEN label = 'important' THEN 1.0 ELSE 0.25 END::DOUBLE AS density FROM seg),
n AS (SELECT *, b - a + 1 AS n, greatest(CAST(round_even((b - a + 1) * density, 0) AS INTEGER), 1) AS m FROM w)
SELECT video_id, idx, CASE WHEN b < a THEN [] WHEN m >= n THEN range(a, b + 1)::INTEGER[] ELSE [a + CAST(round_even(i * (n - 1) / greatest(m - 1, 1)::DOUBLE, 0) AS INTEGER) FOR i IN range(m)] END AS frames FROM n""")
def r6(spark, sf):
    s = select.fast_forward(segments(spark, sf), 0.25)
    return s.select(*KEPT, allocate.thinned_frames(F.col("start_s"), F.col("end_s"), F.col("played"), 0.5, F.lit(80)).alias("frames"))


@query("w6_importance_cdf", "WITH {SEG} SELECT video_id, idx, round(sum(weight) OVER (PARTITION BY video_id ORDER BY idx), 6) AS cdf FROM seg")
def w6(spark, sf):
    order = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return segments(spark, sf).select(*KEPT, F.round(F.sum("weight").over(order), 6).alias("cdf"))


@query("n8_shared_pairs", """WITH {REC} SELECT a.condition AS a, b.condition AS b, count(*) AS n, round(avg(a.value - b.value), 9) + 0.0::DOUBLE AS gap FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition < b.condition GROUP BY a.condition, b.condition HAVING count(*) >= 10""")
def n8(spark, sf):
    from keelson.operators.align import unordered_pairs
    from keelson.plans.bindings import recognition

    pairs = unordered_pairs(recognition(spark, sf), "video_id", "condition", ["value"]).groupBy("a", "b")
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.col("value_a") - F.col("value_b")), 9).alias("gap")).where("n >= 10")


@query("r6_weighted_clips", """WITH {SEG}, w AS (SELECT video_id, idx, CAST(greatest(round_even(start_s / 2, 0), 0) AS INTEGER) AS a, CAST(least(round_even(end_s / 2, 0), 79) AS INTEGER) AS b, CASE WHEN label = 'important' THEN 1.0 ELSE 0.25 END::DOUBLE AS density FROM seg),
n AS (SELECT *, b - a + 1 AS n, greatest(CAST(round_even((b - a + 1) * density, 0) AS INTEGER), 1) AS m FROM w),
p AS (SELECT video_id, flatten(list(CASE WHEN b < a THEN [] WHEN m >= n THEN range(a, b + 1)::INTEGER[] ELSE [a + CAST(round_even(i * (n - 1) / greatest(m - 1, 1)::DOUBLE, 0) AS INTEGER) FOR i IN range(m)] END ORDER BY idx)) AS pool FROM n GROUP BY video_id),
q AS (SELECT video_id, CASE WHEN len(pool) > 0 THEN pool ELSE [0] END AS pool FROM p)
SELECT video_id, CAST(clip AS INTEGER) AS clip, CASE WHEN len(pool) > 16 THEN list_slice(pool, 1 + CAST(round_even(clip * (len(pool) - 16) / 2.0::DOUBLE, 0) AS BIGINT), 16 + CAST(round_even(clip * (len(pool) - 16) / 2.0::DOUBLE, 0) AS BIGINT))
  ELSE list_concat(pool, [pool[len(pool)] FOR i IN range(16 - len(pool))]) END AS frames FROM q, (SELECT unnest(range(3)) AS clip)""")
def r6_clips(spark, sf):
    s = select.fast_forward(segments(spark, sf), 0.25)
    frames = allocate.thinned_frames(F.col("start_s"), F.col("end_s"), F.col("played"), 0.5, F.lit(80))
    pools = s.groupBy("video_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", frames.alias("f")))), lambda x: x["f"])).alias("pool"))
    return pools.select("video_id", F.posexplode(allocate.pooled_clips(F.col("pool"), 16, 3)).alias("clip", "frames"))


@query("r8_hybrid_starts", """WITH {SEG}, v AS (SELECT video_id, CAST(ceil(max(end_s) / 2) AS INTEGER) AS n, list(struct_pack(a := round_even(start_s / 2, 0), b := round_even(end_s / 2, 0), w := CAST(round(weight * 10) AS BIGINT)) ORDER BY idx) AS items FROM seg GROUP BY video_id),
f AS (SELECT video_id, n, unnest(range(n)) AS f, items FROM v), w AS (SELECT video_id, n, f, coalesce(list_filter(items, lambda x: x.a <= f AND f <= x.b)[-1].w, 0) AS w FROM f),
c AS (SELECT *, sum(w) OVER (PARTITION BY video_id ORDER BY f) AS cum, sum(w) OVER (PARTITION BY video_id) AS total, greatest(n - 16, 0) AS last FROM w),
s AS (SELECT video_id, last, max(total) AS total, least(count_if(cum < 0.25::DOUBLE * total), last) AS q1, least(count_if(cum < 0.75::DOUBLE * total), last) AS q3 FROM c GROUP BY video_id, last)
SELECT video_id, CASE WHEN total > 0 THEN list_sort([q1, q3, 0, last])::INTEGER[] ELSE [CAST(round_even(i * last / 3.0::DOUBLE, 0) AS INTEGER) FOR i IN range(4)] END AS starts FROM s""")
def r8(spark, sf):
    item = F.struct("idx", "start_s", "end_s", F.round(F.col("weight") * 10).alias("weight"))
    by = segments(spark, sf).groupBy("video_id").agg(F.ceil(F.max("end_s") / 2).cast("int").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    return by.select("video_id", allocate.hybrid_starts(F.col("items"), F.col("n"), 0.5, 4, 16).alias("starts"))


@query("r16_tiles", """WITH g AS (SELECT i, j FROM (SELECT unnest(range(1, 7)) AS i), (SELECT unnest(range(1, 7)) AS j) WHERE i * j <= 6), p AS (SELECT p_partkey, p_size * 40 AS w, (p_partkey % 9 + 1) * 120 AS h FROM part),
d AS (SELECT *, abs(w / h - i / j) AS off, w * h > 0.5 * 448 * 448 * i * j AS fits FROM p, g), n AS (SELECT *, min(off) OVER (PARTITION BY p_partkey) AS best FROM d)
SELECT p_partkey, CAST(i AS INTEGER) AS "columns", CAST(j AS INTEGER) AS "rows" FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY fits DESC, CASE WHEN fits THEN -i * j ELSE i * j END, CASE WHEN fits THEN -i ELSE i END) AS k FROM n WHERE off = best) WHERE k = 1""")
def r16(spark, sf):
    grid = allocate.tiles(F.col("p_size") * 40, (F.col("p_partkey") % 9 + 1) * 120, most=6)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", grid.alias("g")).select("p_partkey", "g.columns", "g.rows")
