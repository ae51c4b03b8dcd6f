"""Agreement between two raters' weights and between their kept sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import agreement as g
from keelson.operators.permute import null_by_trial, null_summary
from keelson.operators.resample import MIX, STRIDE
from keelson.plans.bindings import query, segments
from keelson.session import table

_SETS = """WITH {SEG}, s AS (SELECT video_id, coalesce(list(idx) FILTER (weight >= 0.5), []) AS a, coalesce(list(idx) FILTER (weight2 >= 0.4), []) AS b FROM seg GROUP BY video_id),
m AS (SELECT video_id, a, b, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM s)"""


def _sets(spark, sf):
    kept = lambda test: F.collect_list(F.when(test, F.col("idx")))
    return segments(spark, sf).groupBy("video_id").agg(kept(F.col("weight") >= 0.5).alias("a"), kept(F.col("weight2") >= 0.4).alias("b"))


_PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"


@query("a29_pearson", "WITH {SEG}, p AS (SELECT video_id, weight AS x, weight2 AS y FROM seg) SELECT video_id, 0.0::DOUBLE + round(" + _PEARSON + ", 9) AS r FROM p GROUP BY video_id")
def a29(spark, sf):
    return segments(spark, sf).groupBy("video_id").agg(F.round(g.pearson(F.col("weight"), F.col("weight2")), 9).alias("r"))


@query("a31_spearman_average", """WITH {SEG}, p AS (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY weight) + (count(*) OVER (PARTITION BY video_id, weight) - 1) / 2 AS x,
  rank() OVER (PARTITION BY video_id ORDER BY weight2) + (count(*) OVER (PARTITION BY video_id, weight2) - 1) / 2 AS y FROM seg) SELECT video_id, 0.0::DOUBLE + round(""" + _PEARSON + ", 6) AS rho FROM p GROUP BY video_id")
def a31(spark, sf):
    return g.spearman(segments(spark, sf), ["video_id"], "weight", "weight2").select("video_id", F.round("rho", 6).alias("rho"))


@query("a32_spearman_ordinal", """WITH {SEG}, p AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY weight, idx)::DOUBLE AS x, row_number() OVER (PARTITION BY video_id ORDER BY weight2, idx)::DOUBLE AS y FROM seg)
SELECT video_id, 0.0::DOUBLE + round(""" + _PEARSON + ", 6) AS rho FROM p GROUP BY video_id")
def a32(spark, sf):
    return g.spearman(segments(spark, sf), ["video_id"], "weight", "weight2", ties="ordinal").select("video_id", F.round("rho", 6).alias("rho"))


@query("a33_spearman_zero", """WITH {SEG}, p AS (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY weight) + (count(*) OVER (PARTITION BY video_id, weight) - 1) / 2 AS x,
  rank() OVER (PARTITION BY video_id ORDER BY weight2) + (count(*) OVER (PARTITION BY video_id, weight2) - 1) / 2 AS y FROM seg) SELECT video_id, coalesce(0.0::DOUBLE + round(""" + _PEARSON + ", 6), 0) AS rho FROM p GROUP BY video_id")
def a33(spark, sf):
    return g.spearman(segments(spark, sf), ["video_id"], "weight", "weight2").select("video_id", F.coalesce(F.round("rho", 6), F.lit(0.0)).alias("rho"))


@query("a34_kendall_tau_b", """WITH {SEG}, p AS (SELECT x.video_id, sign(x.weight - y.weight) AS a, sign(x.weight2 - y.weight2) AS b FROM seg x JOIN seg y ON x.video_id = y.video_id AND x.idx < y.idx),
c AS (SELECT video_id, sum(a * b) AS s, count_if(a <> 0) AS na, count_if(b <> 0) AS nb FROM p GROUP BY video_id)
SELECT v.video_id, 0.0::DOUBLE + round(s / nullif(sqrt(na * nb), 0), 6) AS tau FROM (SELECT DISTINCT video_id FROM seg) v LEFT JOIN c USING (video_id)""")
def a34(spark, sf):
    return g.kendall(segments(spark, sf), "video_id", "weight", "weight2").select("video_id", F.round("tau", 6).alias("tau"))


def _jaccard(name, empty, sql_empty):
    query(name, _SETS + f" SELECT video_id, CASE WHEN u = 0 THEN {sql_empty} ELSE round(i / u, 9) END AS jaccard FROM m")(
        lambda spark, sf: _sets(spark, sf).select("video_id", F.round(g.jaccard(F.col("a"), F.col("b"), empty), 9).alias("jaccard"))
    )


_jaccard("a35_jaccard_empty_zero", 0.0, "0.0")
_jaccard("a36_jaccard_empty_excluded", None, "NULL")
_jaccard("a37_label_iou", 1.0, "1.0")


@query("a38_set_f1", _SETS + " SELECT video_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(2 * i / (len(a) + len(b)), 9) END AS f1 FROM m")
def a38(spark, sf):
    return _sets(spark, sf).select("video_id", F.round(g.set_f1(F.col("a"), F.col("b")), 9).alias("f1"))


@query("a39_top_k_overlap", """WITH {SEG}, r AS (SELECT video_id, count_if(weight >= 0.5) OVER (PARTITION BY video_id) AS k, row_number() OVER (PARTITION BY video_id ORDER BY weight DESC, idx) AS ra, row_number() OVER (PARTITION BY video_id ORDER BY weight2 DESC, idx) AS rb FROM seg)
SELECT video_id, count_if(ra <= k AND rb <= k) / max(k) AS overlap FROM r GROUP BY video_id HAVING max(k) > 0""")
def a39(spark, sf):
    from pyspark.sql import Window as W

    by = W.partitionBy("video_id")
    k = F.sum((F.col("weight") >= 0.5).cast("int")).over(by)
    rank = lambda w: F.row_number().over(by.orderBy(F.desc(w), "idx"))
    r = segments(spark, sf).select("video_id", k.alias("k"), rank("weight").alias("ra"), rank("weight2").alias("rb")).where("k > 0")
    return r.groupBy("video_id").agg((F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k"))) / F.max("k")).alias("overlap"))


@query("a40_keep_ratio_mae", _SETS + ", n AS (SELECT video_id, count(*) AS n FROM seg GROUP BY video_id) SELECT round(avg(abs(len(a) - len(b)) / n), 9) AS mae, count(*) AS videos FROM s JOIN n USING (video_id)")
def a40(spark, sf):
    s = segments(spark, sf)
    x = _sets(spark, sf).join(s.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    return x.agg(F.round(F.avg(F.abs(F.size("a") - F.size("b")) / F.col("n")), 9).alias("mae"), F.count("*").alias("videos"))


@query("a42_agreement_by_group", """WITH {SEG}, s AS (SELECT video_id, coalesce(list(idx) FILTER (weight >= 0.5), []) AS a, coalesce(list(idx) FILTER (weight2 >= 0.4), []) AS b FROM seg GROUP BY video_id),
m AS (SELECT o_orderpriority AS dataset, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM s JOIN orders ON video_id = o_orderkey)
SELECT coalesce(dataset, 'all') AS dataset, round(avg(CASE WHEN u = 0 THEN 0 ELSE i / u END), 9) AS jaccard, count(*) AS videos FROM m GROUP BY GROUPING SETS ((), (dataset))""")
def a42(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("dataset"))
    x = _sets(spark, sf).join(o, "video_id").select("dataset", g.jaccard(F.col("a"), F.col("b"), 0.0).alias("j"))
    return x.rollup("dataset").agg(F.round(F.avg("j"), 9).alias("jaccard"), F.count("*").alias("videos")).withColumn("dataset", F.coalesce("dataset", F.lit("all")))


@query("a44_cohen_kappa", """WITH {SEG}, p AS (SELECT (weight >= 0.5)::INT AS a, (weight2 >= 0.4)::INT AS b FROM seg), m AS (SELECT avg(a) AS pa, avg(b) AS pb, avg((a = b)::INT) AS po FROM p)
SELECT round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM m""")
def a44(spark, sf):
    return segments(spark, sf).agg(F.round(g.kappa(F.col("weight") >= 0.5, F.col("weight2") >= 0.4), 9).alias("kappa"))


@query("a45_kappa_by_class", """WITH {SEG}, p AS (SELECT o_orderpriority AS class, video_id, (weight >= 0.5)::INT AS a, (weight2 >= 0.4)::INT AS b FROM seg JOIN orders ON video_id = o_orderkey),
m AS (SELECT class, count(DISTINCT video_id) AS videos, avg(a) AS pa, avg(b) AS pb, avg((a = b)::INT) AS po FROM p GROUP BY class HAVING count(DISTINCT video_id) >= 10)
SELECT class, videos, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM m""")
def a45(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("class"))
    by = segments(spark, sf).join(o, "video_id").groupBy("class")
    return by.agg(F.count_distinct("video_id").alias("videos"), F.round(g.kappa(F.col("weight") >= 0.5, F.col("weight2") >= 0.4), 9).alias("kappa")).where("videos >= 10")


TRIALS = 200
_RANK = "rank() OVER ({0} ORDER BY {1}) + (count(*) OVER ({0}, {1}) - 1) / 2"


def _mixed_sql(source: str, name: str) -> str:
    """Steps that mix column x of a relation, name0 and on; name2 is the last."""
    steps = []
    for i, (shift, factor) in enumerate(MIX):
        steps.append(f"{name}{i} AS (SELECT * EXCLUDE (x), (xor(x, x >> {shift}) * {factor}) % 4294967296 AS x FROM {source})")
        source = f"{name}{i}"
    return ", ".join(steps)


#: p is the place that place i's weight is shuffled to in trial t.
_NULL = f"""WITH {{SEG}}, g AS (SELECT video_id, weight AS a, weight2 AS b, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS i, md5('7|' || video_id) AS d FROM seg),
r AS (SELECT *, {_RANK.format('PARTITION BY video_id', 'a')} AS ra, {_RANK.format('PARTITION BY video_id', 'b')} AS rb, b >= 0.4 AS kb, count_if(a >= 0.5) OVER (PARTITION BY video_id) AS kept FROM g),
k AS (SELECT DISTINCT video_id, d, t, (('0x' || substr(d, 1, 8))::UBIGINT + (t + 1) * {STRIDE}) % 4294967296 AS x FROM r, (SELECT range::UBIGINT AS t FROM range({TRIALS}))), {_mixed_sql('k', 'h')},
q AS (SELECT r.video_id, t, i, a, ra, kept, (xor(('0x' || substr(r.d, 9, 8))::UBIGINT, x) + i::UBIGINT * {STRIDE}) % 4294967296 AS x FROM r JOIN h2 USING (video_id)), {_mixed_sql('q', 'm')},
s AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY x, i) - 1 AS p FROM m2),
u AS (SELECT s.video_id, CAST(t AS INTEGER) AS trial, s.ra AS x, r.rb AS y, row_number() OVER (PARTITION BY s.video_id, t ORDER BY s.a DESC, p) <= s.kept AS ka, r.kb FROM s JOIN r ON s.video_id = r.video_id AND s.p = r.i UNION ALL SELECT video_id, -1, ra, rb, a >= 0.5, kb FROM r),
v AS (SELECT trial, video_id, {_PEARSON} AS rho, count_if(ka AND kb) / greatest(1, count_if(ka OR kb)) AS jaccard FROM u GROUP BY trial, video_id),
n AS (SELECT trial, round(avg(rho), 9) AS rho, round(avg(jaccard), 9) AS jaccard, count(*) AS n FROM v GROUP BY trial)
"""
_OF = lambda c: f"max({c}) FILTER (trial < 0) + 0.0::DOUBLE AS {c}_observed, list_sort(list({c}) FILTER (trial >= 0))[CAST(floor({TRIALS - 1} * 0.95) AS INTEGER) + 1] + 0.0::DOUBLE AS {c}_p95, round((count_if(trial >= 0 AND {c} >= (SELECT {c} FROM n WHERE trial < 0)) + 1) / {TRIALS + 1}, 9) AS {c}_p"


def _null(spark, sf):
    """Videos of two raters: weights, and what each keeps."""
    item = F.struct("idx", "weight", "weight2")
    by = segments(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    part = lambda f: F.transform("s", f)
    return null_by_trial(by.select("video_id", part(lambda x: x["weight"]).alias("a"), part(lambda x: x["weight2"]).alias("b"), part(lambda x: x["weight"] >= 0.5).alias("kept_a"), part(lambda x: x["weight2"] >= 0.4).alias("kept_b")), "video_id", TRIALS, 7)


@query("a46_permutation_null", _NULL + f"SELECT CAST(max(n) AS BIGINT) AS n, {_OF('rho')}, {_OF('jaccard')} FROM n")
def a46(spark, sf):
    """Spearman's rho and the Jaccard similarity against shuffles of the first rater's weights within each video."""
    return _null(spark, sf).agg(F.max("n").alias("n"), *null_summary("rho"), *null_summary("jaccard"))


@query("a48_disagreement", """WITH {SEG}, p AS (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY weight) + (count(*) OVER (PARTITION BY video_id, weight) - 1) / 2 AS x,
  rank() OVER (PARTITION BY video_id ORDER BY weight2) + (count(*) OVER (PARTITION BY video_id, weight2) - 1) / 2 AS y FROM seg), r AS (SELECT video_id, """ + _PEARSON + """ AS rho FROM p GROUP BY video_id)
SELECT video_id, 0.0::DOUBLE + round(1 - rho, 6) AS disagreement FROM r WHERE rho IS NOT NULL""")
def a48(spark, sf):
    rho = g.spearman(segments(spark, sf), ["video_id"], "weight", "weight2")
    return rho.where(F.col("rho").isNotNull()).select("video_id", F.round(1 - F.col("rho"), 6).alias("disagreement"))
