"""Paired experiments over recognition records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators import align, order, paired, resample
from keelson.operators.agreement import pearson
from keelson.plans.bindings import all_events, query, recognition, weights_sql
from keelson.session import materialize, table

COMPARED = ["click", "error", "purchase", "signup"]


def _aligned(spark, sf):
    """Records of the videos that have every condition and no failed one."""
    rows = recognition(spark, sf)
    rows = rows.join(align.eligible(rows, "video_id", "failed"), "video_id", "left_semi")
    return rows.join(align.having_all(recognition(spark, sf), "video_id", "condition"), "video_id", "left_semi")


def _matrix(spark, sf, value="top1"):
    """Aligned and eligible: one row a video, one column for each condition that is compared."""
    return align.matrix(_aligned(spark, sf).withColumn(value, F.col(value).cast("int")), "video_id", "condition", COMPARED, value)


_ALIGNED = """WITH {REC}, ok AS (SELECT video_id FROM rec GROUP BY video_id HAVING count(DISTINCT condition) = (SELECT count(DISTINCT event_type) FROM events) AND NOT bool_or(failed)),
al AS (SELECT rec.* FROM rec JOIN ok USING (video_id))"""


@query("s1_last_write_wins", "WITH {REC} SELECT event_id, video_id, condition, top1, top5 FROM rec")
def s1(spark, sf):
    return recognition(spark, sf).select("event_id", "video_id", "condition", "top1", "top5")


@query("n1_aligned_videos", "WITH {REC} SELECT video_id FROM rec GROUP BY video_id HAVING count(DISTINCT condition) = (SELECT count(DISTINCT event_type) FROM events)")
def n1(spark, sf):
    return align.having_all(recognition(spark, sf), "video_id", "condition")


@query("f1_eligible", "WITH {REC} SELECT video_id FROM rec GROUP BY video_id HAVING NOT bool_or(failed)")
def f1(spark, sf):
    return align.eligible(recognition(spark, sf), "video_id", "failed")


@query("a1_accuracy", "WITH {REC} SELECT condition, count(*) AS n, count_if(failed) AS failed, round(count_if(top1 AND NOT failed) / greatest(1, count_if(NOT failed)), 9) AS top1, round(count_if(top5 AND NOT failed) / greatest(1, count_if(NOT failed)), 9) AS top5 FROM rec GROUP BY condition")
def a1(spark, sf):
    scored = F.greatest(F.lit(1), F.count_if(~F.col("failed")))
    rate = lambda c: F.round(F.count_if(F.col(c) & ~F.col("failed")) / scored, 9).alias(c)
    return recognition(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), rate("top1"), rate("top5"))


@query("a2_arm_summary", "WITH {REC} SELECT condition, count(*) AS n, count_if(NOT failed) AS parsed, round(coalesce(count_if(failed) / nullif(count(*), 0), 0), 9) AS failure_rate FROM rec GROUP BY condition")
def a2(spark, sf):
    return recognition(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.count_if(~F.col("failed")).alias("parsed"), F.round(F.coalesce(F.try_divide(F.count_if("failed"), F.count("*")), F.lit(0.0)), 9).alias("failure_rate"))


@query("a4_top1_agreement", "WITH {REC} SELECT a.condition AS a, b.condition AS b, count(*) AS n, round(avg((a.top1 = b.top1)::INT), 9) AS agreement FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition < b.condition GROUP BY a.condition, b.condition")
def a4(spark, sf):
    pairs = align.unordered_pairs(recognition(spark, sf), "video_id", "condition", ["top1"])
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("top1_a") == F.col("top1_b")).cast("int")), 9).alias("agreement"))


REPLICATES = 1000


def _boot(columns: dict[str, str], seed: int) -> str:
    """m: a row a video with columns; rep: their means by replicate, -1 for what was observed."""
    of, names = ", ".join(f"{x} AS {c}" for c, x in columns.items()), ", ".join(columns)
    means = ", ".join(f"sum(w * {c}) / nullif(sum(w), 0) AS {c}" for c in columns)
    return _ALIGNED + f", m AS (SELECT video_id, {of} FROM al GROUP BY video_id), w AS ({weights_sql('m', seed, 'video_id', REPLICATES, names)}), rep AS (SELECT r, {means} FROM w GROUP BY r)"


def _top1(condition: str) -> str:
    return f"max(top1::INT) FILTER (condition = '{condition}')"


_PAIR = {"x": _top1("click"), "y": _top1("error")}


def _means(spark, sf, seed, **columns):
    """Replicates of the means of columns of the aligned matrix."""
    m = _matrix(spark, sf).select("video_id", *[c.cast("double").alias(n) for n, c in columns.items()])
    return resample.replicate_means(m, ["video_id"], list(columns), REPLICATES, seed)


@query("a5_paired_bootstrap", _boot(_PAIR, 42)
  + " SELECT round(quantile_cont(round(x, 9), 0.025), 6) AS x_low, round(quantile_cont(round(x, 9), 0.975), 6) AS x_high, round(quantile_cont(round(y, 9), 0.025), 6) AS y_low, round(quantile_cont(round(y, 9), 0.975), 6) AS y_high FROM rep WHERE r >= 0")
def a5(spark, sf):
    s = resample.collected(_means(spark, sf, 42, x=F.col("click"), y=F.col("error")), ["x", "y"])
    q = lambda c, p: F.round(resample.linear(F.col(c), p), 6)
    return s.select(q("x_s", 0.025).alias("x_low"), q("x_s", 0.975).alias("x_high"), q("y_s", 0.025).alias("y_low"), q("y_s", 0.975).alias("y_high"))


def _difference(spark, sf, seed):
    """The difference d of two conditions' means: observed, and its replicates."""
    return resample.collected(_means(spark, sf, seed, d=F.col("click") - F.col("error")), ["d"])


_D = {"d": f"{_top1('click')} - {_top1('error')}"}


@query("a6_paired_difference", _boot(_D, 43) + " SELECT 0.0::DOUBLE + round(quantile_cont(round(d, 9), 0.025), 6) AS low, 0.0::DOUBLE + round(quantile_cont(round(d, 9), 0.975), 6) AS high FROM rep WHERE r >= 0")
def a6(spark, sf):
    q = lambda p: F.round(resample.linear(F.col("d_s"), p), 6)
    return _difference(spark, sf, 43).select(q(0.025).alias("low"), q(0.975).alias("high"))


_TESTS = _ALIGNED + """, t AS (SELECT b.condition AS name, count_if(a.top1 AND NOT b.top1) AS b10, count_if(NOT a.top1 AND b.top1) AS b01 FROM al a JOIN al b ON a.video_id = b.video_id AND a.condition = 'click' AND b.condition <> 'click' GROUP BY b.condition)"""


def _tests(spark, sf):
    rows = _aligned(spark, sf)
    base = rows.where(F.col("condition") == "click").select("video_id", F.col("top1").alias("base"))
    b10, b01 = paired.mcnemar_counts(F.col("base"), F.col("top1"))
    return rows.where(F.col("condition") != "click").join(base, "video_id").groupBy(F.col("condition").alias("name")).agg(b10, b01)


@query("a7_mcnemar_chi2", _TESTS + " SELECT name, b10, b01, round(CASE WHEN b10 + b01 = 0 THEN 0 ELSE pow(abs(b10 - b01) - 1, 2) / (b10 + b01) END, 9) AS chi2 FROM t")
def a7(spark, sf):
    return _tests(spark, sf).withColumn("chi2", F.round(paired.mcnemar_chi2(F.col("b10"), F.col("b01")), 9))


#: The tail of chi-squared with one degree of freedom, erfc(sqrt(x / 2)), by the series of erf with positive terms; exact binomial tail.
_CHI = "(CASE WHEN b10 + b01 = 0 THEN 0 ELSE pow(abs(b10 - b01) - 1, 2) / (b10 + b01) END)::DOUBLE"
_TAIL = "greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * list_sum([exp(2 * j * ln(2) + (2 * j + 1) * ln(greatest(sqrt(chi / 2), 1e-300)) - lgamma(2 * j + 2) + lgamma(j + 1) - chi / 2) FOR j IN range(400)]))"
_P = _TESTS + f", c AS (SELECT *, {_CHI} AS chi FROM t), p AS (SELECT name, b10, b01, {_TAIL} AS p FROM c)"
_EXACT = "least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(b10 + b01 + 1) - lgamma(j + 1) - lgamma(b10 + b01 - j + 1) - (b10 + b01) * ln(2)) FOR j IN range(least(b10, b01) + 1)]))"


def _p(spark, sf):
    return _tests(spark, sf).withColumn("p", F.round(paired.chi2_p(paired.mcnemar_chi2(F.col("b10"), F.col("b01"))), 9))


@query("a7_mcnemar_p", _P + " SELECT name, b10, b01, round(p, 9) AS p FROM p")
def a7p(spark, sf):
    return _p(spark, sf)


@query("a8_mcnemar_exact", _TESTS + f" SELECT name, b10, b01, round(CASE WHEN b10 + b01 = 0 THEN 1 ELSE {_EXACT} END, 9)::DOUBLE AS p FROM t")
def a8(spark, sf):
    return _tests(spark, sf).withColumn("p", F.round(paired.binomial_p("b10", "b01"), 9))


@query("a9_holm", _P + """, r AS (SELECT name, round(p, 9) AS p, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY round(p, 9), name) + 1) AS threshold FROM p)
SELECT name, p, round(threshold, 9) AS threshold, bool_and(p < threshold) OVER (ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rejected FROM r""")
def a9(spark, sf):
    t = _p(spark, sf).select("name", "p", F.lit(0).alias("family"))
    return paired.holm(t, "p", "name", 0.05, ["family"]).select("name", "p", F.round("threshold", 9).alias("threshold"), "rejected")


@query("a10_bonferroni", _P + " SELECT name, round(p, 9) < 0.05 AS raw, round(p, 9) < 0.05 / count(*) OVER () AS corrected FROM p")
def a10(spark, sf):
    """A family of tests is a row for each condition, so its window is small."""
    return _p(spark, sf).select("name", (F.col("p") < 0.05).alias("raw"), (F.col("p") < 0.05 / F.count("*").over(W.partitionBy())).alias("corrected"))


@query("a22_damage", "WITH {REC} SELECT b.condition, count(*) AS n, 0.0::DOUBLE + round(avg(a.top1::INT) - avg(b.top1::INT), 9) AS damage, count_if(a.top1 AND NOT b.top1) AS lost, count_if(NOT a.top1 AND b.top1) AS won FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition = 'view' AND b.condition <> 'view' GROUP BY b.condition HAVING count(*) >= 10")
def a22(spark, sf):
    rows = recognition(spark, sf)
    base = rows.where(F.col("condition") == "view").select("video_id", F.col("top1").alias("base"))
    lost, won = paired.mcnemar_counts(F.col("base"), F.col("top1"))
    both = rows.where(F.col("condition") != "view").join(base, "video_id").groupBy("condition")
    gap = F.round(F.avg(F.col("base").cast("int")) - F.avg(F.col("top1").cast("int")), 9)
    return both.agg(F.count("*").alias("n"), gap.alias("damage"), lost.alias("lost"), won.alias("won")).where("n >= 10")


@query("a19_fraction_means", "SELECT event_type AS ordering, (day(ts) % 10) / 10 AS fraction, round(avg(value), 9) AS mean, round(stddev_samp(value) / sqrt(count(*)), 9) AS se FROM events GROUP BY ordering, fraction")
def a19(spark, sf):
    by = table(spark, sf, "events").groupBy(F.col("event_type").alias("ordering"), (F.dayofmonth("ts") % 10 / 10).alias("fraction"))
    return by.agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.try_divide(F.stddev_samp("value"), F.sqrt(F.count("*"))), 9).alias("se"))


_CURVE = """WITH c AS (SELECT user_id, event_type AS ordering, day(ts) / 31 AS x, avg(value) AS y FROM events GROUP BY ALL), f AS (SELECT * FROM c UNION ALL SELECT DISTINCT user_id, ordering, 0.0, 0.2 FROM c),
p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM f WINDOW w AS (PARTITION BY user_id, ordering ORDER BY x)), a AS (SELECT user_id, ordering, sum((x - px) * (y + py) / 2) AS auc FROM p GROUP BY ALL)"""


def _auc(spark, sf):
    from keelson.operators.coverage import trapezoid

    c = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("ordering"), (F.dayofmonth("ts") / 31).alias("x")).agg(F.avg("value").alias("y"))
    chance = c.select("user_id", "ordering").distinct().select("user_id", "ordering", F.lit(0.0).alias("x"), F.lit(0.2).alias("y"))
    return trapezoid(c.unionByName(chance), ["user_id", "ordering"], "x", "y")


@query("a16_complete_curves", """WITH {REC}, r AS (SELECT *, CAST(right(video_id, 1) AS INTEGER) AS week, length(video_id) % 2 AS ordering FROM rec), i AS (SELECT *, CASE condition WHEN 'click' THEN 25 WHEN 'signup' THEN 50 WHEN 'purchase' THEN 75 END AS pct FROM r WHERE condition IN ('click', 'signup', 'purchase')),
grid AS (SELECT DISTINCT ordering, pct FROM i WHERE NOT coalesce(failed, false)), ok AS (SELECT video_id, ordering FROM i GROUP BY video_id, ordering HAVING NOT bool_or(coalesce(failed, false)) AND count(DISTINCT pct) = (SELECT count(*) FROM grid g WHERE g.ordering = i.ordering)),
f AS (SELECT video_id, coalesce(top1, false) AS top1, coalesce(top5, false) AS top5 FROM r WHERE condition = 'view')
SELECT video_id, ordering, pct / 100 AS fraction, coalesce(i.top1, false)::INT::DOUBLE AS top1, coalesce(i.top5, false)::INT::DOUBLE AS top5 FROM i JOIN ok USING (video_id, ordering) JOIN (SELECT video_id FROM f) USING (video_id)
UNION ALL SELECT video_id, ordering, 0.0, 1 / 174, 5 / 174 FROM ok JOIN f USING (video_id) UNION ALL SELECT video_id, ordering, 1.0, f.top1::INT::DOUBLE, f.top5::INT::DOUBLE FROM ok JOIN f USING (video_id)""")
def a16(spark, sf):
    """Conditions stand for fractions, view for the full record, and the length of a video's id for its ordering."""
    from keelson.operators.coverage import complete_curves

    rows = recognition(spark, sf)
    pct = F.create_map(*[F.lit(x) for x in ("click", 25, "signup", 50, "purchase", 75)])
    points = rows.where(F.col("condition").isin("click", "signup", "purchase")).select("video_id", (F.length("video_id") % 2).alias("ordering"), (F.try_element_at(pct, "condition") / 100).alias("fraction"), "failed", "top1", "top5")
    return complete_curves(points, rows.where("condition = 'view'"), 174)


@query("a17_curve_auc", _CURVE + " SELECT user_id, ordering, round(auc, 6) AS auc FROM a")
def a17(spark, sf):
    return _auc(spark, sf).select("user_id", "ordering", F.round("auc", 6).alias("auc"))


@query("a20_mean_auc", _CURVE + " SELECT ordering, round(avg(auc), 6) AS auc, count(*) AS n FROM a GROUP BY ordering")
def a20(spark, sf):
    return _auc(spark, sf).groupBy("ordering").agg(F.round(F.avg("auc"), 6).alias("auc"), F.count("*").alias("n"))


@query("a30_difference_correlation", "WITH {REC}, p AS (SELECT a.condition AS a, b.condition AS b, a.value - b.value AS x, a.top1::INT - b.top1::INT AS y FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition < b.condition) SELECT a, b, CASE WHEN count(*) >= 10 THEN 0.0::DOUBLE + round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) END AS r, count(*) AS n FROM p GROUP BY a, b")
def a30(spark, sf):
    p = align.unordered_pairs(recognition(spark, sf).withColumn("top1", F.col("top1").cast("int")), "video_id", "condition", ["value", "top1"])
    r = pearson(F.col("value_a") - F.col("value_b"), F.col("top1_a") - F.col("top1_b"))
    return p.groupBy("a", "b").agg(F.when(F.count("*") >= 10, F.round(r, 6)).alias("r"), F.count("*").alias("n"))


@query("n4_ordered_pairs", "WITH {REC} SELECT a.condition AS a, b.condition AS b, count(*) AS n FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition <> b.condition GROUP BY a.condition, b.condition")
def n4(spark, sf):
    rows = recognition(spark, sf).select("video_id", "condition")
    met = rows.withColumnRenamed("condition", "a").join(rows.withColumnRenamed("condition", "b"), "video_id").where("a <> b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("n5_left_strata", "WITH {REC} SELECT coalesce(c_mktsegment, 'unknown') AS stratum, count(*) AS n, round(avg(top1::INT), 9) AS top1 FROM rec LEFT JOIN customer ON CAST(split_part(video_id, 'w', 1) AS BIGINT) * 20 = c_custkey GROUP BY stratum")
def n5(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    key = F.split_part("video_id", F.lit("w"), F.lit(1)).cast("long") * 20
    met = recognition(spark, sf).withColumn("k", key).join(c, F.col("k") == F.col("c_custkey"), "left")
    return met.groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("top1").cast("int")), 9).alias("top1"))


@query("n18_job_grid", "SELECT r_name AS oracle, n_name AS dataset, event_type AS condition FROM region, nation, (SELECT DISTINCT event_type FROM events)")
def n18(spark, sf):
    """A declared grid of few names by few names."""
    r, n = table(spark, sf, "region").select(F.col("r_name").alias("oracle")), table(spark, sf, "nation").select(F.col("n_name").alias("dataset"))
    return r.crossJoin(n).crossJoin(table(spark, sf, "events").select(F.col("event_type").alias("condition")).distinct())


@query("w9_index_edges", "WITH v AS (SELECT list_sort(list(o_totalprice)) AS s FROM orders) SELECT s[len(s) // 4 + 1] AS edge1, s[len(s) * 2 // 4 + 1] AS edge2, s[len(s) * 3 // 4 + 1] AS edge3 FROM v")
def w9(spark, sf):
    return paired.index_edges(table(spark, sf, "orders"), "o_totalprice", 4)


@query("w10_fixed_bins", "SELECT CASE WHEN l_discount < 0.02 THEN 'low' WHEN l_discount < 0.05 THEN 'mid' WHEN l_discount < 0.08 THEN 'high' ELSE 'top' END AS bin, count(*) AS n FROM lineitem GROUP BY bin")
def w10(spark, sf):
    d = F.col("l_discount")
    bin_ = F.when(d < 0.02, "low").when(d < 0.05, "mid").when(d < 0.08, "high").otherwise("top")
    return table(spark, sf, "lineitem").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("a51_quantile_bucket", "WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT CAST((a < o_totalprice)::INT + (b < o_totalprice)::INT + (c < o_totalprice)::INT AS INTEGER) AS bucket, count(*) AS n FROM orders, e GROUP BY bucket")
def a51(spark, sf):
    o = table(spark, sf, "orders")
    edges = o.agg(F.percentile("o_totalprice", [0.25, 0.5, 0.75])).first()[0]
    return o.groupBy(sum((F.col("o_totalprice") > e).cast("int") for e in edges).alias("bucket")).agg(F.count("*").alias("n"))


#: The kept-ratio strata's edges.
_KEPT_EDGES = (0.4, 0.6, 0.8)
_LEVELS, _QUARTERS, _KEPT = ["low", "medium", "high"], ["Q1", "Q2", "Q3", "Q4"], ["below 0.4", "0.4 to 0.6", "0.6 to 0.8", "from 0.8"]


def _label_sql(value: str, edges: list[str], names: list[str]) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'unknown' " + " ".join(f"WHEN {value} < {e} THEN '{n}'" for e, n in zip(edges, names)) + f" ELSE '{names[-1]}' END"  # noqa: B905


_EDGES = lambda name, n: [f"(SELECT list_sort(list({name}))[count({name}) * {k} // {n} + 1] FROM c)" for k in range(1, n)]


@query("a12_stratified", _ALIGNED + f""", per AS (SELECT video_id, max(CASE WHEN condition = 'view' AND value > 2 THEN value END) AS confidence, sum(value) AS seconds, sum(CASE WHEN condition IN ('click', 'error', 'view') THEN value ELSE 0 END) / nullif(sum(value), 0) AS kept FROM al GROUP BY video_id),
m AS (SELECT video_id, {', '.join(f"{_top1(c)} AS {c}" for c in COMPARED)} FROM al GROUP BY video_id), c AS (SELECT video_id, confidence, round(seconds, 6) AS seconds, round(kept, 9) AS kept, {', '.join(COMPARED)} FROM per JOIN m USING (video_id)),
f AS (SELECT *, 'all' AS family, 'all' AS stratum FROM c UNION ALL SELECT *, 'confidence', {_label_sql('confidence', _EDGES('confidence', 3), _LEVELS)} FROM c UNION ALL SELECT *, 'length', {_label_sql('seconds', _EDGES('seconds', 4), _QUARTERS)} FROM c UNION ALL SELECT *, 'kept_ratio', {_label_sql('kept', [str(e) for e in _KEPT_EDGES], _KEPT)} FROM c),
w AS ({weights_sql('f', 42, 'video_id', REPLICATES, 'family, stratum, ' + ', '.join(COMPARED))}), v AS (UNPIVOT w ON {', '.join(COMPARED)} INTO NAME condition VALUE top1),
rep AS (SELECT family, stratum, condition, r, sum(w) AS n, sum(w * top1) / nullif(sum(w), 0) AS x FROM v GROUP BY ALL)
SELECT family, stratum, condition, CAST(max(n) FILTER (r < 0) AS BIGINT) AS n, round(max(x) FILTER (r < 0), 9) AS top1, round(quantile_cont(round(x, 9), 0.025) FILTER (r >= 0), 6) AS low, round(quantile_cont(round(x, 9), 0.975) FILTER (r >= 0), 6) AS high FROM rep GROUP BY family, stratum, condition HAVING max(n) FILTER (r < 0) >= 5""")
def a12(spark, sf):
    """Strata by terciles of confidence, quartiles of length and ranges of the kept ratio, beside all videos; those of fewer than five videos are left out."""
    rows = _aligned(spark, sf)
    value = lambda test: F.sum(F.when(test, F.col("value")).otherwise(0.0))
    confidence = F.max(F.when((F.col("condition") == "view") & (F.col("value") > 2), F.col("value")))
    kept = F.try_divide(value(F.col("condition").isin("click", "error", "view")), F.sum("value"))
    one = [F.max(F.when(F.col("condition") == c, F.col("top1").cast("double"))).alias(c) for c in COMPARED]
    videos = materialize(rows.groupBy("video_id").agg(confidence.alias("confidence"), F.round(F.sum("value"), 6).alias("seconds"), F.round(kept, 9).alias("kept"), *one), "strata")
    families = {"all": F.lit("all"), "confidence": paired.index_strata(videos, "confidence", _LEVELS), "length": paired.index_strata(videos, "seconds", _QUARTERS), "kept_ratio": paired.stratum(F.col("kept"), [F.lit(e) for e in _KEPT_EDGES], _KEPT)}
    each = videos.select("video_id", *COMPARED, F.explode(F.array(*[F.struct(F.lit(f).alias("family"), s.alias("stratum")) for f, s in families.items()])).alias("s"))
    rep = resample.replicate_means(each.select("video_id", *COMPARED, "s.*"), ["video_id"], COMPARED, REPLICATES, 42, ["family", "stratum"])
    s = resample.collected(rep, COMPARED, ["family", "stratum"]).where("n >= 5")
    bound = lambda c, q: F.round(resample.linear(F.col(f"{c}_s"), q), 6)
    out = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.round(c, 9).alias("top1"), bound(c, 0.025).alias("low"), bound(c, 0.975).alias("high")) for c in COMPARED]))
    return s.select("family", "stratum", "n", out.alias("o")).select("family", "stratum", "o.condition", "n", "o.top1", "o.low", "o.high")


@query("a53_cochran_q", "WITH g AS (SELECT event_type, avg(value) AS x, var_samp(value) / count(*) AS v FROM events GROUP BY event_type), s AS (SELECT sum(1 / greatest(v, 1e-12)) AS w, sum(x / greatest(v, 1e-12)) AS wx, sum(x * x / greatest(v, 1e-12)) AS wxx, count(*) AS n FROM g) SELECT round(wxx - wx * wx / w, 6) AS q, n - 1 AS df FROM s")
def a53(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("x"), (F.var_samp("value") / F.count("*")).alias("v"))
    return paired.cochran_q(g, "x", "v").select(F.round("q", 6).alias("q"), "df")


@query("w16_duplicates", "WITH {REC} SELECT video_id, condition, count(*) AS writes, max(event_id) AS last FROM rec0 GROUP BY video_id, condition HAVING count(*) > 1")
def w16(spark, sf):
    return all_events(spark, sf).groupBy("video_id", "condition").agg(F.count("*").alias("writes"), F.max("event_id").alias("last")).where("writes > 1")


@query("f7_shard", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 7 = 3")
def f7(spark, sf):
    return order.numbered(table(spark, sf, "events").select("event_id"), [F.col("event_id")]).where("position % 7 = 3").select("event_id")


@query("x4_wins_losses", "WITH {REC} SELECT CASE WHEN a.top1 AND b.top1 THEN 'both' WHEN a.top1 THEN 'win' WHEN b.top1 THEN 'loss' ELSE 'neither' END AS outcome, count(*) AS n FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition = 'click' AND b.condition = 'view' GROUP BY outcome")
def x4(spark, sf):
    rows = recognition(spark, sf)
    one = lambda c, n: rows.where(F.col("condition") == c).select("video_id", F.col("top1").alias(n))
    outcome = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "win").when(F.col("b"), "loss").otherwise("neither")
    return one("click", "a").join(one("view", "b"), "video_id").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("a21_index_interval", _boot(_D, 44) + ", s AS (SELECT list_sort(list(round(d, 9))) AS s FROM rep WHERE r >= 0) SELECT 0.0::DOUBLE + s[26] AS low, 0.0::DOUBLE + s[976] AS high FROM s")
def a21(spark, sf):
    return _difference(spark, sf, 44).select(resample.at_share(F.col("d_s"), 0.025).alias("low"), resample.at_share(F.col("d_s"), 0.975).alias("high"))


@query("a41_lower_index_interval", _boot(_D, 7) + ", s AS (SELECT list_sort(list(round(d, 9))) AS s FROM rep WHERE r >= 0) SELECT 0.0::DOUBLE + s[26] AS low, 0.0::DOUBLE + s[975] AS high FROM s")
def a41(spark, sf):
    return _difference(spark, sf, 7).select(resample.at_share(F.col("d_s"), 0.025).alias("low"), resample.at_share(F.col("d_s"), 0.975, less=1).alias("high"))


@query("a18_centred_p", _CURVE + f", m AS (SELECT a.user_id, a.auc - b.auc AS d FROM a JOIN a b ON a.user_id = b.user_id AND a.ordering = 'click' AND b.ordering = 'error'), w AS ({weights_sql('m', 45, 'user_id', REPLICATES, 'd')}), rep AS (SELECT r, sum(w * d) / nullif(sum(w), 0) AS d FROM w GROUP BY r),"
  + """ o AS (SELECT avg(d) AS o, count(*) AS n FROM m), t AS (SELECT o, n, avg((round(d, 9) - o >= abs(o) - 1e-9)::INT) AS up, avg((round(d, 9) - o <= 1e-9 - abs(o))::INT) AS down, quantile_cont(round(d, 9), 0.025) AS low, quantile_cont(round(d, 9), 0.975) AS high FROM rep, o WHERE r >= 0 AND d IS NOT NULL GROUP BY o, n)
SELECT n, round(o, 6) + 0.0::DOUBLE AS mean, CASE WHEN n > 1 THEN round(low, 6) + 0.0::DOUBLE END AS low, CASE WHEN n > 1 THEN round(high, 6) + 0.0::DOUBLE END AS high, CASE WHEN n > 1 THEN round(least(1, greatest(1 / 1000, 2 * least(up, down))), 9)::DOUBLE END AS p FROM t""")
def a18(spark, sf):
    """Differences of two orderings' areas, paired by user: any real values."""
    auc = _auc(spark, sf).where(F.col("ordering").isin("click", "error")).groupBy("user_id").pivot("ordering", ["click", "error"]).agg(F.max("auc"))
    pairs = auc.select("user_id", (F.col("click") - F.col("error")).alias("d"))
    s = resample.collected(resample.replicate_means(pairs, ["user_id"], ["d"], REPLICATES, 45), ["d"])
    enough = lambda c, name, digits=6: F.when(F.col("n") > 1, F.round(c, digits)).alias(name)
    low, high = (resample.linear(F.col("d_s"), q) for q in (0.025, 0.975))
    return s.select("n", F.round("d", 6).alias("mean"), enough(low, "low"), enough(high, "high"), enough(resample.centred_p(F.col("d_s"), F.col("d")), "p", 9))


_SHUFFLED = {"d": f"({_top1('click')} - {_top1('purchase')}) - ({_top1('error')} - {_top1('signup')})"}


@query("a24_sign_p", _boot(_SHUFFLED, 46) + ", o AS (SELECT avg(d) AS o FROM m) SELECT 0.0::DOUBLE + round(o, 9) AS diff, 0.0::DOUBLE + round(quantile_cont(round(d, 9), 0.025), 6) AS low, 0.0::DOUBLE + round(quantile_cont(round(d, 9), 0.975), 6) AS high, round(least(1, 2 * avg((CASE WHEN o >= 0 THEN round(d, 9) <= 0 ELSE round(d, 9) >= 0 END)::INT)), 9)::DOUBLE AS p FROM rep, o WHERE r >= 0 AND d IS NOT NULL GROUP BY o")
def a24(spark, sf):
    """The damage of shuffling to one selection less that to another; purchase and signup stand for the shuffled twins of click and error."""
    d = (F.col("click") - F.col("purchase")) - (F.col("error") - F.col("signup"))
    s = resample.collected(_means(spark, sf, 46, d=d), ["d"])
    low, high = (F.round(resample.linear(F.col("d_s"), q), 6) for q in (0.025, 0.975))
    return s.select(F.round("d", 9).alias("diff"), low.alias("low"), high.alias("high"), F.round(resample.sign_p(F.col("d_s"), F.col("d")), 9).alias("p"))
