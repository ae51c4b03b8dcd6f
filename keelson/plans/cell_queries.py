"""Cells, gates and preferences: smaller operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators import order, paired, resample, sample
from keelson.plans.bindings import query, recognition, segments, weights_sql
from keelson.session import table


@query("f2_precheck_default", "SELECT count_if(coalesce(nullif(c_acctbal > 0, c_custkey % 3 = 0), false)) AS strict, count_if(coalesce(nullif(c_acctbal > 0, c_custkey % 3 = 0), true)) AS lenient FROM customer")
def f2(spark, sf):
    """A missing flag is a parameter's matter: false in the strict count, true in the lenient."""
    flag = F.nullif(F.col("c_acctbal") > 0, F.col("c_custkey") % 3 == 0)
    return table(spark, sf, "customer").agg(F.count_if(F.coalesce(flag, F.lit(False))).alias("strict"), F.count_if(F.coalesce(flag, F.lit(True))).alias("lenient"))


@query("f9_index_set", "WITH {SEG} SELECT video_id, idx FROM seg WHERE idx IN (0, 2, 5)")
def f9(spark, sf):
    return segments(spark, sf).where(F.col("idx").isin(0, 2, 5)).select("video_id", "idx")


@query("f11_bookkeeping", r"SELECT url FROM pages WHERE NOT regexp_matches(regexp_extract(url, '([^/]+)$', 1), '^(\.|config|_|1)')")
def f11(spark, sf):
    return table(spark, sf, "pages").where(~F.regexp_extract("url", "([^/]+)$", 1).rlike(r"^(\.|config|_|1)")).select("url")


@query("n2_in_all_runs", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def n2(spark, sf):
    """Keys in every run: one aggregation instead of a chain of joins."""
    by = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O", "P")).groupBy("o_custkey")
    return by.agg(F.count_distinct("o_orderstatus").alias("n")).where("n = 3").select("o_custkey")


@query("n3_run_pairs", "WITH r AS (SELECT o_orderstatus AS run, o_custkey, round(avg(o_totalprice), 4) AS x FROM orders GROUP BY ALL) SELECT a.run AS a, b.run AS b, count(*) AS n, round(avg(abs(a.x - b.x)), 4) AS gap FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.run < b.run GROUP BY a.run, b.run")
def n3(spark, sf):
    from keelson.operators.align import unordered_pairs

    r = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("run"), "o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("x"))
    pairs = unordered_pairs(r, "o_custkey", "run", ["x"]).groupBy("a", "b")
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x_a") - F.col("x_b"))), 4).alias("gap"))


@query("n7_twins", "WITH {REC} SELECT a.video_id, a.top1 AS base, b.top1 AS shuffled FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition = 'click' AND b.condition = 'error'")
def n7(spark, sf):
    r = recognition(spark, sf)
    a = r.where("condition = 'click'").select("video_id", F.col("top1").alias("base"))
    return a.join(r.where("condition = 'error'").select("video_id", F.col("top1").alias("shuffled")), "video_id")


@query("n19_preference", "WITH {REC} SELECT video_id, coalesce(max(value) FILTER (condition = 'purchase'), max(value) FILTER (condition = 'click'), max(value) FILTER (condition = 'view')) AS value FROM rec GROUP BY video_id")
def n19(spark, sf):
    pick = lambda c: F.max(F.when(F.col("condition") == c, F.col("value")))
    return recognition(spark, sf).groupBy("video_id").agg(F.coalesce(pick("purchase"), pick("click"), pick("view")).alias("value"))


@query("a11_pairwise_reference", "WITH {REC} SELECT b.condition, count(*) AS n, round(avg(b.top1::INT) - avg(a.top1::INT), 9) + 0.0::DOUBLE AS gain FROM rec a JOIN rec b ON a.video_id = b.video_id AND a.condition = 'error' AND b.condition <> 'error' GROUP BY b.condition")
def a11(spark, sf):
    r = recognition(spark, sf)
    base = r.where("condition = 'error'").select("video_id", F.col("top1").cast("int").alias("base"))
    met = r.where("condition <> 'error'").join(base, "video_id").groupBy("condition")
    return met.agg(F.count("*").alias("n"), F.round(F.avg(F.col("top1").cast("int")) - F.avg("base"), 9).alias("gain"))


@query("a23_differential_damage", "WITH {REC}, w AS (SELECT video_id, max(top1::INT) FILTER (condition = 'click') AS a, max(top1::INT) FILTER (condition = 'error') AS b, max(top1::INT) FILTER (condition = 'view') AS c FROM rec GROUP BY video_id) SELECT count(*) AS n, round(avg(a - b) - avg(a - c), 9) + 0.0::DOUBLE AS differential FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def a23(spark, sf):
    m = recognition(spark, sf).groupBy("video_id").pivot("condition", ["click", "error", "view"]).agg(F.max(F.col("top1").cast("int"))).dropna()
    return m.agg(F.count("*").alias("n"), F.round(F.avg(F.col("click") - F.col("error")) - F.avg(F.col("click") - F.col("view")), 9).alias("differential"))


@query("a25_success_matrix", "WITH {REC} SELECT condition, count_if(failed) AS failed, count_if(NOT failed AND top1) AS hits, count(*) AS n FROM rec WHERE value <> 0 GROUP BY condition")
def a25(spark, sf):
    r = recognition(spark, sf).where("value <> 0").groupBy("condition")
    return r.agg(F.count_if("failed").alias("failed"), F.count_if(~F.col("failed") & F.col("top1")).alias("hits"), F.count("*").alias("n"))


@query("a43_pooled_and_mean", "SELECT round(avg(l_discount), 9) AS pooled, round((SELECT avg(m) FROM (SELECT avg(l_discount) AS m FROM lineitem GROUP BY l_suppkey)), 9) AS mean_of_means FROM lineitem")
def a43(spark, sf):
    by = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum("s") / F.sum("n"), 9).alias("pooled"), F.round(F.avg(F.col("s") / F.col("n")), 9).alias("mean_of_means"))


@query("a50_correlation", f"""WITH m AS (SELECT c_custkey, c_mktsegment, c_acctbal AS x, c_nationkey AS y FROM customer), w AS ({weights_sql('m', 7, 'c_custkey', 1000, 'c_mktsegment, x, y')}),
v AS (SELECT c_mktsegment, r, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS mxx, sum(w * y * y) / sum(w) AS myy, sum(w * x * y) / sum(w) AS mxy FROM w GROUP BY c_mktsegment, r),
c AS (SELECT c_mktsegment, r, n, CASE WHEN mxx - mx * mx >= 1e-18 AND myy - my * my >= 1e-18 THEN round((mxy - mx * my) / sqrt((mxx - mx * mx) * (myy - my * my)), 9) END AS rho FROM v),
s AS (SELECT c_mktsegment, max(n) FILTER (r < 0) AS n, max(rho) FILTER (r < 0) AS r, list_sort(list(rho) FILTER (r >= 0 AND rho IS NOT NULL)) AS s FROM c GROUP BY c_mktsegment)
SELECT c_mktsegment, CAST(n AS BIGINT) AS n, CASE WHEN n >= 3 THEN round(r, 6) + 0.0::DOUBLE END AS r, CASE WHEN n >= 3 THEN round(s[CAST(floor(len(s) * 0.025) AS INTEGER) + 1], 6) + 0.0::DOUBLE END AS low, CASE WHEN n >= 3 THEN round(s[CAST(floor(len(s) * 0.975) AS INTEGER) + 1], 6) + 0.0::DOUBLE END AS high FROM s""")
def a50(spark, sf):
    rep = resample.replicate_pearson(table(spark, sf, "customer"), ["c_custkey"], "c_acctbal", "c_nationkey", 1000, 7, ["c_mktsegment"])
    s = resample.collected(rep, ["value"], ["c_mktsegment"])
    enough = lambda c, name: F.when(F.col("n") >= 3, F.round(c, 6)).alias(name)
    return s.select("c_mktsegment", "n", enough(F.col("value"), "r"), enough(resample.at_share(F.col("value_s"), 0.025), "low"), enough(resample.at_share(F.col("value_s"), 0.975), "high"))


@query("a52_selection_gaps", "WITH {REC}, w AS (SELECT video_id, max(top1::INT) FILTER (condition = 'click') AS s, max(top1::INT) FILTER (condition = 'error') AS l, max(top1::INT) FILTER (condition = 'view') AS u FROM rec GROUP BY video_id) SELECT right(video_id, 2) AS cell, count(*) AS n, round(avg(s - l), 9) + 0.0::DOUBLE AS eps, round(avg(s - u), 9) + 0.0::DOUBLE AS tds FROM w WHERE s IS NOT NULL AND l IS NOT NULL AND u IS NOT NULL GROUP BY cell")
def a52(spark, sf):
    m = recognition(spark, sf).groupBy("video_id").pivot("condition", ["click", "error", "view"]).agg(F.max(F.col("top1").cast("int"))).dropna()
    by = m.groupBy(F.right("video_id", F.lit(2)).alias("cell"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg(F.col("click") - F.col("error")), 9).alias("eps"), F.round(F.avg(F.col("click") - F.col("view")), 9).alias("tds"))


@query("a54_interval_variance", "SELECT s_suppkey, round(greatest(pow((s_acctbal / 1000) / 3.92, 2), 1e-12), 9) AS variance FROM supplier")
def a54(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(paired.variance_from_interval(F.lit(0.0), F.col("s_acctbal") / 1000), 9).alias("variance"))


@query("a55_direction", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_up, count_if(o_totalprice > 100000) AS up FROM orders GROUP BY o_orderpriority")
def a55(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("all_up"), F.count_if(F.col("o_totalprice") > 100000).alias("up"))


@query("a56_cell_coverage", "SELECT n_name AS cell, count(c_custkey) AS present, count(s_suppkey) AS covered, count(c_custkey) - count(s_suppkey) AS missing FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey GROUP BY cell")
def a56(spark, sf):
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    met = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_suppkey") == F.col("c_custkey"), "left")
    return met.groupBy(F.col("n_name").alias("cell")).agg(F.count("c_custkey").alias("present"), F.count("s_suppkey").alias("covered"), (F.count("c_custkey") - F.count("s_suppkey")).alias("missing"))


@query("a57_timing_alignment", "WITH {SEG}, t AS (SELECT video_id, string_agg(start_s || '-' || end_s, ',' ORDER BY idx) AS timing, count(*) AS n FROM seg GROUP BY video_id) SELECT n, count(DISTINCT timing) AS timings, count(DISTINCT timing) = 1 AS aligned FROM t GROUP BY n")
def a57(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.round("start_s", 4).alias("s"), F.round("end_s", 4).alias("e"))))
    t = segments(spark, sf).groupBy("video_id").agg(ordered.alias("timing"), F.count("*").alias("n"))
    return t.groupBy("n").agg(F.count_distinct("timing").alias("timings")).withColumn("aligned", F.col("timings") == 1)


@query("a58_floor_gate", "SELECT source, round(count_if(n_chars >= 500) / count(*), 9) AS rate FROM documents GROUP BY source HAVING count_if(n_chars >= 500) / count(*) < 0.95 AND source NOT IN ('src0')")
def a58(spark, sf):
    by = table(spark, sf, "documents").groupBy("source").agg((F.count_if(F.col("n_chars") >= 500) / F.count("*")).alias("x"))
    return by.where((F.col("x") < 0.95) & ~F.col("source").isin("src0")).select("source", F.round("x", 9).alias("rate"))


@query("a59_seed_spread", "WITH s AS (SELECT o_orderkey, o_totalprice, unnest([1, 2, 3]) AS seed FROM orders), m AS (SELECT seed, avg(o_totalprice) AS m FROM s WHERE ('0x' || substr(md5(seed || '|' || o_orderkey), 1, 8))::BIGINT < 2147483648 GROUP BY seed) SELECT round(min(m), 4) AS low, round(max(m), 4) AS high, round(max(m) - min(m), 4) AS spread FROM m")
def a59(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"))
    h = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("o_orderkey").cast("string")))
    m = s.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < 1 << 31).groupBy("seed").agg(F.avg("o_totalprice").alias("m"))
    return m.agg(F.round(F.min("m"), 4).alias("low"), F.round(F.max("m"), 4).alias("high"), F.round(F.max("m") - F.min("m"), 4).alias("spread"))


@query("a69_recovery_gate", "SELECT lang, round(count_if(n_chars > 0) / count(*), 9) AS recovered, count_if(n_chars > 0) / count(*) >= 0.995 AS passed FROM documents GROUP BY lang")
def a69(spark, sf):
    share = F.count_if(F.col("n_chars") > 0) / F.count("*")
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(share, 9).alias("recovered"), (share >= 0.995).alias("passed"))


@query("a73_deletion_auc", "WITH {SEG}, p AS (SELECT video_id, idx / greatest(count(*) OVER (PARTITION BY video_id) - 1, 1) AS x, 1 - weight AS y, idx FROM seg), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY video_id ORDER BY idx)) SELECT video_id, round(coalesce(sum(abs(x - px) * (y + py) / 2), 0), 6) AS auc FROM l GROUP BY video_id")
def a73(spark, sf):
    by, order = W.partitionBy("video_id"), W.partitionBy("video_id").orderBy("idx")
    p = segments(spark, sf).select("video_id", "idx", (F.col("idx") / F.greatest(F.count("*").over(by) - 1, F.lit(1))).alias("x"), (1 - F.col("weight")).alias("y"))
    area = F.abs(F.col("x") - F.lag("x").over(order)) * (F.col("y") + F.lag("y").over(order)) / 2
    return p.withColumn("a", area).groupBy("video_id").agg(F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 6).alias("auc"))


@query("g4_precheck_gate", "SELECT event_id, event_type <> 'error' AND value / 50 > 0.5 AS passed FROM events")
def g4(spark, sf):
    return table(spark, sf, "events").select("event_id", ((F.col("event_type") != "error") & (F.col("value") / 50 > 0.5)).alias("passed"))


@query("g6_binary_labels", "WITH {SEG}, k AS (SELECT video_id, list(idx) FILTER (weight >= 0.5) AS kept FROM seg GROUP BY video_id) SELECT seg.video_id, idx, CASE WHEN list_contains(coalesce(kept, []), idx) THEN 'important' ELSE 'unimportant' END AS label FROM seg JOIN k USING (video_id)")
def g6(spark, sf):
    kept = F.collect_list(F.when(F.col("weight") >= 0.5, F.col("idx"))).over(W.partitionBy("video_id"))
    return segments(spark, sf).select("video_id", "idx", kept.alias("kept")).select("video_id", "idx", F.when(F.array_contains("kept", F.col("idx")), "important").otherwise("unimportant").alias("label"))


@query("x3_subset_test", "WITH {REC} SELECT video_id, count(DISTINCT condition) FILTER (condition IN ('click', 'view')) = 2 AS covers FROM rec GROUP BY video_id")
def x3(spark, sf):
    return recognition(spark, sf).groupBy("video_id").agg((F.count_distinct(F.when(F.col("condition").isin("click", "view"), F.col("condition"))) == 2).alias("covers"))


@query("x9_downsample", "SELECT c_custkey FROM customer ORDER BY md5('9|' || c_custkey), c_custkey LIMIT 150")
def x9(spark, sf):
    return sample.exactly(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 150, 9)


@query("x11_half_sample", "SELECT s_suppkey FROM supplier ORDER BY md5('11|' || s_suppkey), s_suppkey LIMIT (SELECT count(*) // 2 FROM supplier)")
def x11(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    return order.first_of(s, [sample.hash_order(11, "s_suppkey"), F.col("s_suppkey")], 1, 2)


@query("k7_matrix", "WITH {REC}, p AS (SELECT a.condition AS a, b.condition AS b, avg((a.top1 = b.top1)::INT) AS v FROM rec a JOIN rec b ON a.video_id = b.video_id GROUP BY a.condition, b.condition) SELECT a, max(v) FILTER (b = 'click') AS click, max(v) FILTER (b = 'view') AS view FROM (SELECT a, b, printf('%.3f', v) AS v FROM p) GROUP BY a")
def k7(spark, sf):
    from keelson.operators.align import unordered_pairs
    from keelson.sources.sinks import matrix

    pairs = unordered_pairs(recognition(spark, sf), "video_id", "condition", ["top1"]).groupBy("a", "b").agg(F.avg((F.col("top1_a") == F.col("top1_b")).cast("int")).alias("v"))
    return matrix(pairs, "v", ["click", "view"])


@query("k6_digest_manifest", "SELECT doc_id, sha256(text) AS sha256, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS shard FROM documents")
def k6(spark, sf):
    digests = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return order.numbered(digests, [F.col("doc_id")]).select("doc_id", "sha256", F.floor(F.col("position") / 100).alias("shard"))


@query("r11_cut_mask", "WITH {SEG} SELECT video_id, count(*) AS removed, round(sum(dur), 6) AS seconds FROM seg WHERE label <> 'important' GROUP BY video_id")
def r11(spark, sf):
    return segments(spark, sf).where("label <> 'important'").groupBy("video_id").agg(F.count("*").alias("removed"), F.round(F.sum("dur"), 6).alias("seconds"))


@query("w3_gaps", "WITH {SEG} SELECT video_id, idx, greatest(lead(start_s) OVER (PARTITION BY video_id ORDER BY idx) - end_s, 0) AS gap FROM seg WHERE label = 'important' QUALIFY lead(start_s) OVER (PARTITION BY video_id ORDER BY idx) IS NOT NULL")
def w3(spark, sf):
    nxt = F.lead("start_s").over(W.partitionBy("video_id").orderBy("idx"))
    kept = segments(spark, sf).where("label = 'important'").withColumn("n", nxt).where("n IS NOT NULL")
    return kept.select("video_id", "idx", F.greatest(F.col("n") - F.col("end_s"), F.lit(0.0)).alias("gap"))


@query("w13_class_counts", "SELECT p_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS place FROM part GROUP BY p_type")
def w13(spark, sf):
    by = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return by.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.desc("n"), "p_type")))
