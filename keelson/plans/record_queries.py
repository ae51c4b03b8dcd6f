"""Joins, set operations, samples, top-k and rolling windows over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators import align, sample
from keelson.plans.bindings import query
from keelson.session import table


@query("n6_inner_enrichment", "SELECT o_orderpriority, count(*) AS n, round(avg(l_discount), 9) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def n6(spark, sf):
    met = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("discount"))


@query("n10_resolution", "SELECT c_custkey, coalesce(n.n_name, r.r_name, 'none') AS label FROM customer LEFT JOIN nation n ON c_nationkey = n_nationkey AND c_acctbal > 0 LEFT JOIN region r ON c_nationkey % 7 = r_regionkey")
def n10(spark, sf):
    """By id where it counts, else by the second key; the dimensions are a few rows that Spark broadcasts by their size."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    met = c.join(n, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > 0), "left").join(r, F.col("c_nationkey") % 7 == F.col("r_regionkey"), "left")
    return met.select("c_custkey", align.first_of(F.col("n_name"), F.col("r_name"), F.lit("none")).alias("label"))


@query("n11_first_source", "SELECT l_orderkey, l_linenumber AS source, l_returnflag AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS k FROM lineitem) WHERE k = 1")
def n11(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("source"), F.col("l_returnflag").alias("value"))
    return align.first_source(rows, "l_orderkey", "source", "value")


@query("n15_pending", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def n15(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, sf, "orders").select("o_orderkey").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("n16_full_outer", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY k), b AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY k) SELECT coalesce(a.k, b.k) AS nation, coalesce(n, 0) AS customers, coalesce(m, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k")
def n16(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer").fillna(0, ["customers", "suppliers"])


@query("n17_only_in_one", "SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS only_right")
def n17(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select("o_custkey").distinct()
    left = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("only_left"))
    right = o.join(c.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("only_right"))
    return left.join(right)  # one row each


@query("n20_field_compare", "SELECT o_orderkey, o_orderstatus IS NOT DISTINCT FROM s AS same FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def n20(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s"))
    return table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderstatus").eqNullSafe(F.col("s")).alias("same"))


@query("n9_all_or_nothing", "SELECT l_orderkey, bool_and(abs(l_discount - 0.05) <= 0.041) AS valid, CASE WHEN bool_and(abs(l_discount - 0.05) <= 0.041) THEN max(l_returnflag) END AS text FROM lineitem GROUP BY l_orderkey")
def n9(spark, sf):
    """Enrichment that counts only if every row of the key checks."""
    ok = F.bool_and(F.abs(F.col("l_discount") - 0.05) <= 0.041)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ok.alias("valid"), F.when(ok, F.max("l_returnflag")).alias("text"))


@query("f4_first_last", "SELECT l_orderkey, arg_min(l_discount, l_shipdate || '|' || l_partkey || '|' || l_suppkey) AS first, arg_max(l_quantity, l_shipdate || '|' || l_partkey || '|' || l_suppkey) AS last FROM lineitem GROUP BY l_orderkey")
def f4(spark, sf):
    key = F.concat_ws("|", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    by = table(spark, sf, "lineitem").groupBy("l_orderkey")
    return by.agg(F.min(F.struct(key, "l_discount"))["l_discount"].alias("first"), F.max(F.struct(key, "l_quantity"))["l_quantity"].alias("last"))


@query("f6_pending_reasons", "SELECT CASE WHEN l_returnflag = 'R' THEN 'done' WHEN l_discount = 0 THEN 'no annotation' WHEN l_tax < 0.02 THEN 'precheck' ELSE 'pending' END AS reason, count(*) AS n FROM lineitem GROUP BY reason")
def f6(spark, sf):
    reason = F.when(F.col("l_returnflag") == "R", "done").when(F.col("l_discount") == 0, "no annotation").when(F.col("l_tax") < 0.02, "precheck").otherwise("pending")
    return table(spark, sf, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f8_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def f8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("x1_set_operations", "(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def x1(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return c.intersect(table(spark, sf, "orders").select("o_custkey")).subtract(table(spark, sf, "supplier").select("s_suppkey"))


@query("x2_union_runs", "SELECT 'customer' AS run, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier")
def x2(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("run"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("run"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


_H = "md5('{s}|' || o_orderkey)"


@query("x5_class_cap", f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H.format(s=1)}, o_orderkey) AS k FROM orders) WHERE k <= 40")
def x5(spark, sf):
    return sample.cap_by_class(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 40, 1)


@query("x6_proportional", f"""WITH c AS (SELECT o_orderpriority AS c, count(*) AS size, 500 * count(*) / sum(count(*)) OVER () AS exact FROM orders GROUP BY c), b AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, size DESC, c) AS place FROM c),
q AS (SELECT c, base + (place <= 500 - sum(base) OVER ())::INT AS quota FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H.format(s=2)}, o_orderkey) AS k FROM orders) SELECT o_orderkey, o_orderpriority FROM r JOIN q ON o_orderpriority = c WHERE k <= quota""")
def x6(spark, sf):
    return sample.proportional(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 500, 2)


@query("x7_class_diverse", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H.format(s=3)}, o_orderkey) AS k FROM orders) ORDER BY k, {_H.format(s=3)}, o_orderkey LIMIT 23")
def x7(spark, sf):
    return sample.one_per_class_then_fill(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 23, 3).select("o_orderkey")


@query("x8_reservoir", f"SELECT o_orderkey FROM orders ORDER BY {_H.format(s=4)}, o_orderkey LIMIT 200")
def x8(spark, sf):
    return sample.exactly(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200, 4)


@query("x10_seeded_pick", f"SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' ORDER BY {_H.format(s=5)}, o_orderkey LIMIT 12")
def x10(spark, sf):
    return sample.exactly(table(spark, sf, "orders").where("o_totalprice > 50000 AND o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", 12, 5)


@query("x12_stratified_split", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H.format(s=6)}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)) ELSE 0 END THEN 'val' ELSE 'train' END AS part FROM r")
def x12(spark, sf):
    return sample.split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.1, 6).select("o_orderkey", "part")


@query("x13_bernoulli", f"WITH r AS (SELECT *, {_H.format(s=8)} AS h FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS k FROM r) SELECT o_orderkey FROM k WHERE (('0x' || substr(h, 1, 8))::BIGINT < 85899345 OR k <= 3) AND k <= 26")
def x13(spark, sf):
    return sample.bernoulli(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.02, 3, 26, 8).select("o_orderkey")


_SIM = """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, round(avg(x), 9) AS c FROM v GROUP BY label, i),
s AS (SELECT v.vec_id, v.label AS truth, c.label AS label, round(sum(x * c), 6) AS score FROM v JOIN c USING (i) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s)"""


def _scored(spark, sf, block=512):
    """Each vector's similarity to the labels' means, s (negative) and label, in blocks of labels: a row for each vector and block."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("truth"), F.col("embedding").cast("array<double>").alias("x"))
    means = v.select("truth", F.posexplode("x").alias("i", "x")).groupBy("truth", "i").agg(F.round(F.avg("x"), 9).alias("c"))
    means = means.groupBy("truth").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("c"))
    blocks = means.where("truth IS NOT NULL").groupBy(F.floor(F.col("truth") / block)).agg(F.collect_list(F.struct(F.col("truth").alias("label"), "c")).alias("labels"))
    dot = lambda c: F.round(F.aggregate(F.zip_with("x", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), 6)
    scored = F.transform("labels", lambda m: F.struct((-dot(m["c"])).alias("s"), m["label"].alias("label")))
    return v.crossJoin(blocks).select("vec_id", "truth", scored.alias("scored"))


def _scores(spark, sf, k):
    """The k most similar labels of each vector: the best of the best of all blocks."""
    met = _scored(spark, sf).select("vec_id", "truth", F.slice(F.array_sort("scored"), 1, k).alias("best"))
    return met.groupBy("vec_id", "truth").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("ranked"))


@query("a76_top5", _SIM + " SELECT vec_id, list(label ORDER BY k) AS top5 FROM k WHERE k <= 5 GROUP BY vec_id")
def a76(spark, sf):
    return _scores(spark, sf, 5).select("vec_id", F.transform("ranked", lambda x: x["label"]).alias("top5"))


@query("a3_per_class", _SIM + " SELECT truth AS class, count(*) AS n, round(avg((label = truth)::INT), 9) AS top1 FROM k WHERE k = 1 GROUP BY truth")
def a3(spark, sf):
    s = _scores(spark, sf, 1)
    return s.groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("ranked")[0]["label"] == F.col("truth")).cast("int")), 9).alias("top1"))


@query("a49_difficulty", _SIM + ", e AS (SELECT vec_id, truth, label, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id) AS p FROM k) SELECT vec_id, round(-ln(greatest(p, 1e-9)), 5) AS difficulty FROM e WHERE label = truth")
def a49(spark, sf):
    """From sums over the blocks of labels."""
    total = F.aggregate("scored", F.lit(0.0), lambda a, x: a + F.exp(-x["s"]))
    own = F.try_element_at(F.filter("scored", lambda x: x["label"] == F.col("truth")), F.lit(1))["s"]
    by = _scored(spark, sf).groupBy("vec_id", "truth").agg(F.sum(total).alias("total"), F.max(own).alias("own"))
    return by.select("vec_id", F.round(-F.ln(F.greatest(F.exp(-F.col("own")) / F.col("total"), F.lit(1e-9))), 5).alias("difficulty"))


@query("a47_format_failures", "SELECT c_nationkey AS cell, count(o_custkey) AS present, count(*) - count(o_custkey) AS missing, round((count(*) - count(o_custkey)) / greatest(1, count(*)), 9) AS rate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY cell")
def a47(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    by = table(spark, sf, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_nationkey").alias("cell"))
    missing = F.count("*") - F.count("o_custkey")
    return by.agg(F.count("o_custkey").alias("present"), missing.alias("missing"), F.round(missing / F.greatest(F.lit(1), F.count("*")), 9).alias("rate"))


@query("a70_throughput", "SELECT l_suppkey % 8 AS shard, count(*) AS n, round(sum(l_quantity), 6) AS seconds, round(count(*) / sum(l_quantity), 9) AS rate FROM lineitem GROUP BY shard")
def a70(spark, sf):
    by = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("shard"))
    return by.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("seconds"), F.round(F.count("*") / F.sum("l_quantity"), 9).alias("rate"))


@query("a72_signal_mean", "SELECT o_orderkey, round(avg(l_tax), 9) AS signal FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN o_orderkey % 3 AND o_orderkey % 3 + 3 GROUP BY o_orderkey")
def a72(spark, sf):
    met = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("l_linenumber").between(F.col("o_orderkey") % 3, F.col("o_orderkey") % 3 + 3))
    return met.groupBy("o_orderkey").agg(F.round(F.avg("l_tax"), 9).alias("signal"))


@query("a75_weighted_mean", "SELECT l_orderkey, round(CASE WHEN sum(l_discount) > 0 THEN sum(l_tax * l_discount) / sum(l_discount) ELSE avg(l_tax) END, 9) AS mean FROM lineitem GROUP BY l_orderkey")
def a75(spark, sf):
    w = F.sum("l_discount")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.when(w > 0, F.try_divide(F.sum(F.col("l_tax") * F.col("l_discount")), w)).otherwise(F.avg("l_tax")), 9).alias("mean"))


@query("a77_best_epoch", "SELECT user_id, event_id AS epoch, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def a77(spark, sf):
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("event_id"), F.col("value"))).alias("x")
    return table(spark, sf, "events").groupBy("user_id").agg(best).select("user_id", F.col("x.event_id").alias("epoch"), "x.value")


@query("a65_coverage_ratio", "SELECT round(sum(l_quantity) FILTER (l_returnflag <> 'N') / sum(l_quantity), 9) AS ratio FROM lineitem")
def a65(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))) / F.sum("l_quantity"), 9).alias("ratio"))


@query("stream_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_limit(spark, sf):
    """Events of a user in the rolling hour before each, as a window over time in microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy(at).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("recent"))


@query("response_cache_hits", "SELECT event_type, round(avg((k > 1)::INT), 9) AS hit_rate FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type, day(ts) ORDER BY event_id) AS k FROM events) GROUP BY event_type")
def cache_hits(spark, sf):
    k = F.row_number().over(W.partitionBy("user_id", "event_type", F.dayofmonth("ts")).orderBy("event_id"))
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.round(F.avg((F.col("k") > 1).cast("int")), 9).alias("hit_rate"))


#: What an answer is like, by video_id % 9: as it should be, fenced after a thought, with ids twice (the last counts), or of one of the kinds that can't be joined.
_ANSWER = {
    "plain": "concat('{{\"action_summary\": \"sum ', v, '\", \"segments\": [', items, ']}}')",
    "fenced": "concat('<think> {{\"a\" </think> so: ```json\n{{\"segments\": [', items, ']}}\n``` end')",
    "twice": "concat('{{\"segments\": [{{\"segment_id\": 1, \"importance\": 3}}, ', items, ']}}')",
    "unparseable": "concat('{{\"segments\": [', items, '}}')",
    "no list": "'{{\"segments\": []}}'",
    "one less": "concat('{{\"segments\": [', replace(items, '\"segment_id\": 1,', '\"segment_id\": 1000,'), ']}}')",
    "other weight": "concat('{{\"segments\": [', replace(items, '\"importance\": ', '\"importance\": 1'), ']}}')",
    "none": "NULL",
    "word": "concat('{{\"segments\": [', replace(replace(items, '\"importance\": ', '\"importance\": \"'), ', \"phase', '\", \"phase'), ']}}')",
}


def _sidecars(spark, sf):
    """A record for each video: its segments, and an answer about them of one of nine kinds."""
    from keelson.plans.bindings import segments

    item = F.format_string('{"segment_id": %d, "importance": %d, "phase": "p%d", "reason": "r%d"%s}', F.col("idx") + 1, F.round(F.col("weight") * 100).cast("long"), F.col("idx"), F.col("idx"), F.when(F.col("idx") % 2 == 0, F.concat(F.lit(', "time_range": "t'), F.col("idx").cast("string"), F.lit('"'))).otherwise(""))
    one = F.struct(F.col("idx").alias("index"), "start_s", "end_s", F.col("weight").alias("frequency"), "label", "weight")
    by = segments(spark, sf).withColumn("item", item).groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("segments"), F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("items"))
    by = by.select(F.col("video_id").alias("n"), F.col("video_id").cast("string").alias("v"), "segments", F.array_join(F.transform("items", lambda x: x["item"]), ", ").alias("items"))
    kinds = " ".join(f"WHEN {i} THEN {text.format()}" for i, text in enumerate(_ANSWER.values()))
    raw = F.expr(f"CASE n % 9 {kinds} END")
    response = F.when(raw.isNotNull(), F.array(F.struct(F.lit("YES").alias("decision"), F.lit(0.5).alias("confidence"), F.concat(F.lit("seen "), "v").alias("evidence"), raw.alias("raw_output"))))
    kept = F.transform(F.filter("segments", lambda s: s["label"] == "important"), lambda s: s["index"])
    result = F.struct(F.array(F.struct(kept.alias("kept_indices"))).alias("mss_runs"), F.lit(1).alias("total_oracle_calls"), F.lit(True).alias("precheck_passed"), F.lit(1.0).alias("precheck_vote_yes"), response.alias("precheck_responses"))
    summary = F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"total_segments": '), F.size("segments").cast("string"), F.lit(', "important_ratio": 0.5}'))).otherwise("prose")
    return by.select(F.col("v").alias("video_id"), F.lit("label").alias("action_label"), F.concat(F.lit("/x/data/clips/"), "v").alias("video_path"), F.lit(None).cast("string").alias("timestamp"), summary.alias("summary"), "segments", result.alias("mss_result"), F.lit(1.5).alias("elapsed_s"))


_CANONICAL = """WITH {SEG}, k AS (SELECT *, video_id % 9 AS kind FROM seg), s AS (SELECT *, CASE kind WHEN 0 THEN 'enriched' WHEN 1 THEN 'enriched' WHEN 2 THEN 'enriched' WHEN 3 THEN 'degraded:raw_unparseable' WHEN 4 THEN 'degraded:no_raw_segments'
  WHEN 5 THEN 'degraded:segment_count_mismatch' WHEN 7 THEN 'degraded:no_precheck_response' ELSE 'degraded:weight_join_mismatch' END AS status FROM k),
g AS (SELECT video_id, kind, status, CAST(count(*) AS INTEGER) AS n, list(idx ORDER BY idx) FILTER (label = 'important') AS kept, list(CASE WHEN status = 'enriched' THEN 'r' || idx ELSE '' END ORDER BY idx) AS reasons, list(CASE WHEN status = 'enriched' THEN 'p' || idx END ORDER BY idx) AS phases,
  list(CASE WHEN status = 'enriched' AND idx % 2 = 0 THEN 't' || idx ELSE CAST(start_s AS BIGINT) || '-' || CAST(end_s AS BIGINT) END ORDER BY idx) AS ranges FROM s GROUP BY video_id, kind, status)
"""


@query("j28_canonical", _CANONICAL + """SELECT CAST(video_id AS VARCHAR) AS video_id, 'clips/' || video_id AS video_path, status, CASE WHEN kind = 0 THEN 'sum ' || video_id WHEN kind <> 7 THEN 'seen ' || video_id WHEN video_id % 2 = 1 THEN 'prose' END AS summary,
  CASE WHEN video_id % 2 = 0 THEN CAST(n AS BIGINT) END AS total_segments, coalesce(kept, []) AS kept, reasons, phases, ranges FROM g""")
def j28(spark, sf):
    from keelson.operators.release import canonical

    part = lambda name: F.transform("segments", lambda s: s[name])
    rows = canonical(_sidecars(spark, sf))
    return rows.select("video_id", "video_path", "status", "summary", "label_counts.total_segments", F.col("mss_result.kept_indices").alias("kept"), part("reason").alias("reasons"), part("phase").alias("phases"), part("time_range").alias("ranges"))


@query("j28_recovery", _CANONICAL + "SELECT count(*) AS n, count_if(status = 'enriched') AS enriched, round(count_if(status = 'enriched') / count(*), 9) AS share, count_if(status = 'enriched') / count(*) >= 0.995 AS passed FROM g")
def j28_recovery(spark, sf):
    from keelson.operators.release import canonical, recovery

    return recovery(canonical(_sidecars(spark, sf)), 0.995)


@query("stream_rolling_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def rolling_counts(spark, sf):
    """The rate limit as a stream over the table's files. A row far ahead, in a folder of its own, moves the watermark past all events."""
    import uuid

    from keelson.session import shared_dir
    from keelson.streaming import limiter

    own = spark.newSession()
    own.conf.set(*limiter.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    where = f"{shared_dir(spark).rstrip('/')}/rolling-{uuid.uuid4().hex}"
    events = table(own, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.agg(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).write.parquet(f"{where}/ahead")
    source = own.readStream.schema(table(own, sf, "events").schema).parquet(f"{sf}/event[s].parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))  # by a pattern, since a stream's path must be a folder and this may be a file
    stream = source.unionByName(own.readStream.schema(events.schema).parquet(f"{where}/ahead"))
    out = limiter.rolling_counts(stream, "user_id", "event_id", "ts", 3600, "1 second")
    out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_id long, recent long").parquet(f"{where}/out").select("event_id", "recent")
