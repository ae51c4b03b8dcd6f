"""Answers of models, prompts, protocols and functions in SQL, over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from keelson.functions import prompts, registry, tokens
from keelson.operators import allocate, order
from keelson.plans.bindings import query, segments
from keelson.session import table

#: Tokens of a user's events: its type gives the word, its number the likeliest tokens there.
_WORD = "CASE event_type WHEN 'click' THEN ' yes' WHEN 'error' THEN 'NO ' WHEN 'purchase' THEN 'Skip' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'x</think>' ELSE 'so' END ELSE 'the' END"
_TOKENS = f"""WITH t AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, {_WORD} AS word FROM events),
th AS (SELECT user_id, coalesce(min(pos) FILTER (word LIKE '%</think>%') + 1, 0) AS start, count(*) AS n FROM t GROUP BY user_id),
f AS (SELECT th.user_id, start, n, min(pos) FILTER (pos >= start AND event_type IN ('click', 'error', 'purchase')) AS pos FROM th JOIN t USING (user_id) GROUP BY ALL),
d AS (SELECT user_id, CASE WHEN pos IS NOT NULL THEN pos WHEN start > 0 AND start >= n THEN -2 ELSE -1 END AS position,
  coalesce(CASE WHEN event_id % 3 = 0 THEN greatest(-value / 10, -(value + 1) / 20) END, CASE WHEN event_type = 'click' THEN -value / 5 END) AS yes, coalesce(CASE WHEN event_id % 3 = 0 THEN -value / 7 END, CASE WHEN event_type = 'error' THEN -value / 5 END) AS no,
  coalesce(CASE WHEN event_id % 3 = 1 THEN -value / 10 END, CASE WHEN event_type = 'purchase' THEN -value / 5 END) AS skip FROM f LEFT JOIN t USING (user_id, pos))"""


def _tokens(spark, sf):
    one = lambda word, logprob: F.struct(F.lit(word).alias("token"), logprob.alias("logprob"))
    v, kind = F.col("value"), F.col("event_id") % 3
    top = F.when(kind == 0, F.array(one("YES", -v / 10), one("yes ", -(v + 1) / 20), one("No", -v / 7))).when(kind == 1, F.array(one("SKIP", -v / 10), one("x", F.lit(0.0)))).otherwise(F.array())
    token = F.struct("event_id", F.struct(F.expr(_WORD).alias("token"), (-v / 5).alias("logprob"), top.alias("top")).alias("t"))
    by = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(token), lambda a, b: F.signum(a["event_id"] - b["event_id"]).cast("int")).alias("s"))
    return by.select("user_id", F.transform("s", lambda x: x["t"]).cast(tokens.TOKENS).alias("tokens"))


@query("g8_decision_token", _TOKENS + " SELECT user_id, CAST(position AS INTEGER) AS position, round(yes, 9) AS yes, round(no, 9) AS no, round(skip, 9) AS skip FROM d")
def g8(spark, sf):
    found = _tokens(spark, sf).select("user_id", tokens.decision_logprobs(F.col("tokens")).alias("d"))
    return found.select("user_id", "d.position", *[F.round(f"d.{c}", 9).alias(c) for c in ("yes", "no", "skip")])


@query("g8_token_confidence", _TOKENS + """, p AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'SKIP' END AS decision, 1 / (1 + exp(-least(100, greatest(-100, yes - no)))) AS p_yes FROM d),
s AS (SELECT *, CASE WHEN position = -2 THEN 'thought_only' WHEN position = -1 THEN 'no_decision' WHEN yes IS NULL OR no IS NULL THEN 'partial' WHEN decision = 'YES' AND p_yes < 0.01 OR decision = 'NO' AND p_yes > 0.99 THEN 'anomaly' ELSE 'tokens' END AS source FROM p)
SELECT user_id, source, round(CASE WHEN source = 'tokens' THEN p_yes WHEN decision = 'YES' THEN 0.7 ELSE 0 END, 9)::DOUBLE AS confidence, round(CASE WHEN source = 'tokens' THEN exp(skip) / (exp(yes) + exp(no) + exp(skip)) WHEN decision = 'SKIP' THEN 1 END, 9)::DOUBLE AS p_skip FROM s""")
def g8_confidence(spark, sf):
    decision = F.when(F.col("user_id") % 3 == 0, "YES").when(F.col("user_id") % 3 == 1, "NO").otherwise("SKIP")
    found = _tokens(spark, sf).select("user_id", tokens.token_confidence(decision, F.lit(0.7), F.col("tokens")).alias("c"))
    return found.select("user_id", "c.source", F.round("c.logit_confidence", 9).alias("confidence"), F.round("c.logit_p_skip", 9).alias("p_skip"))


_TEMPLATE = 'Is "{action_template}{action_label}" shown with {placeholders}? Say {{"yes": 1}}. ({prompt_template_id})'


@query("j22_prompt", """WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ssv2' WHEN 'BUILDING' THEN 'k400' WHEN 'FURNITURE' THEN 'diving48' ELSE 'other' END AS kind, c_name, n_name,
  CASE c_custkey % 4 WHEN 0 THEN c_name || ', a {x}' WHEN 1 THEN 'plain' WHEN 2 THEN coalesce(n_name, 'unknown') ELSE coalesce(n_name, 'unknown') END AS objects, c_custkey % 4 >= 2 AND n_name IS NOT NULL AS other FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE kind WHEN 'ssv2' THEN 'Is "' || CASE WHEN other THEN 'of ' || n_name ELSE c_name END || '{action_label}" shown with ' || objects || '? Say {"yes": 1}. (mss_verification_ssv2)' WHEN 'k400' THEN 'Is "{action_template}' || c_name || '" shown with {placeholders}? Say {"yes": 1}. (mss_verification_k400)' END AS text,
  CASE kind WHEN 'ssv2' THEN ['action_label'] WHEN 'k400' THEN ['action_template', 'placeholders'] END AS missing FROM c""")
def j22(spark, sf):
    """Customers stand for records, nations for the table that is asked for what a record lacks; kinds without a template have no prompt."""
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.struct(F.concat(F.lit('["'), "n_name", F.lit('"]')).alias("placeholders"), F.concat(F.lit("of "), "n_name").alias("label")).alias("found"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "ssv2").when(F.col("c_mktsegment") == "BUILDING", " K400").when(F.col("c_mktsegment") == "FURNITURE", "diving48").otherwise("other")
    key = F.col("c_custkey") % 4
    given = F.when(key == 0, F.concat(F.lit('["'), "c_name", F.lit('", "a {x}"]'))).when(key == 1, "plain").when(key == 2, "")
    rows = c.select("c_custkey", prompts.context(kind, F.col("c_name"), given, F.col("found")).alias("context"))
    prompt = prompts.render(_TEMPLATE, F.col("context"))
    return rows.select("c_custkey", F.when(F.col("context").isNotNull(), prompt).alias("p")).select("c_custkey", "p.*")


@query("udtf_segments", """WITH d AS (SELECT o_orderkey AS video_id, (o_orderkey % 50 + 1) / 4 AS duration FROM orders), k AS (SELECT *, unnest(range(CAST(ceil(duration / 2) AS BIGINT))) AS idx FROM d)
SELECT video_id, CAST(idx AS INTEGER) AS idx, (idx * 2.0)::DOUBLE AS start_s, least((idx + 1) * 2.0::DOUBLE, duration) AS end_s FROM k""")
def udtf_segments(spark, sf):
    """R1 from SQL."""
    registry.register(spark)
    orders = table(spark, sf, "orders")
    return spark.sql("SELECT o_orderkey AS video_id, s.* FROM {orders}, LATERAL segments((o_orderkey % 50 + 1) / 4, 2) AS s", orders=orders)


@query("udaf_area", "WITH p AS (SELECT o_custkey, o_orderkey % 1000 AS x, o_totalprice / 1000 AS y FROM orders), w AS (SELECT o_custkey, (x - lag(x) OVER o) * (y + lag(y) OVER o) / 2 AS a FROM p WINDOW o AS (PARTITION BY o_custkey ORDER BY x, y)) SELECT o_custkey, round(coalesce(sum(a), 0), 6) AS area FROM w GROUP BY o_custkey")
def udaf_area(spark, sf):
    registry.register(spark)
    orders = table(spark, sf, "orders")
    return spark.sql("SELECT o_custkey, round(area(CAST(o_orderkey % 1000 AS DOUBLE), o_totalprice / 1000), 6) AS area FROM {orders} GROUP BY o_custkey", orders=orders)


@query("r12_protocols", """WITH {SEG}, v AS (SELECT video_id, CAST(max(end_s) AS INTEGER) AS total, list_sort(list_distinct(flatten(coalesce(list(range(CAST(start_s AS BIGINT), least(CAST(max_end AS BIGINT) - 1, CAST(end_s AS BIGINT)) + 1)) FILTER (label = 'important'), [])))) AS pool
  FROM (SELECT *, max(end_s) OVER (PARTITION BY video_id) AS max_end FROM seg) GROUP BY video_id), w AS (SELECT *, [CAST(round_even(i * (total - 1) / 7::DOUBLE, 0) AS INTEGER) FOR i IN range(8)] AS whole, unnest(['repack', 'mask', 'sparse']) AS protocol FROM v)
SELECT video_id, protocol, CASE WHEN protocol = 'mask' OR len(pool) = 0 THEN whole ELSE [CAST(pool[CAST(round_even(i * (len(pool) - 1) / 7::DOUBLE, 0) AS INTEGER) + 1] AS INTEGER) FOR i IN range(8)] END AS frames,
  CASE WHEN protocol = 'mask' THEN [NOT list_contains(pool, i) FOR i IN whole] ELSE [false FOR i IN range(8)] END AS blank FROM w""")
def r12(spark, sf):
    kept = F.collect_list(F.when(F.col("label") == "important", F.struct("start_s", "end_s"))).alias("kept")
    v = segments(spark, sf).groupBy("video_id").agg(F.max("end_s").cast("int").alias("total"), kept)
    each = v.withColumn("protocol", F.explode(F.array(*map(F.lit, allocate.PROTOCOLS))))
    return each.select("video_id", "protocol", allocate.protocol_frames(F.col("kept"), F.col("total"), F.lit(1.0), 8, F.col("protocol")).alias("p")).select("video_id", "protocol", "p.*")


@query("r15_flat_batches", "SELECT CAST(floor(rn / 64) AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY batch")
def r15(spark, sf):
    """Batches of 64 in order, numbered without one task."""
    rows = order.numbered(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    by = rows.groupBy(F.floor(F.col("position") / 64).alias("batch"))
    return by.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("w14_ordered_output", "SELECT row_number() OVER (ORDER BY p_type, p_name, p_partkey) - 1 AS position, p_type, p_name, p_partkey FROM part")
def w14(spark, sf):
    """The final order of an output: range partitions that follow one another, with each row's place."""
    rows = table(spark, sf, "part").select("p_type", "p_name", "p_partkey")
    return order.numbered(rows, [F.col("p_type"), F.col("p_name"), F.col("p_partkey")])


@query("recogniser_registry", """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, round(avg(x), 9) AS c FROM v GROUP BY label, i),
s AS (SELECT v.vec_id, c.label AS label, round(sum(x * c), 6) AS score FROM v JOIN c USING (i) GROUP BY ALL) SELECT vec_id, arg_max(label, score) AS label, max(score) AS score FROM s GROUP BY vec_id""")
def recogniser(spark, sf):
    """Vectors recognised by the means of their labels (a row a label), through a registered name. Scores count to six digits; of labels that are equal there it is the least.
    A null label's mean gives scores, but no label."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = v.select("label", F.posexplode("x").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("c"))
    labels = {r["label"]: r["c"] for r in means.orderBy("label").collect()}
    known = registry.Recognisers()
    known.add("centroids", "keelson.functions.registry:centroids", means=list(labels.values()))
    names = F.array(*map(F.lit, labels))
    found = v.select("vec_id", known.column("centroids", F.col("x"), 2, digits=6).alias("r"))
    label = lambda k: F.get(names, F.get(F.col("r.top_ids"), F.lit(k)))
    return found.select("vec_id", F.coalesce(label(0), label(1)).alias("label"), F.col("r.top_scores")[0].alias("score"))


@query("r11_mask_modes", """WITH {SEG}, f AS (SELECT video_id, idx, label = 'important' AS hidden, unnest(['blur', 'freeze', 'black', 'mean', 'cut']) AS mode FROM seg),
s AS (SELECT *, last_value(CASE WHEN NOT hidden THEN idx END IGNORE NULLS) OVER (PARTITION BY video_id, mode ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM f)
SELECT mode, video_id, idx, CASE WHEN NOT hidden OR mode = 'blur' THEN idx WHEN mode = 'freeze' THEN coalesce(before, 0) END AS shows, CASE WHEN hidden AND mode <> 'freeze' THEN mode END AS effect FROM s WHERE NOT (mode = 'cut' AND hidden)""")
def r11_modes(spark, sf):
    """Segments stand for frames, and important ones are hidden."""
    frames = segments(spark, sf).select("video_id", "idx", (F.col("label") == "important").alias("hidden"))
    rows = [allocate.masked(frames, "video_id", "idx", "hidden", mode).select(F.lit(mode).alias("mode"), "video_id", "idx", "shows", "effect") for mode in allocate.MASKS]
    return reduce(lambda a, b: a.unionByName(b), rows)
