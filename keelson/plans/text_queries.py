"""Text, key and hash functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import text as t
from keelson.operators import align, gates
from keelson.plans.bindings import query
from keelson.session import table


#: Labels in brackets, quotes and stops; the same expression in both dialects but for the quote sign.
_RAW = "CASE p_partkey % 4 WHEN 0 THEN concat('[', p_name, '  ', p_type, '!]') WHEN 1 THEN concat(' (\"', p_name, '\") ') WHEN 2 THEN concat(p_name, ':`.,') ELSE concat({quote}, p_type, '.', {quote}) END"


@query("j8_label_key", "SELECT p_partkey, regexp_replace(lower(trim(regexp_replace(trim(regexp_replace(trim(raw), '^[\\[(\"'']+|[\\])\"'']+$', '', 'g')), '[.,;!?''\"`]+$', ''))), '\\s+', ' ', 'g') AS key FROM (SELECT p_partkey, " + _RAW.format(quote="chr(39)") + " AS raw FROM part)")
def j8(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", _RAW.format(quote="char(39)") + " AS raw").select("p_partkey", t.label_key(F.col("raw")).alias("key"))


_COLOURS = ["red", "green", "dark blue", "white", "black", "grey", "pink"]
#: Answers by p_partkey % 10, with what they give: labels, whether normalised, reason.
_ANSWERS = [
    ('{"top5_label_ids": [0, 1, 2, 3, 6]}', ["red", "green", "dark blue", "white", "pink"], False, ""),
    ('```json\n{"top5": ["red", "Green", "dark  blue", "(white)", "pink."]}\n```', ["red", "green", "dark blue", "white", "pink"], True, ""),
    ('so: ["red", "green", "black", "grey", "white"] ok', ["red", "green", "black", "grey", "white"], False, ""),
    ('{"top5_ids": ["1", 2, 3, 4, 5]}', ["green", "dark blue", "white", "black", "grey"], False, ""),
    ('{"top5_label_ids": [0, 1, 2, 3, 7]}', [], False, "id range"),
    ("[1, 1, 2, 3, 4]", [], False, "same ids"),
    ("[1, 2, 3]", [], False, "not five: 3"),
    ("I do not know", [], False, "no list"),
    ('["red", "Red", "pink", "grey", "black"]', [], False, "same labels"),
    ('["red", "green", "pink", "grey", true]', [], False, "mixed kinds"),
]
_BY_KIND = lambda place, text: "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {text(a[place])}" for i, a in enumerate(_ANSWERS)) + " END"


@query("j7_five_answers", f"SELECT p_partkey, {_BY_KIND(1, lambda x: f'{x}::VARCHAR[]')} AS labels, p_partkey % 10 = 1 AS normalized, {_BY_KIND(3, repr)} AS reason FROM part")
def j7(spark, sf):
    raw = F.get(F.array(*[F.lit(a) for a, *_ in _ANSWERS]), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf, "part").select("p_partkey", t.five_answers(raw, _COLOURS).alias("x")).select("p_partkey", "x.*")


@query("j3_last_resort", r"""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS decision, CASE WHEN event_id % 3 > 0 THEN event_id % 10 + 0.5::DOUBLE END AS confidence, CASE WHEN event_id % 3 > 0 THEN 'it \" is ' || event_type END AS evidence FROM events""")
def j3(spark, sf):
    name = F.when(F.col("event_id") % 3 > 0, F.lit('{"Decision": "')).otherwise(F.lit('{"choice": "'))
    raw = F.concat(name, "event_type", F.lit('", "confidence": '), (F.col("event_id") % 10).cast("string"), F.lit('.5, "evidence": "it \\" is '), "event_type", F.lit('", "cut'))
    return table(spark, sf, "events").select("event_id", t.last_resort(raw).alias("x")).select("event_id", "x.*")


@query("j9_bracketless", "SELECT p_partkey, lower(translate('[' || p_name || '] ' || p_brand, '[]', '')) AS label FROM part")
def j9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.bracketless(F.concat(F.lit("["), "p_name", F.lit("] "), "p_brand")).alias("label"))


@query("j12_stem", r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM pages")
def j12(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.stem(F.col("url")).alias("stem"))


@query("s4_record_key", """WITH n AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'v' || user_id ELSE 'v' || user_id || '__x__' || event_type END AS name FROM events)
SELECT event_id, CASE WHEN contains(name, '__') THEN regexp_extract(name, '^(.*)__', 1) ELSE name END AS video_id, CASE WHEN contains(name, '__') THEN regexp_extract(name, '^.*__(.*)$', 1) ELSE 'full' END AS condition FROM n""")
def s4(spark, sf):
    name = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("v"), F.col("user_id"))).otherwise(F.concat(F.lit("v"), F.col("user_id"), F.lit("__x__"), F.col("event_type")))
    video, condition = t.record_key(F.col("name"))
    return table(spark, sf, "events").select("event_id", name.alias("name")).select("event_id", video.alias("video_id"), condition.alias("condition"))


@query("j10_scrub_path", "SELECT p_partkey, regexp_replace('/home/x/data/' || p_type || '/' || p_partkey, '^.*/data/', '') AS path FROM part")
def j10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.scrub_path(F.concat(F.lit("/home/x/data/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"))).alias("path"))


@query("j14_condition_grammar", r"""WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'id-vlm-f' || (event_id % 100) WHEN 'view' THEN 'score-threshold-t' || (event_id % 100) WHEN 'error' THEN 'fastforward-a' || (event_id % 100) ELSE 'full' END AS c FROM events)
SELECT event_id, nullif(regexp_replace(regexp_extract(c, '^(.*-threshold-t|.*fastforward-a|id-[a-z-]+-f)(\d{1,3})$', 1), '-[taf]$', ''), '') AS family, CAST(nullif(regexp_extract(c, '^(.*-threshold-t|.*fastforward-a|id-[a-z-]+-f)(\d{1,3})$', 2), '') AS INTEGER) AS percent FROM c""")
def j14(spark, sf):
    n = (F.col("event_id") % 100).cast("string")
    c = F.when(F.col("event_type") == "click", F.concat(F.lit("id-vlm-f"), n)).when(F.col("event_type") == "view", F.concat(F.lit("score-threshold-t"), n)).when(F.col("event_type") == "error", F.concat(F.lit("fastforward-a"), n)).otherwise("full")
    return table(spark, sf, "events").select("event_id", t.parse_condition(c).alias("x")).select("event_id", "x.family", "x.percent")


@query("j19_run_hash", "SELECT lang, sha256(string_agg(source || chr(1) || sha256(text) || chr(1), '' ORDER BY source || chr(1) || sha256(text) || chr(1))) AS digest FROM documents GROUP BY lang")
def j19(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", F.sha2("text", 256).alias("digest"))
    return d.groupBy("lang").agg(t.run_hash("source", "digest").alias("digest"))


@query("j20_text_hash", "SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short FROM documents")
def j20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


@query("j4_decision", "SELECT event_id, CASE event_type WHEN 'click' THEN 'YES' WHEN 'view' THEN 'NO' ELSE 'SKIP' END AS decision, round(greatest(0, least(1, value / 50)), 9) AS confidence FROM events")
def j4(spark, sf):
    word = F.when(F.col("event_type") == "click", " yes").when(F.col("event_type") == "view", "No").otherwise("uncertain")
    return table(spark, sf, "events").select("event_id", t.decision(word).alias("decision"), F.round(t.confidence(F.col("value") / 50), 9).alias("confidence"))


@query("j1_json_repair", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '{"a": [1, ' || props || ']}' ELSE props END AS json, CASE event_id % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'fenced' WHEN 2 THEN 'balanced' ELSE 'closed' END AS recovery FROM events""")
def j1(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("<think>{no}</think>```json\n"), "props", F.lit("```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("so: "), "props", F.lit(" done"))).otherwise(F.concat(F.lit("{\"a\": [1, "), F.regexp_replace("props", "}$", "")))
    return table(spark, sf, "events").select("event_id", t.repaired(raw).alias("x")).select("event_id", "x.json", "x.recovery")


@query("j1_known_keys", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"decision": "' || event_type || '"}' WHEN 1 THEN '{"confidence": ' || event_id || '}' WHEN 2 THEN '{"evidence": "{", "x": ' || props || '}' END AS json, CASE WHEN event_id % 4 < 3 THEN 'balanced' ELSE 'none' END AS recovery FROM events""")
def j1_known_keys(spark, sf):
    """Among objects without a known key, inside of them, after a brace in a text, and nowhere."""
    kind, some = F.col("event_id") % 4, F.lit('{"decision": "')
    raw = F.when(kind == 0, F.concat(F.lit("see "), "props", F.lit(" then "), some, "event_type", F.lit('"} end'))).when(kind == 1, F.concat(F.lit('{"list": [1, {"confidence": '), F.col("event_id").cast("string"), F.lit("}], \"p\": "), "props", F.lit("}")))
    raw = raw.when(kind == 2, F.concat(F.lit('{"open": {"a": "}", {"evidence": "{", "x": '), "props", F.lit("} {"))).otherwise(F.concat("props", F.lit(' {"a": '), "props"))
    return table(spark, sf, "events").select("event_id", t.repaired(raw, t.ORACLE_KEYS).alias("x")).select("event_id", "x.json", "x.recovery")


@query("j6_gap_fill", "WITH s AS (SELECT o_orderkey, (o_orderkey % 10) / 10 AS a, (o_orderkey % 7) / 7 AS d FROM orders) SELECT o_orderkey, round(a, 9) AS s1, round((a + d) / 2, 9) AS s2, round(((a + d) / 2 + d) / 2, 9) AS s3, round(d, 9) AS s4 FROM s")
def j6(spark, sf):
    key = F.col("o_orderkey")
    holes = F.array(key % 10 / 10, F.lit(None).cast("double"), F.lit(None).cast("double"), key % 7 / 7)
    filled = table(spark, sf, "orders").select("o_orderkey", t.fill_gaps(holes).alias("s"))
    return filled.select("o_orderkey", *[F.round(F.col("s")[i], 9).alias(f"s{i + 1}") for i in range(4)])


@query("j17_placeholders", "SELECT doc_id, array_to_string(string_split(text, ' '), ', ') AS joined FROM documents")
def j17(spark, sf):
    listed = F.to_json(F.split("text", " "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.from_json(listed, "array<string>"), ", ").alias("joined"))


@query("j25_chance_level", "SELECT p_size, least(1.0, 5.0 / p_size)::DOUBLE AS chance, count(*) AS n FROM part WHERE p_size > 0 GROUP BY p_size")
def j25(spark, sf):
    p = table(spark, sf, "part").where("p_size > 0")
    return p.groupBy("p_size").agg(F.count("*").alias("n")).withColumn("chance", F.least(F.lit(1.0), 5.0 / F.col("p_size")))


@query("j27_cosine_rate", "SELECT o_orderkey, round(CASE WHEN s < 100 THEN s / 100 ELSE 0.5 * (1 + cos(pi() * (s - 100) / 900)) END, 9) AS rate FROM (SELECT o_orderkey, o_orderkey % 1000 AS s FROM orders)")
def j27(spark, sf):
    s = F.col("o_orderkey") % 1000
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.when(s < 100, s / 100).otherwise(0.5 * (1 + F.cos(F.pi() * (s - 100) / 900))), 9).alias("rate"))


@query("a67_rate_gate", "SELECT source, count(*) AS n, round(count_if(n_chars < 500) / count(*), 9) AS rate, abs(count_if(n_chars < 500) / count(*) - 0.1) <= 0.05 AS passed FROM documents GROUP BY source")
def a67(spark, sf):
    return gates.rate(table(spark, sf, "documents"), "source", F.col("n_chars") < 500, 0.1, 0.05)


@query("a68_count_gate", "SELECT (SELECT count(*) FROM lineitem) AS canonical, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS source, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS passed")
def a68(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return gates.equal_counts({"canonical": l, "source": l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")})


@query("f13_parity", "SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS status_differs, count(DISTINCT o_orderpriority) > 1 AS priority_differs FROM orders GROUP BY o_custkey")
def f13(spark, sf):
    return gates.parity(table(spark, sf, "orders"), ["o_custkey"], {"status_differs": "o_orderstatus", "priority_differs": "o_orderpriority"})


_SIZES = "CASE o_orderkey % 4 WHEN 0 THEN o_orderkey / 8 WHEN 1 THEN o_orderkey * 1e-6 WHEN 2 THEN o_orderkey * 1000.0 ELSE 0 END"


@query("j18_time_range", f"SELECT o_orderkey, printf('%g', (o_orderkey % 500 / 4)::DOUBLE) || '-' || printf('%g', ({_SIZES})::DOUBLE) AS time_range FROM orders")
def j18(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", t.time_range(F.col("o_orderkey") % 500 / 4, F.expr(f"cast({_SIZES} as double)")).alias("time_range"))


@query("j13_by_substring", "SELECT doc_id, CASE WHEN contains(lower(text), 'table') OR contains(lower(text), 'the') THEN 'a' WHEN contains(lower(text), 'data') THEN 'b' ELSE 'unknown' END AS dataset FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def j13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.first_containing(F.col("text"), [("table", "a"), ("the", "a"), ("data", "b")], "unknown").alias("dataset"))


@query("j26_by_prefix", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'given' WHEN p_type LIKE 'S%' THEN 's' WHEN p_type LIKE 'P%' THEN 'p' ELSE 'local' END AS provider FROM part")
def j26(spark, sf):
    given = F.when(F.col("p_partkey") % 5 == 0, "given").when(F.col("p_partkey") % 5 == 1, "auto")
    return table(spark, sf, "part").select("p_partkey", t.first_prefix(F.col("p_type"), [("S", "s"), ("P", "p")], "local", given).alias("provider"))


@query("j15_class_name", "SELECT event_id, CASE event_type WHEN 'click' THEN coalesce(CASE WHEN event_id % 2 = 0 THEN 'template' END, props) WHEN 'view' THEN props END AS name FROM events")
def j15(spark, sf):
    template = F.when(F.col("event_id") % 2 == 0, "template").otherwise("")
    return table(spark, sf, "events").select("event_id", t.class_name(F.col("event_type"), {"click": [template, F.col("props")], "view": [F.col("props")]}).alias("name"))


@query("f12_pass_through", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 1.5 END::DOUBLE AS score FROM supplier")
def f12(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, 1.5).otherwise(float("nan")).alias("score"))
    rest = rows.select("s_suppkey", t.other_columns(rows, ["s_suppkey"]).alias("m"))
    return rest.select("s_suppkey", F.col("m")["s_nationkey"].alias("nation"), F.col("m")["s_name"].alias("name"), F.col("m")["score"].cast("double").alias("score"))


@query("j11_scrub_json", r"""SELECT p_partkey, '{"/root/x": "a/' || p_partkey || '", "l": ["b \" /root/x", {"v": "c"}], "t": "at /root/d"}' AS doc, ['/root/', 'at /'] AS markers FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, '{"/root/x": "a/' || p_partkey || '", "l": ["b \" /root/x", {"v": "c"}], "t": "at d"}' AS doc, ['/root/'] AS markers FROM part WHERE p_partkey % 7 > 0""")
def j11(spark, sf):
    tail = F.when(F.col("p_partkey") % 7 == 0, "at /root/d").otherwise("at d")
    raw = F.concat(F.lit('{"/root/x": "/root/a/'), F.col("p_partkey").cast("string"), F.lit('", "l": ["b \\" /root/x", {"v": "/root/c"}], "t": "'), tail, F.lit('"}'))
    clean = table(spark, sf, "part").select("p_partkey", t.scrub_json(raw, "/root/").alias("doc"))
    return clean.select("p_partkey", "doc", t.forbidden(F.col("doc"), ["/root/", "at /"]).alias("markers"))


@query("j16_backfill_truth", """WITH ids AS (SELECT lower(p_type) AS key, CAST(min(p_size) - 1 AS INTEGER) AS id FROM part GROUP BY 1),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INTEGER) END AS truth_id, CASE WHEN p_partkey % 4 = 3 THEN 'no such' ELSE lower(p_type) END AS key, [CAST(p_size - 1 AS INTEGER), 0, 7] AS a FROM part)
SELECT p_partkey, coalesce(truth_id, id) AS truth_id, truth_id IS NULL AND id IS NOT NULL AND a[1] = id AS top1, truth_id IS NULL AND id IS NOT NULL AND list_contains(a, id) AS top5 FROM r LEFT JOIN ids USING (key)""")
def j16(spark, sf):
    p = table(spark, sf, "part")
    label = F.when(F.col("p_partkey") % 4 == 3, "no such").when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" ["), "p_type", F.lit("]"))).otherwise(F.col("p_type"))
    records = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("int")).alias("truth_id"), label.alias("truth"), F.array((F.col("p_size") - 1).cast("int"), F.lit(0), F.lit(7)).alias("top5_ids"), F.lit(False).alias("top1"), F.lit(False).alias("top5"))
    return align.backfill_truth(records, p.select(F.col("p_type").alias("label"), (F.col("p_size") - 1).cast("int").alias("id"))).drop("truth", "top5_ids")
