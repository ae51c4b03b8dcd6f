"""Canonical tables (segments, recognition) over the test tables, in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators import resample
from keelson.session import table

QUERIES: dict = {}
ORACLES: dict = {}

SEG = """
seg0 AS (SELECT l_orderkey AS video_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS idx,
  l_quantity AS dur, l_discount * 10 AS weight, l_tax * 10 AS weight2, CASE WHEN l_returnflag <> 'N' THEN 'important' ELSE 'unimportant' END AS label FROM lineitem),
seg AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s,
  sum(dur) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_s FROM seg0)"""
REC = """
rec0 AS (SELECT event_id, user_id || 'w' || CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS video_id, event_type AS condition, value > 20 AS top1, value > 5 AS top5,
  value, CAST(json_extract(props, '$.k') AS INTEGER) = 0 AS failed FROM events),
rec AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, condition ORDER BY event_id DESC) AS rn FROM rec0) WHERE rn = 1)"""


#: Rows of segments from which their partitions are counted, and rows a partition then has at most, about: each of a task's sorts holds its whole partition.
COUNTED_FROM, A_PARTITION = 1_000_000, 250_000


def by_video(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """Large tables in as many partitions of whole videos as they have rows for, so a task holds no more of a larger table; small ones as they are. Counting reads only the files' footers."""
    n = rows.count()
    return rows if n < COUNTED_FROM else rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // A_PARTITION)), key)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, idx, dur, weight, weight2, label, start_s, end_s."""
    order = W.partitionBy("video_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_quantity").alias("dur"), (F.col("l_discount") * 10).alias("weight"), (F.col("l_tax") * 10).alias("weight2"),
        F.when(F.col("l_returnflag") != "N", "important").otherwise("unimportant").alias("label"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
    )
    end = F.sum("dur").over(order.rowsBetween(W.unboundedPreceding, 0))
    return by_video(rows).select("video_id", (F.row_number().over(order) - 1).alias("idx"), "dur", "weight", "weight2", "label", (end - F.col("dur")).alias("start_s"), end.alias("end_s"))


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.col("user_id").cast("string"), F.lit("w"), week.cast("string")).alias("video_id"), F.col("event_type").alias("condition"),
        (F.col("value") > 20).alias("top1"), (F.col("value") > 5).alias("top5"), "value", (F.get_json_object("props", "$.k").cast("int") == 0).alias("failed"),
    )


def recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a video and condition, the last written: event_id, video_id, condition, top1, top5, value, failed."""
    from keelson.operators.align import last_write

    return last_write(all_events(spark, sf_dir), ["video_id", "condition"], "event_id")


def weights_sql(rows: str, seed: int, key: str, replicates: int, carry: str) -> str:
    """The counts of resample.weights in SQL: r (from -1), w and the carried columns of a relation."""
    digests = f"SELECT *, md5('{seed}|' || {key}) AS __d FROM {rows}"
    words = f"SELECT {carry}, ('0x' || substr(__d, 1, 8))::UBIGINT AS __high, ('0x' || substr(__d, 9, 8))::UBIGINT AS __low FROM ({digests})"
    steps = f"SELECT {carry}, r, __low, (__high + (r + 1) * {resample.STRIDE}) % 4294967296 AS __x FROM ({words}), (SELECT range::UBIGINT AS r FROM range({replicates}))"
    for last in (False, True):
        for shift, factor in resample.MIX:
            steps = f"SELECT {carry}, r, __low, (xor(__x, __x >> {shift}) * {factor}) % 4294967296 AS __x FROM ({steps})"
        if not last:
            steps = f"SELECT {carry}, r, __low, xor(__low, __x) AS __x FROM ({steps})"
    count = " + ".join(f"(__x >= {t})::INT" for t in resample.REACHED)
    return f"SELECT {carry}, CAST(r AS INTEGER) AS r, {count} AS w FROM ({steps}) UNION ALL SELECT {carry}, -1, 1 FROM {rows}"


def _one_zero(df: DataFrame) -> DataFrame:
    """Negative zero as zero."""
    return df.select(*[(F.col(c) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _long_counts(sql: str) -> str:
    """DuckDB counts conditions in 128 bits; casts them to long."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[end : end + 5] == " OVER":
            out.append(sql[at:end])
        else:
            out += [sql[at:k], f"CAST({sql[k:end]} AS BIGINT)"]
        at = end
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that checks it; SEG and REC in braces stand for the canonical tables."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: _one_zero(function(spark, sf_dir))
        if sql:
            ORACLES[name] = _long_counts(sql.replace("{SEG}", SEG.strip()).replace("{REC}", REC.strip()))
        return function

    return register
