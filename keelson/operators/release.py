"""Canonical records of a release: an answer's texts joined to a record's segments, all or none, with a code for how it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import let, scrub_path, time_range

# Status codes, and how far a weight may be from an importance in percent.
ENRICHED, UNPARSED, NO_RESPONSE, NO_SEGMENTS = "enriched", "degraded:raw_unparseable", "degraded:no_precheck_response", "degraded:no_raw_segments"
COUNT_MISMATCH, WEIGHT_MISMATCH = "degraded:segment_count_mismatch", "degraded:weight_join_mismatch"
TOLERANCE = 1e-6
# How answers mark thoughts and fenced text.
THOUGHT, FENCE = r"(?s)<think>.*?</think>", r"(?s)```(?:json)?\s*(.*?)```"
COUNTS = "total_segments bigint, important_count bigint, unimportant_count bigint, important_ratio double, unimportant_ratio double"
NUMBERS = r"^(BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"


def object_of(raw: Column) -> Column:
    """The JSON object of an answer as a variant: without thoughts, in the first fence if there is one, from the first brace to the last. Null if that
    is no object."""
    bare = F.regexp_replace(raw, THOUGHT, "")
    body = let(bare, lambda text: F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text))

    def inner(text: Column) -> Column:
        start, after = F.locate("{", text), F.locate("}", F.reverse(text))
        return F.when((start > 0) & (after > 0), F.substring(text, start, F.length(text) - after - start + F.lit(2)))

    parsed = let(body, lambda text: F.try_parse_json(inner(text)))
    return let(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _kind(v: Column, path: str) -> Column:
    """The type at a path; null where the path is missing, VOID where the value is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def answered(raw: Column) -> Column:
    """The segments of an answer, those with an integer id: id, importance (null unless a number), time_range, phase, reason. Null if there is no
    list of segments or an empty one."""
    items = F.when(_kind(raw, "$.segments").startswith("ARRAY"), F.try_variant_get(raw, "$.segments", "array<variant>"))
    text = lambda x, path: F.try_variant_get(x, path, "string")
    one = lambda x: F.struct(
        F.try_variant_get(x, "$.segment_id", "bigint").alias("id"),
        F.when(_kind(x, "$.importance").rlike(NUMBERS), F.try_variant_get(x, "$.importance", "double")).alias("importance"),
        F.nullif(text(x, "$.time_range"), F.lit("")).alias("time_range"),
        text(x, "$.phase").alias("phase"),
        F.when(_kind(x, "$.reason").isNull(), F.lit("")).otherwise(text(x, "$.reason")).alias("reason"),
    )
    with_id = lambda those: F.filter(those, lambda x: F.coalesce(_kind(x, "$.segment_id") == "BIGINT", F.lit(False)))
    return let(items, lambda those: F.when(F.size(those) > 0, F.transform(with_id(those), one)))


def _joined(segments: Column, said: Column) -> Column:
    """Each segment with what was said about it: an answer's ids count from 1, segments' indices from 0, and the last of equal ids counts."""
    last = lambda s: F.try_element_at(F.filter(said, lambda a: a["id"] == s["index"] + 1), F.lit(-1))
    return F.transform(segments, lambda s: F.struct(s.alias("own"), last(s).alias("said")))


def _problem(pair: Column) -> Column:
    """Why a segment doesn't join; null if it does."""
    off = F.abs(pair["own"]["weight"] - pair["said"]["importance"] / 100.0) > TOLERANCE
    return F.when(pair["said"].isNull(), COUNT_MISMATCH).when(F.coalesce(off, F.lit(True)), WEIGHT_MISMATCH)


def canonical(records: DataFrame, root: str = "data/") -> DataFrame:
    """records: video_id, action_label, video_path, timestamp, summary (text: prose, or the counts as JSON), segments, mss_result, elapsed_s. Returns the release's
    nested columns and `status`. Texts of the first response are joined to the segments by their ids, without exploding a row, and only if every segment
    has one and its weight is the importance said; else no text of the row is taken and the first problem is the status."""
    responses = F.coalesce(F.col("mss_result.precheck_responses"), F.array())
    first = F.get(responses, F.lit(0))
    own = F.coalesce(F.col("segments"), F.array())
    read = records.withColumn("__raw", object_of(first["raw_output"])).withColumn("__said", answered(F.col("__raw"))).withColumn("__pairs", _joined(own, F.col("__said")))
    problem = F.try_element_at(F.filter(F.transform("__pairs", _problem), lambda p: p.isNotNull()), F.lit(1))
    status = F.when(F.size(responses) == 0, NO_RESPONSE).when(F.col("__raw").isNull(), UNPARSED).when(F.col("__said").isNull(), NO_SEGMENTS).otherwise(F.coalesce(problem, F.lit(ENRICHED)))
    read = read.withColumn("status", status)
    enriched = F.col("status") == ENRICHED

    def segment(p: Column) -> Column:
        s, said = p["own"], lambda name: F.when(enriched, p["said"][name])
        return F.struct(
            s["index"].alias("index"), F.coalesce(said("time_range"), time_range(s["start_s"], s["end_s"])).alias("time_range"), s["start_s"].alias("start_s"), s["end_s"].alias("end_s"),
            s["label"].alias("label"), s["weight"].alias("weight"), said("phase").alias("phase"), F.when(enriched, p["said"]["reason"]).otherwise("").alias("reason"),
        )

    is_counts = F.col("summary").rlike(r"^\s*\{")
    said = F.when(_kind(F.col("__raw"), "$.action_summary") == "STRING", F.try_variant_get("__raw", "$.action_summary", "string"))
    prose = F.coalesce(said, first["evidence"], F.when(~is_counts, F.col("summary")))
    kinds = {f.name for f in records.schema["mss_result"].dataType.fields}
    recovered = F.col("mss_result.scores_recovered_from_raw_output") if "scores_recovered_from_raw_output" in kinds else F.lit(None)
    kept = F.coalesce(F.get("mss_result.mss_runs", F.lit(0))["kept_indices"], F.array().cast("array<int>"))
    result = F.struct(
        kept.alias("kept_indices"), F.col("mss_result.total_oracle_calls").cast("bigint").alias("total_oracle_calls"), F.col("mss_result.precheck_passed").alias("precheck_passed"),
        F.col("mss_result.precheck_vote_yes").alias("precheck_vote_yes"), recovered.cast("boolean").alias("scores_recovered_from_raw_output"), F.transform(responses, lambda r: r.dropFields("raw_output")).alias("precheck_responses"),
    )
    return read.select(
        "video_id", "action_label", scrub_path(F.col("video_path"), root).alias("video_path"), "timestamp", prose.alias("summary"), F.when(is_counts, F.from_json("summary", COUNTS)).alias("label_counts"),
        F.transform("__pairs", segment).alias("segments"), result.alias("mss_result"), "elapsed_s", "status",
    )


def recovery(canonical_records: DataFrame, least: float) -> DataFrame:
    """One row: records, how many are enriched, their share, and whether it is `least` at least."""
    share = F.try_divide(F.count_if(F.col("status") == ENRICHED), F.count("*"))
    return canonical_records.agg(F.count("*").alias("n"), F.count_if(F.col("status") == ENRICHED).alias("enriched"), F.round(share, 9).alias("share"), (share >= least).alias("passed"))
