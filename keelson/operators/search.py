"""Greedy minimal-subset search as an iterative query: all videos of a round are scored together."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from keelson.functions.text import direct_scores
from keelson.session import materialize, shared_dir


# Why a search ended.
BELOW, NONE_LEFT, SINGLE, COMPLETE = "baseline_below_tau_min", "no_removable_segments", "single_segment", "complete"
_ENDED = "video_id string, kept array<int>, removed array<int>, calls long, baseline double, reason string"
_TRACE = "video_id string, iteration int, baseline double, candidate int, score double, drop double, removable boolean, removed boolean"


@dataclass
class Search:
    """What a search found: a row a video, and a row for each candidate of each round."""

    found: DataFrame
    trace: DataFrame


def score_based_removal(segments: DataFrame, ask: Callable[[DataFrame], DataFrame], limits: DataFrame | None = None, least: float = 0.5) -> Search:
    """segments: video_id, idx. ask takes candidate subsets (video_id, removed, kept, n) and adds `score`. Each round asks, for each open video, about
    every subset that lacks one segment more; of those that score above `least` the one with the smallest drop from the baseline goes (the first on ties), and its
    score is the new baseline. A video ends with one segment left, or when no segment can go.

    limits: video_id, baseline (1 where null), and tau_final, delta, tau_min, each null for no such limit: then a candidate must also
    score tau_final at least and drop by less than delta, and a video whose baseline is below tau_min ends before it is asked about. Its other columns go with the video's questions.

    Only open videos are written anew in a round: a round's table has the videos that were open before it, and the result is what ended in any of them."""
    spark = segments.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    asked = segments.select(F.col("video_id").cast("string").alias("video_id"), "idx").groupBy("video_id").agg(F.array_sort(F.collect_set(F.col("idx").cast("int"))).alias("kept"))
    names = ["baseline", "tau_final", "delta", "tau_min"]
    if limits is None:
        extra = []
        limited = asked.withColumns({n: F.lit(None).cast("double") for n in names})
    else:
        extra = [c for c in limits.columns if c not in ("video_id", *names)]
        limited = asked.join(limits.select(F.col("video_id").cast("string").alias("video_id"), *[F.col(n).cast("double").alias(n) for n in names], *extra), "video_id", "left")
    now = limited.withColumns({"baseline": F.coalesce("baseline", F.lit(1.0)), "n": F.when(F.size("kept") > 0, F.array_max("kept") + 1).otherwise(0), "removed": F.expr("cast(array() as array<int>)"), "calls": F.lit(0).cast("long"), "found": F.lit(True)})
    schema = StructType.fromDDL(f"{_ENDED}, tau_final double, delta double, tau_min double, n int, found boolean")
    schema = StructType([*schema.fields, *(limited.schema[c] for c in extra)])
    for number in count(1):
        over = F.when(F.size("kept") == 1, SINGLE).when(F.size("kept") == 0, COMPLETE).when(~F.col("found"), NONE_LEFT).when(F.col("baseline") < F.col("tau_min"), BELOW)
        left = Observation()
        now.withColumn("reason", over).observe(left, F.count_if(F.col("reason").isNull()).alias("open")).write.parquet(f"{where}/videos/round={number}")
        if not left.get["open"]:
            break
        still = spark.read.schema(schema).parquet(f"{where}/videos/round={number}").where("reason IS NULL").drop("reason")
        candidates = still.select("video_id", F.col("kept").alias("all"), "n", *extra, F.explode("kept").alias("candidate"))
        questions = candidates.select("video_id", F.col("candidate").alias("removed"), F.array_remove("all", F.col("candidate")).alias("kept"), "n", *extra)
        scored = ask(questions).select("video_id", F.col("removed").alias("candidate"), F.coalesce("score", F.lit(0.0)).alias("score"))
        drop = F.col("baseline") - F.col("score")
        can = (F.col("score") > least) & F.coalesce(F.col("score") >= F.col("tau_final"), F.lit(True)) & F.coalesce(drop < F.col("delta"), F.lit(True))
        judged = scored.join(still.select("video_id", "baseline", "tau_final", "delta"), "video_id").select("video_id", F.lit(number).alias("iteration"), "baseline", "candidate", "score", drop.alias("drop"), can.alias("removable"))
        best = F.min(F.when(F.col("removable"), F.struct("drop", "candidate"))).over(W.partitionBy("video_id"))
        judged.withColumn("removed", F.coalesce(F.col("candidate") == best["candidate"], F.lit(False))).write.parquet(f"{where}/trace/round={number}")
        trace = spark.read.schema(_TRACE).parquet(f"{where}/trace/round={number}")
        picked = trace.groupBy("video_id").agg(F.max(F.when(F.col("removed"), F.struct("candidate", "score"))).alias("best"), F.count("*").alias("more"))
        gone = F.col("best.candidate")
        now = still.join(picked, "video_id").select(
            "video_id", F.when(gone.isNull(), F.col("kept")).otherwise(F.array_remove("kept", gone)).alias("kept"), F.coalesce("best.score", "baseline").alias("baseline"), "tau_final", "delta", "tau_min", "n",
            F.when(gone.isNull(), F.col("removed")).otherwise(F.array_append("removed", gone)).alias("removed"), (F.col("calls") + F.col("more")).alias("calls"), gone.isNotNull().alias("found"), *extra,
        )
    ended = spark.read.schema(StructType([*schema.fields, StructField("round", IntegerType())])).parquet(f"{where}/videos").where("reason IS NOT NULL").select("video_id", "kept", "removed", "calls", "baseline", "reason")
    if number == 1:
        return Search(ended, spark.createDataFrame([], _TRACE))
    return Search(ended, spark.read.schema(f"{_TRACE}, round int").parquet(f"{where}/trace").drop("round"))


def minimal_subset(segments: DataFrame, score: Callable[[DataFrame], DataFrame], least: float = 0.5) -> DataFrame:
    """The same without limits: score adds `p` to candidate subsets. Returns video_id, kept, rounds (in which a segment went)."""
    found = score_based_removal(segments, lambda rows: score(rows).withColumnRenamed("p", "score"), least=least).found
    return found.select("video_id", "kept", F.size("removed").alias("rounds"))


def random_removal(segments: DataFrame, score: Callable[[DataFrame], DataFrame], seed: int = 42, fraction: float = 0.5, least: int = 2, most: int = 8) -> DataFrame:
    """segments: video_id, idx. score takes (video_id, removed, kept, n) rows of candidate subsets and adds `ok`. Each round scores a shortlist
    of a video's segments, chosen by hash: `fraction` of them, `least` at least and `most` at most. Only where none of it is ok, all
    others are scored too. One of those that are ok goes, chosen by hash; a video ends with one segment or when none is ok. Only open videos are
    written anew in a round. Returns video_id, kept, removed (in order), calls (scored subsets), reason (single_segment, no_removable)."""
    spark = segments.sparkSession
    ended = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    now = segments.groupBy("video_id").agg(F.array_sort(F.collect_set("idx")).alias("kept"))
    now = now.withColumns({"n": F.coalesce(F.array_max("kept") + 1, F.lit(0)), "removed": F.expr("cast(array() as array<int>)"), "calls": F.lit(0).cast("long"), "found": F.lit(True)})
    schema = now.drop("n", "found").withColumn("reason", F.lit(SINGLE)).schema
    for number in count(1):
        over = F.when(F.size("kept") <= 1, SINGLE).when(~F.col("found"), "no_removable")
        state = materialize(now.withColumn("reason", over), "open")
        state.where("reason IS NOT NULL").drop("n", "found").write.mode("append").parquet(ended)
        still = state.where("reason IS NULL")
        if still.isEmpty():
            return spark.read.schema(schema).parquet(ended)
        drawn = lambda use, x: F.md5(F.concat_ws("|", F.lit(f"{seed}|{number}|{use}"), F.col("video_id").cast("string"), x.cast("string")))  # noqa: B023, E731
        mixed = F.array_sort(F.transform("kept", lambda x: F.struct(drawn("list", x).alias("h"), x.alias("x"))))
        candidates = still.select("video_id", F.col("kept").alias("all"), "n", F.posexplode(mixed).alias("place", "y"))
        size = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.lit(fraction) * F.size("all"))))
        candidates = candidates.select("video_id", F.col("y.x").alias("removed"), F.array_remove("all", F.col("y.x")).alias("kept"), "n", (F.col("place") < size).alias("listed"))
        asked = lambda rows: score(rows.drop("listed")).select("video_id", "removed", "ok")
        first = materialize(asked(candidates.where("listed")), "shortlist")
        others = candidates.where("not listed").join(first.where("ok").select("video_id").distinct(), "video_id", "left_anti")
        scored = first.unionByName(asked(others))
        gone = F.min(F.when(F.col("ok"), F.struct(drawn("pick", F.col("removed")).alias("h"), F.col("removed").alias("x"))))["x"].alias("gone")
        step = still.join(scored.groupBy("video_id").agg(gone, F.count("*").alias("more")), "video_id")
        now = step.select(
            "video_id", F.when(F.col("gone").isNull(), F.col("kept")).otherwise(F.array_remove("kept", F.col("gone"))).alias("kept"), "n",
            F.when(F.col("gone").isNull(), F.col("removed")).otherwise(F.array_append("removed", F.col("gone"))).alias("removed"),
            (F.col("calls") + F.col("more")).alias("calls"), F.col("gone").isNotNull().alias("found"),
        )
    raise AssertionError("unreachable")


def score_directly(records: DataFrame, ask: Callable[[DataFrame, int], DataFrame], attempts: int = 3) -> DataFrame:
    """records: video_id, kept (all indices), n, and what the model reads. ask takes them and the number of the attempt, and adds raw_output. Records whose answer can't be read are asked
    about again, `attempts` times in all; the rest keep all segments at one half. Returns video_id, weights, kept, calls, source (parsed, fallback)."""
    spark = records.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    schema = "video_id string, weights array<double>, kept array<int>, calls int, source string"
    left = records.withColumn("video_id", F.col("video_id").cast("string"))
    for attempt in range(1, attempts + 1):
        read = ask(left.withColumn("attempt", F.lit(attempt)), attempt).withColumn("found", direct_scores(F.col("raw_output"), F.col("n")))
        read = materialize(read.select(*left.columns, "found"), "scored")
        read.where("found IS NOT NULL").select("video_id", "found.weights", "found.kept", F.lit(attempt).alias("calls"), F.lit("parsed").alias("source")).write.mode("append").parquet(where)
        left = read.where("found IS NULL").drop("found")
        if left.isEmpty():
            break
    half = F.transform("kept", lambda _: F.lit(0.5))
    left.select("video_id", half.alias("weights"), "kept", F.lit(attempts).alias("calls"), F.lit("fallback").alias("source")).write.mode("append").parquet(where)
    return spark.read.schema(schema).parquet(where)


#: How much less sure an answer may be without the unimportant segments, and what counts as a yes.
MAY_DROP, A_YES = 0.2, 0.5


def sufficiency(labelled: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labelled: video_id, important (indices), n, label, wrong_label, and what the model reads. ask takes subsets (video_id, kept, n, asked_label, ...) and adds `score` and `skip`.
    Whether the important segments suffice (keep_important), whether the others can go (remove_unimportant: score drops by MAY_DROP at most), whether the others alone don't do (keep_unimportant:
    below A_YES, or there are none), and whether a wrong label is refused (wrong_label). Each with its score; a row a video. Tests of one subset and label are one question, with a bit
    in `tests` for each; `calls` counts tests."""
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = labelled.withColumns({"video_id": F.col("video_id").cast("string"), "__places": places}).withColumn("__others", F.array_except("__places", "important"))
    rows = rows.withColumns({"__keep": F.array_sort("important"), "__remove": F.array_except("__places", "__others")})
    tests = {"full": "__places", "keep_important": "__keep", "remove_unimportant": "__remove", "keep_unimportant": "__others", "wrong_label": "__places"}
    names, sets, wrong = list(tests), list(tests.values()), 1 << len(tests) - 1
    there = [F.size("__others") > 0 if name == "keep_unimportant" else F.lit(True) for name in names]
    # a test is asked where no one before has its subset; the wrong label is a question of its own
    alike = lambda j, k: F.coalesce(F.col(sets[j]) == F.col(sets[k]), F.lit(False)) & there[j] & there[k]
    asks = []
    for k, kept in enumerate(sets[:-1]):
        bits = F.lit(1 << k)
        for later in range(k + 1, len(sets) - 1):
            bits = bits + F.when(alike(k, later), 1 << later).otherwise(0)
        asked = there[k]
        for j in range(k):
            asked = asked & ~alike(j, k)
        asks.append(F.when(asked, F.struct(bits.alias("tests"), F.col(kept).alias("kept"), F.col("label").alias("asked_label"))))
    asks.append(F.struct(F.lit(wrong).alias("tests"), F.col("__places").alias("kept"), F.col("wrong_label").alias("asked_label")))
    own = [c for c in labelled.columns if c not in ("important", "label", "wrong_label")]
    questions = rows.withColumn("t", F.explode(F.array(*asks))).where("t IS NOT NULL").select(*own, "t.*")
    keyed = questions.withColumn("video_id", F.when(F.col("tests") == wrong, F.concat("video_id", F.lit("_wrong"))).otherwise(F.col("video_id")))
    given = F.when(F.col("tests") == wrong, F.expr("left(video_id, length(video_id) - 6)")).otherwise(F.col("video_id"))
    asked = ask(keyed).select(given.alias("video_id"), "tests", "score", "skip")
    of = lambda name, c: F.max(F.when(F.col("tests").bitwiseAND(1 << names.index(name)) != 0, F.col(c)))
    by = asked.groupBy("video_id").agg(*[of(name, "score").alias(name) for name in tests], of("keep_important", "skip").alias("skip"), F.sum(F.bit_count("tests")).alias("calls"))
    return by.select(
        "video_id", *tests, ((F.col("keep_important") > A_YES) & ~F.col("skip")).alias("important_suffices"), (F.col("full") - F.col("remove_unimportant") <= MAY_DROP).alias("others_can_go"),
        F.coalesce(F.col("keep_unimportant") < A_YES, F.lit(True)).alias("others_do_not_do"), (F.col("wrong_label") < A_YES).alias("wrong_label_refused"), "calls",
    )
