"""Questions to a model about subsets of a record's segments: batches, one model a task, a written cache, resumption.

A question is a row: video_id, kept (indices, ascending), n (segments) and whatever else the model reads. Its key is (video_id, hash of the mask, template); an
answer that the cache has isn't asked for again, neither in this run nor in a later one. A batch that fails is asked once more; if it fails again its
rows have an error instead of an answer, and are asked again the next time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["video_id", "mask_hash", "template"]
# Field names of answers.
ANSWER = "decision string, confidence double, evidence string, raw_output string, logit_confidence double, logit_p_skip double"
_ANSWERED = f"video_id string, mask_hash string, template string, {ANSWER}, attempts int, error string"
#: Columns of a part of the cache that a model isn't shown.
_OWN = ("left_out", "__place")

Model = Callable[[list[dict]], list[dict]]


@dataclass(frozen=True)
class Oracle:
    """start gives the model, once a task; the model answers a list of questions (as dicts) by as many dicts, of the fields in ANSWER."""

    start: Callable[[], Model]
    template: str = "mss_verification"
    batch: int = 4
    attempts: int = 2


def mask_hash(kept: Column, n: Column) -> Column:
    """16 hex digits of the mask: a 1 for each segment that is left out."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.substring(F.md5(F.array_join(F.transform(places, lambda i: F.when(F.array_contains(kept, i), "0").otherwise("1")), "")), 1, 16)


def _values(column: pa.Array) -> list:
    """A column's values in Python; numbers, texts and lists of numbers without nulls by whole arrays, the rest one by one."""
    kind = column.type
    if pa.types.is_list(kind) and not column.null_count:
        inner, ends = _values(column.flatten()), column.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        return [inner[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    if pa.types.is_string(kind) or (pa.types.is_integer(kind) or pa.types.is_floating(kind)) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _asked(questions: DataFrame, oracle: Oracle) -> DataFrame:
    """Questions in order of their keys, with `__known` where the cache has the answer: all columns, with an answer, attempts, error and `called`. Rows of equal keys are asked about once, in
    batches within the task; `called` marks the one that was."""
    names = [x.split()[0] for x in ANSWER.split(", ")]
    carried = [c for c in questions.columns if c not in (*names, "__known")]

    def answered(model: Model | None, part: list[dict]) -> tuple[Model | None, list[tuple]]:
        error, answers = None, [{}] * len(part)
        for attempt in range(1, oracle.attempts + 1):
            try:
                model = model or oracle.start()
                answers = model(part)
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} questions")
                error = None
                break
            except Exception as raised:  # a model's failure of any kind is the answer's error, after another attempt
                error, answers = f"{type(raised).__name__}: {raised}", [{}] * len(part)
        return model, [(a, attempt, error) for a in answers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, said = None, None, None
        for batch in batches:
            known = _values(batch.column("__known"))
            columns = {c: _values(batch.column(c)) for c in [*asks, *(names if True in known else [])]}
            keys = list(zip(*(columns[k] for k in KEY), strict=True))
            out, new, before = [None] * len(keys), [], last
            for i, key in enumerate(keys):
                if not known[i] and key != before:
                    new.append(i)
                before = key
            fields = [columns[c] for c in asks]
            for at in range(0, len(new), oracle.batch):
                places = new[at : at + oracle.batch]
                model, answers = answered(model, [dict(zip(asks, row, strict=True)) for row in zip(*([v[i] for i in places] for v in fields), strict=True)])
                for i, a in zip(places, answers, strict=True):
                    out[i] = a
            called = [a is not None for a in out]
            for i, key in enumerate(keys):
                if known[i]:
                    out[i] = ({k: columns[k][i] for k in names}, None, None)
                elif out[i] is None:
                    out[i] = said
                last, said = key, out[i]
            found = [[a.get(k) for a, _, _ in out] for k in names] + [[x[1] for x in out], [x[2] for x in out]]
            arrays = [batch.column(c) for c in carried] + [pa.array(v, f.type) for v, f in zip(found, arrow, strict=True)] + [pa.array(called, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *arrow.names, "called"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(f"{ANSWER}, attempts int, error string")
    arrow, asks = to_arrow_schema(added), [c for c in carried if c not in _OWN]
    return questions.mapInArrow(run, StructType([questions.schema[c] for c in carried] + added.fields).add("called", "boolean"))


@dataclass
class Cached:
    """An oracle with its cache, a folder of Parquet files with a part for each time that it was asked. A part has all rows asked about, with `called` for those that the model answered, which
    are what the cache knows. Counts the rows asked about, those that needed no call (hits), calls of the model and failures."""

    oracle: Oracle
    cache: str
    counts: dict[str, int] = field(default_factory=lambda: {"rows": 0, "hits": 0, "calls": 0, "failed": 0})

    def known(self, spark) -> DataFrame | None:
        """The cache's answers with `left_out`, the number of segments left out; None before the first."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.cache)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        parts = spark.read.schema(f"{_ANSWERED}, called boolean, left_out int, asked string").parquet(self.cache)
        return parts.where("coalesce(called, true) AND error IS NULL").drop("asked", "called", "error", "attempts")

    def ask(self, questions: DataFrame, attempt: int = 1) -> DataFrame:
        """The questions with mask_hash, template, the fields of ANSWER and error. Another attempt asks anew what has an answer already. They are read once, and the result is
        what was written of them; only where the cache has parts already, they are read before for how many segments they leave out, since no other answers can be theirs."""
        spark = questions.sparkSession
        template = self.oracle.template if attempt == 1 else f"{self.oracle.template}#{attempt}"
        left_out = F.coalesce(F.col("n") - F.size("kept"), F.lit(-1)).cast("int")
        keyed = questions.withColumns({"mask_hash": mask_hash(F.col("kept"), F.col("n")), "template": F.lit(template), "video_id": F.col("video_id").cast("string"), "left_out": left_out})
        known = self.known(spark)
        if known is None:
            met = keyed.withColumn("__known", F.lit(False)).repartition(*KEY).sortWithinPartitions(*KEY)
        else:
            least, most = questions.agg(F.min(left_out), F.max(left_out)).first()
            own = known.where((F.col("template") == template) & (F.col("left_out").isNull() | F.col("left_out").between(least, most))).drop("left_out").dropDuplicates(KEY).withColumn("__known", F.lit(True))
            met = keyed.join(own, KEY, "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
            met = met.withColumn("__place", F.row_number().over(W.partitionBy(*KEY).orderBy("left_out")))
        seen = Observation()
        part = f"{self.cache.rstrip('/')}/asked={uuid.uuid4().hex}"
        done = _asked(met, self.oracle)
        done.observe(seen, F.count("*").alias("rows"), F.count_if("called").alias("calls"), F.count_if(F.col("called") & F.col("error").isNotNull()).alias("failed")).write.parquet(part)
        rows, calls, failed = (seen.get[k] for k in ("rows", "calls", "failed"))
        for name, more in zip(("rows", "hits", "calls", "failed"), (rows, rows - calls, calls, failed), strict=True):
            self.counts[name] += more
        return spark.read.schema(done.schema).parquet(part).drop("attempts", "called", "left_out", "__place")


def score(most_skip: float = 0.5) -> Column:
    """How sure an answer is that the action is still there: zero if it would rather skip, else the probability of YES, else the stated
    confidence of a YES."""
    stated = F.when(F.col("decision") == "YES", F.coalesce("confidence", F.lit(0.0))).otherwise(0.0)
    return F.when(skipped(most_skip), 0.0).otherwise(F.coalesce("logit_confidence", stated))


def skipped(most_skip: float = 0.5) -> Column:
    """Whether an answer would rather skip: by its tokens, or by its text where they don't say."""
    return F.coalesce(F.col("logit_p_skip") > most_skip, F.col("decision") == "SKIP", F.lit(False))


def yes() -> Column:
    """Whether an answer's decision is YES."""
    return F.coalesce(F.col("decision") == "YES", F.lit(False))
